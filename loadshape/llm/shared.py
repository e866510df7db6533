"""Helpers shared by the operators: the shared folder, connected components,
batch bounds and small numpy utilities."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadshape.session import ensure_checkpoint_dir

#: Rows per Arrow batch: whole texts travel in batches, so a batch is kept small.
ROWS_PER_BATCH = 1024


#: Bytes per Arrow batch, beyond which a batch is cut (one long row may exceed it).
BYTES_PER_BATCH = "16MB"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ROWS_PER_BATCH rows and about BYTES_PER_BATCH,
    so that a batch of long texts stays far below a Python worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives
    lost executors, and computes what several readers need once."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it while ``df`` has such a column, so
    that a new column never replaces one of the caller's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed_rows(docs: DataFrame) -> DataFrame:
    """doc_id and text beside the whole row as one struct ``data``: names that
    an operator adds can't clash with the caller's."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("data"))


def unpacked(rows: DataFrame, columns: list[str], changed: dict[str, Column] | None = None) -> DataFrame:
    """The caller's columns out of ``data``, some of them ``changed``."""
    changed = changed or {}
    return rows.select(*[changed.get(c, F.col("data")[c]).alias(c) for c in columns])


def all_rows(frames: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    """One frame of all (None if there are none), for bounded samples only."""
    found = [f for f in frames if len(f)]
    return pd.concat(found, ignore_index=True) if found else None


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable node number per node for edges (a, b) of 0..n-1:
    minimum labels spread over edges with pointer jumping."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) between any int64 ids reduced to one star per component:
    at most one edge per node, whatever the number of edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = local_components(at[: len(a)], at[len(a):], len(nodes))
    leaf = label != np.arange(len(nodes))
    return nodes[leaf], nodes[label[leaf]]


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of an edge table (a long, b long) as
    (node, root), root = smallest node id, for every node that has an edge and
    isn't a root itself.

    Alternating large-star and small-star steps: each is a map-side combined
    minimum per node and a join back, edges never grow in number, and hubs are
    split by the skew join. Every step is written to the shared folder; only
    two totals come to the driver.
    """
    spark = edges.sparkSession
    pair = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    pair = write_shared(pair, f"{name}-edges")

    def totals(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    before = totals(pair)
    while before[0]:
        low = write_shared(pair.groupBy("lo").agg(F.min("lo")).select(F.col("lo").alias("node"), F.col("lo").alias("m0"))
                           .join(pair.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m1")), "node", "left")
                           .select("node", F.least("m0", "m1").alias("m")), f"{name}-low")
        large = write_shared(
            pair.join(low, pair.lo == low.node).select("hi", F.col("m").alias("lo")).distinct(), f"{name}-large")
        least = write_shared(large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m")), f"{name}-least")
        small = (
            large.join(least, large.hi == least.node)
            .select(F.explode(F.array(F.struct(F.col("hi").alias("x"), "m"), F.struct(F.col("lo").alias("x"), "m"))).alias("e"))
            .where("e.x <> e.m")
            .select(F.greatest("e.x", "e.m").alias("hi"), F.least("e.x", "e.m").alias("lo"))
            .distinct()
        )
        pair = write_shared(small, f"{name}-small")
        after = totals(pair)
        if after == before:
            break
        before = after
    return pair.select(F.col("hi").alias("node"), F.col("lo").alias("root")) if before[0] else spark.createDataFrame(
        [], "node long, root long")


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Cut a stream of frames sorted by ``keys`` so that no group spans two."""
    held: pd.DataFrame | None = None
    for frame in frames:
        if held is not None and len(held):
            frame = pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        last = frame[keys].iloc[-1]
        same = np.ones(len(frame), bool)
        for k in keys:
            same &= frame[k].to_numpy() == last[k]
        # the last group is contiguous at the end
        cut = len(frame) - int(same[::-1].argmin() if not same.all() else len(frame))
        held = frame.iloc[cut:]
        if cut:
            yield frame.iloc[:cut]
    if held is not None and len(held):
        yield held


def with_group_values(rows: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """``rows`` (a written table) with aggregates of their ``key``, nulls
    together. Keys that hold a thousandth of the rows or more, a thousand at
    most, are broadcast, so that a hot key isn't shuffled; the others join."""
    totals = write_shared(
        rows.groupBy(F.col(key).alias("of_key")).agg(F.count(F.lit(1)).alias("of_rows"), *[v.alias(c) for c, v in values.items()]),
        f"{key}-values")
    n = rows.count()
    hot = F.broadcast(totals.where(F.col("of_rows") * 1000 >= n).drop("of_rows"))
    cold = totals.where(F.col("of_rows") * 1000 < n).drop("of_rows")
    same = F.col(key).eqNullSafe(F.col("of_key"))
    of_hot = rows.join(hot, same)
    of_cold = rows.join(hot.select("of_key"), same, "left_anti").join(cold, same)
    return of_hot.unionByName(of_cold).drop("of_key")
