"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its ``PREFIX`` nearest of ``PIVOTS`` reference points,
in order. Inverted lists per (label, dimension, pivot) hold the vectors that
have the pivot in their prefix; two vectors that share ``SHARED`` pivots or more
are candidates and are verified by cosine in double precision. Every vector is
indexed; only the reference points are fitted, per dimension on at most
``SAMPLE_ROWS`` of its vectors, as mutually distant ones (farthest-first), so
that a crowded spot doesn't use them up.

Equal vectors are one node with a count. A list above ``block_rows`` is split
into pairs of blocks that different tasks compare, so no list is too long and
none is capped. A pair is compared in the list of the least pivot that both
share, hence counted once. Tasks return link counts and one star of edges per
component, never pairs.

Edge cases: vectors that are null, empty, all zero or hold null or non-finite
components, and rows with null labels, link with nothing (component = own id);
vectors of different dimension never link; equal rows each count as a vector;
a null vec_id takes part but never names a component; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadshape.llm.shared import bound_batches, components, local_components, whole_groups, write_shared

THRESHOLD = 0.93
PIVOTS = 128
PREFIX = 12
SHARED = 4
SAMPLE_ROWS = 4096
BLOCK_ROWS = 1024
#: Reference points of all dimensions together, held by the driver and each worker.
POINT_BYTES = 64 << 20


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def distant_points(vectors: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice of up to ``count`` rows of unit vectors."""
    picked, nearest = [0], vectors @ vectors[0]
    while len(picked) < min(count, len(vectors)):
        nxt = int(nearest.argmin())
        if nearest[nxt] > 1 - 1e-9:
            break
        picked.append(nxt)
        nearest = np.maximum(nearest, vectors @ vectors[nxt])
    return vectors[picked]


def fit_pivots(nodes: DataFrame, pivots: int = PIVOTS, rows: int = SAMPLE_ROWS,
               point_bytes: int = POINT_BYTES) -> dict[int, np.ndarray]:
    """Reference points per dimension: each dimension's are chosen in one task
    from the dimension's own sample of at most ``rows`` vectors, the least by
    hash. At most ``pivots`` vectors a dimension return, and ``point_bytes`` in
    all; dimensions beyond that, the rarest, have none."""
    sizes = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim")
    held, share = 0, []
    for r in sizes.toLocalIterator():  # at most one row per length of a vector
        held += 8 * r.dim * min(r.n, pivots)
        if held > point_bytes:
            break
        share.append((r.dim, min(1.0, 1.25 * rows / r.n) if r.n > rows else 1.0))
    if not share:
        return {}

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["dim"]):
            for dim, part in frame.groupby("dim"):
                part = part.sort_values(["at", "node"]).head(rows).sort_values("node")
                points = distant_points(unit(np.stack(part["embedding"].to_list())), pivots)
                yield pd.DataFrame({"dim": [dim], "points": [points.astype(np.float64).tobytes()]})

    # a share of the hashes a quarter too large has the least ``rows`` in it, and bounds what a task receives
    limits = F.broadcast(nodes.sparkSession.createDataFrame(share, "of_dim int, share double"))
    sample = (
        nodes.withColumn("at", F.xxhash64("label", "embedding"))
        .join(limits, F.col("dim") == F.col("of_dim"))
        .where(F.col("at") / F.lit(2.0 ** 64) + 0.5 <= F.col("share"))
        .select("dim", "at", "node", "embedding").repartition("dim").sortWithinPartitions("dim"))
    return {r.dim: np.frombuffer(r.points, np.float64).reshape(-1, r.dim)
            for r in sample.mapInPandas(choose, "dim int, points binary").toLocalIterator()}


def prefix_words(prefixes: np.ndarray, words: int) -> np.ndarray:
    """Bit sets (rows x words of 64 bits) of pivot prefixes; -1 is no pivot."""
    out = np.zeros((len(prefixes), words), np.uint64)
    for column in prefixes.T:
        rows = np.flatnonzero(column >= 0)
        out[rows, column[rows] // 64] |= np.uint64(1) << (column[rows] % 64).astype(np.uint64)
    return out


def candidates(left: np.ndarray, right: np.ndarray, pivot: int, shared: int) -> np.ndarray:
    """Matrix of pairs that share ``shared`` pivots or more, ``pivot`` being
    the least of them."""
    count = np.zeros((len(left), len(right)), np.uint8)
    lower = np.zeros((len(left), len(right)), bool)
    for w in range(left.shape[1]):
        both = left[:, None, w] & right[None, :, w]
        count += np.bitwise_count(both)
        if w < pivot // 64:
            lower |= both > 0
        elif w == pivot // 64:
            lower |= (both & np.uint64((1 << (pivot % 64)) - 1)) > 0
    return (count >= shared) & ~lower


def valid_vectors(vectors: DataFrame) -> DataFrame:
    good = (
        F.col("label").isNotNull()
        & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)))
    return vectors.withColumn("good", good)


def index_nodes(nodes: DataFrame, points: dict[int, np.ndarray], prefix: int) -> DataFrame:
    """``nodes`` with ``pivots``, their nearest reference points in order. A
    dimension without points is one list, in which all pairs are candidates."""

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = np.empty(len(frame), object)
            for dim, part in frame.reset_index(drop=True).groupby("dim"):
                if dim not in points:
                    for i in part.index:
                        out[i] = np.zeros(1, np.int32)
                    continue
                close = unit(np.stack(part["embedding"].to_list())) @ points[dim].T
                order = np.argsort(-close, axis=1, kind="stable")[:, :prefix].astype(np.int32)
                for i, row in zip(part.index, order):
                    out[i] = row
            yield frame.assign(pivots=out)

    return nodes.mapInPandas(nearest, T.StructType([*nodes.schema.fields, T.StructField("pivots", T.ArrayType(T.IntegerType()))]))


def group_links(frame: pd.DataFrame, shared: int, threshold: float) -> pd.DataFrame | None:
    """Links inside one list block or between two: per node its count of
    linked vectors, and its root among this group's nodes."""
    same = frame["b0"].iat[0] == frame["b1"].iat[0]
    vectors = unit(np.stack(frame["embedding"].to_list()))
    width = max(map(len, frame["pivots"]))
    prefixes = np.full((len(frame), width), -1, np.int64)
    for i, p in enumerate(frame["pivots"]):
        prefixes[i, : len(p)] = p
    pivot = int(frame["pivot"].iat[0])
    words = prefix_words(prefixes, max(int(prefixes.max()) // 64, pivot // 64) + 1)
    side = frame["side"].to_numpy()
    left = np.arange(len(frame)) if same else np.flatnonzero(side == frame["b0"].iat[0])
    right = left if same else np.flatnonzero(side == frame["b1"].iat[0])
    i, j = np.nonzero(candidates(words[left], words[right], pivot, min(shared, width)))
    i, j = left[i], right[j]
    if same:
        i, j = i[i < j], j[i < j]
    a, b = [], []
    for at in range(0, len(i), 1 << 17):
        x, y = i[at: at + (1 << 17)], j[at: at + (1 << 17)]
        near = np.einsum("ij,ij->i", vectors[x], vectors[y]) >= threshold
        a.append(x[near])
        b.append(y[near])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    if not len(a):
        return None
    times = frame["times"].to_numpy()
    links = np.bincount(a, weights=times[b], minlength=len(frame)) + np.bincount(b, weights=times[a], minlength=len(frame))
    node = frame["node"].to_numpy()
    root = node[local_components(a, b, len(frame))]
    on = links > 0
    return pd.DataFrame({"node": node[on], "links": links[on].astype(np.int64), "root": root[on]})


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, pivots: int = PIVOTS, prefix: int = PREFIX,
                 shared: int = SHARED, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS,
                 point_bytes: int = POINT_BYTES) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = valid_vectors(vectors.select("vec_id", "label", "embedding"))
    good = rows.where("good")
    distinct = good.groupBy("label", "embedding").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"))
    nodes = write_shared(
        distinct.withColumn("dim", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()), "pivot-nodes")
    points = fit_pivots(nodes, pivots, sample_rows, point_bytes)
    indexed = write_shared(index_nodes(nodes.select("node", "label", "dim", "embedding", "times"), points, prefix),
                           "pivot-index")
    sizes = write_shared(
        indexed.select("label", "dim", F.explode("pivots").alias("pivot")).groupBy("label", "dim", "pivot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.col("label").alias("of_label"), F.col("dim").alias("of_dim"), F.col("pivot").alias("of_pivot"),
                F.ceil(F.col("n") / F.lit(block_rows)).alias("blocks")), "pivot-lists")
    posted = indexed.select("*", F.explode("pivots").alias("pivot"))
    parted = (
        posted.join(sizes, (posted.label == sizes.of_label) & (posted.dim == sizes.of_dim) & (posted.pivot == sizes.of_pivot))
        .withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("label", "dim", "pivot", F.least("side", "other").alias("b0"), F.greatest("side", "other").alias("b1"),
                "side", "node", "times", "embedding", "pivots")
    )
    keys = ["label", "dim", "pivot", "b0", "b1"]

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, keys):
            for _, part in frame.groupby(keys, sort=False):
                found = group_links(part.reset_index(drop=True), shared, threshold)
                if found is not None:
                    yield found

    found = write_shared(
        parted.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(verify, "node long, links long, root long"),
        "pivot-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "pivot")
    named = (
        nodes.select("node", "label", "embedding", "least", "times").join(rooted, "node", "left").join(counts, "node", "left")
        .withColumn("root", F.coalesce("root", "node")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("times") - 1)
    )
    named = write_shared(named, "pivot-named")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    member = write_shared(
        named.join(names, "root").select(F.col("label").alias("of_label"), F.col("embedding").alias("of_embedding"),
                                         "links", "component_id"), "pivot-members")
    out = good.join(member, (good.label == member.of_label) & (good.embedding == member.of_embedding), "left")
    linked = out.select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
