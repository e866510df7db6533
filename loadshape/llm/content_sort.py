"""Exact duplicates by a content sort.

Each text loses its blanks (U+0020, U+0009 to U+000D) and becomes bytes.
Sampled splitters range-partition the rows by those bytes, every partition is
sorted externally, equal contents then stand next to each other, and each row's
whole content is compared with its neighbour's. Of equal contents the row with
the most code points in its original text stays, then the smallest doc_id: it
is the first of its run in sort order.

The splitters see the first ``HEAD_BYTES`` bytes, the digest, the length, the
id and the row's number. So the sample that the driver receives has a bounded
size per row, beginnings that many texts share are cut by the digest, and a
group of copies of any size is cut by ids: a run may span partitions. The first
and last run of a partition are compared, whole, with those of its neighbours in
a join; what the driver joins up are two numbers per partition.

Edge cases: a null text counts as empty, empty texts are equal to each other and
to texts of blanks only; a null doc_id comes after all others and may be the one
that stays; rows that are alike in everything are separate members of which one
stays; very long texts are compared whole; an empty table gives no rows; other
columns, whatever their names, are ignored by ``content_groups`` and unchanged
in ``drop_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadshape.llm.shared import bound_batches, write_shared

BLANKS = "[\\x20\\x09-\\x0D]+"
HEAD_BYTES = 64
#: Bytes of text per partition of the sort.
PARTITION_BYTES = 32 << 20

#: Where a run lies in its partition.
INNER, FIRST, LAST, ONLY = 0, 1, 2, 3


def content_rows(docs: DataFrame, carry: bool) -> DataFrame:
    """Sort keys of every row, and with ``carry`` the row itself."""
    text = F.coalesce(F.col("text"), F.lit(""))
    content = F.regexp_replace(text, BLANKS, "").cast("binary")
    rows = docs.select(
        "doc_id", F.char_length(text).alias("points"), content.alias("content"),
        F.monotonically_increasing_id().alias("row"), *([F.struct(*docs.columns).alias("data")] if carry else []))
    return rows.select("*", F.substring("content", 1, HEAD_BYTES).alias("head"), F.sha2("content", 256).alias("digest"))


def partitions_for(docs: DataFrame, partition_bytes: int) -> int:
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // partition_bytes))


class Runs:
    """Cuts the sorted stream of one partition into runs of equal content."""

    def __init__(self, schema: pa.Schema, passed: list[str]):
        self.schema, self.passed = schema, passed
        self.open: list[pa.RecordBatch] = []  # the rows of the run that isn't ended yet
        self.content: pa.Scalar | None = None
        self.part, self.runs = None, 0

    def feed(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = batch.num_rows
        content = batch.column("content")
        differs = np.ones(n, bool)
        differs[1:] = pc.not_equal(content.slice(1), content.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        if self.open:
            differs[0] = content[0].as_py() != self.content.as_py()
        starts = np.flatnonzero(differs)
        self.part = batch.column("part")[0].as_py()
        rows = batch.select([*self.passed, "digest"])
        if not len(starts):
            self.open.append(rows)
            return
        if starts[0]:
            self.open.append(rows.slice(0, starts[0]))
        if self.open:
            yield from self.close(INNER if self.runs else FIRST)
        # all but the last run that starts here end here too
        ends = np.append(starts[1:], n)
        done = slice(0, len(starts) - 1)
        if not self.runs and len(starts) > 1:  # the partition's first run
            self.open, self.content = [rows.slice(starts[0], ends[0] - starts[0])], content[starts[0]]
            yield from self.close(FIRST)
            done = slice(1, len(starts) - 1)
        if done.stop > done.start:
            begin, sizes = starts[done], (ends - starts)[done]
            whole = rows.slice(begin[0], sizes.sum())
            of = np.repeat(begin - begin[0], sizes)
            self.runs += len(begin)
            yield self.out(whole, whole.column("doc_id").take(pa.array(of)), np.repeat(sizes, sizes),
                           np.arange(len(of)) == of, INNER, None)
        self.open, self.content = [rows.slice(starts[-1])], content[starts[-1]]

    def close(self, where: int) -> Iterator[pa.RecordBatch]:
        """The open run's rows. The first row of a run at the partition's
        border carries the content, for the comparison across the border."""
        self.runs += 1
        size, keep = sum(b.num_rows for b in self.open), self.open[0].column("doc_id").slice(0, 1)
        for k, rows in enumerate(self.open):
            first = np.arange(rows.num_rows) == (0 if k == 0 else -1)
            ids = keep.take(pa.array(np.zeros(rows.num_rows, np.int64)))
            yield self.out(rows, ids, np.full(rows.num_rows, size), first, where, None if k or where == INNER else self.content)
        self.open = []

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.open:
            yield from self.close(LAST if self.runs else ONLY)

    def out(self, rows, keep, sizes, kept, where, content) -> pa.RecordBatch:
        n = rows.num_rows
        held = pa.array([None if content is None else content.as_py(), *[None] * (n - 1)], pa.binary()) if content is not None \
            else pa.nulls(n, pa.binary())
        columns = [rows.column(c) for c in self.passed] + [
            rows.column("digest"), keep, pa.array(sizes, pa.int64()), pa.array(kept), pa.array(np.full(n, self.part), pa.int32()),
            pa.array(np.full(n, where), pa.int32()), held]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def sorted_runs(docs: DataFrame, carry: bool, partition_bytes: int, tasks: int | None) -> DataFrame:
    """Every row with its run inside its partition, written to the shared folder."""
    rows = content_rows(docs, carry)
    least_id = F.col("doc_id").asc_nulls_last()
    keys = ["head", "digest", F.desc("points"), least_id, "row"]
    spread = rows.repartitionByRange(tasks or partitions_for(docs, partition_bytes), *keys)
    ordered = (
        spread.sortWithinPartitions("head", "digest", "content", F.desc("points"), least_id, "row")
        .withColumn("part", F.spark_partition_id()).drop("head", "points", "row"))
    passed = ["doc_id", *(["data"] if carry else [])]
    out = T.StructType([
        *[T.StructField(c, rows.schema[c].dataType) for c in passed], T.StructField("text_sha256", T.StringType()),
        T.StructField("keep_id", rows.schema["doc_id"].dataType), T.StructField("group_size", T.LongType()),
        T.StructField("kept", T.BooleanType()), T.StructField("part", T.IntegerType()),
        T.StructField("border", T.IntegerType()), T.StructField("content", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        runs = Runs(to_arrow_schema(out), passed)
        for batch in batches:
            if batch.num_rows:
                yield from runs.feed(batch)
        yield from runs.end()

    return write_shared(ordered.mapInArrow(cut, out), "content-runs")


def joined_runs(runs: DataFrame) -> list[tuple]:
    """Runs that go on across partitions, as (part, border, keep_id, size,
    whether the part holds the run's first row). At most two per partition."""
    spark = runs.sparkSession
    border = runs.where(F.col("kept") & (F.col("border") != INNER))
    told = border.select("part", "border", "keep_id", "group_size").orderBy("part", "border").collect()
    parts = sorted({r.part for r in told})
    if len(parts) < 2:
        return []
    follows = F.broadcast(spark.createDataFrame(list(zip(parts, parts[1:])), "before int, after int"))
    left = border.where(F.col("border").isin(LAST, ONLY)).select(F.col("part").alias("before"), F.col("content").alias("above"))
    right = border.where(F.col("border").isin(FIRST, ONLY)).select(F.col("part").alias("after"), F.col("content").alias("below"))
    equal = left.join(follows, "before").join(right, "after").where("above = below").select("after")
    goes_on = {r.after for r in equal.collect()}
    chains: list[list] = []
    for r in told:
        if r.border in (FIRST, ONLY) and r.part in goes_on:
            chains[-1].append(r)
        else:
            chains.append([r])
    return [(r.part, r.border, c[0].keep_id, sum(x.group_size for x in c), r is c[0]) for c in chains if len(c) > 1 for r in c]


def content_runs(docs: DataFrame, carry: bool, partition_bytes: int, tasks: int | None) -> DataFrame:
    spark = docs.sparkSession
    bound_batches(spark)
    runs = sorted_runs(docs, carry, partition_bytes, tasks)
    schema = T.StructType([
        T.StructField("of_part", T.IntegerType()), T.StructField("of_border", T.IntegerType()),
        T.StructField("whole_id", runs.schema["keep_id"].dataType), T.StructField("whole_size", T.LongType()),
        T.StructField("has_first", T.BooleanType())])
    whole = F.broadcast(spark.createDataFrame(joined_runs(runs), schema))  # two rows a partition at most
    spans = F.col("of_part").isNotNull()
    return runs.join(whole, (runs.part == whole.of_part) & (runs.border == whole.of_border), "left").select(
        *[c for c in ("doc_id", "data") if c in runs.columns],
        F.when(spans, F.col("whole_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(spans, F.col("whole_size")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("kept") & F.coalesce("has_first", F.lit(True))).alias("kept"), "text_sha256")


def content_groups(docs: DataFrame, partition_bytes: int = PARTITION_BYTES, tasks: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    return content_runs(docs.select("doc_id", "text"), False, partition_bytes, tasks)


def drop_copies(docs: DataFrame, partition_bytes: int = PARTITION_BYTES, tasks: int | None = None) -> DataFrame:
    """``docs`` without the rows whose content another row keeps."""
    return content_runs(docs, True, partition_bytes, tasks).where("kept").select("data.*")


CONTENT_GROUPS_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents),
g AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY content) AS group_size
  FROM t WINDOW w AS (PARTITION BY content ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(content) AS text_sha256 FROM g
"""
