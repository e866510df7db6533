"""Meter sources (S1-S4) and the submission sink (S5).

* ``load_meter_csv`` reads the challenge CSV layout with a fixed schema (no
  inference pass over 100 TB), sets lines that don't parse apart and numbers
  rows in file order, whatever the splits; ``read_meter_csv`` is its good rows.
* ``meter_view`` derives the same seven-column meter table from the shared
  ``events`` test table, so every check query reads real input whose size
  grows with the scale factor.
* ``write_submission`` writes the sorted four-column predictions file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import config as C
from ..operators.sizing import small_side
from ..session import cut_lineage, written

TRAIN_SCHEMA = T.StructType([
    T.StructField(C.SITE, T.StringType()),
    T.StructField(C.TIME, T.TimestampNTZType()),
    T.StructField(C.TEMP, T.DoubleType()),
    T.StructField(C.RAD, T.DoubleType()),
    T.StructField(C.POWER, T.DoubleType()),
    T.StructField(C.FLAG, T.IntegerType()),
    T.StructField(C.CAP, T.DoubleType()),
])
TEST_SCHEMA = T.StructType(TRAIN_SCHEMA.fields[:5])


BAD_LINE = "_line"


@dataclass
class MeterLoad:
    """What a CSV load found: good rows, rejected lines, counts of both."""
    rows: DataFrame          # the schema's columns and row_id
    rejects: DataFrame       # row_id, file, line
    n_rows: int
    n_rejected: int


def first_existing(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """S3: the first of ``paths`` that exists, as CSV lines with a header."""
    last_error: Exception | None = None
    for p in paths:
        try:
            df = (spark.read.schema(schema)
                  .option("header", True)
                  .option("mode", "PERMISSIVE")
                  .option("columnNameOfCorruptRecord", BAD_LINE)
                  .option("timestampNTZFormat", "yyyy-MM-dd[['T'][ ]HH:mm[:ss[.SSSSSS][.SSS]]]")
                  .csv(p))
            df.schema  # resolves the path now so a missing file falls through
            return df
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            last_error = exc
    raise FileNotFoundError(f"none of {paths} is readable") from last_error


def load_meter_csv(spark: SparkSession, path: str | list[str], labelled: bool = True) -> MeterLoad:
    """S1/S2/S4: header CSV with a declared schema; ``Timestamp_Local`` is
    parsed as TIMESTAMP_NTZ (local wall-clock time, never shifted by the
    session zone). ``path`` may be a list: the first existing one is used
    (S3, path fallback). Dates with or without a time, seconds, fractions or a
    ``T`` are read.

    The text is parsed once, into a table in the shared folder. A line with a
    field that doesn't parse, or with too few or too many fields, becomes a
    reject; it neither fails the load nor leaves NULLs in a row.

    ``row_id`` is the line's position, from 0, in the files in order of their
    names, rejected lines included: lines are numbered inside the piece of a
    file that a task reads, and pieces by the lines before them. So it is the
    same for any size of pieces and any number of tasks."""
    schema = TRAIN_SCHEMA if labelled else TEST_SCHEMA
    paths = [path] if isinstance(path, str) else list(path)
    lines = first_existing(spark, paths, T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())]))
    lines = lines.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                         F.monotonically_increasing_id().alias("_nth"))
    held = written(lines, "meter-lines")
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)   # one row per piece of a file
    counts = held.groupBy("_file", "_block").agg(
        F.min("_nth").alias("_first"), F.count(F.lit(1)).alias("_n"), F.count(BAD_LINE).alias("_bad"))
    pieces = written(counts.select(
        "_file", "_block", "_first", "_n", "_bad", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "meter-pieces")
    numbered = held.join(small_side(pieces.drop("_n", "_bad"), row_bytes=512), ["_file", "_block"]).withColumn(
        C.ROW_ID, F.col("_before") + F.col("_nth") - F.col("_first"))
    good = numbered.where(F.col(BAD_LINE).isNull()).select(*[F.col(f"`{f.name}`") for f in schema], C.ROW_ID)
    bad = numbered.where(F.col(BAD_LINE).isNotNull()).select(C.ROW_ID, F.col("_file").alias("file"), F.col(BAD_LINE).alias("line"))
    # summed here, not observed: a session that has observed can't send a forest model with its training summary to tasks
    found = pieces.agg(F.sum("_n").alias("n"), F.sum("_bad").alias("bad")).first()
    n_bad = found["bad"] or 0
    return MeterLoad(good, bad, (found["n"] or 0) - n_bad, n_bad)


def read_meter_csv(spark: SparkSession, path: str | list[str], labelled: bool = True, most_rejected: float = 0.01) -> DataFrame:
    """Good rows of ``load_meter_csv``. More rejected lines than the share
    ``most_rejected`` mean that the file isn't of this layout: an error."""
    load = load_meter_csv(spark, path, labelled)
    if load.n_rejected > most_rejected * (load.n_rows + load.n_rejected):
        raise ValueError(f"{load.n_rejected} of {load.n_rows + load.n_rejected} lines of {path} don't parse")
    return load.rows


def meter_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meter feed over the shared ``events`` table (13 sites, nulls injected,
    site power means on both sides of the archetype threshold)."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    site_no = F.col("user_id") % 13
    eid = F.col("event_id")
    flag = (F.when(F.col("event_type") == "signup", 1)
            .when(F.col("event_type") == "error", -1).otherwise(0))
    power = F.when(eid % 97 == 0, F.lit(None).cast("double")).otherwise(
        F.col("value") * (1 + site_no % 3))
    return ev.select(
        F.concat(F.lit("Site"), F.expr("chr(65 + user_id % 13)")).alias(C.SITE),
        eid.alias(C.ROW_ID),
        (F.col("ts") + F.make_dt_interval(days=(F.col("user_id") % 12 * 30).cast("int"))).alias(C.TIME),
        F.when(eid % 53 == 0, F.lit(None).cast("double"))
         .otherwise(5 + (eid * 37 % 3000) / F.lit(100.0)).alias(C.TEMP),
        F.when(eid % 71 == 0, F.lit(None).cast("double"))
         .when(F.hour("ts").between(6, 18), (eid * 91 % 1000).cast("double"))
         .otherwise(F.lit(0.0)).alias(C.RAD),
        power.alias(C.POWER),
        flag.cast("int").alias(C.FLAG),
        capacity_label(flag, power).alias(C.CAP),
    )


def capacity_label(flag: Column, power: Column) -> Column:
    """Event-capacity label of the fixture: a quarter of the load, signed by
    the event direction; 0 outside events."""
    return F.when(flag == 0, F.lit(0.0)).otherwise(flag * power * 0.25)


def time_holdout(meter: DataFrame, holdout_days: int = 61) -> tuple[DataFrame, DataFrame]:
    """Split the labelled meter table into a training file and an unlabelled
    test file by time: the last ``holdout_days`` days form the test file. The
    cut point is one scalar aggregate; as a literal it reaches the scan."""
    max_ts = meter.agg(F.max(C.TIME)).first()[0]
    cut = F.lit(max_ts) - F.make_dt_interval(days=F.lit(holdout_days))
    train = meter.where(F.col(C.TIME) < cut)
    test = meter.where(F.col(C.TIME) >= cut).drop(C.FLAG, C.CAP)
    return train, test


SUBMISSION_ORDER = [C.SITE, C.TIME, C.ROW_ID]


def with_position(df: DataFrame, order: list[str]) -> DataFrame:
    """Global position (from 0) of every row in ``order`` without one task for
    all rows: a range-partitioned sort, the row's number in its partition,
    and the rows of the partitions before (a table of one row per partition)."""
    part_rows = (1 << 33) - 1     # monotonically_increasing_id keeps the row number in the low 33 bits
    ordered = cut_lineage(df.orderBy(*order).select(
        "*", F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(part_rows)).alias("_nth")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"))
    return (ordered.join(F.broadcast(offsets), "_part")
            .withColumn("position", F.col("_rows_before") + F.col("_nth")).drop("_part", "_nth", "_rows_before"))


def write_submission(pred: DataFrame, path: str) -> None:
    """S5: four columns sorted by (Site, Timestamp_Local), header CSV.
    The global sort range-partitions the output into ordered part files;
    nothing is coalesced into one task."""
    order = [c for c in SUBMISSION_ORDER if c in pred.columns]
    (pred.orderBy(*order).select(*C.SUBMISSION_COLUMNS)
         .write.mode("overwrite").option("header", True)
         .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
         .csv(path))
