"""SparkSession helpers: one place for local defaults and the shared
checkpoint folder.

On a cluster the session is created by the platform: we only *read*
``spark.checkpoint.dir``. A private folder is set only when the setting is
missing (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "loadshape") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LOADSHAPE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a private one only when
    the session names none (local runs and tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="loadshape-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives lost
    executors, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder. Unlike a checkpoint it has a
    known size, so Spark plans no runtime filter that rescans the other side."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, steps: list[Callable], at_once: int) -> list:
    """Results of independent steps, in order. Up to ``at_once`` of them run at
    a time, so the Spark jobs of one use the cores that another's leave idle."""
    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
        try:
            return [r.result() for r in running]
        except BaseException:
            for r in running:
                r.cancel()
            raise


def only_compiled_methods(spark: SparkSession) -> None:
    """The JVM never compiles a method of over 8,000 bytes; a projection of some
    dozens of columns in one generated method is longer and runs interpreted.
    Above this limit Spark plans it in parts instead. Results are the same."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def storage_bytes(spark: SparkSession) -> int:
    """Bytes that the executors of now have for cached rows, all together (in
    local mode the driver's own)."""
    sc = spark.sparkContext
    found, each = {}, sc._jsc.sc().getExecutorMemoryStatus().iterator()
    while each.hasNext():
        one = each.next()
        found[one._1()] = one._2()._1()
    if len(found) > 1:
        found.pop(sc._jvm.org.apache.spark.SparkEnv.get().blockManager().blockManagerId().hostPort(), None)
    return sum(found.values())
