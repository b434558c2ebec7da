"""Intermediate tables in the folder the cluster shares."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting for deleting a query's shuffle files when the query ends, not when the driver's memory is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_roots: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster an
    executor could not read what another machine wrote there.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            base = tempfile.mkdtemp(prefix="gleamline-")
        _roots[app] = f"{base.rstrip('/')}/gleamline-{app}-{uuid.uuid4().hex[:8]}"
        path, fs = _filesystem(spark, _roots[app])
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return _roots[app]


@contextmanager
def _written(spark: SparkSession) -> Iterator[None]:
    """A block whose writes leave no shuffle files: what is written is read back, and never computed again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where several jobs read the same shuffled result.  A written table
    cuts the lineage, survives lost executors, and lets each later job read
    only the columns it needs.  Its shuffle files go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{uuid.uuid4().hex}"
    with _written(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, key: str, rows_per_task: int = 2000) -> DataFrame:
    """``df``, a staged table of ``rows`` rows, for work that costs far more than reading it.

    A table of a few megabytes is one file and one task, however long that takes: it is written again in more files.
    """
    tasks = min(math.ceil(rows / rows_per_task), 4 * df.sparkSession.sparkContext.defaultParallelism)
    return stage(df.repartition(tasks, key)) if tasks > df.rdd.getNumPartitions() else df


@contextmanager
def scratch(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` staged for a block and deleted after it.

    For wide tables that end in a smaller staged one: nothing lazy that reads it may leave the block.
    """
    spark = df.sparkSession
    location = f"{staging_root(spark)}/{uuid.uuid4().hex}"
    try:
        with _written(spark):
            df.write.option("compression", "zstd").parquet(location)
        yield spark.read.schema(df.schema).parquet(location)
    finally:
        path, fs = _filesystem(spark, location)
        fs.delete(path, True)


def clear_staging(spark: SparkSession) -> None:
    """Delete this application's staged tables; results built on them become unreadable."""
    root = _roots.pop(spark.sparkContext.applicationId, None)
    if root:
        path, fs = _filesystem(spark, root)
        fs.delete(path, True)


def _filesystem(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())
