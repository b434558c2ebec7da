"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleamline.session import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name with underscores in front until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def run_count(spark: SparkSession) -> int:
    """How many runs a key's rows are split into: a power of two, at least the shuffle partitions."""
    return 1 << max(3, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def run_of(id_col: Column, runs: int) -> Column:
    """The run of a row: a hash of its identifier, so that a repeated task gives it the same one."""
    return F.pmod(F.xxhash64(id_col), F.lit(runs)).cast("int")


def by_run(rows: DataFrame, keys: list[str], partial: list[Column], total: list[Column]) -> DataFrame:
    """Totals of ``keys``, given once per run and key.

    ``rows`` has a column ``run``; ``partial`` aggregates them by run and key, ``total`` the
    partial rows by key.  A key held by a third of all rows has at most as many partial rows as
    there are runs, and the result joins back on (run, key), which is as even as the runs.
    """
    leaf = stage(rows.groupBy("run", *keys).agg(*partial))
    return leaf.select("run", *keys).join(leaf.groupBy(*keys).agg(*total), keys)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short batches, so that a task holds few Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bounded(batches: Iterable[pa.RecordBatch], text: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches whose texts, in column number ``text``, have about ``size`` bytes, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        total = np.cumsum(np.asarray(lengths, dtype=np.int64)) if batch.num_rows else np.zeros(0, np.int64)
        at = 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + size, "right")))
            yield batch.slice(at, to - at)
            at = to
