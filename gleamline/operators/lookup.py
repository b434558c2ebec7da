"""Dense numbering of distinct values, and joins against such a table."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleamline.session import stage
from gleamline.types import col

# Largest lookup table sent whole to every executor, in rows and in characters.
BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 32_000_000
SALTS = 16


def dense_index(df: DataFrame, order: list[str], name: str = "slot") -> DataFrame:
    """Number the rows 0, 1, 2, ... in sort order, without a one-task window.

    A range sort lays the rows out in order; each row's number is its place in
    its partition plus the sizes of the partitions before.
    """
    placed = df.sort(*[col(n) for n in order]).select(
        "*",
        F.spark_partition_id().alias("__part"),
        F.monotonically_increasing_id().alias("__place"),
    )
    table = stage(placed)
    # One row per partition of the sort.
    parts = (
        table.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("n"), F.min("__place").alias("first"))
        .orderBy("__part")
        .collect()
    )
    starts = itertools.accumulate([p["n"] for p in parts], initial=0)
    shifts = [(p["__part"], start - p["first"]) for p, start in zip(parts, starts)]
    offsets = df.sparkSession.createDataFrame(shifts, "__part int, __shift bigint")
    return (
        table.join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__place") + F.col("__shift"))
        .drop("__part", "__place", "__shift")
    )


def is_small(table: DataFrame, key: str) -> bool:
    """Whether a lookup table is within the size that may be broadcast."""
    row = table.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.length(col(key).cast("string"))), F.lit(0)).alias("chars"),
    ).first()
    return fits_broadcast(row["n"], row["chars"])


def fits_broadcast(rows: int, chars: int) -> bool:
    return rows <= BROADCAST_ROWS and chars <= BROADCAST_CHARS


def lookup(
    df: DataFrame, value: Column, table: DataFrame, key: str, field: str, name: str, small: bool
) -> DataFrame:
    """Add ``table.field`` of the row whose ``key`` equals ``value``; null when there is none.

    ``table`` has one row per key.  When it is too large to broadcast, both
    sides are salted, so that a value held by much of ``df`` is spread over
    several tasks.
    """
    right = table.select(col(key).alias("__key"), col(field).alias(name))
    left = df.withColumn("__value", value)
    if small:
        joined = left.join(F.broadcast(right), F.col("__value") == F.col("__key"), "left")
        return joined.drop("__value", "__key")
    salt = F.pmod(F.xxhash64(*[col(n) for n in df.columns]), F.lit(SALTS)).cast("int")
    left = left.withColumn("__salt", salt)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    right = right.withColumn("__copy", salts)
    on = (F.col("__value") == F.col("__key")) & (F.col("__salt") == F.col("__copy"))
    return left.join(right, on, "left").drop("__value", "__key", "__salt", "__copy")
