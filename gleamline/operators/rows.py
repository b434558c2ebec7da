"""Operators that choose rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleamline.operators.order_stats import quantiles
from gleamline.operators.stats import fences
from gleamline.types import col, columns_of


def drop_sparse_rows(df: DataFrame, max_missing: int = 2) -> DataFrame:
    """Keep rows with at most ``max_missing`` null cells."""
    needed = len(df.columns) - max_missing
    return df.na.drop(thresh=needed) if needed > 0 else df


def drop_missing(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(col(target).isNotNull())


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Distinct whole rows; nulls equal each other.

    Copies are folded in each task before the shuffle, so a row repeated across
    the table costs one row per task.
    """
    return df.dropDuplicates()


def outlier_fences(df: DataFrame, name: str) -> tuple[float | None, float | None]:
    return fences(*quantiles(df, [name], [0.25, 0.75])[name])


def within(df: DataFrame, name: str, low: float | None, high: float | None) -> DataFrame:
    """Drop rows outside the fences; null cells are kept."""
    outside = F.lit(False)
    if low is not None:
        outside = outside | (col(name) < F.lit(low))
    if high is not None:
        outside = outside | (col(name) > F.lit(high))
    return df.where(~F.coalesce(outside, F.lit(False)))


def remove_outliers(df: DataFrame, names: list[str]) -> DataFrame:
    """Interquartile filter, column after column.

    Each column's quartiles are those of the rows the previous columns left.
    The fitted fences are literals, so the chain stays one filter over the input.
    """
    numeric = set(columns_of(df, "number"))
    for n in names:
        if n in numeric:
            df = within(df, n, *outlier_fences(df, n))
    return df


def preview(df: DataFrame, n: int = 5, key: list[str] | None = None) -> DataFrame:
    """First ``n`` rows, by ``key`` when the table has one."""
    if key:
        df = df.orderBy(*[col(k) for k in key])
    return df.limit(n)
