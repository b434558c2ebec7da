"""The profile of a table."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame

from gleamline.operators import stats
from gleamline.operators.columns import normalize_nulls
from gleamline.operators.rows import preview
from gleamline.types import conform, dtype_name


def dtype_counts(df: DataFrame) -> DataFrame:
    """Number of columns per type name."""
    counted = Counter(dtype_name(f.dataType) for f in df.schema)
    rows = sorted(counted.items(), key=lambda kv: (-kv[1], kv[0]))
    return df.sparkSession.createDataFrame(rows, "dtype string, column_count bigint")


@dataclass
class Profile:
    shape: DataFrame
    missing: DataFrame
    health: DataFrame
    dtypes: DataFrame
    correlation: DataFrame
    preview: DataFrame


def profile(df: DataFrame, preview_rows: int = 5, key: list[str] | None = None) -> Profile:
    """All parts of a profile, each a lazy DataFrame over the normalised table."""
    table = normalize_nulls(conform(df))
    return Profile(
        shape=stats.profile_shape(table),
        missing=stats.missing_counts(table),
        health=stats.table_health(table),
        dtypes=dtype_counts(table),
        correlation=stats.correlation_matrix(table),
        preview=preview(table, preview_rows, key),
    )
