"""Whole-table statistics, one aggregate job for all columns where possible."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleamline.functions.numeric import extract_number, to_number
from gleamline.operators.order_stats import quantiles
from gleamline.types import col, columns_of, is_protected, quote

# Aggregate expressions per correlation job; wider tables take several jobs,
# each reading only the columns of its block.
CORRELATION_BLOCK = 24
NUMERIC_SHARE = 0.2


def unpivot(df: DataFrame, names: list[str], cast: str = "string") -> DataFrame:
    """Long form ``(column, value)`` of the given columns."""
    pairs = ", ".join(
        f"'{_sql_text(n)}', CAST({quote(n)} AS {cast})" for n in names
    )
    return df.select(F.expr(f"stack({len(names)}, {pairs}) AS (column, value)"))


def _sql_text(name: str) -> str:
    return name.replace("\\", "\\\\").replace("'", "\\'")


def long_form(df: DataFrame, names: list[str], aggregates: dict[str, list[Column]]) -> DataFrame:
    """One aggregate over the table, laid out with a row per column name.

    ``aggregates`` maps an output field to one expression per column.
    """
    flat = [
        a.alias(f"{k}_{i}") for k, exprs in aggregates.items() for i, a in enumerate(exprs)
    ]
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("column"), *[F.col(f"{k}_{i}").alias(k) for k in aggregates])
            for i, n in enumerate(names)
        ]
    )
    return df.agg(*flat).select(F.inline(cells))


def profile_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count")
    )


def missing_counts(df: DataFrame) -> DataFrame:
    return long_form(
        df, df.columns, {"missing": [F.count_if(col(n).isNull()) for n in df.columns]}
    )


def table_health(df: DataFrame) -> DataFrame:
    missing = F.lit(0).cast("bigint")
    for n in df.columns:
        missing = missing + F.count_if(col(n).isNull())
    status = F.when(F.col("issues") == 0, "Clean Data").otherwise("Needs Cleaning")
    return df.agg(missing.alias("issues")).select("issues", status.alias("status"))


def pearson(a: Column, b: Column) -> Column:
    """Correlation over the rows where both are present; null on a constant.

    ``corr`` raises on a constant column under ANSI rules.
    """
    return F.try_divide(F.regr_sxy(a, b), F.sqrt(F.regr_sxx(a, b) * F.regr_syy(a, b)))


def correlation_matrix(df: DataFrame) -> DataFrame:
    """Every ordered pair of numeric columns as ``(col_x, col_y, r)``.

    Pairs are computed once, in blocks of columns, and mirrored.  A table with
    fewer than two numeric columns gives no rows.
    """
    names = columns_of(df, "number")
    empty = df.sparkSession.createDataFrame([], "col_x string, col_y string, r double")
    if len(names) < 2:
        return empty
    blocks = [names[i : i + CORRELATION_BLOCK] for i in range(0, len(names), CORRELATION_BLOCK)]
    parts = []
    for i, left in enumerate(blocks):
        for right in blocks[i:]:
            pairs = [
                (a, b) for x, a in enumerate(left) for b in (left[x:] if left is right else right)
            ]
            parts.append(_correlate(df, pairs))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def _correlate(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    double = {n: col(n).cast("double") for pair in pairs for n in pair}
    # The diagonal is 1, or null on a constant or single-valued column.
    aggregates = [
        (F.when(F.min(double[a]) < F.max(double[a]), 1.0) if a == b else pearson(double[a], double[b]))
        .alias(f"r{i}")
        for i, (a, b) in enumerate(pairs)
    ]
    cells = [
        F.struct(F.lit(x).alias("col_x"), F.lit(y).alias("col_y"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
        for x, y in ([(a, b)] if a == b else [(a, b), (b, a)])
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*cells)))


def means(df: DataFrame, names: list[str]) -> dict[str, float | None]:
    if not names:
        return {}
    row = df.agg(*[F.avg(col(n)).alias(f"m{i}") for i, n in enumerate(names)]).first()
    return {n: None if v is None or math.isnan(v) else float(v) for n, v in zip(names, row)}


def quartiles(df: DataFrame) -> DataFrame:
    """Q1, median and Q3 of every numeric column."""
    names = columns_of(df, "number")
    found = quantiles(df, names, [0.25, 0.5, 0.75])
    return df.sparkSession.createDataFrame(
        [(n, *found[n]) for n in names], "column string, q1 double, median double, q3 double"
    )


def fences(q1: float | None, q3: float | None) -> tuple[float | None, float | None]:
    """Bounds 1.5 interquartile ranges outside the quartiles; None where undefined."""
    if q1 is None or q3 is None:
        return None, None
    reach = 1.5 * (q3 - q1)
    low, high = q1 - reach, q3 + reach
    return (None if math.isnan(low) else low), (None if math.isnan(high) else high)


def numeric_share(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Per unprotected text column, how many cells hold a number once cleaned of other signs.

    The share is of all rows, nulls included.
    """
    if names is None:
        names = [n for n in columns_of(df, "text") if not is_protected(n)]
    parsed = long_form(
        df,
        names,
        {
            "parsed": [F.count(extract_number(col(n))) for n in names],
            "row_count": [F.count(F.lit(1)) for _ in names],
        },
    )
    over = F.col("parsed") > NUMERIC_SHARE * F.col("row_count")
    return parsed.select("column", "parsed", "row_count", over.alias("is_numeric"))


def modes(df: DataFrame, names: list[str]) -> DataFrame:
    """Most frequent value per text column, smallest on ties; all-null columns give no row.

    Cells are counted per distinct value first, so a value that fills the table
    reaches the shuffle as one row per task.
    """
    counted = (
        unpivot(df, names)
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value")
    )


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg((col(label) == col(prediction)).cast("double")).alias("accuracy"))


def r2(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``1 - SS_res / SS_tot``; null when the label is constant."""
    residual = F.sum((col(label) - col(prediction)) ** 2)
    total = F.regr_sxx(col(label), col(label))
    return df.agg(
        residual.alias("res"), total.alias("tot"), F.count(F.lit(1)).alias("n")
    ).select((1 - F.try_divide(F.col("res"), F.col("tot"))).alias("r2"))


def to_numbers(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """Coercions for the listed columns: text is parsed, numbers stay."""
    text = set(columns_of(df, "text"))
    return {n: to_number(col(n)) for n in names if n in text}
