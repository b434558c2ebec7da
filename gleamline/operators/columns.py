"""Operators that rewrite columns.

Fitting functions return a few numbers or names per column; the matching
``apply`` step is one projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleamline.functions import numeric, text
from gleamline.operators import stats
from gleamline.operators.order_stats import (
    interpolate,
    non_null_counts,
    order_statistics,
    quantile_ranks,
    quantiles,
)
from gleamline.types import col, columns_of, is_protected, replace_columns


def normalize_nulls(df: DataFrame, tokens: tuple[str, ...] = text.NULL_TOKENS) -> DataFrame:
    """Null the whole-cell spellings of missing in the text columns."""
    changed = {n: text.null_if_in(col(n), tokens) for n in columns_of(df, "text")}
    return replace_columns(df, changed)


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[col(n) for n in df.columns if n not in names])


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame | None]:
    """Features and target of the rows that have a target; ``NONE`` means no target."""
    if target == "NONE":
        return df, None
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found.")
    kept = df.where(col(target).isNotNull())
    return drop_columns(kept, [target]), kept.select(col(target))


def standardize_text(df: DataFrame, names: list[str]) -> DataFrame:
    """Strip and title-case the listed columns; other types become text.

    A cell that reads ``nan`` in any case is missing afterwards.
    """
    changed = {}
    for n in names:
        if n in df.columns:
            titled = text.title_case(text.strip_text(_as_text(df, n)))
            changed[n] = text.null_if_in(titled, ("Nan",))
    return replace_columns(df, changed)


def _as_text(df: DataFrame, name: str):
    """Text form of a column, as a CSV file would show it."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return F.when(col(name), "True").when(~col(name), "False")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return text.printed(col(name).cast("double"))
    return col(name).cast("string")


def extract_numbers(df: DataFrame, names: list[str]) -> DataFrame:
    """Turn listed, unprotected columns into the numbers in their cells; numbers stay."""
    numbers = set(columns_of(df, "number"))
    changed = {
        n: numeric.extract_number(_as_text(df, n))
        for n in names
        if n in df.columns and n not in numbers and not is_protected(n)
    }
    return replace_columns(df, changed)


def numeric_text_columns(df: DataFrame) -> list[str]:
    """Unprotected text columns of which more than a fifth of all rows hold a number."""
    names = [n for n in columns_of(df, "text") if not is_protected(n)]
    if not names:
        return []
    return [r["column"] for r in stats.numeric_share(df, names).collect() if r["is_numeric"]]


def extract_numbers_auto(df: DataFrame) -> DataFrame:
    return extract_numbers(df, numeric_text_columns(df))


def fill_unknown(df: DataFrame, names: list[str]) -> DataFrame:
    """Null and ``nan`` spellings to ``Unknown``; a numeric column becomes text."""
    changed = {n: text.fill_unknown(_as_text(df, n)) for n in names if n in df.columns}
    return replace_columns(df, changed)


def fill_mean(df: DataFrame, names: list[str]) -> DataFrame:
    """Coerce the listed columns to numbers, then null to the mean."""
    booleans = set(columns_of(df, "bool"))
    names = [n for n in names if n in df.columns and n not in booleans]
    parsed = replace_columns(df, stats.to_numbers(df, names))
    return apply_fill(parsed, stats.means(parsed, names))


def fill_median(df: DataFrame, names: list[str]) -> DataFrame:
    found = quantiles(df, names, [0.5])
    return apply_fill(df, {n: v[0] for n, v in found.items()})


def fill_mode(df: DataFrame, names: list[str]) -> DataFrame:
    return apply_fill(df, {r["column"]: r["value"] for r in stats.modes(df, names).collect()})


def apply_fill(df: DataFrame, values: dict) -> DataFrame:
    """Null to the given value; a number may turn a bigint column into double."""
    changed = {}
    for n, v in values.items():
        if v is None:
            continue
        c = col(n) if isinstance(v, str) else col(n).cast("double")
        changed[n] = F.coalesce(c, F.lit(v))
    return replace_columns(df, changed)


def fill_auto(df: DataFrame) -> DataFrame:
    """Columns with a null: numbers take the median, everything else ``Unknown``."""
    counts, rows = counts_and_rows(df, df.columns)
    lacking = [n for n in df.columns if counts[n] < rows]
    numbers = [n for n in columns_of(df, "number") if n in lacking]
    found = quantiles(df, numbers, [0.5], counts)
    filled = apply_fill(df, {n: v[0] for n, v in found.items()})
    return fill_rest(filled, [n for n in lacking if n not in numbers])


def fill_rest(df: DataFrame, names: list[str]) -> DataFrame:
    changed = {n: F.coalesce(_as_text(df, n), F.lit(text.UNKNOWN)) for n in names}
    return replace_columns(df, changed)


def counts_and_rows(df: DataFrame, names: list[str]) -> tuple[dict[str, int], int]:
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(col(n)).alias(f"n{i}") for i, n in enumerate(names)],
    ).first()
    return dict(zip(names, row[1:])), row[0]


def fit_caps(df: DataFrame, names: list[str], counts: dict[str, int] | None = None) -> dict:
    found = quantiles(df, names, [0.25, 0.75], counts or non_null_counts(df, names))
    return {n: stats.fences(*found[n]) for n in names}


def apply_caps(df: DataFrame, bounds: dict) -> DataFrame:
    return replace_columns(df, {n: numeric.clip(col(n), *b) for n, b in bounds.items()})


def cap_outliers(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Cap every numeric column at its fences; nulls stay null."""
    names = [n for n in columns_of(df, "number") if n not in exclude]
    return apply_caps(df, fit_caps(df, names))


def fit_medians_and_caps(
    df: DataFrame, names: list[str], counts: dict[str, int], rows: int
) -> tuple[dict, dict]:
    """Medians, and the fences the columns have once nulls hold the median.

    Filling puts ``m`` copies of the median ``v`` among the sorted values ``x``,
    so rank ``r`` of the filled column is ``x[r]`` clamped against ``v`` and
    ``x[r - m]``.  Both fits therefore come from the same ranks of the unfilled
    column, in one pass instead of two.
    """
    ranks: dict[str, list[int]] = {}
    for n in names:
        have = counts[n]
        if not have:
            continue
        missing = rows - have
        wanted = [*quantile_ranks(have, 0.5)[:2]] if missing else []
        for p in (0.25, 0.75):
            for r in quantile_ranks(rows, p)[:2]:
                wanted += [k for k in (r, r - missing) if 0 <= k < have]
        ranks[n] = wanted
    found = order_statistics(df, ranks, counts)

    medians, bounds = {}, {}
    for n in names:
        have = counts[n]
        if not have:
            bounds[n] = (None, None)
            continue
        missing, x = rows - have, found[n]
        if missing:
            low, high, share = quantile_ranks(have, 0.5)
            medians[n] = interpolate(x[low], x[high], share)

        def filled(r: int) -> float:
            if not missing:
                return x[r]
            upper = max(medians[n], x[r - missing]) if r >= missing else medians[n]
            return min(x[r], upper) if r < have else upper

        quarter = []
        for p in (0.25, 0.75):
            low, high, share = quantile_ranks(rows, p)
            quarter.append(interpolate(filled(low), filled(high), share))
        bounds[n] = stats.fences(*quarter)
    return medians, bounds


def round_floats(df: DataFrame) -> DataFrame:
    return replace_columns(df, {n: numeric.round2(col(n)) for n in double_columns(df)})


def double_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def whole_columns(df: DataFrame) -> list[str]:
    """Double columns without nulls whose every value is whole; an empty table passes."""
    names = double_columns(df)
    if not names:
        return []
    checks = [F.coalesce(F.every(numeric.is_whole(col(n))), F.lit(True)) for n in names]
    row = df.agg(*[c.alias(f"w{i}") for i, c in enumerate(checks)]).first()
    return [n for n, whole in zip(names, row) if whole]


def demote_whole_floats(df: DataFrame) -> DataFrame:
    return replace_columns(df, {n: col(n).cast("bigint") for n in whole_columns(df)})
