"""A cleaning strategy read off the data, and one read from JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleamline.functions.numeric import extract_number
from gleamline.operators import stats
from gleamline.operators.order_stats import quantiles
from gleamline.operators.stats import NUMERIC_SHARE, fences
from gleamline.types import STRATEGY_SCHEMA, Strategy, col, columns_of, is_protected


def mixed_case_columns(df: DataFrame) -> list[str]:
    """Text columns where two spellings differ only in case or outer blanks.

    Grouping by the folded spelling and comparing the smallest and largest
    original finds them without a distinct count per column.  Digests keep the
    shuffled rows short however long the cells are.
    """
    names = columns_of(df, "text")
    if not names:
        return []
    cells = stats.unpivot(df, names).where(F.col("value").isNotNull())
    spelling = F.md5(F.col("value").cast("binary"))
    folded = F.md5(F.lower(F.trim("value")).cast("binary"))
    mixed = (
        cells.select("column", folded.alias("folded"), spelling.alias("spelling"))
        .groupBy("column", "folded")
        .agg(F.min("spelling").alias("a"), F.max("spelling").alias("b"))
        .where("a <> b")
        .select("column")
        .distinct()
    )
    found = {r["column"] for r in mixed.collect()}
    return [n for n in names if n in found]


def suggest_strategy(df: DataFrame) -> Strategy:
    """Mixed-case text, text and numbers with nulls, numbers beyond their fences, text with units."""
    texts, numbers = columns_of(df, "text"), columns_of(df, "number")
    unprotected = [n for n in texts if not is_protected(n)]
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(col(n)).alias(f"n{i}") for i, n in enumerate(df.columns)],
        *[F.count(extract_number(col(n))).alias(f"x{i}") for i, n in enumerate(unprotected)],
        *[F.min(col(n).cast("double")).alias(f"a{i}") for i, n in enumerate(numbers)],
        *[F.max(col(n).cast("double")).alias(f"b{i}") for i, n in enumerate(numbers)],
    ).first()
    rows = row["rows"]
    counts = {n: row[f"n{i}"] for i, n in enumerate(df.columns)}
    found = quantiles(df, numbers, [0.25, 0.75], counts)
    outlying = []
    for i, n in enumerate(numbers):
        low, high = fences(*found[n])
        if (low is not None and row[f"a{i}"] < low) or (high is not None and row[f"b{i}"] > high):
            outlying.append(n)
    parsed = {n: row[f"x{i}"] for i, n in enumerate(unprotected)}
    # A text column about to become numbers is filled as numbers are.
    units = [n for n in unprotected if parsed[n] > NUMERIC_SHARE * rows]
    stays = [n for n in texts if n not in units]
    lacking = [n for n in units if parsed[n] < rows] + [n for n in numbers if counts[n] < rows]
    return Strategy(
        standardize_text=mixed_case_columns(df.select(*[col(n) for n in stays])),
        extract_numbers=units,
        fill_unknown=[n for n in stays if counts[n] < rows],
        fill_mean=lacking,
        remove_outliers=outlying,
        drop_duplicates=True,
    )


def strategy_table(df: DataFrame) -> DataFrame:
    """The suggested strategy as ``(rule, column)`` rows."""
    s = suggest_strategy(df)
    rules = ("standardize_text", "extract_numbers", "fill_unknown", "fill_mean", "remove_outliers")
    pairs = [(rule, n) for rule in rules for n in getattr(s, rule)]
    return df.sparkSession.createDataFrame(pairs, "rule string, column string")


def _span(c: Column) -> Column:
    """From the first ``{`` to the last ``}``."""
    start = F.locate("{", c)
    return F.substr(c, start, F.length(c) - F.locate("}", F.reverse(c)) - start + 2)


def parse_strategy(c: Column) -> Column:
    """A strategy from free text: the span from the first ``{`` to the last ``}``."""
    return F.from_json(_span(c), STRATEGY_SCHEMA)


USABLE, EMPTY, UNPARSABLE = "usable", "empty", "unparsable"


def strategy_outcome(c: Column) -> Column:
    """Whether free text holds a strategy: an object with a key, one without, or none that parses (a null text too)."""
    found = F.from_json(F.when(c.contains("{") & c.contains("}"), _span(c)), "map<string,string>")
    return F.when(found.isNull(), UNPARSABLE).when(F.size(found) == 0, EMPTY).otherwise(USABLE)


def choose_strategy(df: DataFrame, given: Strategy | dict | str | None) -> tuple[Strategy | None, str]:
    """The strategy a run follows, none if it isn't usable, and the outcome.

    ``given`` is a strategy, a reply's text that should hold one, or nothing, for which one is suggested.
    """
    if given is None:
        return suggest_strategy(df), USABLE
    if isinstance(given, str):
        text = F.lit(given)
        row = df.sparkSession.range(1).select(strategy_outcome(text).alias("outcome"), parse_strategy(text).alias("found")).first()
        given = row["found"].asDict() if row["outcome"] == USABLE and row["found"] else {}
        return (Strategy.of(given) if row["outcome"] == USABLE else None), row["outcome"]
    return (Strategy.of(given), USABLE) if given else (None, EMPTY)
