"""CSV scan with type inference, and the CSV sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleamline.functions.numeric import INTEGER_PATTERN, to_number
from gleamline.functions.text import DEFAULT_NULLS, NULL_TOKENS
from gleamline.operators.columns import normalize_nulls
from gleamline.operators.stats import unpivot
from gleamline.sources.records import read_records
from gleamline.types import col, columns_of, replace_columns

SURPLUS = "__surplus__"


def read_table(
    spark: SparkSession, path: str, multi_line: bool | None = None, infer: str = "strict"
) -> DataFrame:
    """Scan CSV with a header row and infer each column's type.

    Cells may hold line breaks, and files are still split between tasks (``sources/records.py``); the parsed cells are
    written once, which inference and later steps read column by column.  ``multi_line=False`` promises that no cell
    does, and scans the files themselves.  ``True`` reads each file in one task, as files whose lines end in CR need.
    """
    reader = spark.read.option("multiLine", multi_line is not False).option("escape", '"')
    names = _header(reader, path)
    # One more column than the header shows catches rows with too many cells.
    wide = [*names, SURPLUS]
    if multi_line is None:
        cells = _parsed(spark, path, wide)
    else:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in wide])
        cells = reader.option("header", True).schema(schema).csv(path)
    return infer_types(cells, infer=infer)


def _parsed(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    schema = ", ".join(f"c{i} STRING" for i in range(len(names)))
    options = {"escape": '"', "multiLine": "true", "maxColumns": str(max(20480, len(names) + 1))}
    cells = read_records(spark, path, lambda record: F.from_csv(record, schema, options))
    return cells.select(*[F.col(f"record.c{i}").alias(n) for i, n in enumerate(names)])


def _header(reader, path: str) -> list[str]:
    first = reader.option("header", False).csv(path).first()
    if first is None:
        raise ValueError(f"no header row in {path}")
    return unique_names(list(first))


def unique_names(cells: list[str | None]) -> list[str]:
    """Blank headers become ``Unnamed: i``; repeats get ``.1``, ``.2`` and so on."""
    given = [c if c else f"Unnamed: {i}" for i, c in enumerate(cells)]
    taken, out = set(given), []
    for n in given:
        name, k = n, 0
        while name in out or (k and name in taken):
            k += 1
            name = f"{n}.{k}"
        out.append(name)
    return out


def infer_types(df: DataFrame, infer: str = "strict") -> DataFrame:
    """Type the text columns of ``df``: bigint, double, boolean, or text.

    Default null spellings are nulled first.  ``normalized`` also nulls the
    cleaning tokens before looking at the cells; ``strict`` leaves them, so one
    ``NAN`` keeps a column of numbers text.
    """
    df = normalize_nulls(df, DEFAULT_NULLS)
    if infer == "normalized":
        df = normalize_nulls(df, NULL_TOKENS)
    names = [n for n in columns_of(df, "text") if n != SURPLUS]
    kinds = _infer_kinds(df, names)
    typed = {n: _typed(col(n), kinds[n]) for n in names}
    return replace_columns(df, typed).select(*[col(n) for n in df.columns if n != SURPLUS])


# One bit per reading of a cell.
LONG, HUGE, NUMBER, BOOLEAN, TEXT = 1, 2, 4, 8, 16


def _cell_kind(c: Column) -> Column:
    """The narrowest reading of one cell; null for a null cell."""
    long = F.when(c.try_cast("bigint").isNull(), HUGE).otherwise(LONG)
    return (
        F.when(c.isNull(), None)
        .when(c.rlike(INTEGER_PATTERN), long)
        .when(to_number(c).isNotNull(), NUMBER)
        .when(F.lower(c).isin("true", "false"), BOOLEAN)
        .otherwise(TEXT)
    )


def _infer_kinds(df: DataFrame, names: list[str]) -> dict[str, str]:
    """One scan that finds, per column, the kinds of its cells and how many there are.

    Cells are laid out as rows, so the reading of a cell is compiled once and
    not once per column; each task folds its cells to one row per column.
    """
    watched = [*names, SURPLUS] if SURPLUS in df.columns else names
    if not watched:
        return {}
    cells = unpivot(df, watched).select("column", _cell_kind(F.col("value")).alias("kind"))
    found = cells.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.count("kind").alias("n"), F.bit_or("kind").alias("kinds")
    )
    seen = {r["column"]: r for r in found.collect()}  # one row per column
    if SURPLUS in seen and seen[SURPLUS]["n"]:
        surplus = seen[SURPLUS]["n"]
        raise ValueError(f"{surplus} rows hold more cells than the header names")
    return {n: _column_kind(seen.get(n)) for n in names}


def _column_kind(seen) -> str:
    if seen is None:  # an empty table
        return "string"
    kinds, complete = seen["kinds"] or 0, seen["n"] == seen["rows"]
    if kinds & (TEXT | HUGE):
        return "string"  # an integer no bigint can hold stays exact as text
    if kinds & BOOLEAN:
        return "boolean" if kinds == BOOLEAN and complete else "string"
    if kinds == LONG and complete:
        return "bigint"
    return "double"  # an all-null column included


def _typed(c: Column, kind: str) -> Column:
    if kind == "double":
        return to_number(c)
    if kind == "boolean":
        return F.lower(c) == "true"
    return c.cast(kind)


def write_table(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header; null is an empty cell."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("overwrite").option("header", True).option("escape", '"')
    writer.option("nullValue", "").option("emptyValue", "").csv(path)
