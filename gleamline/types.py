"""Column roles, the cleaning strategy and the training configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A column whose lower-cased name contains one of these is never
# turned into numbers by the number-extraction steps.
PROTECTED_NAME_PARTS = ("email", "id", "date", "name", "phone")

STRATEGY_SCHEMA = T.StructType(
    [
        T.StructField("standardize_text", T.ArrayType(T.StringType())),
        T.StructField("extract_numbers", T.ArrayType(T.StringType())),
        T.StructField("fill_unknown", T.ArrayType(T.StringType())),
        T.StructField("fill_mean", T.ArrayType(T.StringType())),
        T.StructField("remove_outliers", T.ArrayType(T.StringType())),
        T.StructField("drop_columns", T.ArrayType(T.StringType())),
        T.StructField("drop_duplicates", T.BooleanType()),
    ]
)


@dataclass
class Strategy:
    """What a declared cleaning run does; the order of work is fixed by the engine."""

    standardize_text: list[str] = field(default_factory=list)
    extract_numbers: list[str] = field(default_factory=list)
    fill_unknown: list[str] = field(default_factory=list)
    fill_mean: list[str] = field(default_factory=list)
    remove_outliers: list[str] = field(default_factory=list)
    drop_columns: list[str] = field(default_factory=list)
    drop_duplicates: bool = False

    @classmethod
    def of(cls, given: "Strategy | dict") -> "Strategy":
        if isinstance(given, cls):
            return given
        known = {f.name for f in STRATEGY_SCHEMA}
        return cls(**{k: v for k, v in given.items() if k in known and v is not None})


@dataclass
class MlConfig:
    """Manual training choices; the defaults are the automatic run."""

    drop_columns: list[str] = field(default_factory=list)
    scaling: str = "standard"
    models: list[str] = field(default_factory=list)
    seed: int = 42


def col(name: str) -> Column:
    """A column by its literal name, dots, blanks and back-ticks included."""
    return F.col(quote(name))


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def is_number(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def columns_of(df: DataFrame, kind: str) -> list[str]:
    """Names of the ``number``, ``text`` or ``bool`` columns, in table order."""
    tests = {
        "number": is_number,
        "text": lambda t: isinstance(t, T.StringType),
        "bool": lambda t: isinstance(t, T.BooleanType),
    }
    return [f.name for f in df.schema if tests[kind](f.dataType)]


def dtype_name(data_type: T.DataType) -> str:
    """The four type names a profile reports."""
    if isinstance(data_type, T.IntegralType):
        return "int64"
    if is_number(data_type):
        return "float64"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    return "object"


def is_protected(name: str) -> bool:
    lowered = name.lower()
    return any(part in lowered for part in PROTECTED_NAME_PARTS)


def conform(df: DataFrame) -> DataFrame:
    """Reduce any scan to the four column types the engine works with.

    Integers become bigint, other numbers double with NaN as null, dates and
    timestamps text; booleans and text stay.  Nested columns pass through.
    """
    picked = []
    for f in df.schema:
        c, t = col(f.name), f.dataType
        if isinstance(t, T.IntegralType) and not isinstance(t, T.LongType):
            c = c.cast("bigint")
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        elif isinstance(t, T.DecimalType):
            c = c.cast("double")
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        picked.append(c.alias(f.name))
    return df.select(*picked)


def replace_columns(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """One projection that swaps the given columns and keeps the rest in place."""
    if not changed:
        return df
    return df.select(*[changed[n].alias(n) if n in changed else col(n) for n in df.columns])
