"""Number column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# A cell is a number when it is decimal digits, maybe signed, with an exponent
# and padding, or one of the spellings of infinity.  A plain cast would also
# take '1d' and '5f'.
NUMBER_PATTERN = (
    r"^(\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*|[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?)\z"
)
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*\z"


def to_number(c: Column) -> Column:
    """Text to double; whatever is not a number, or overflows, becomes null."""
    parsed = F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double"))
    overflow = (F.abs(parsed) == float("inf")) & c.rlike(r"\d")
    return F.when(~overflow, parsed)


def extract_number(c: Column) -> Column:
    """Delete all but digits, ``.`` and ``-``, then parse."""
    return to_number(F.regexp_replace(c, r"[^\d.-]", ""))


def round2(c: Column) -> Column:
    """Half-even on the scaled value, the rounding of array libraries."""
    return F.rint(c * 100) / 100


def is_whole(c: Column) -> Column:
    """True for whole finite values that fit a bigint; infinity has a NaN remainder."""
    return c.isNotNull() & (c % 1 == 0) & (F.abs(c) < 2.0**63)


def clip(c: Column, low: float | None, high: float | None) -> Column:
    """Cap to the given bounds and keep nulls (``least`` would turn them into a bound)."""
    capped = c.cast("double")
    if low is not None and not math.isnan(low):
        capped = F.when(capped < low, F.lit(low)).otherwise(capped)
    if high is not None and not math.isnan(high):
        capped = F.when(capped > high, F.lit(high)).otherwise(capped)
    return capped
