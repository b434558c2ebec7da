"""Text column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whole cells the CSV scan reads as null.
DEFAULT_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Whole cells cleaning turns into null.
NULL_TOKENS = ("Nan", "nan", "Null", "null", "NAN", "N/A", "n/a")

# Spellings the constant fill treats as missing, and its constant.
UNKNOWN_TOKENS = ("nan", "Nan", "NaN")
UNKNOWN = "Unknown"

CASED = r"[\p{Lu}\p{Ll}\p{Lt}]"
UNCASED = r"[^\p{Lu}\p{Ll}\p{Lt}]"
MARK = "\x01 "


def null_if_in(c: Column, tokens: tuple[str, ...]) -> Column:
    return F.when(~c.isin(*tokens), c)


def strip_text(c: Column) -> Column:
    """Remove every kind of white space at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def title_case(c: Column) -> Column:
    """Upper-case the first letter of each run of cased letters, lower-case the rest.

    ``initcap`` starts words at blanks only, so a marked blank is put before
    every other start and taken out afterwards.  Texts with letters whose upper
    case is more than one letter go run by run.
    """
    sharp_s = F.regexp_replace(c, f"(?<!{CASED})\u00df", "Ss")
    plain = F.when(c.contains("\u00df"), sharp_s).otherwise(c)
    marked = F.regexp_replace(plain, f"(?<=[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}} ])(?={CASED})", MARK)
    quick = F.replace(F.initcap(marked), F.lit(MARK), F.lit(""))
    others = F.replace(c, F.lit("\u00df"), F.lit(""))
    unusual = c.contains(MARK[0]) | (F.length(F.upper(others)) != F.length(others))
    return F.when(unusual, _title_runs(c)).otherwise(quick)


def _title_runs(c: Column) -> Column:
    runs = F.regexp_extract_all(c, F.lit(f"({CASED}+|{UNCASED}+)"), F.lit(1))
    return F.array_join(F.transform(runs, _titled), "")


def _titled(run: Column) -> Column:
    # A ligature has an upper case of two letters, of which one stays.
    first = F.upper(F.substring(run, 1, 1))
    rest = F.concat(F.substr(first, F.lit(2)), F.substr(run, F.lit(2)))
    return F.concat(F.substring(first, 1, 1), F.lower(rest))


def fill_unknown(c: Column) -> Column:
    return F.when(c.isNull() | c.isin(*UNKNOWN_TOKENS), F.lit(UNKNOWN)).otherwise(c)


def safe_name(c: Column) -> Column:
    """White space to ``_``, then only letters, digits, ``_``, ``.`` and ``-``."""
    joined = F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", "_")
    return F.regexp_replace(joined, r"[^\p{L}\p{N}_.-]", "")


def clean_name(c: Column) -> Column:
    return F.concat(F.lit("clean_"), safe_name(c))


def printed(c: Column) -> Column:
    """A double as plain decimal text, ``12345678.9`` where a cast gives ``1.23456789E7``."""
    plain = c.cast("string")
    size = F.abs(c)
    wide = plain.cast("decimal(38,18)").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(wide, r"0+$", ""), r"\.$", ".0")
    scientific = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    return F.when(scientific, trimmed).otherwise(plain)
