"""CSV files cut into many byte ranges, against one task and pandas."""

import random

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleamline.sources import records as R
from gleamline.sources import tables as T


def single(*paths):
    """What one reader makes of each file as a whole."""
    frames = [pd.read_csv(p, dtype=str, keep_default_na=False) for p in paths]
    return sorted(tuple(r) for f in frames for r in f.itertuples(index=False))


def cells(spark, path, names):
    return sorted(tuple("" if c is None else c for c in r) for r in T._parsed(spark, path, names).collect())


@pytest.fixture
def ranges(spark, monkeypatch):
    """Sets the length of a byte range; what is staged stays in memory, where it isn't cut as short."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    monkeypatch.setattr(R, "stage", lambda df: spark.createDataFrame(df.collect(), df.schema))
    yield lambda size: spark.conf.set(key, str(size))
    spark.conf.set(key, before)


def random_csv(seed: int, rows: int, end: str = "\n") -> str:
    rng = random.Random(seed)

    def cell() -> str:
        text = "".join(rng.choice(["a", "é", ",", '"', end, " ", "b" * rng.randrange(9)]) for _ in range(rng.randrange(7)))
        return '"' + text.replace('"', '""') + '"' if rng.random() < 0.7 or any(c in text for c in ',"\n') else text or "x"

    return end.join(["a,b,c", *(",".join([str(i), cell(), cell()]) for i in range(rows))]) + (end if seed % 2 else "")


@pytest.mark.parametrize("size,end", [(17, "\n"), (29, "\r\n"), (64, "\n")])
def test_many_ranges_equal_one_task(spark, tmp_path, ranges, size, end):
    for seed in range(2):
        (tmp_path / f"{seed}.csv").write_bytes(random_csv(seed, 6, end).encode())
    expected = single(*tmp_path.iterdir())
    assert len(expected) == 12
    ranges(size)
    assert cells(spark, str(tmp_path), ["a", "b", "c"]) == expected


def test_every_edge_within_a_quoted_break(spark, tmp_path, ranges):
    text = 'a,b\n1,"x\n""y"",\n\nz"\n2,plain\n"3","\n"\n'
    path = tmp_path / "in.csv"
    path.write_text(text)
    expected = single(path)
    for size in (4, 10, 15):
        ranges(size)
        assert cells(spark, str(path), ["a", "b"]) == expected, size


def test_a_header_across_ranges_a_byte_order_mark_and_an_open_cell(spark, tmp_path, ranges):
    (tmp_path / "in.csv").write_text('﻿"first\nname",b\n1,x\n\n 2,"never closed\n3,4\n')
    ranges(5)
    assert cells(spark, str(tmp_path), ["a", "b"])[1] == ("1", "x")
    assert len(cells(spark, str(tmp_path), ["a", "b"])) == 2


def test_a_quote_within_an_unquoted_cell_opens_nothing(spark, tmp_path, ranges):
    (tmp_path / "in.csv").write_text('a,b\n5" pipe,x\n6 "y" z,"p\nq"\n')
    ranges(6)
    assert cells(spark, str(tmp_path), ["a", "b"]) == sorted([('5" pipe', "x"), ('6 "y" z', "p\nq")])


def test_types_and_an_empty_table(spark, tmp_path):
    (tmp_path / "in.csv").write_text('id,"line\nbreak",note\n1,2.5,"a\nb"\n2,3,\n')
    df = T.read_table(spark, str(tmp_path / "in.csv"))
    assert df.dtypes == [("id", "bigint"), ("line\nbreak", "double"), ("note", "string")]
    (tmp_path / "none.csv").write_text("a,b\n")
    assert T.read_table(spark, str(tmp_path / "none.csv")).count() == 0


def test_ranges_are_read_again_only_where_they_begin_inside(spark, tmp_path, ranges):
    rows = [f'{i},"x{i}\ny"' if i == 40 else f"{i},plain{i}" for i in range(80)]
    (tmp_path / "in.csv").write_text("\n".join(["a,b", *rows]))
    ranges(60)
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path)).selectExpr(
        "value", "1L AS file", "_metadata.file_block_start AS start"
    )
    found = lines.mapInArrow(R._cut(False), R.SCHEMA).filter(f"kind = {R.RANGE}")
    assert found.count() > 5 and R.inside_ranges(found).count() <= 1


def plain_inside(text: str, inside: bool) -> bool:
    """A character at a time."""
    begins, closing = not inside, False
    for i, c in enumerate(text):
        if inside:
            if closing:
                closing = False
                if c == '"':
                    continue
                inside, begins = False, c == ","
            elif c == '"':
                closing = True
        elif begins and c == '"':
            inside, begins = True, False
        else:
            begins = c == ","
    return inside and not closing


@settings(max_examples=300, deadline=None)
@given(st.text('",ab\r', max_size=14), st.booleans())
def test_a_lines_end_state(line, inside):
    assert R.ends_inside(line, inside) == plain_inside(line, inside)
    closed = pc.match_substring_regex(pa.array([line]), R._CLOSED)[0].as_py()
    assert closed == (not plain_inside(line, False))
