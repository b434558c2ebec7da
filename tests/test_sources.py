import datetime as dt
import io

import numpy as np
import pandas as pd
import pytest

from gleamline.sources import runs as H
from gleamline.sources import tables as T

CSV = '''id,price,done,note,mixed,gap,big,day
1,1.5,True,"a, b",1,,9223372036854775808,2024-01-01
2,NA,false,"say ""hi""",NAN,,7,2024-01-02
3,inf,TRUE,n/a,3,,8,2024-01-03

4,-2e3,FALSE,plain,4,,9,2024-01-04
'''


def written(tmp_path, text, name="in.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_types_equal_pandas(spark, tmp_path):
    df = T.read_table(spark, written(tmp_path, CSV))
    kinds = {"int64": "bigint", "float64": "double", "bool": "boolean", "object": "string"}
    expected = pd.read_csv(io.StringIO(CSV))
    for n, kind in df.dtypes:
        if n != "big":  # beyond bigint: kept exact as text
            assert kind == kinds[str(expected[n].dtype)], n
    rows = {r["id"]: r for r in df.collect()}
    assert len(rows) == 4 and rows[3]["price"] == float("inf") and rows[2]["price"] is None
    assert rows[1]["note"] == "a, b" and rows[2]["note"] == 'say "hi"' and rows[3]["note"] is None
    assert rows[2]["mixed"] == "NAN" and rows[1]["big"] == "9223372036854775808"
    assert T.read_table(spark, written(tmp_path, CSV), infer="normalized").schema["mixed"].dataType.typeName() == "double"


def test_quoted_line_breaks(spark, tmp_path):
    path = written(tmp_path, 'a,b\n1,"two\nlines"\n2,x\n')
    for multi_line in (None, True):
        assert {r["b"] for r in T.read_table(spark, path, multi_line).collect()} == {"two\nlines", "x"}
    flat = written(tmp_path, 'a\n"x ""y"""\n', "flat.csv")
    assert [[r["a"] for r in T.read_table(spark, flat, m).collect()] for m in (None, False)] == [['x "y"']] * 2


def test_long_rows_fail_and_short_rows_are_padded(spark, tmp_path):
    with pytest.raises(ValueError, match="more cells"):
        T.read_table(spark, written(tmp_path, "a,b\n1,2\n1,2,3\n"))
    rows = T.read_table(spark, written(tmp_path, "a,b\n1\n2,3\n", "short.csv")).collect()
    assert sorted((r["a"], r["b"]) for r in rows) == [(1, None), (2, 3.0)]


def test_header_names(spark, tmp_path):
    cells = ["a", "a", "b", "a", None, "a.1"]
    assert T.unique_names(cells)[:4] == ["a", "a.2", "b", "a.3"]
    assert T.unique_names(["a", "a", "b", "a"]) == ["a", "a.1", "b", "a.2"]
    assert T.unique_names([None, "x"]) == ["Unnamed: 0", "x"]
    df = T.read_table(spark, written(tmp_path, "a,a,b c,\n1,2,3,4\n"))
    assert df.columns == ["a", "a.1", "b c", "Unnamed: 3"]


def test_written_table_reads_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, 'q"u,o')], "n bigint, t string")
    T.write_table(df, str(tmp_path / "out"), single_file=True)
    files = list((tmp_path / "out").glob("*.csv"))
    assert len(files) == 1
    back = pd.read_csv(files[0])
    assert back["n"].tolist() == [1, 2, 3] and np.isnan(back["t"][1]) and back["t"][2] == 'q"u,o'
    assert sorted(map(tuple, T.read_table(spark, str(tmp_path / "out")).collect()), key=str) == sorted(
        map(tuple, df.collect()), key=str
    )


def test_run_history(spark, tmp_path):
    users = spark.createDataFrame([(7, "ann"), (3, "ann"), (5, "bob")], "id bigint, username string")
    path = str(tmp_path / "runs")
    for i in range(12):
        when = dt.datetime(2024, 1, 1 + i, 8, 30)
        assert H.log_run(users, "ann", path, f"f{i}.csv", f"clean_f{i}.csv", f"/d/f{i}.csv", i, when)
    assert not H.log_run(users, "zoe", path, "x", "y", "z", 0)
    runs = H.read_runs(spark, path)
    assert runs.count() == 12 and {r["user_id"] for r in runs.collect()} == {3}
    latest = sorted(H.recent_runs(runs, users, "ann").collect(), key=lambda r: r["place"])
    assert [r["filename"] for r in latest] == [f"f{i}.csv" for i in range(11, 1, -1)]
    assert latest[0]["date"] == "2024-01-12 08:30"
    assert H.recent_runs(runs, users, "bob").count() == 0
