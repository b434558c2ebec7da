"""Cleaning runs against the same steps written with pandas."""

import json
import math

import numpy as np
import pandas as pd
import pytest

from gleamline.functions.text import NULL_TOKENS
from gleamline.operators import columns as C
from gleamline.operators import profile as P
from gleamline.operators import rows as R
from gleamline.operators import stats as S
from gleamline.plans.clean import auto_clean, clean
from gleamline.plans.suggest import suggest_strategy
from gleamline.types import conform


def messy(n=240, seed=3):
    rng = np.random.default_rng(seed)
    city = rng.choice(["  new york", "NEW YORK", "o'fallon", "N/A", "Null", "paris "], n)
    weight = [f"{v} kg" if i % 3 else f"{v}" for i, v in enumerate(rng.integers(40, 90, n))]
    weight = [None if i % 11 == 0 else w for i, w in enumerate(weight)]
    price = np.where(rng.random(n) < 0.04, 9e5, rng.normal(100, 10, n)).round(3)
    price = [None if i % 7 == 0 else float(p) for i, p in enumerate(price)]
    flag = rng.integers(0, 2, n).astype(bool)
    rooms = [None if i % 13 == 0 else float(r) for i, r in enumerate(rng.integers(1, 5, n))]
    frame = pd.DataFrame(
        {"user_id": np.arange(n), "city": city, "weight": weight, "price": price, "flag": flag, "rooms": rooms}
    )
    return pd.concat([frame, frame.iloc[::9]], ignore_index=True)


SCHEMA = "user_id bigint, city string, weight string, price double, flag boolean, rooms double"


def to_spark(spark, frame, schema=SCHEMA):
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in frame.astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, schema)


def as_rows(frame):
    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return f"{float(v):.6f}" if isinstance(v, (int, float, np.number)) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in frame.astype(object).itertuples(index=False))


def pandas_numbers(s):
    return pd.to_numeric(s.astype(str).str.replace(r"[^\d.-]", "", regex=True), errors="coerce")


def pandas_auto(df):
    df = df.drop_duplicates().copy()
    for n in ("city", "weight"):
        df[n] = df[n].str.strip().str.title()
        numbers = pandas_numbers(df[n])
        if numbers.notna().sum() > 0.2 * len(df):
            df[n] = numbers
    for n in df.columns[df.isnull().any()]:
        numeric = pd.api.types.is_numeric_dtype(df[n])
        df[n] = df[n].fillna(df[n].median() if numeric else "Unknown")
    for n in df.select_dtypes("number").columns:
        a, b = df[n].quantile(0.25), df[n].quantile(0.75)
        df[n] = df[n].clip(a - 1.5 * (b - a), b + 1.5 * (b - a))
    return df


def pandas_start(df):
    df = df.replace(list(NULL_TOKENS), np.nan)
    return df.dropna(thresh=len(df.columns) - 2)


def pandas_finish(df):
    for n in df.select_dtypes("float").columns:
        df[n] = df[n].round(2)
        if df[n].notna().all() and (df[n] % 1 == 0).all():
            df[n] = df[n].astype("Int64")
    return df


def test_auto_run_equals_pandas(spark):
    frame = messy()
    result = clean(to_spark(spark, frame), "auto_smart")
    expected = pandas_finish(pandas_auto(pandas_start(frame)))
    assert as_rows(result.data.toPandas()) == as_rows(expected)
    names = {"Int64": "bigint", "int64": "bigint", "float64": "double", "bool": "boolean", "object": "string"}
    assert dict(result.data.dtypes) == {n: names[str(t)] for n, t in expected.dtypes.items()}


def test_strategy_run_equals_pandas(spark):
    frame = messy()
    strategy = {
        "drop_duplicates": True, "drop_columns": ["rooms"], "standardize_text": ["city", "absent"],
        "extract_numbers": ["weight", "user_id"], "fill_unknown": ["city"],
        "fill_mean": ["weight", "price"], "remove_outliers": ["price", "weight", "city"],
    }
    df = pandas_start(frame).drop_duplicates().drop(columns="rooms")
    df["city"] = df["city"].astype(str).str.strip().str.title().replace("Nan", np.nan)
    df["weight"] = pandas_numbers(df["weight"])
    df["city"] = df["city"].fillna("Unknown")
    for n in ("weight", "price"):
        df[n] = df[n].fillna(df[n].mean())
    for n in ("price", "weight"):
        a, b = df[n].quantile(0.25), df[n].quantile(0.75)
        df = df[~((df[n] < a - 1.5 * (b - a)) | (df[n] > b + 1.5 * (b - a)))]
    result = clean(to_spark(spark, frame), "ai_agent", strategy)
    assert as_rows(result.data.toPandas()) == as_rows(pandas_finish(df))
    ops = [e[1] for e in result.log.entries]
    assert ops.index("drop_column") < ops.index("standardize_text") < ops.index("fill_mean")


def test_log_counts_rows(spark):
    frame = messy()
    log = {(e[1], e[2]): e[3] for e in clean(to_spark(spark, frame), "auto_smart").log.entries}
    kept = pandas_start(frame)
    assert log["dedupe_rows", None] == len(kept) - len(kept.drop_duplicates())
    assert log.get(("drop_sparse_rows", None), 0) == len(frame) - len(kept)
    assert log["fill_median", "price"] == kept.drop_duplicates()["price"].isna().sum()


def test_manual_modes(spark):
    df = to_spark(spark, messy())
    assert clean(df, "drop_missing").data.where("price IS NULL OR city IS NULL").count() == 0
    assert clean(df, "fill_mean").data.where("price IS NULL").count() == 0
    assert clean(df, "remove_outliers").data.where("price > 1000").count() == 0
    assert clean(df, "manual").data.count() >= clean(df, "remove_outliers").data.count()
    with pytest.raises(ValueError):
        clean(df, "other")


def test_empty_strategy_falls_back_only_when_suggestion_is_asked(spark):
    result = clean(to_spark(spark, messy()), "ai_agent", {"drop_duplicates": False})
    assert [e[1] for e in result.log.entries][-1] == "load_strategy"


def test_suggestion(spark):
    s = suggest_strategy(C.normalize_nulls(conform(to_spark(spark, messy()))))
    assert s.standardize_text == ["city"] and s.extract_numbers == ["weight"]
    assert s.fill_unknown == ["city"] and set(s.fill_mean) == {"weight", "price", "rooms"}
    assert "price" in s.remove_outliers and s.drop_duplicates


def test_edge_tables(spark):
    one = spark.createDataFrame([(None,), (1.0,)], "a double")
    assert R.drop_sparse_rows(one).count() == 2
    empty = spark.createDataFrame([], "a double, b string")
    assert clean(empty, "auto_smart").data.dtypes == [("a", "bigint"), ("b", "string")]
    blank = spark.createDataFrame([(None, "x"), (None, "y")], "a double, b string")
    assert auto_clean(blank).where("a IS NULL").count() == 2
    assert C.whole_columns(blank) == []
    inf = spark.createDataFrame([(float("inf"),), (1.0,)], "a double")
    assert C.whole_columns(inf) == [] and C.cap_outliers(inf).count() == 2
    nan = conform(spark.createDataFrame([(float("nan"),), (1.0,)], "a float"))
    assert S.missing_counts(nan).first()["missing"] == 1
    flags = spark.createDataFrame([(True, 1), (None, 2)], "ok boolean, n bigint")
    assert sorted(r["ok"] for r in C.fill_auto(flags).collect()) == ["True", "Unknown"]
    assert S.correlation_matrix(one).count() == 0
    odd = spark.createDataFrame([(1.0, 2.0), (2.0, 5.0)], "`a.b` double, `c ``d'` double")
    assert C.cap_outliers(odd).columns == odd.columns
    assert S.correlation_matrix(odd).count() == 4 and S.missing_counts(odd).count() == 2


def test_clean_twice_changes_nothing(spark):
    once = clean(to_spark(spark, messy()), "manual").data
    assert as_rows(clean(once, "manual").data.toPandas()) == as_rows(once.toPandas())


def test_profile_parts(spark):
    frame = messy()
    parts = P.profile(to_spark(spark, frame), key=["user_id"])
    assert tuple(parts.shape.first()) == (len(frame), 6)
    missing = {r["column"]: r["missing"] for r in parts.missing.collect()}
    normal = frame.replace(list(NULL_TOKENS), np.nan)
    assert missing == normal.isnull().sum().to_dict()
    assert parts.health.first()["issues"] == sum(missing.values())
    r = {(x["col_x"], x["col_y"]): x["r"] for x in parts.correlation.collect()}
    expected = normal.select_dtypes("number").corr()
    for a in expected:
        for b in expected:
            assert r[a, b] == pytest.approx(expected.loc[a, b], abs=1e-9)
    assert parts.preview.count() == 5


def test_correlation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "CORRELATION_BLOCK", 2)
    rng = np.random.default_rng(0)
    frame = pd.DataFrame(rng.normal(size=(40, 5)), columns=list("abcde"))
    got = S.correlation_matrix(spark.createDataFrame(frame)).toPandas()
    assert len(got) == 25
    table = got.pivot(index="col_x", columns="col_y", values="r")
    assert np.allclose(table, frame.corr())


def test_fitted_steps_run_on_a_stream(spark, tmp_path):
    """A fitted step is a projection, so it also serves streaming input."""
    frame = messy()
    to_spark(spark, frame).select("price", "rooms").write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    bounds = C.fit_caps(batch, ["price"])
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = (
        C.apply_caps(stream, bounds).writeStream.format("memory").queryName("capped")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    high = spark.table("capped").agg({"price": "max"}).first()[0]
    assert high == pytest.approx(bounds["price"][1])


@pytest.mark.parametrize("given,outcome", [({}, "empty"), ("", "unparsable"), ("} {", "unparsable"), ("{} {", "empty"), ("none {}", "empty"), ('{"a": [', "unparsable")])
def test_a_strategy_that_is_not_usable_runs_the_automatic_plan(spark, given, outcome):
    df = to_spark(spark, messy())
    result, auto = clean(df, "ai_agent", given), clean(df, "auto_smart")
    assert sorted(map(str, result.data.collect())) == sorted(map(str, auto.data.collect()))
    ops = [r["op"] for r in result.log_table().orderBy("seq").collect()]
    assert [o for o in ops if o.startswith(("strategy_", "fallback_"))] == [f"strategy_{outcome}", "fallback_auto"]


def test_a_strategy_in_a_reply_is_run(spark):
    df = to_spark(spark, messy())
    plan = {"drop_duplicates": True, "fill_unknown": [df.columns[0]]}
    told = clean(df, "ai_agent", "Here you are:\n" + json.dumps(plan) + "\nDone.")
    assert sorted(map(str, told.data.collect())) == sorted(map(str, clean(df, "ai_agent", plan).data.collect()))
    assert "load_strategy" in {r["op"] for r in told.log_table().collect()}


def test_removed_rows_are_counted_by_the_scan_that_removes_them(spark):
    rows = [(i, None if i % 3 else 1, None if i % 3 else 2, None if i % 6 else 3) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, a int, b int, c int").repartition(4)
    assert [r["affected"] for r in clean(df, "manual").log_table().collect() if r["op"] == "drop_sparse_rows"] == [20]
    nothing = df.where("id % 3 > 0")  # every row goes
    assert [r["affected"] for r in clean(nothing, "manual").log_table().collect()] == [20]
    assert clean(df.limit(0), "manual").log_table().collect() == []
