import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleamline.operators import order_stats as O
from gleamline.operators.columns import fit_medians_and_caps
from gleamline.operators.stats import fences

PROBABILITIES = [0.25, 0.5, 0.75]


def check(spark, columns, monkeypatch=None, **kw):
    names = list(columns)
    rows = list(zip(*[[None if v is None else float(v) for v in c] for c in columns.values()]))
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(5)
    got = O.quantiles(df, names, PROBABILITIES, **kw)
    for n in names:
        present = [v for v in columns[n] if v is not None]
        if not present:
            assert got[n] == [None] * 3
        else:
            assert np.allclose(got[n], np.quantile(present, PROBABILITIES), rtol=1e-15, atol=0), n


def awkward(n, seed=1):
    rng = np.random.default_rng(seed)
    hot = np.where(rng.random(n) < 0.35, 7.0, rng.normal(size=n))
    return {
        "plain": rng.normal(size=n).tolist(),
        "one value.holds a third": hot.tolist(),
        "huge": (10.0 ** rng.uniform(-200, 200, n)).tolist(),
        "flags": rng.integers(0, 2, n).tolist(),
        "gaps": [None if i % 3 else float(i) for i in range(n)],
        "nothing": [None] * n,
        "sorted": sorted(rng.exponential(size=n).tolist()),
        "steps": np.repeat([1.0, 2.0], [n // 2, n - n // 2]).tolist(),
    }


def test_small_table_in_one_aggregate(spark):
    check(spark, awkward(501))


def test_narrowing_is_exact(spark, monkeypatch):
    monkeypatch.setattr(O, "INTERVAL_VALUES", 20)
    check(spark, awkward(4001), direct_values=0)


def test_narrowing_survives_bad_pivots(spark, monkeypatch):
    """Pivots only steer: wrong ones cost passes, not exactness."""
    monkeypatch.setattr(O, "INTERVAL_VALUES", 400)
    real, calls = O._next_pivots, []

    def off(search, sizes, grids):
        calls.append(1)
        low, high = real(search, sizes, grids)
        return (high, high) if len(calls) < 4 else (low, high)

    monkeypatch.setattr(O, "_next_pivots", off)
    check(spark, {"plain": awkward(3000)["plain"]}, direct_values=0)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=30))
def test_median_and_fences_of_the_filled_column(spark, cells):
    df = spark.createDataFrame([(None if c is None else float(c),) for c in cells], "c double")
    present = [c for c in cells if c is not None]
    medians, bounds = fit_medians_and_caps(df, ["c"], {"c": len(present)}, len(cells))
    if not present:
        assert bounds["c"] == (None, None)
        return
    median = float(np.median(present))
    if len(present) < len(cells):
        assert medians["c"] == median
    filled = [median if c is None else c for c in cells]
    assert bounds["c"] == pytest.approx(fences(*np.quantile(filled, [0.25, 0.75])))
