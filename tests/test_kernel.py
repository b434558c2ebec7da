"""Kernel machines against a brute-force solution of their dual."""

import numpy as np

from gleamline.ml import kernel

SCHEMA = "id long, num array<double>, slots array<int>, label double"
GAMMA = 0.5


def rows(n, seed, label):
    rng = np.random.default_rng(seed)
    num, slots = rng.normal(size=(n, 2)), rng.integers(0, 3, (n, 1))
    return num, slots, np.array([label(x, s[0], rng) for x, s in zip(num, slots)])


def table(spark, num, slots, y):
    return spark.createDataFrame([(i, a.tolist(), b.tolist(), float(t)) for i, (a, b, t) in enumerate(zip(num, slots, y))], SCHEMA)


def gram(num, slots, other_num, other_slots):
    d = ((num[:, None] - other_num[None]) ** 2).sum(2) + 2.0 * (slots[:, None] != other_slots[None]).sum(2)
    return np.exp(-GAMMA * d) + 1.0  # the intercept is a weight like others


def brute(k, y, epsilon):
    """The dual by accelerated proximal steps on all variables at once."""
    b, v, t, rate = np.zeros(len(y)), np.zeros(len(y)), 1.0, 1.0 / np.linalg.eigvalsh(k)[-1]
    for _ in range(20_000):
        at = v + rate * (y - k @ v)
        if epsilon is None:
            new = y * np.clip(y * at, 0.0, kernel.COST)
        else:
            new = np.clip(np.sign(at) * np.maximum(np.abs(at) - rate * epsilon, 0.0), -kernel.COST, kernel.COST)
        nt = (1.0 + np.sqrt(1.0 + 4.0 * t * t)) / 2.0
        v, b, t = new + (t - 1.0) / nt * (new - b), new, nt
    return b


def machine(spark, data, classes=0, epsilon=None, **how):
    df = table(spark, *data)
    state = kernel.prepare(df, (2, 1), GAMMA, 1, how.pop("landmarks", 256))
    return df, kernel.fit(df, state, len(data[2]), classes, epsilon, **how)


def predicted(df, state):
    return np.array([r["prediction"] for r in kernel.predict(df, state).orderBy("id").collect()])


def curve(x, s, rng):
    return np.sin(2 * x[0]) + x[1] ** 2 + s + rng.normal(scale=0.1)


def test_regression_in_blocks_nears_the_exact_dual(spark):
    num, slots, y = data = rows(200, 1, curve)
    gaps = []
    for rounds in (4, 12):
        df, state = machine(spark, data, epsilon=0.1, block_rows=60, rounds=rounds)
        gaps.append(state["gap"])
    assert 0 < gaps[1] < gaps[0] and gaps[1] < 0.3
    k = gram(num, slots, num, slots)
    exact = k @ brute(k, y - y.mean(), 0.1) + y.mean()
    assert np.corrcoef(predicted(df, state), exact)[0, 1] > 0.98


def test_regression_equals_the_exact_dual(spark):
    data = rows(200, 1, curve)
    df, state = machine(spark, data, epsilon=0.1, gap=1e-4, rounds=200)
    assert 0 <= state["gap"] <= 1e-4
    num, slots, y = data
    k, centred = gram(num, slots, num, slots), y - y.mean()
    b = brute(k, centred, 0.1)
    assert np.abs(predicted(df, state) - (k @ b + y.mean())).max() < 0.05
    assert abs(state["support"] - (np.abs(b) > 1e-9).sum()) <= 6


def test_classification_equals_the_exact_dual(spark):
    data = rows(200, 2, lambda x, s, rng: float(x[0] * x[1] + 0.3 * s > 0.2))
    df, state = machine(spark, data, classes=2, gap=1e-4, rounds=200)
    num, slots, y = data
    k, sign = gram(num, slots, num, slots), np.where(y == 1, 1.0, -1.0)
    out = k @ brute(k, sign, None)
    clear = np.abs(out) > 0.02
    assert clear.mean() > 0.9 and (predicted(df, state) == (out > 0))[clear].all()


def test_rounds_reach_the_gap_in_any_number_of_blocks(spark):
    """Many blocks of few rows descend as one block does: the sums over them are the same."""
    data = rows(200, 1, curve)
    for how in ({}, {"block_rows": 7}):
        df, state = machine(spark, data, epsilon=0.1, **how)
        assert state["gap"] <= kernel.GAP and state["rounds"] <= 30


def test_many_classes_and_fewer_landmarks_than_rows(spark):
    data = rows(600, 3, lambda x, s, rng: float(int(x[0] > 0.3) + int(x[1] > 0)))
    df, state = machine(spark, data, classes=3, landmarks=40)
    assert state["gap"] <= kernel.GAP and len(state["root"]) == 40
    assert (predicted(df, state) == data[2]).mean() > 0.93


def test_repeated_rows_and_one_class(spark):
    num, slots = np.zeros((30, 2)), np.zeros((30, 1), int)
    df, state = machine(spark, (num, slots, np.ones(30)), classes=2)
    assert (predicted(df, state) == 1.0).all() and len(state["root"][0]) == 1
    df, state = machine(spark, (num, slots, np.full(30, 7.0)), epsilon=0.1)
    assert np.allclose(predicted(df, state), 7.0, atol=0.11) and state["rounds"] == 1


def test_rows_without_numbers_or_without_texts(spark):
    y = np.arange(40) % 2
    only_text = spark.createDataFrame([(i, [], [int(t)], float(t)) for i, t in enumerate(y)], SCHEMA)
    state = kernel.fit(only_text, kernel.prepare(only_text, (0, 1), GAMMA, 1), 40, 2)
    assert (predicted(only_text, state) == y).all()
    only_number = spark.createDataFrame([(i, [float(t)], [], float(t)) for i, t in enumerate(y)], SCHEMA)
    state = kernel.fit(only_number, kernel.prepare(only_number, (1, 0), GAMMA, 1), 40, 2)
    assert (predicted(only_number, state) == y).all()
