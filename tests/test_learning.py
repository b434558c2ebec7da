from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from checks.views import load
from gleamline.ml import models, network
from gleamline.ml import nearest as N
from gleamline.ml.features import FeatureSpace, encode_label, one_hot, scale_minmax, scale_standard
from gleamline.ml.silhouette import Boxes, silhouette, visits
from gleamline.session import stage
from gleamline.ml.split import split_exact
from gleamline.operators import lookup as U
from gleamline.plans.automl import PREDICTED, automl, infer_task, score_table
from gleamline.types import MlConfig

SMALL = "/root/testdata/sf0.001"
POINTS = "id bigint, num array<double>, slots array<int>"


@pytest.mark.parametrize("n", [1, 4, 5, 103])
def test_split_sizes_are_exact_and_stable(spark, n):
    df = spark.range(n).repartition(3)
    train, test = split_exact(df, ["id"])
    held = {r["id"] for r in test.collect()}
    assert len(held) == -(-n // 5) and train.count() == n - len(held)
    again = split_exact(df.repartition(7), ["id"])[1]
    assert {r["id"] for r in again.collect()} == held
    if n == 103:
        assert {r["id"] for r in split_exact(df, ["id"], seed=7)[1].collect()} != held


def test_split_needs_a_key(spark):
    with pytest.raises(ValueError, match="does not identify"):
        split_exact(spark.range(50).select(F.lit(1).alias("k")), ["k"])


def test_dense_index_and_salted_lookup(spark):
    df = spark.range(1000).select(F.concat(F.lit("v"), F.col("id") % 97).alias("v")).repartition(6)
    table = U.dense_index(df.distinct(), ["v"])
    got = {r["v"]: r["slot"] for r in table.collect()}
    assert got == {v: i for i, v in enumerate(sorted(got))}
    facts = df.withColumn("v", F.when(F.rand(1) < 0.4, "v5").otherwise(F.col("v"))).union(
        spark.createDataFrame([("new",)], "v string")
    )
    for small in (True, False):
        joined = U.lookup(facts, F.col("v"), table, "v", "slot", "slot", small)
        assert joined.columns == ["v", "slot"] and joined.count() == 1001
        assert joined.where("slot IS NULL").count() == 1
        assert all(r["slot"] == got.get(r["v"]) for r in joined.collect())


def brute(queries, train, k):
    out = {}
    for qid, qn, qs in queries:
        found = []
        for tid, tn, ts in train:
            d = sum((a - b) ** 2 for a, b in zip(qn, tn))
            d += sum(0 if a == b else (1 if a < 0 else 2) for a, b in zip(qs, ts))
            found.append((d, tid))
        out[qid] = [t for _, t in sorted(found)[:k]]
    return out


def points(n, seed, hot=False, unseen=False):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        num = [0.5, 0.25] if hot and rng.random() < 0.4 else rng.integers(0, 9, 2).astype(float).tolist()
        slots = [int(rng.integers(-1 if unseen else 0, 4))]
        rows.append((i, num, [1] if hot and num == [0.5, 0.25] else slots))
    return rows


@pytest.mark.parametrize("hot", [False, True])
def test_nearest_join_equals_brute_force(spark, monkeypatch, hot):
    """Both ways of the join; small blocks force cells, cuts and copies to matter."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    queries, train = points(70, 1, hot, unseen=True), points(300, 2, hot)
    expected = brute(queries, train, 5)
    q, t = spark.createDataFrame(queries, POINTS), spark.createDataFrame(train, POINTS)
    for cells in (10**9, 0):
        got = {}
        for r in sorted(N.knn_join(q, t, broadcast_cells=cells).collect()):
            got.setdefault(r["query_id"], []).append(r["train_id"])
        assert got == expected


def test_nearest_join_with_few_training_rows(spark):
    q, t = spark.createDataFrame(points(3, 1), POINTS), spark.createDataFrame(points(2, 2), POINTS)
    for cells in (10**9, 0):
        assert N.knn_join(q, t, broadcast_cells=cells).count() == 6
    assert N.knn_join(q, t.limit(0)).count() == 0


def test_queries_visit_few_cells_and_are_written_once(spark, monkeypatch):
    rng = np.random.default_rng(11)
    queries = [(i, rng.normal(size=2).tolist(), [int(rng.integers(-1, 3))]) for i in range(200)]
    train = [(i, rng.normal(size=2).round(1).tolist(), [int(rng.integers(0, 3))]) for i in range(1500)]
    written = []
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    monkeypatch.setattr(N, "MATRIX", 500)
    monkeypatch.setattr(N, "stage", lambda df: (written.append(stage(df)), written[-1])[1])
    q, t = spark.createDataFrame(queries, POINTS), spark.createDataFrame(train, POINTS)
    got = {}
    for r in sorted(N.knn_join(q, t, broadcast_cells=0).collect()):
        got.setdefault(r["query_id"], []).append(r["train_id"])
    assert got == brute(queries, train, 5)
    asked = [df for df in written if "cells" in df.columns]
    assert [df.count() for df in asked] == [200, 200]
    cells = len({r["cell"] for df in written if "reach" in df.columns for r in df.collect()})
    visited = sum(len(r["cells"]) for df in asked for r in df.collect())
    assert cells > 40 and 200 <= visited < 0.4 * 200 * cells


def brute_silhouette(rows, squared=False):
    scores = []
    for i, (a, sa, ca) in enumerate(rows):
        totals, sizes = {}, {}
        for j, (b, sb, cb) in enumerate(rows):
            if i == j:
                continue
            d = sum((x - y) ** 2 for x, y in zip(a, b)) + sum(2 * (x != y) for x, y in zip(sa, sb))
            totals[cb] = totals.get(cb, 0) + (d if squared else d**0.5)
            sizes[cb] = sizes.get(cb, 0) + 1
        if ca not in sizes:
            scores.append(0.0)
            continue
        own = totals[ca] / sizes[ca]
        other = min(totals[c] / sizes[c] for c in totals if c != ca)
        scores.append((other - own) / max(own, other) if max(own, other) else 0.0)
    return float(np.mean(scores))


@pytest.mark.parametrize("block", [7, 4096])
def test_silhouette_equals_brute_force(spark, block):
    rows = [(n, s, int(n[0] > 4) + int(n[1] > 6)) for _, n, s in points(80, 5, hot=True)]
    rows.append(([50.0, 50.0], [2], 9))  # a cluster of one
    df = spark.createDataFrame(rows, "num array<double>, slots array<int>, cluster int")
    assert silhouette(df, block_rows=block) == pytest.approx(brute_silhouette(rows), abs=1e-6)
    assert silhouette(df, "squared") == pytest.approx(brute_silhouette(rows, True), abs=1e-9)
    assert silhouette(df.withColumn("cluster", F.lit(1))) == 0.0


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_silhouette_visits_few_pairs_and_misses_no_nearest_cluster(spark, offset):
    rng = np.random.default_rng(5)
    centres = rng.uniform(-40, 40, (8, 3)) + offset
    rows = [((centres[i % 8] + rng.normal(size=3)).tolist(), [i % 3], i % 8) for i in range(240)]
    rows += [(rng.uniform(-40, 40, 3).tolist() if not offset else (offset + rng.uniform(-40, 40, 3)).tolist(), [0], i) for i in range(8)]
    df = spark.createDataFrame(rows, "num array<double>, slots array<int>, cluster int")
    assert silhouette(df, block_rows=16) == pytest.approx(brute_silhouette(rows), abs=1e-6)
    points = df.selectExpr("num", "slots", "cluster", "1L AS copies").coalesce(1).withColumn("id", F.monotonically_increasing_id())
    sizes = {c: 31 for c in range(8)}
    found = visits(points, sorted(sizes), sizes).groupBy("id").count().collect()
    assert len(found) == len(rows) and min(r["count"] for r in found) >= 2
    assert sum(r["count"] for r in found) < 0.4 * 8 * len(rows)


@pytest.mark.parametrize("width", [1, 2])
def test_silhouette_of_boxes_equals_brute_force(spark, width):
    rng = np.random.default_rng(6)
    rows = [(rng.normal(size=width).tolist(), rng.integers(0, 2, 2).tolist(), int(rng.integers(0, 3))) for _ in range(700)]
    rows += rows[:30] + [([0.5] * width, [0, 1], 2)] * 3 + [([9.0] * width, [0, 0], 7)]
    df = spark.createDataFrame(rows, "num array<double>, slots array<int>, cluster int")
    assert silhouette(df, leaf_rows=8) == pytest.approx(brute_silhouette(rows), abs=1e-10)


def test_boxes_leave_few_pairs(spark):
    places = np.random.default_rng(7).normal(size=(40_000, 2))
    tree = Boxes(places[::20], 512)
    leaf = tree.leaf(places)
    tree.fit({x: (places[leaf == x].min(0), places[leaf == x].max(0)) for x in np.unique(leaf).tolist()}, 2)
    held = np.bincount(leaf, minlength=len(tree.axis))
    assert held.max() < 8 * 40_000 / 512 and held.sum() == 40_000
    for cost in (0.0, 2.0):
        far, near = tree.visits(cost)
        assert sum(len(b) for b in far.values()) < 100 * 512
        assert sum(held[a] * held[b].sum() for a, b in near.items()) < 0.1 * 40_000**2
        leaves = np.flatnonzero(tree.axis < 0)
        inside = lambda node: [node] if tree.axis[node] < 0 else [x for c in tree.child[node] for x in inside(c)]
        for a in leaves[::100].tolist():  # every leaf is reached once
            assert sorted(near[a] + [x for b in far[a] for x in inside(b)]) == leaves.tolist()


def test_scalers_and_encoders(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, "b"), (None, 5.0, "a"), (3.0, 5.0, None), (8.0, 5.0, "b")], "x double, c double, t string"
    )
    x = pd.Series([1, 4, 3, 8.0])
    got = [r["x"] for r in scale_standard(df, ["x", "c"]).collect()]
    assert np.allclose(got, (x - x.mean()) / x.std(ddof=0))
    rows = scale_minmax(df, ["x", "c"]).collect()
    assert np.allclose([r["x"] for r in rows], (x - 1) / 7) and {r["c"] for r in rows} == {0.0}
    assert [r["t_slot"] for r in one_hot(df, ["t"]).orderBy("x").collect()] == [0, 1, 1, 1]
    assert {r["t"]: r["label"] for r in encode_label(df, "t").collect()} == {"a": 0, "b": 1, None: None}


def test_feature_space_vectors_and_variance(spark, tmp_path):
    train = spark.createDataFrame(
        [(float(i % 7), ["u", "v", "w"][i % 3], True, None) for i in range(30)],
        "x double, t string, flag boolean, none double",
    )
    for scaling in ("standard", "minmax"):
        space = FeatureSpace.fit(train, scaling)
        assert space.width == 4  # flags and all-null columns are left out
        matrix = np.array([r["features"].toArray() for r in space.transform(train).collect()])
        assert matrix.shape == (30, 4) and np.allclose(matrix[:, 1:].sum(1), 1)
        assert matrix.var() == pytest.approx(space.variance)
    new = spark.createDataFrame([(None, "zzz"), (1.0, None)], "x double, t string")
    space.save(str(tmp_path / "s"), spark)
    for s in (space, FeatureSpace.load(str(tmp_path / "s"), spark)):
        rows = s.transform(new).collect()
        unseen = next(r for r in rows if r["t"] == "zzz")
        assert unseen["slots"] == [-1] and unseen["features"].toArray()[1:].sum() == 0
        assert next(r for r in rows if r["t"] is None)["slots"] == [0]


def test_network_gradient(spark):
    rng = np.random.default_rng(0)
    rows = [(rng.normal(size=2).tolist(), [int(rng.integers(-1, 3))], float(rng.normal())) for _ in range(50)]
    data = spark.createDataFrame(rows, "num array<double>, slots array<int>, y double")
    w = rng.normal(size=(2 + 3) * 4 + 4 + 4 + 1)
    _, gradient = network._loss(data, w, 2, [3], 4, 50)
    for i in range(0, len(w), 5):
        step = np.zeros_like(w)
        step[i] = 1e-6
        high, low = (network._loss(data, w + s, 2, [3], 4, 50)[0] for s in (step, -step))
        assert gradient[i] == pytest.approx((high - low) / 2e-6, abs=1e-6)


def test_tasks(spark):
    df = spark.createDataFrame([(i, i % 15, f"t{i}") for i in range(40)], "a bigint, b bigint, c string")
    assert infer_task(df, "a") == "Regression" and infer_task(df, "b") == "Classification"
    assert infer_task(df, "c") == "Classification" and infer_task(df, "NONE") == "Clustering"


def test_chosen_models():
    pick = lambda names: list(models.chosen(models.CLASSIFIERS, names))
    assert pick([]) == list(models.CLASSIFIERS)
    assert pick(["SVM", "KNN Regressor"]) == ["KNN Classifier", "SVM (SVC)"]
    assert pick(["linear"]) == ["Logistic Regression"] and pick(["nothing"]) == []
    assert list(models.chosen(models.CLUSTERERS, ["K-Means (k=3)"])) == ["K-Means (k=3)"]
    assert len(models.chosen(models.CLUSTERERS, ["kmeans"])) == 2


def test_trees_grow_alike_at_every_number_of_rows(spark):
    """Every split takes the largest value off, so a tree is as deep as it may grow."""
    data = spark.createDataFrame([([float(i)], 4.0**i) for i in range(32)], "num array<double>, label double")
    data = data.withColumn("features", array_to_vector("num"))
    for rows in (32, 200_000):
        training = models.Training(data, FeatureSpace.fit(data.select("label")), rows, 0, 1)
        assert models.tree_regressor(training).model.depth == 30


def wide_rows(spark):
    """A few rows, said to be of more features than the driver was thought to hold weights for."""
    rows = [(i, [float(i % 7), float(i % 2)], [], float(i % 2)) for i in range(40)]
    data = spark.createDataFrame(rows, "id bigint, num array<double>, slots array<int>, label double")
    data = stage(data.withColumn("features", array_to_vector("num")))  # as a training's rows are
    space = SimpleNamespace(width=30_000_000, variance=1.0, numbers={"a": None, "b": None}, texts=[], sizes={})
    return models.Training(data, space, 40, 2, 1)


def test_wide_classifiers_are_trained(spark):
    t = wide_rows(spark)
    assert models.logistic(t).model.coefficients[1] > 1.0
    assert models.tree_classifier(t).model.depth == 1


def test_wide_regressors_are_trained(spark):
    t = wide_rows(spark)
    for fit in (models.linear, models.mlp_regressor):
        found = fit(t).predict(t.data).agg(F.max(F.abs(F.col("prediction") - F.col("label")))).first()[0]
        assert found < 0.05


def test_network_gradient_is_the_same_added_up_by_tasks(spark, monkeypatch):
    """Rows in blocks of three, levels without rows, and more levels than one task sees."""
    rng = np.random.default_rng(0)
    rows = [(rng.normal(size=1).tolist(), [int(rng.integers(-1, 150)), i % 2], float(rng.normal())) for i in range(300)]
    data = spark.createDataFrame(rows, "num array<double>, slots array<int>, y double").repartition(3)
    w = rng.normal(size=(1 + 200 + 2) * 4 + 4 + 4 + 1)
    loss, gradient = network._loss(data, w, 1, [200, 2], 4, 300)
    monkeypatch.setattr(network, "DIRECT_ROWS", 0)
    again, same = network._loss(data, w, 1, [200, 2], 4, 300)
    assert again == pytest.approx(loss) and np.allclose(same, gradient)
    x = np.zeros((300, 203))
    for i, (num, slots, _) in enumerate(rows):
        x[i, 0], x[i, 201 + slots[1]] = num[0], 1.0
        if slots[0] >= 0:
            x[i, 1 + slots[0]] = 1.0
    first, bias, second, last = w[:812].reshape(203, 4), w[812:816], w[816:820], w[820]
    h = np.maximum(x @ first + bias, 0.0)
    back = np.outer(h @ second + last - [r[2] for r in rows], second) * (h > 0)
    assert np.allclose(gradient[:812].reshape(203, 4) * 300, x.T @ back + network.ALPHA * first)
    assert np.allclose(gradient[812:816] * 300, back.sum(0))


def check_board(result):
    rows = result.leaderboard.collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert not result.skipped
    return {r["model"]: r["score"] for r in rows}


def three_classes(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(180):
        k = i % 3
        x, y = rng.normal([(0, 0), (6, 0), (0, 6)][k], 0.5)
        rows.append((i, float(x), None if i % 20 == 0 else float(y), ["p", "q"][i % 2], ["red", "green", "blue"][k]))
    return spark.createDataFrame(rows, "id bigint, x double, y double, label string, colour string")


def test_classification_run(spark, tmp_path):
    """Three classes, and columns named like the engine's own."""
    df = three_classes(spark)
    families = ["linear", "knn", "tree", "svm", "mlp"]  # the forest is in the regression run
    result = automl(df, "colour", "manual", MlConfig(models=families))
    scores = check_board(result)
    assert result.task == "Classification"
    assert set(scores) == set(models.CLASSIFIERS) - {"Random Forest"}
    assert min(scores.values()) > 80
    result.best.save(str(tmp_path / "m"))
    direct = sorted(map(str, result.best.predict(df).collect()))
    loaded = score_table(spark, str(tmp_path / "m"), df)
    assert sorted(map(str, loaded.collect())) == direct
    assert loaded.columns == [*df.columns, PREDICTED] and loaded.count() == 180
    assert loaded.where(F.col(PREDICTED) == F.col("colour")).count() > 160


def test_regression_run(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), ["u", "v"][i % 2], float(3 * a - b + i % 2)) for i, (a, b) in enumerate(rng.normal(size=(150, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, kind string, y double")
    result = automl(df, "y")
    scores = check_board(result)
    assert result.task == "Regression" and set(scores) == set(models.REGRESSORS)
    assert scores["Linear Regression"] > 99.9 and scores["Neural Network (MLP)"] > 95
    assert scores["SVM (SVR)"] > 80
    for seq, name in enumerate(("KNN Regressor", "SVM (SVR)", "Neural Network (MLP)")):
        # Kinds of model that are not one Spark ML stage have their own way to disk.
        only = automl(df, "y", "manual", MlConfig(models=[name])).best
        only.save(str(tmp_path / str(seq)))
        a = sorted(r[PREDICTED] for r in only.predict(df).collect())
        b = sorted(r[PREDICTED] for r in score_table(spark, str(tmp_path / str(seq)), df).collect())
        assert np.allclose(a, b)


def test_clustering_run(spark):
    result = automl(three_classes(spark).drop("id", "colour", "label"), "NONE")
    scores = check_board(result)
    assert result.best.name == "K-Means (k=3)" and scores["K-Means (k=3)"] > 60
    assert result.best.predict(three_classes(spark)).select(PREDICTED).distinct().count() == 3


def test_wrong_requests(spark):
    df = load(spark, SMALL, "ml_reg")
    with pytest.raises(ValueError, match="not found"):
        automl(df, "absent")
    with pytest.raises(ValueError, match="none of the models"):
        automl(df, "price", "manual", MlConfig(models=["kmeans"]))
