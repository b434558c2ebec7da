"""Candidate models and what each leaves behind once fitted.

A fitted model adds ``prediction`` to rows with ``id``, ``num``, ``slots`` and
``features``, and can be written to and read from a folder.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession

from gleamline.ml import kernel, network
from gleamline.ml.features import FeatureSpace
from gleamline.ml.nearest import knn_predict

# As deep as Spark's trees can grow, at every number of rows.  A tree's nodes live on the driver, at most two per row.
DEPTH = 30
HIDDEN = 100


@dataclass
class Training:
    """What a candidate sees: the transformed training rows and their description."""

    data: DataFrame
    space: FeatureSpace
    rows: int
    classes: int
    seed: int


@dataclass
class Fitted:
    """A Spark ML model, a neighbour table, a network or a kernel machine."""

    kind: str
    model: Model | None = None
    table: DataFrame | None = None
    state: dict = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        if self.kind == "knn":
            found = knn_predict(df, self.table, self.state["classify"])
            return df.join(found, "id")
        if self.kind == "network":
            return network.predict(df, self.state)
        if self.kind == "kernel":
            return kernel.predict(df, self.state)
        return self.model.transform(df)

    def save(self, path: str, spark: SparkSession) -> None:
        note = json.dumps({"kind": self.kind, "state": self.state})
        spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/fitted"
        )
        if self.model is not None:
            PipelineModel([self.model]).write().overwrite().save(f"{path}/model")
        if self.table is not None:
            self.table.write.mode("overwrite").parquet(f"{path}/table")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "Fitted":
        note = json.loads(spark.read.text(f"{path}/fitted").first()["value"])
        model = table = None
        if note["kind"] == "spark":
            model = PipelineModel.load(f"{path}/model").stages[0]
        if note["kind"] == "knn":
            table = spark.read.parquet(f"{path}/table")
        return cls(note["kind"], model, table, note["state"])


def _spark(estimator, t: Training) -> Fitted:
    return Fitted("spark", estimator.fit(t.data))


def _knn(t: Training, classify: bool) -> Fitted:
    table = t.data.select("id", "num", "slots", "label")
    return Fitted("knn", table=table, state={"classify": classify})


def _kernel_machine(t: Training, classes: int = 0, epsilon: float | None = None) -> Fitted:
    wide = (len(t.space.numbers), len(t.space.texts))
    gamma = 1.0 / (t.space.width * (t.space.variance or 1.0))
    state = kernel.prepare(t.data, wide, gamma, t.seed)
    return Fitted("kernel", state=kernel.fit(t.data, state, t.rows, classes, epsilon))


def logistic(t: Training) -> Fitted:
    return _spark(LogisticRegression(maxIter=1000, regParam=1.0 / t.rows, standardization=False), t)


def knn_classifier(t: Training) -> Fitted:
    return _knn(t, classify=True)


# Deep trees remember each row's node, or every level would walk all trees again.
def tree_classifier(t: Training) -> Fitted:
    return _spark(DecisionTreeClassifier(seed=t.seed, maxDepth=DEPTH, cacheNodeIds=True), t)


def forest_classifier(t: Training) -> Fitted:
    return _spark(RandomForestClassifier(seed=t.seed, numTrees=100, maxDepth=DEPTH, cacheNodeIds=True), t)


def svm_classifier(t: Training) -> Fitted:
    return _kernel_machine(t, classes=t.classes)


def mlp_classifier(t: Training) -> Fitted:
    layers = [t.space.width, HIDDEN, t.classes]
    estimator = MultilayerPerceptronClassifier(layers=layers, maxIter=500, seed=t.seed)
    return _spark(estimator, t)


def linear(t: Training) -> Fitted:
    return _spark(LinearRegression(regParam=0.0), t)


def knn_regressor(t: Training) -> Fitted:
    return _knn(t, classify=False)


def tree_regressor(t: Training) -> Fitted:
    return _spark(DecisionTreeRegressor(seed=t.seed, maxDepth=DEPTH, cacheNodeIds=True), t)


def forest_regressor(t: Training) -> Fitted:
    return _spark(RandomForestRegressor(seed=t.seed, numTrees=100, maxDepth=DEPTH, cacheNodeIds=True), t)


def svm_regressor(t: Training) -> Fitted:
    return _kernel_machine(t, epsilon=kernel.EPSILON)


def mlp_regressor(t: Training) -> Fitted:
    return Fitted("network", state=network.fit(t.data, t.space, HIDDEN, 500, t.seed))


def kmeans(k: int):
    return lambda t: _spark(KMeans(k=k, seed=t.seed), t)


# Names, in training order.
CLASSIFIERS = {
    "Logistic Regression": logistic,
    "KNN Classifier": knn_classifier,
    "Decision Tree": tree_classifier,
    "Random Forest": forest_classifier,
    "SVM (SVC)": svm_classifier,
    "Neural Network (MLP)": mlp_classifier,
}
REGRESSORS = {
    "Linear Regression": linear,
    "KNN Regressor": knn_regressor,
    "Decision Tree": tree_regressor,
    "Random Forest": forest_regressor,
    "SVM (SVR)": svm_regressor,
    "Neural Network (MLP)": mlp_regressor,
}
CLUSTERERS = {"K-Means (k=3)": kmeans(3), "K-Means (k=5)": kmeans(5)}

# A family name, or a name of another task, stands for the member of this task.
FAMILIES = {
    "linear": ("Logistic Regression", "Linear Regression"),
    "knn": ("KNN Classifier", "KNN Regressor"),
    "tree": ("Decision Tree",),
    "forest": ("Random Forest",),
    "svm": ("SVM (SVC)", "SVM (SVR)", "SVM"),
    "mlp": ("Neural Network (MLP)",),
    "kmeans": ("K-Means (k=3)", "K-Means (k=5)"),
}


def chosen(candidates: dict, wanted: list[str]) -> dict:
    """The candidates named by model or by family; an empty list keeps all."""
    if not wanted:
        return dict(candidates)
    names = set()
    for w in wanted:
        names.add(w)
        for family, members in FAMILIES.items():
            # K-Means names pick one k, so only the family name expands.
            if w == family or (w in members and family != "kmeans"):
                names.update(members)
    return {n: f for n, f in candidates.items() if n in names}
