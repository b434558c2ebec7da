"""Infer the task, train the candidates, rank them, keep the best, score new rows."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleamline.ml import models
from gleamline.ml.features import FeatureSpace, label_table
from gleamline.ml.silhouette import silhouette
from gleamline.ml.split import split_exact
from gleamline.operators.lookup import is_small, lookup
from gleamline.plans import leaderboard as board
from gleamline.session import spread, stage
from gleamline.types import MlConfig, col, columns_of, conform

NO_TARGET = "NONE"
FEW_VALUES = 15
PREDICTED = "Predicted_Result"
ROW_ID = "__row_id"
METRICS = {
    "Classification": "Accuracy",
    "Regression": "R-Square",
    "Clustering": "Silhouette Score",
}
CANDIDATES = {
    "Classification": models.CLASSIFIERS,
    "Regression": models.REGRESSORS,
    "Clustering": models.CLUSTERERS,
}
log = logging.getLogger(__name__)


def infer_task(df: DataFrame, target: str) -> str:
    """Clustering without a target; text or few distinct values classify; else regression."""
    if target == NO_TARGET:
        return "Clustering"
    if target in columns_of(df, "text"):
        return "Classification"
    values = df.select(col(target)).where(col(target).isNotNull()).distinct()
    few = values.limit(FEW_VALUES + 1).count() <= FEW_VALUES
    return "Classification" if few else "Regression"


@dataclass
class Pipeline:
    """The fitted feature space and model, with the table that names the classes."""

    task: str
    name: str
    columns: list[str]
    space: FeatureSpace
    fitted: models.Fitted
    labels: DataFrame | None = None

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``Predicted_Result`` to rows with the training columns."""
        rows = stage(conform(df).withColumn(ROW_ID, F.monotonically_increasing_id()))
        features = self.space.transform(feature_view(rows, self.columns))
        found = self.fitted.predict(features).select(F.col("id").alias(ROW_ID), "prediction")
        if self.task == "Regression":
            found = found.withColumnRenamed("prediction", PREDICTED)
        elif self.task == "Clustering":
            found = found.withColumn(PREDICTED, F.col("prediction").cast("bigint")).drop("prediction")
        else:
            small = is_small(self.labels, "value")
            label = F.col("prediction").cast("bigint")
            found = lookup(found, label, self.labels, "label", "value", PREDICTED, small).drop("prediction")
        return rows.join(found, ROW_ID).drop(ROW_ID)

    def save(self, path: str) -> None:
        """Write the whole pipeline below ``path``."""
        spark = SparkSession.active()
        note = json.dumps({"task": self.task, "name": self.name, "columns": self.columns})
        spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/pipeline"
        )
        self.space.save(path, spark)
        self.fitted.save(path, spark)
        if self.labels is not None:
            self.labels.write.mode("overwrite").parquet(f"{path}/labels")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "Pipeline":
        note = json.loads(spark.read.text(f"{path}/pipeline").first()["value"])
        labels = None
        if note["task"] == "Classification":
            labels = spark.read.parquet(f"{path}/labels")
        space, fitted = FeatureSpace.load(path, spark), models.Fitted.load(path, spark)
        return cls(note["task"], note["name"], note["columns"], space, fitted, labels)


def feature_view(rows: DataFrame, columns: list[str], *others) -> DataFrame:
    """``id`` and the features under names of their own, so no user column can collide."""
    named = [col(n).alias(f"x{i}") for i, n in enumerate(columns)]
    return rows.select(F.col(ROW_ID).alias("id"), *others, *named)


def save_model(pipeline: Pipeline, path: str) -> None:
    pipeline.save(path)


def score_table(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """Load a saved pipeline and add its predictions to ``df``."""
    return Pipeline.load(path, spark).predict(df)


@dataclass
class AutoMlResult:
    task: str
    scores: DataFrame
    leaderboard: DataFrame
    best: Pipeline
    skipped: dict[str, str]


def automl(
    df: DataFrame,
    target: str,
    mode: str = "auto",
    config: MlConfig | None = None,
    key: list[str] | None = None,
    silhouette_metric: str = "euclidean",
) -> AutoMlResult:
    """Train and rank the candidates of the inferred task.

    The feature space is fitted once on the training rows and shared by all
    candidates.  A candidate that fails is skipped and reported.  ``key`` names
    columns that identify a row; without it rows are numbered once, and the
    numbering is written so that a rerun task sees the same rows.
    """
    config = config if config is not None and mode == "manual" else MlConfig()
    spark, table = df.sparkSession, conform(df)
    if target != NO_TARGET:
        if target not in table.columns:
            raise ValueError(f"Target column '{target}' not found.")
        table = table.where(col(target).isNotNull())
    table = stage(table.withColumn(ROW_ID, F.monotonically_increasing_id()))
    task = infer_task(table, target)
    candidates = models.chosen(CANDIDATES[task], config.models)
    if not candidates:
        raise ValueError(f"none of the models {config.models} fits the task {task}")

    columns = [n for n in table.columns if n not in (ROW_ID, target, *config.drop_columns)]
    if task == "Clustering":
        train = test = feature_view(table, columns)
    else:
        train, test = [
            feature_view(part, columns, col(target).alias("target"))
            for part in split_exact(table, key or [ROW_ID], seed=config.seed)
        ]
    space = FeatureSpace.fit(train.select(*[f"x{i}" for i in range(len(columns))]), config.scaling)
    labels = None
    if task == "Classification":
        labels = stage(label_table(table, target))
        small = is_small(labels, "value")
        train, test = [
            lookup(part, F.col("target"), labels, "value", "label", "label", small)
            for part in (train, test)
        ]
    elif task == "Regression":
        train, test = [part.withColumnRenamed("target", "label") for part in (train, test)]
    carried = ["id", "num", "slots", "features"]
    if task != "Clustering":
        carried.append(F.col("label").cast("double").alias("label"))
    train = stage(space.transform(train).select(*carried))
    rows = train.count()
    train = spread(train, rows, "id")
    if task == "Clustering":
        test = train
    else:
        test = stage(space.transform(test).select(*carried))
        test = spread(test, test.count(), "id")
    classes = labels.count() if labels is not None else 0
    training = models.Training(train, space, rows, classes, config.seed)

    scored, fitted, skipped = [], {}, {}
    for seq, (name, fit) in enumerate(candidates.items(), start=1):
        try:
            fitted[name] = fit(training)
            value = _score(task, fitted[name].predict(test), silhouette_metric)
            scored.append((seq, name, value, METRICS[task]))
        except Exception as e:  # a failing candidate does not stop the others
            log.warning("%s skipped: %s", name, e)
            skipped[name] = str(e)
    if not scored:
        raise RuntimeError(f"every candidate failed: {skipped}")
    scores = spark.createDataFrame(scored, "seq int, model string, score double, metric string")
    best = max(scored, key=lambda s: (s[2], -s[0]))[1]
    pipeline = Pipeline(task, best, columns, space, fitted[best], labels)
    return AutoMlResult(task, scores, board.leaderboard(scores), pipeline, skipped)


def _score(task: str, predicted: DataFrame, silhouette_metric: str) -> float:
    if task == "Classification":
        hit = (F.col("prediction") == F.col("label")).cast("double")
        return float(predicted.agg(F.avg(hit)).first()[0])
    if task == "Regression":
        return float(RegressionEvaluator(metricName="r2").evaluate(predicted))
    clustered = predicted.select("num", "slots", F.col("prediction").alias("cluster"))
    return silhouette(clustered, silhouette_metric)
