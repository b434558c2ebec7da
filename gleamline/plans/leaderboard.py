"""Ranking of scored models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leaderboard(scores: DataFrame) -> DataFrame:
    """Rank ``(seq, model, score, metric)`` by the rounded percentage, then training order.

    One row per trained model, so a single window suffices.
    """
    percent = F.rint(F.col("score") * 10000) / 100
    place = F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("seq")))
    return (
        scores.withColumn("score", percent)
        .withColumn("rank", place)
        .select("rank", "model", "score", "metric")
    )


def best_model(scores: DataFrame) -> DataFrame:
    """The model with the largest unrounded score; the first trained wins ties."""
    first = F.max_by("model", F.struct(F.col("score"), -F.col("seq")))
    return scores.agg(first.alias("best_model"))
