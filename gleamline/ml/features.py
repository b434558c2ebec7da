"""Feature space: imputation, scaling and one-hot slots, fitted on the training rows."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleamline.operators import stats
from gleamline.operators.lookup import dense_index, fits_broadcast, is_small, lookup
from gleamline.session import stage
from gleamline.types import col, columns_of, replace_columns


def feature_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and text feature names; every other type is left out."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, (T.LongType, T.DoubleType))]
    return numbers, columns_of(df, "text")


@dataclass
class NumberStats:
    mean: float
    std: float
    low: float
    high: float


def number_stats(df: DataFrame, names: list[str]) -> dict[str, NumberStats]:
    """Mean, spread and range with nulls at the mean; all-null columns are left out.

    Imputed cells add nothing to the squared deviations, so the spread of the
    imputed column follows from that of the present cells.
    """
    if not names:
        return {}
    parts = {"mean": F.avg, "std": F.stddev_pop, "low": F.min, "high": F.max, "n": F.count}
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(col(n).cast("double")).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in parts.items()],
    ).first()
    out = {}
    for i, n in enumerate(names):
        if row[f"n{i}"]:
            shrink = math.sqrt(row[f"n{i}"] / row["rows"])
            out[n] = NumberStats(
                row[f"mean{i}"], row[f"std{i}"] * shrink, row[f"low{i}"], row[f"high{i}"]
            )
    return out


def scaled(c: Column, s: NumberStats, scaling: str) -> Column:
    """Impute with the mean and scale; a constant column becomes 0."""
    start, width = (s.low, s.high - s.low) if scaling == "minmax" else (s.mean, s.std)
    filled = F.coalesce(c.cast("double"), F.lit(s.mean))
    return (filled - F.lit(start)) / F.lit(width) if width else filled * 0.0


def scale_columns(df: DataFrame, names: list[str], scaling: str) -> DataFrame:
    found = number_stats(df, names)
    return replace_columns(df, {n: scaled(col(n), s, scaling) for n, s in found.items()})


def scale_standard(df: DataFrame, names: list[str]) -> DataFrame:
    return scale_columns(df, names, "standard")


def scale_minmax(df: DataFrame, names: list[str]) -> DataFrame:
    return scale_columns(df, names, "minmax")


def label_table(df: DataFrame, target: str) -> DataFrame:
    """``(value, label)``: the distinct targets numbered in their order."""
    values = df.select(col(target).alias("value")).where("value IS NOT NULL").distinct()
    return dense_index(values, ["value"], "label")


def encode_label(df: DataFrame, target: str, labels: DataFrame | None = None) -> DataFrame:
    """Add ``label``, the target's place among its sorted distinct values."""
    labels = labels if labels is not None else label_table(df, target)
    small = is_small(labels, "value")
    return lookup(df, col(target), labels, "value", "label", "label", small)


def vocabulary(df: DataFrame, names: list[str]) -> DataFrame:
    """``(column, value, slot)``: the levels of each text column, numbered from 0 in order."""
    levels = stats.unpivot(df, names).where("value IS NOT NULL").distinct()
    numbered = dense_index(levels, ["column", "value"], "place")
    first = numbered.groupBy("column").agg(F.min("place").alias("first"))
    # One row per text column.
    return numbered.join(F.broadcast(first), "column").select(
        "column", "value", (F.col("place") - F.col("first")).alias("slot")
    )


def sizes_of(levels: DataFrame) -> DataFrame:
    return levels.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("chars")
    )


def one_hot(df: DataFrame, names: list[str]) -> DataFrame:
    """Replace each text column by its level's slot; the vector has a one there.

    Nulls take the most frequent level.
    """
    fills = {r["column"]: r["value"] for r in stats.modes(df, names).collect()}
    levels = vocabulary(df, names)
    for n in names:
        own = levels.where(F.col("column") == n)
        value = F.coalesce(col(n), F.lit(fills.get(n)))
        df = lookup(df, value, own, "value", "slot", f"{n}_slot", is_small(own, "value"))
    return df.select(*[col(c) for c in df.columns if c not in names])


@dataclass
class FeatureSpace:
    """Fitted preprocessing.

    ``transform`` adds ``num`` (scaled numbers), ``slots`` (one level number per
    text column, -1 when unseen) and ``features`` (the vector of both).  The
    levels stay a table: they are joined, never collected.
    """

    numbers: dict[str, NumberStats]
    texts: list[str]
    fills: dict[str, str]
    sizes: dict[str, int]
    small: dict[str, bool]
    scaling: str
    levels: DataFrame | None

    @classmethod
    def fit(cls, train: DataFrame, scaling: str = "standard") -> "FeatureSpace":
        numbers, texts = feature_columns(train)
        fills, sizes, small, levels = {}, {}, {}, None
        if texts:
            fills = {r["column"]: r["value"] for r in stats.modes(train, texts).collect()}
            texts = [n for n in texts if n in fills]  # an all-null column has no level
        if texts:
            levels = stage(vocabulary(train, texts))
            for r in sizes_of(levels).collect():  # one row per text column
                sizes[r["column"]] = r["n"]
                small[r["column"]] = fits_broadcast(r["n"], r["chars"])
        return cls(number_stats(train, numbers), texts, fills, sizes, small, scaling, levels)

    @property
    def width(self) -> int:
        return len(self.numbers) + sum(self.sizes.values())

    @property
    def variance(self) -> float:
        """Variance over all cells of the transformed training matrix."""
        total = len(self.texts)
        squares = float(len(self.texts))
        for s in self.numbers.values():
            width = s.high - s.low
            if self.scaling == "minmax":
                mean, spread = ((s.mean - s.low) / width, s.std / width) if width else (0.0, 0.0)
            else:
                mean, spread = 0.0, 1.0 if s.std else 0.0
            total += mean
            squares += spread**2 + mean**2
        return squares / self.width - (total / self.width) ** 2

    def transform(self, df: DataFrame) -> DataFrame:
        kept = df.columns
        nums = [scaled(col(n), s, self.scaling) for n, s in self.numbers.items()]
        for i, n in enumerate(self.texts):
            own = self.levels.where(F.col("column") == n)
            value = F.coalesce(col(n).cast("string"), F.lit(self.fills[n]))
            df = lookup(df, value, own, "value", "slot", f"__slot{i}", self.small[n])
        slots = [F.coalesce(F.col(f"__slot{i}"), F.lit(-1)).cast("int") for i in range(len(self.texts))]
        # A level number past the last one encodes as the zero vector.
        hot = [
            F.when(s < 0, F.lit(self.sizes[n])).otherwise(s).cast("double").alias(
                f"__hot{i}", metadata=_nominal(self.sizes[n])
            )
            for i, (n, s) in enumerate(zip(self.texts, slots))
        ]
        out = df.select(
            *[col(c) for c in kept],
            (F.array(*nums) if nums else F.array().cast("array<double>")).alias("num"),
            (F.array(*slots) if slots else F.array().cast("array<int>")).alias("slots"),
            *hot,
        )
        return self._vectors(out).select(*[col(c) for c in kept], "num", "slots", "features")

    def _vectors(self, df: DataFrame) -> DataFrame:
        inputs = []
        if self.numbers:
            df = df.withColumn("__num", array_to_vector("num"))
            inputs.append("__num")
        if self.texts:
            hot = [f"__hot{i}" for i in range(len(self.texts))]
            vectors = [f"__vec{i}" for i in range(len(self.texts))]
            encoder = OneHotEncoder(inputCols=hot, outputCols=vectors, handleInvalid="keep")
            df = encoder.fit(df).transform(df)
            inputs += vectors
        if self.numbers:
            hint = VectorSizeHint(inputCol="__num", size=len(self.numbers), handleInvalid="optimistic")
            df = hint.transform(df)
        return VectorAssembler(inputCols=inputs, outputCol="features").transform(df)

    def save(self, path: str, spark: SparkSession) -> None:
        state = {
            "numbers": {n: vars(s) for n, s in self.numbers.items()},
            "texts": self.texts,
            "fills": self.fills,
            "sizes": self.sizes,
            "small": self.small,
            "scaling": self.scaling,
        }
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/space")
        if self.levels is not None:
            self.levels.write.mode("overwrite").parquet(f"{path}/levels")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "FeatureSpace":
        state = json.loads(spark.read.text(f"{path}/space").first()["value"])
        state["numbers"] = {n: NumberStats(**s) for n, s in state["numbers"].items()}
        levels = spark.read.parquet(f"{path}/levels") if state["texts"] else None
        return cls(**state, levels=levels)


def _nominal(size: int) -> dict:
    return {"ml_attr": {"type": "nominal", "num_vals": size}}
