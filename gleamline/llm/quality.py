"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

Each document has a vector of transformed statistics.  For every language and source the estimate of
place and scatter is that of the half of its documents with the smallest scatter: from medians and
median deviations, concentration steps take the nearest half by Mahalanobis distance, and the mean
and covariance of that half, until the scatter's determinant no longer falls.  All documents count;
every sum and rank is an aggregate by group over whole numbers, so no group is gathered and no result
depends on the order of rows.

A document is rejected beyond ``CUT`` times the distance its group's nearest half reaches, scaled to
that of a normal vector, and only if it lies on the side of more symbols, repeats or longer words.

Groups of fewer than ``LEAST`` documents share the estimate of the language's small groups, and of all
small ones where those are few; without enough documents at all nothing is rejected.

Defined cases: a null text has no words and fails the base rule.  Null languages and sources are groups
of their own.  Rows that repeat count each.  Null identifiers are passed on.  An empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleamline.llm.common import bounded, column
from gleamline.session import stage

SYMBOLS = b"#*$%&|<>"
#: Parts of a unit that statistics are counted in: whole numbers make sums exact.
UNIT = 256
LEAST = 100
STEPS = 4
#: Least standard deviation of each statistic, in units: what differs by less is no outlier.
FLOOR = (0.5, 0.06, 0.05, 0.05, 0.06)
#: A rejected document's squared distance is over this: 99.99 % of normal vectors are below it.
CUT = 25.7
#: Median of the squared distance of a normal vector of five statistics.
_CHI_MEDIAN = 4.3515
STATS = ("x0", "x1", "x2", "x3", "x4")


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, b"\t\n\x0b\x0c\r ")))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    repeats = 0
    if n >= 4:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        k = len(number)
        if k**3 < 1 << 62:
            window = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
        else:
            _, pair = np.unique(ids[:-2] * k + ids[1:-1], return_inverse=True)
            window = pair * k + ids[2:]
        order = np.argsort(window, kind="stable")
        same = np.diff(window[order]) == 0
        if same.any():
            twice = np.zeros(len(window), bool)
            twice[order[:-1][same]] = True
            twice[order[1:][same]] = True
            covered = np.zeros(n, bool)
            for j in range(3):
                covered[j : n - 2 + j] |= twice
            repeats = int(covered.sum())
    return n, chars, symbols, dup, repeats


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the measures, ``base_failed`` and the vector x0 to x4 of every document."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(batches, 3, 4 << 20):
            m = np.array([measures(t) for t in part.column(3).to_pylist()], np.int64).T
            lines = np.array([(t or "").count("\n") + 1 for t in part.column(3).to_pylist()], float)
            n = np.maximum(m[0], 1)
            x = [np.log(n), np.log1p(m[1] / n), np.log1p(m[2] / n), np.log1p(m[3] / lines), np.log1p(m[4] / n)]
            units = [pa.array(np.rint(v * UNIT).astype(np.int64)) for v in x]
            failed = pa.array((m[0] < 50) | (100 * m[4] > 50 * m[0]))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], *map(pa.array, m), failed, *units],
                names=["doc_id", "lang", "source", *names, "base_failed", *STATS],
            )

    rows = docs.select(
        column("doc_id").alias("doc_id"), column("lang").cast("string").alias("lang"),
        column("source").cast("string").alias("source"), column("text").cast("string").alias("text"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in names)
    return rows.mapInArrow(
        run, f"doc_id {kind}, lang string, source string, {longs}, base_failed boolean, " + ", ".join(f"{c} long" for c in STATS)
    )


def _rank_value(counts: DataFrame, by: list[str], value: str, n: str, share: float) -> DataFrame:
    """Per ``by``, the smallest ``value`` up to which ``share`` of the rows counted in ``n`` lie.

    ``counts`` has a row per ``by`` and value, and values are few: numbers of units, not of rows.
    """
    upto = F.sum(n).over(Window.partitionBy(*by).orderBy(value))
    total = F.sum(n).over(Window.partitionBy(*by))
    return (
        counts.withColumns({"__upto": upto, "__total": total})
        .filter(F.col("__upto") >= F.ceil(F.col("__total") * share))
        .groupBy(*by)
        .agg(F.min(value).alias(value))
    )


def _grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with ``g``: their language and source, or a wider group where that has too few rows."""
    g = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    lang = F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})
    sizes = rows.filter(~F.col("base_failed")).groupBy(g.alias("own"), lang.alias("wide")).count()
    wide = sizes.filter(F.col("count") < LEAST).groupBy("wide").agg(F.sum("count").alias("wide_count"))
    named = sizes.join(wide, "wide", "left").select(
        "own",
        F.when(F.col("count") >= LEAST, F.col("own"))
        .when(F.col("wide_count") >= LEAST, F.col("wide"))
        .otherwise("all")
        .alias("g"),
    )
    return rows.withColumn("own", g).join(named, "own", "left").drop("own")


def _moments() -> list:
    sums = [F.sum(x).alias(f"s_{x}") for x in STATS]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(STATS) for b in STATS[i:]]
    return [F.count("*").alias("n"), *sums, *products]


def _shape(pdf: pd.DataFrame) -> pd.DataFrame:
    """Place, inverse scatter and log determinant of each group, from its moments."""
    out = []
    floor = np.diag((np.array(FLOOR) * UNIT) ** 2)
    for r in pdf.to_dict("records"):
        mean = np.array([float(r[f"s_{x}"]) for x in STATS]) / r["n"]
        cov = np.zeros((5, 5))
        for i, a in enumerate(STATS):
            for j, b in enumerate(STATS[i:], i):
                cov[i, j] = cov[j, i] = float(r[f"p_{a}_{b}"]) / r["n"] - mean[i] * mean[j]
        out.append(_entry(r["g"], mean, cov + floor))
    return pd.DataFrame(out, columns=["g", "place", "inverse", "logdet"])


def _entry(g: str, mean: np.ndarray, cov: np.ndarray) -> tuple:
    return g, mean.tolist(), np.linalg.inv(cov).reshape(-1).tolist(), float(np.linalg.slogdet(cov)[1])


def _first_shape(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in pdf.to_dict("records"):
        spread = np.maximum(np.array([r[f"mad_{x}"] for x in STATS]) * 1.4826, np.array(FLOOR) * UNIT)
        out.append(_entry(r["g"], np.array([float(r[f"med_{x}"]) for x in STATS]), np.diag(spread**2)))
    return pd.DataFrame(out, columns=["g", "place", "inverse", "logdet"])


_SHAPE = "g string, place array<double>, inverse array<double>, logdet double"


def _each(pdf_fn):
    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf_fn(pdf)

    return run


def _centres(rows: DataFrame) -> DataFrame:
    """Median and median deviation of each statistic by group."""
    long = rows.select("g", F.explode(F.array(*[F.struct(F.lit(x).alias("stat"), F.col(x).alias("v")) for x in STATS])).alias("e"))
    counts = stage(long.select("g", "e.stat", "e.v").groupBy("g", "stat", "v").agg(F.count("*").alias("n")))
    medians = _rank_value(counts, ["g", "stat"], "v", "n", 0.5).withColumnRenamed("v", "med")
    apart = counts.join(medians, ["g", "stat"]).select("g", "stat", F.abs(F.col("v") - F.col("med")).alias("d"), "n")
    mads = _rank_value(apart.groupBy("g", "stat", "d").agg(F.sum("n").alias("n")), ["g", "stat"], "d", "n", 0.5)
    both = medians.join(mads, ["g", "stat"]).groupBy("g")
    return both.agg(
        *[F.max(F.when(F.col("stat") == x, F.col("med"))).alias(f"med_{x}") for x in STATS],
        *[F.max(F.when(F.col("stat") == x, F.col("d"))).alias(f"mad_{x}") for x in STATS],
    )


def _distance():
    """Squared Mahalanobis distance, in sixty-fourths, of a row joined with its group's shape."""
    apart = [F.col(x) - F.col("place")[i] for i, x in enumerate(STATS)]
    total = F.lit(0.0)
    for i in range(5):
        for j in range(5):
            total = total + apart[i] * apart[j] * F.col("inverse")[5 * i + j]
    # Far ones are far: a bound keeps the numbers of distances to be ranked few.
    return F.round(F.least(total, F.lit(4096.0)) * 64).cast("long")


def robust_shapes(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """(g, place, inverse, half): each group's estimate and the distance its nearest half reaches."""
    shape = stage(_centres(rows).mapInPandas(_each(_first_shape), _SHAPE))
    for step in range(steps + 1):
        near = rows.join(shape, "g").withColumn("d", _distance())
        counts = near.groupBy("g", "d").agg(F.count("*").alias("n"))
        half = _rank_value(counts, ["g"], "d", "n", 0.5).withColumnRenamed("d", "half")
        if step == steps:
            return shape.join(half, "g").select("g", "place", "inverse", "half")
        inner = near.join(half, "g").filter("d <= half").groupBy("g").agg(*_moments())
        moved = inner.mapInPandas(_each(_shape), _SHAPE)
        old = shape.select("g", *(F.col(c).alias(f"old_{c}") for c in ("place", "inverse", "logdet")))
        # A step that doesn't concentrate is not taken; the first one always is.
        better = F.lit(step == 0) | (F.col("logdet") < F.col("old_logdet"))
        shape = stage(
            moved.join(old, "g").select(
                "g", *(F.when(better, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in ("place", "inverse", "logdet"))
            )
        )


def judge(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, the measures, base_failed, kept, distance: the verdict on every document."""
    rows = stage(_grouped(stage(statistics(docs))))
    counted = rows.filter(~F.col("base_failed"))
    enough = counted.groupBy("g").count().filter(F.col("count") >= LEAST).select("g")
    shapes = stage(robust_shapes(counted.join(enough, "g")))
    scale = F.lit(_CHI_MEDIAN) / F.greatest(F.col("half") / 64.0, F.lit(_CHI_MEDIAN))
    worse = F.lit(False)
    for i in range(1, 5):
        # Beyond the cut in a statistic of its own, on the side of junk.
        apart = (F.col(STATS[i]) - F.col("place")[i]) / UNIT
        worse = worse | (apart > 3 * FLOOR[i])
    judged = rows.join(shapes, "g", "left").withColumn("distance", _distance() / 64.0 * scale)
    outlier = F.coalesce((F.col("distance") > cut) & worse, F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~outlier).alias("kept"), "distance",
    )
