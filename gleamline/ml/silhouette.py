"""Silhouette of a clustering.

The Euclidean form adds up distances only where they can matter: from a row to its own cluster, and to those clusters
that can be its nearest other one.  The sums of squared distances to a cluster, which are linear work, bound its mean
distance on both sides: it is at least the distance to the cluster's mean, and at most the root of the mean squared
distance.  A cluster whose lower bound is above another's upper bound isn't visited; the others are summed exactly.

Rows that ask and rows that are asked are cut into blocks of bounded size, and each task adds up, per row of one block,
the distances to another; no pair of rows is ever a record.  The squared form needs only sums per cluster.

A large table with few numbers and few combinations of levels is laid out in a tree of boxes instead, and its rows are
summed against all clusters.  Distances between boxes that lie apart are smooth, so they are interpolated: the
weights of a box's rows are moved to ``NODES`` Chebyshev points a dimension, and what these give at the points of the
asking box is read off at its rows.  Boxes count as apart where the error of that falls by ``FALL`` a point, below 1e-9 of
a distance altogether; rows of boxes that don't are summed pair by pair.  The work so grows with the rows, not their
square.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleamline.ml.nearest import _kernel, _widths
from gleamline.session import stage

BLOCK_ROWS = 4096
# Rows of a leaf of the tree of boxes, about; a table of no more than 32 leaves is summed in blocks.
LEAF_ROWS = 2048
TREE_LEAVES = 32
# Chebyshev points a dimension of a box, and the factor by which each more lowers the error.
NODES = 16
FALL = 4.0
# Numbers and combinations of levels with which a tree of boxes pays.
TREE_NUMBERS, TREE_LEVELS = 2, 64
# Numbers in the weights of all boxes together: these are sent to every task.
TREE_WEIGHTS = 8_000_000
# Rows whose places in space decide where boxes are cut.
SAMPLE_ROWS = 200_000


def silhouette(
    df: DataFrame, metric: str = "euclidean", block_rows: int = BLOCK_ROWS, leaf_rows: int = LEAF_ROWS
) -> float:
    """Mean silhouette of rows with ``num``, ``slots`` and ``cluster``; 0 for one cluster."""
    sizes = {r["cluster"]: r["n"] for r in df.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return 0.0
    row = silhouette_rows(df, sizes, metric, block_rows, leaf_rows).agg(
        (F.sum(F.col("silhouette") * F.col("copies")) / F.sum("copies")).alias("s")
    )
    return float(row.first()["s"])


def silhouette_rows(
    df: DataFrame, sizes: dict[int, int], metric: str = "euclidean", block_rows: int = BLOCK_ROWS, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """Silhouette per distinct row, with its number of copies."""
    # Equal rows share their value: a row repeated across the table is one row here.
    points = stage(
        df.groupBy("num", "slots", "cluster")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    order = sorted(sizes)
    if metric == "euclidean":
        levels = _levels(points, leaf_rows)
        totals = _euclidean_totals(points, order, sizes, block_rows) if levels is None else _tree_totals(points, order, levels, leaf_rows)
    elif metric == "squared":
        totals = _squared_totals(points, order, sizes)
    else:
        raise ValueError(f"unknown silhouette metric '{metric}'")
    scored = points.select("id", "cluster", "copies").join(totals, "id")
    own, other = F.lit(None).cast("double"), F.lit(float("inf"))
    count = F.lit(None).cast("bigint")
    for i, c in enumerate(order):
        total = F.col("totals")[i]
        is_own = F.col("cluster") == c
        own = F.when(is_own, F.try_divide(total, F.lit(sizes[c] - 1))).otherwise(own)
        count = F.when(is_own, F.lit(sizes[c])).otherwise(count)
        other = F.when(is_own, other).otherwise(F.least(other, total / sizes[c]))
    value = F.coalesce(F.try_divide(other - own, F.greatest(other, own)), F.lit(0.0))
    return scored.select(
        "id", "cluster", "copies", F.when(count > 1, value).otherwise(0.0).alias("silhouette")
    )


def visits(points: DataFrame, order: list[int], sizes: dict[int, int]) -> DataFrame:
    """``(id, num, slots, target)``: the clusters each row must be summed against, its own among them.

    ``order`` names the clusters and ``sizes`` counts their rows, copies included.
    """
    squares = stage(_squared_totals(points, order, sizes))
    width = _widths(points)
    own = points.select("id", "cluster", "copies").join(squares, "id")
    # Twice a cluster's mean squared distance from its mean is its rows' mean squared distance from each other.
    norm = F.aggregate("num", F.lit(0.0), lambda t, x: t + x * x)
    spread = own.agg(
        *[F.sum(F.when(F.col("cluster") == c, F.col("totals")[i] * F.col("copies"))).alias(f"v{i}") for i, c in enumerate(order)]
    ).first()
    scale = points.agg(F.max(norm).alias("scale")).first()["scale"] or 0.0
    # Beyond the rounding error of the sums, so that a bound never cuts off the nearest cluster.
    slack = 1e-10 * (scale + 2.0 * width[1] + 1e-300)
    lower, upper = [], []
    for i, c in enumerate(order):
        mean = F.col("totals")[i] / F.lit(float(sizes[c]))
        inner = (spread[f"v{i}"] or 0.0) / (2.0 * float(sizes[c]) ** 2)
        lower.append(F.sqrt(F.greatest(mean - F.lit(inner + slack), F.lit(0.0))))
        upper.append(F.sqrt(F.greatest(mean, F.lit(0.0)) + F.lit(slack)))
    other = [F.when(F.col("cluster") != F.lit(c), u) for c, u in zip(order, upper)]
    nearest = F.array_min(F.array(*other))
    asked = [F.when((F.col("cluster") == F.lit(c)) | (low <= F.col("nearest")), F.lit(c)) for c, low in zip(order, lower)]
    needed = own.withColumn("nearest", nearest).select("id", F.explode(F.array_compact(F.array(*asked))).alias("target"))
    return points.select("id", "num", "slots").join(needed, "id")


def _euclidean_totals(points: DataFrame, order: list[int], sizes: dict[int, int], block_rows: int) -> DataFrame:
    """``(id, totals)``: distance sums by cluster in ``order``, null for clusters that were not visited."""
    stacked, squared, _ = _kernel()
    wn, ws = _widths(points)
    asking = stage(visits(points, order, sizes))
    # One row per cluster comes to the driver.
    ask = {r["target"]: r["count"] for r in asking.groupBy("target").count().collect()}
    held = {r["cluster"]: r["count"] for r in points.groupBy("cluster").count().collect()}
    clusters = [c for c in order if c in ask]

    def blocks(name: str, counts: dict):
        return F.element_at(F.array(*[F.lit(math.ceil(counts[c] / block_rows)) for c in clusters]), F.array_position(
            F.array(*[F.lit(c) for c in clusters]), F.col(name)).cast("int"))

    def dealt(blocks_of):
        return F.pmod(F.xxhash64("id"), blocks_of).cast("int")

    def each(blocks_of):
        return F.explode(F.sequence(F.lit(0), blocks_of - 1))

    left = asking.withColumn("q", dealt(blocks("target", ask))).withColumn("t", each(blocks("target", held)))
    right = points.withColumnRenamed("cluster", "target")
    right = right.withColumn("t", dealt(blocks("target", held))).withColumn("q", each(blocks("target", ask)))

    def add_up(asked: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        """Distance sums of one block's rows to another's."""
        if not len(asked) or not len(members):
            return pd.DataFrame({"id": [], "target": [], "total": []}).astype({"id": "int64", "target": "int64", "total": float})
        n, s = stacked(asked["num"], wn, np.float64), stacked(asked["slots"], ws, np.int64)
        tn, ts = stacked(members["num"], wn, np.float64), stacked(members["slots"], ws, np.int64)
        distance = np.sqrt(squared(n, s, tn, ts))
        _, i, j = np.intersect1d(asked["id"].to_numpy(), members["id"].to_numpy(), return_indices=True)
        distance[i, j] = 0.0  # a row and itself
        total = distance @ members["copies"].to_numpy(float)
        return pd.DataFrame({"id": asked["id"].to_numpy(), "target": asked["target"].to_numpy().astype("int64"), "total": total})

    keys = ["target", "q", "t"]
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(add_up, "id bigint, target bigint, total double")
    sums = [F.sum(F.when(F.col("target") == c, F.col("total"))) for c in order]
    return partial.groupBy("id").agg(F.array(*sums).alias("totals"))


def _levels(points: DataFrame, leaf_rows: int) -> list[tuple[int, ...]] | None:
    """The combinations of levels if a tree of boxes pays for ``points``, else None."""
    if not 1 <= _widths(points)[0] <= TREE_NUMBERS or points.count() <= TREE_LEAVES * leaf_rows:
        return None
    found = points.select("slots").distinct().limit(TREE_LEVELS + 1).collect()
    return sorted(tuple(r["slots"]) for r in found) if len(found) <= TREE_LEVELS else None


class Boxes:
    """A binary tree of boxes over places in space, cut at medians; node 0 is the root."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis, self.cut, self.child = [], [], []
        self._grow(sample, leaves)
        self.axis, self.cut, self.child = np.array(self.axis), np.array(self.cut), np.array(self.child)

    def _grow(self, sample: np.ndarray, leaves: int) -> int:
        node = len(self.axis)
        self.axis.append(-1), self.cut.append(0.0), self.child.append((-1, -1))
        spread = np.ptp(sample, axis=0) if len(sample) else np.zeros(1)
        if leaves > 1 and spread.max() > 0:
            axis = int(spread.argmax())
            cut = float(np.median(sample[:, axis]))
            left = sample[:, axis] <= cut
            if left.all():  # the median is the largest value
                left = sample[:, axis] < cut
                cut = float(sample[left, axis].max())
            self.axis[node], self.cut[node] = axis, cut
            self.child[node] = (self._grow(sample[left], leaves // 2), self._grow(sample[~left], leaves - leaves // 2))
        return node

    def leaf(self, places: np.ndarray) -> np.ndarray:
        """The leaf of each place."""
        at, rows = np.zeros(len(places), np.int64), np.arange(len(places))
        while (inner := self.axis[at] >= 0).any():
            right = places[rows, np.maximum(self.axis[at], 0)] > self.cut[at]
            at = np.where(inner, self.child[at, right.astype(int)], at)
        return at

    def fit(self, leaves: dict[int, tuple[list[float], list[float]]], width: int) -> None:
        """Centres and half widths of all boxes around what the leaves hold; empty ones have none."""
        low, high = np.full((len(self.axis), width), np.inf), np.full((len(self.axis), width), -np.inf)
        for leaf, (a, b) in leaves.items():
            low[leaf], high[leaf] = a, b
        for node in range(len(self.axis) - 1, -1, -1):  # children stand behind their parents
            if self.axis[node] >= 0:
                low[node], high[node] = low[self.child[node]].min(0), high[self.child[node]].max(0)
        self.held = low[:, 0] <= high[:, 0]
        self.centre = np.where(self.held[:, None], (low + high) / 2, 0.0)
        self.half = np.where(self.held[:, None], (high - low) / 2, 0.0)

    def points(self, node: int) -> np.ndarray:
        """The Chebyshev points of a box."""
        axes = [c + h * _chebyshev() for c, h in zip(self.centre[node], self.half[node])]
        return np.stack([g.ravel() for g in np.meshgrid(*axes, indexing="ij")], 1)

    def shares(self, node: int, places: np.ndarray) -> np.ndarray:
        """What each Chebyshev point of a box counts at each place in it."""
        out = np.ones((len(places), 1))
        for d in range(places.shape[1]):
            half = self.half[node, d]
            x = np.clip((places[:, d] - self.centre[node, d]) / half, -1.0, 1.0) if half else np.zeros(len(places))
            m = np.arange(1, NODES)
            terms = np.cos(np.arccos(x)[:, None] * m) @ np.cos(m[:, None] * np.arccos(_chebyshev())[None, :])
            out = (out[:, :, None] * ((1.0 + 2.0 * terms) / NODES)[:, None, :]).reshape(len(places), -1)
        return out

    def apart(self, a: np.ndarray, b: np.ndarray, cost: float) -> np.ndarray:
        """Whether distances between two boxes, with ``cost`` added to their squares, can be interpolated."""
        gap = np.maximum(np.abs(self.centre[a] - self.centre[b]) - self.half[a] - self.half[b], 0.0)
        well = np.ones(len(a), bool)
        for d in range(gap.shape[1]):
            beside = np.sqrt(np.maximum((gap**2).sum(1) - gap[:, d] ** 2, 0.0) + cost)
            for half in (self.half[a, d], self.half[b, d]):
                half = np.maximum(half, 1e-300)
                u, v = np.where(gap[:, d] > 0, 1.0 + gap[:, d] / half, 0.0), beside / half
                # The square root is smooth within an ellipse through (u, v) around the box's side.
                axis = (np.hypot(u - 1.0, v) + np.hypot(u + 1.0, v)) / 2.0
                well &= axis >= (FALL + 1.0 / FALL) / 2.0
        return well

    def visits(self, cost: float) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
        """``(far, near)``: boxes each leaf is interpolated from, and leaves it is summed with pair by pair."""
        a = np.flatnonzero((self.axis < 0) & self.held)
        b, far, near = np.zeros(len(a), np.int64), {int(x): [] for x in a}, {int(x): [] for x in a}
        while len(a):
            keep = self.held[b]
            a, b = a[keep], b[keep]
            well = self.apart(a, b, cost)
            end = ~well & (self.axis[b] < 0)
            for x, y in zip(a[well].tolist(), b[well].tolist()):
                far[x].append(y)
            for x, y in zip(a[end].tolist(), b[end].tolist()):
                near[x].append(y)
            a, b = a[~well & ~end], b[~well & ~end]
            a, b = np.repeat(a, 2), self.child[b].ravel()
        return far, near


def _chebyshev() -> np.ndarray:
    return np.cos((np.arange(NODES) + 0.5) * np.pi / NODES)


def _distances(a: np.ndarray, b: np.ndarray, cost: float) -> np.ndarray:
    """Distances between two sets of places, with ``cost`` added to their squares."""
    total = np.full((len(a), len(b)), cost)
    for d in range(a.shape[1]):
        total += np.subtract.outer(a[:, d], b[:, d]) ** 2
    return np.sqrt(total, out=total)


def _tree_totals(points: DataFrame, order: list[int], levels: list[tuple[int, ...]], leaf_rows: int) -> DataFrame:
    """``(id, totals)``: distance sums by cluster in ``order``, interpolated between boxes that lie apart."""
    stacked, squared, _ = _kernel()
    spark = points.sparkSession
    wn, ws = _widths(points)
    rows, grid = points.count(), NODES**wn
    bounded = 2 * rows * grid * len(levels) * len(order) // TREE_WEIGHTS
    leaves = math.ceil(rows / max(leaf_rows, bounded))
    sample = points.select("num").orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE_ROWS, 64 * leaves)).toPandas()
    tree = Boxes(stacked(sample["num"], wn, np.float64), leaves)
    known = np.array(levels, np.int64).reshape(len(levels), ws)
    costs = squared(np.zeros((len(levels), 0)), known, np.zeros((len(levels), 0)), known)

    def place(batches):
        for p in batches:
            leaf = tree.leaf(stacked(p["num"], wn, np.float64))
            yield p.assign(leaf=leaf, level=p["slots"].map(lambda s: levels.index(tuple(s))), at=p["cluster"].map(order.index)).drop(
                columns=["slots", "cluster"]
            )

    placed = "id long, num array<double>, copies long, leaf int, level int, at int"
    shaped = stage(points.select("id", "num", "copies", "slots", "cluster").mapInPandas(place, placed))
    ends = [f(F.col("num")[d]).alias(f"{n}{d}") for n, f in (("low", F.min), ("high", F.max)) for d in range(wn)]
    found = shaped.groupBy("leaf").agg(*ends).collect()  # one row per leaf
    tree.fit({r["leaf"]: ([r[f"low{d}"] for d in range(wn)], [r[f"high{d}"] for d in range(wn)]) for r in found}, wn)

    def weigh(rows: pd.DataFrame) -> pd.DataFrame:
        """The weights of one leaf's Chebyshev points, by level and cluster."""
        leaf = int(rows["leaf"].iloc[0])
        shares = tree.shares(leaf, stacked(rows["num"], wn, np.float64)) * rows["copies"].to_numpy(float)[:, None]
        out = np.zeros((len(levels) * len(order), grid))
        np.add.at(out, rows["level"].to_numpy() * len(order) + rows["at"].to_numpy(), shares)
        return pd.DataFrame({"leaf": [leaf], "weights": [out.tobytes()]})

    weights = np.zeros((len(tree.axis), len(levels), len(order), grid))
    for r in shaped.groupBy("leaf").applyInPandas(weigh, "leaf int, weights binary").toLocalIterator():
        weights[r["leaf"]] = np.frombuffer(r["weights"]).reshape(weights.shape[1:])
    for node in range(len(tree.axis) - 1, -1, -1):
        for child in tree.child[node] if tree.axis[node] >= 0 else ():
            if tree.held[child]:
                weights[node] += weights[child] @ tree.shares(node, tree.points(child))
    distinct = np.unique(costs).tolist()
    visits = [tree.visits(cost) for cost in distinct]
    shared = spark.sparkContext.broadcast((tree, weights, visits))
    close = {(b, a) for _, near in visits for a, some in near.items() for b in some}
    pairs = spark.createDataFrame(pd.DataFrame(sorted(close), columns=["leaf", "asking"], dtype="int64"), "leaf int, asking int")

    def add_up(asked: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        """Distance sums of one leaf's rows to every cluster."""
        if not len(asked):
            return pd.DataFrame({"id": [], "totals": []}).astype({"id": "int64"})
        tree, weights, visits = shared.value
        leaf, num, level = int(asked["asking"].iloc[0]), stacked(asked["num"], wn, np.float64), asked["level"].to_numpy()
        there, own = stacked(members["there"], wn, np.float64), members["own"].to_numpy()
        counted = np.zeros((len(members), len(order)))
        counted[np.arange(len(members)), members["at"].to_numpy()] = members["copies"].to_numpy(float)
        here, shares = tree.points(leaf), tree.shares(leaf, num)
        at_points, totals = np.zeros((grid, len(levels), len(order))), np.zeros((len(asked), len(order)))
        for cost, (far, near) in zip(distinct, visits):
            alike = (costs == cost).astype(float)
            for node in far[leaf]:
                moved = np.tensordot(alike, weights[node], 1).reshape(-1, grid)
                at_points += (_distances(here, tree.points(node), cost) @ moved.T).reshape(at_points.shape)
            beside = np.isin(members["leaf"].to_numpy(), near[leaf])
            for a in np.unique(level):
                some, asking = np.flatnonzero(beside & (costs[a, own] == cost)), np.flatnonzero(level == a)
                step = max(1, 1_000_000 // max(1, len(some)))
                for i in range(0, len(asking) if len(some) else 0, step):
                    rows = asking[i : i + step]
                    totals[rows] += _distances(num[rows], there[some], cost) @ counted[some]
        for a in np.unique(level):
            rows = level == a
            totals[rows] += shares[rows] @ at_points[:, a]
        return pd.DataFrame({"id": asked["id"], "totals": list(totals)})

    left = shaped.select("id", "num", "level", F.col("leaf").alias("asking"))
    right = shaped.select("leaf", F.col("num").alias("there"), F.col("level").alias("own"), "at", "copies")
    right = right.join(F.broadcast(pairs), "leaf").withColumnRenamed("asking", "asked_by")
    return left.groupBy("asking").cogroup(right.groupBy("asked_by")).applyInPandas(add_up, "id long, totals array<double>")


def _squared_totals(points: DataFrame, order: list[int], sizes: dict[int, int]) -> DataFrame:
    """Totals of squared distances: ``n|x|^2 - 2x.sum(y) + sum|y|^2`` per cluster.

    Levels add the number of cluster rows whose level differs, twice.
    """
    wn, ws = _widths(points)
    weight = F.col("copies").cast("double")
    numbers = points.groupBy("cluster").agg(
        *[F.sum(F.col("num")[d] * weight).alias(f"s{d}") for d in range(wn)],
        *[F.sum(F.col("num")[d] ** 2 * weight).alias(f"q{d}") for d in range(wn)],
    )
    moments = {r["cluster"]: r for r in numbers.collect()}  # one row per cluster
    cells = []
    for c in order:
        n, total = float(sizes[c]), F.lit(0.0)
        for d in range(wn):
            x = F.col("num")[d]
            total = total + n * x * x - 2 * x * moments[c][f"s{d}"] + moments[c][f"q{d}"]
        cells.append(total + 2.0 * n * ws)
    base = points.select("id", F.array(*cells).alias("base"))
    if ws == 0:
        return base.withColumnRenamed("base", "totals")
    # Cluster rows that share a row's level, per text column: counted once per level.
    levels = points.select("id", "cluster", "copies", F.posexplode("slots").alias("d", "slot"))
    shared = levels.groupBy("d", "slot").agg(
        F.array(
            *[F.sum(F.when(F.col("cluster") == c, F.col("copies")).otherwise(0)) for c in order]
        ).alias("shared")
    )
    same = (
        levels.select("id", "d", "slot")
        .join(shared, ["d", "slot"])
        .groupBy("id")
        .agg(*[F.sum(F.col("shared")[i]).alias(f"c{i}") for i in range(len(order))])
    )
    totals = [F.col("base")[i] - 2.0 * F.col(f"c{i}") for i in range(len(order))]
    return base.join(same, "id").select("id", F.array(*totals).alias("totals"))
