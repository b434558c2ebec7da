"""Exact k-nearest-neighbour join, and votes over it.

Rows carry ``num`` (array of doubles) and ``slots`` (one level number per text
column).  The squared distance is that of the one-hot vectors: each differing
level adds two, or one when the query's level is unseen (-1).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleamline.operators.lookup import is_small, lookup
from gleamline.session import stage

NEIGHBOURS = 5
# Cells of the training side that may be sent whole to every task.
BROADCAST_CELLS = 4_000_000
# Pairs of rows up to which all are compared; beyond, cells rule most out.
BROADCAST_PAIRS = 400_000_000
# Rows of either side that meet in one task.
BLOCK_ROWS = 4096
# Cells hold about ``BLOCK_ROWS`` rows up to this many pivots.
MAX_PIVOTS = 4096
# Numbers of one intermediate matrix in a task.
MATRIX = 500_000

RESULT = "query_id bigint, train_id bigint, squared double"


def _kernel():
    """The numpy work of one block, free of outside names so that it ships by value."""

    def stacked(column, width, dtype):
        if len(column) == 0 or width == 0:
            return np.zeros((len(column), width), dtype)
        return np.stack(column.to_numpy()).astype(dtype, copy=False)

    def squared(qn, qs, tn, ts):
        """All squared distances between two small blocks."""
        d = (qn**2).sum(1)[:, None] + (tn**2).sum(1)[None, :] - 2.0 * (qn @ tn.T)
        np.maximum(d, 0.0, out=d)
        for c in range(qs.shape[1]):
            cost = np.where(qs[:, c] < 0, 1.0, 2.0)[:, None]
            d += (qs[:, c][:, None] != ts[:, c][None, :]) * cost
        return d

    def nearest(qid, qn, qs, tid, tn, ts, k, limit=None):
        """The k nearest of each query as a frame, smallest id first among equals.

        Rows beyond ``limit``, a squared distance per query, are left out where that saves ranking them.
        """
        out_q, out_t, out_d = [], [], []
        k = min(k, len(tid))
        if k == 0 or len(qid) == 0:
            return pd.DataFrame({"query_id": [], "train_id": [], "squared": []}).astype(
                {"query_id": "int64", "train_id": "int64", "squared": "float64"}
            )
        scale = 1.0 + float((tn**2).sum(1).max(initial=0.0))
        step = max(1, MATRIX // len(tid))
        for at in range(0, len(qid), step):
            rows = slice(at, at + step)
            rough = squared(qn[rows], qs[rows], tn, ts)
            bound = np.partition(rough, k - 1, axis=1)[:, k - 1]
            slack = 1e-9 * (scale + (qn[rows] ** 2).sum(1))
            asking = range(rough.shape[0])
            if limit is not None:
                asking = np.flatnonzero(rough.min(axis=1) <= limit[rows] + slack)
                bound = np.minimum(bound, limit[rows])
            for i in asking:
                # The rough form loses digits; rank the contenders by the plain one.
                near = np.flatnonzero(rough[i] <= bound[i] + slack[i])
                exact = ((tn[near] - qn[at + i]) ** 2).sum(1)
                cost = np.where(qs[at + i] < 0, 1.0, 2.0)
                exact += ((ts[near] != qs[at + i]) * cost).sum(1)
                best = np.lexsort((tid[near], exact))[:k]
                out_q.append(np.full(len(best), qid[at + i]))
                out_t.append(tid[near][best])
                out_d.append(exact[best])
        if not out_q:
            return nearest(qid[:0], qn[:0], qs[:0], tid, tn, ts, k)
        return pd.DataFrame(
            {
                "query_id": np.concatenate(out_q),
                "train_id": np.concatenate(out_t),
                "squared": np.concatenate(out_d),
            }
        )

    return stacked, squared, nearest


def _widths(df: DataFrame) -> tuple[int, int] | None:
    row = df.select(F.size("num"), F.size("slots")).first()
    return None if row is None else (row[0], row[1])


def knn_join(
    queries: DataFrame, train: DataFrame, k: int = NEIGHBOURS, broadcast_cells: int = BROADCAST_CELLS
) -> DataFrame:
    """``(query_id, rank, train_id, distance)``: the ``k`` nearest training rows of each query.

    Both inputs have ``id``, ``num`` and ``slots``.  Equal distances are ranked
    by training id.  A small training side is broadcast; a large one, or one with many queries, is cut
    into cells around pivots; a query visits the nearest one, and then the cells
    that can hold a row nearer than the ``k``-th found there.
    """
    widths = _widths(train)
    if widths is None:
        empty = "query_id bigint, rank int, train_id bigint, distance double"
        return queries.sparkSession.createDataFrame([], empty)
    rows = train.count()
    cells = rows * (sum(widths) + 1)
    queries, train = queries.select("id", "num", "slots"), train.select("id", "num", "slots")
    if cells <= broadcast_cells and rows * queries.count() <= BROADCAST_PAIRS:
        pairs = _broadcast_join(queries, train, k, widths)
    else:
        pairs = _cell_join(queries, train, k, widths)
    nearest_first = Window.partitionBy("query_id").orderBy("squared", "train_id")
    return (
        pairs.withColumn("rank", F.row_number().over(nearest_first))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "train_id", F.sqrt("squared").alias("distance"))
    )


def _broadcast_join(queries, train, k, widths):
    stacked, _, nearest = _kernel()
    frame = train.toPandas()  # at most ``broadcast_cells`` numbers
    shared = queries.sparkSession.sparkContext.broadcast(
        (
            frame["id"].to_numpy(np.int64),
            stacked(frame["num"], widths[0], np.float64),
            stacked(frame["slots"], widths[1], np.int64),
        )
    )

    def search(batches):
        for q in batches:
            qn = stacked(q["num"], widths[0], np.float64)
            qs = stacked(q["slots"], widths[1], np.int64)
            yield nearest(q["id"].to_numpy(np.int64), qn, qs, *shared.value, k)

    return queries.mapInPandas(search, RESULT)


def _cell_join(queries, train, k, widths):
    stacked, squared, nearest = _kernel()
    wn, ws = widths
    # Of training rows with the same features only the k smallest ids can win.
    copies = Window.partitionBy("num", "slots").orderBy("id")
    train = stage(
        train.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k).drop("copy")
    )
    rows = train.count()
    wanted = max(4, min(MAX_PIVOTS, math.ceil(rows / BLOCK_ROWS)))
    chosen = train.orderBy(F.md5(F.col("id").cast("string"))).limit(wanted).toPandas()
    pn, ps = stacked(chosen["num"], wn, np.float64), stacked(chosen["slots"], ws, np.int64)

    def assign(batches):
        step = max(1, MATRIX // len(pn))
        for t in batches:
            tn, ts = stacked(t["num"], wn, np.float64), stacked(t["slots"], ws, np.int64)
            cell, reach = np.zeros(len(t), np.int32), np.zeros(len(t))
            for i in range(0, len(t), step):
                d = squared(tn[i : i + step], ts[i : i + step], pn, ps)
                cell[i : i + step], reach[i : i + step] = d.argmin(1), np.sqrt(d.min(1))
            yield t.assign(cell=cell, reach=reach)

    vectors = "id bigint, num array<double>, slots array<int>"
    train = stage(train.mapInPandas(assign, f"{vectors}, cell int, reach double"))
    sizes = {
        r["cell"]: (r["n"], r["reach"])
        for r in train.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach")).collect()
    }
    used = np.array(sorted(sizes))
    radius = np.array([sizes[c][1] for c in used])
    un, us = pn[used], ps[used]

    def homes(batches):
        """Each query with its nearest cell."""
        step = max(1, MATRIX // len(used))
        for q in batches:
            qn, qs = stacked(q["num"], wn, np.float64), stacked(q["slots"], ws, np.int64)
            home = [squared(qn[i : i + step], qs[i : i + step], un, us).argmin(1) for i in range(0, len(q), step)]
            yield q.assign(cells=[used[[c]] for h in home for c in h], bound=np.inf)

    def visits(batches):
        """Each query with the other cells that may hold one of its k nearest."""
        step = max(1, MATRIX // len(used))
        for q in batches:
            qn, qs = stacked(q["num"], wn, np.float64), stacked(q["slots"], ws, np.int64)
            bound, cells = q["bound"].fillna(np.inf).to_numpy(float), []
            for i in range(0, len(q), step):
                squares = squared(qn[i : i + step], qs[i : i + step], un, us)
                home, rows = squares.argmin(1), np.arange(len(squares))
                d = np.sqrt(squares)
                limit = np.sqrt(bound[i : i + step]) + 1e-6 * (1 + d.max(1))
                # A cell's rows are within its radius, and beyond the plane halfway from the home cell's pivot.
                apart = 2.0 * np.sqrt(squared(un[home], us[home], un, us))
                ahead = squares - squares[rows, home][:, None] - 1e-9 * (1 + squares.max(1))[:, None]
                plane = np.divide(ahead, apart, out=np.zeros_like(d), where=apart > 1e-6)
                near = np.maximum(d - radius[None, :], plane) <= limit[:, None]
                near[rows, home] = False
                cells += [used[r] for r in near]
            yield q.assign(cells=cells, bound=bound)

    def search(q, t):
        return nearest(
            q["id"].to_numpy(np.int64),
            stacked(q["num"], wn, np.float64),
            stacked(q["slots"], ws, np.int64),
            t["id"].to_numpy(np.int64),
            stacked(t["num"], wn, np.float64),
            stacked(t["slots"], ws, np.int64),
            k,
            q["bound"].to_numpy(float),
        )

    def pairs_of(asked):
        """The nearest rows in the cells asked; a cell with many rows of either side is cut into blocks of bounded size."""
        single = asked.select("id", "num", "slots", "bound", F.explode("cells").alias("cell"))
        asked_sizes = {r["cell"]: r["n"] for r in single.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        cuts = [
            (int(c), math.ceil(sizes[c][0] / BLOCK_ROWS), math.ceil(n / BLOCK_ROWS))
            for c, n in asked_sizes.items()
        ]
        cuts = F.broadcast(queries.sparkSession.createDataFrame(cuts, "cell int, t_blocks int, q_blocks int"))
        own = F.pmod(F.xxhash64("id"), F.col("t_blocks")).cast("int")
        right = train.join(cuts, "cell").select(
            "id", "num", "slots", "cell", own.alias("t"),
            F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q"),
        )
        own = F.pmod(F.xxhash64("id"), F.col("q_blocks")).cast("int")
        left = single.join(cuts, "cell").select(
            "id", "num", "slots", "bound", "cell", own.alias("q"),
            F.explode(F.sequence(F.lit(0), F.col("t_blocks") - 1)).alias("t"),
        )
        blocks = ["cell", "q", "t"]
        return left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInPandas(search, RESULT)

    # The home cell's rows bound the distance of the k-th nearest one; only cells within it are visited.
    asked = f"{vectors}, cells array<int>, bound double"
    first = stage(pairs_of(stage(queries.mapInPandas(homes, asked))))
    bounds = (
        first.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("squared")))
        .where(F.col("r") == k)
        .select(F.col("query_id").alias("asker"), F.col("squared").alias("bound"))
    )
    bounded = queries.join(bounds, F.col("id") == F.col("asker"), "left").drop("asker")
    return first.unionByName(pairs_of(stage(bounded.mapInPandas(visits, asked))))


def knn_predict(
    queries: DataFrame, train: DataFrame, classify: bool, k: int = NEIGHBOURS
) -> DataFrame:
    """``(id, prediction)``: the neighbours' most frequent label (smallest on ties), or their mean.

    ``train`` carries ``label`` next to the features.
    """
    pairs = knn_join(queries, train, k)
    # One training row may be near very many queries, so this is a salted lookup.
    small = is_small(train, "id")
    labelled = lookup(pairs, F.col("train_id"), train, "id", "label", "label", small)
    if not classify:
        return labelled.groupBy(F.col("query_id").alias("id")).agg(
            F.avg("label").cast("double").alias("prediction")
        )
    votes = labelled.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))
    winner = F.min_by("label", F.struct(-F.col("n"), F.col("label")))
    return votes.groupBy(F.col("query_id").alias("id")).agg(
        winner.cast("double").alias("prediction")
    )
