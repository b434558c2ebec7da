"""Exact order statistics of many columns without sorting the table.

A small table is answered by one aggregate.  A large one is narrowed: each job
counts, for every wanted rank, how many values lie below two pivot values, and
sketches the values between them to choose the next pivots.  A job shrinks the
open interval around a rank about a hundredfold, so a few scans leave an
interval that one aggregate can rank exactly.  Sketches only choose pivots;
ranks are decided by counts, so the result is exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleamline.types import col

# Values one aggregate may hold to rank them directly.
DIRECT_VALUES = 2_000_000
# Values one narrowed interval may hold.
INTERVAL_VALUES = 100_000
# Sketch size, points read from a sketch, the share of an interval kept on each
# side of a rank, and the number of groups partial sketches are merged in.
SKETCH_SIZE = 400
GRID = 500
SLACK = 0.015
SKETCH_GROUPS = 256
COLUMNS_PER_JOB = 8


@dataclass
class _Search:
    name: str
    rank: int
    low: float | None = None  # the value lies strictly above this ...
    high: float | None = None  # ... and strictly below this
    below: int = 0  # values up to and including ``low``
    inside: int = 0  # values strictly between
    pivots: tuple[float, float] | None = None
    value: float | None = None

    @property
    def settled(self) -> bool:
        return self.value is not None or self.inside <= INTERVAL_VALUES


def non_null_counts(df: DataFrame, names: list[str]) -> dict[str, int]:
    if not names:
        return {}
    row = df.agg(*[F.count(col(n)).alias(f"n{i}") for i, n in enumerate(names)]).first()
    return dict(zip(names, row))


def order_statistics(
    df: DataFrame,
    ranks: dict[str, list[int]],
    counts: dict[str, int],
    direct_values: int = DIRECT_VALUES,
) -> dict[str, dict[int, float]]:
    """Per column, the values at the given 0-based ranks among its non-null cells."""
    wanted = {n: sorted(set(r)) for n, r in ranks.items() if r}
    if not wanted:
        return {}
    if sum(counts[n] for n in wanted) <= direct_values:
        return _direct(df, wanted, counts)
    names = list(wanted)
    found: dict[str, dict[int, float]] = {}
    for at in range(0, len(names), COLUMNS_PER_JOB):
        batch = {n: wanted[n] for n in names[at : at + COLUMNS_PER_JOB]}
        found.update(_narrowed(df, batch, counts))
    return found


def _direct(df, wanted, counts):
    aggregates = [
        F.expr(_disc_sql(n, [(r + 0.5) / counts[n] for r in rs])).alias(f"v{i}")
        for i, (n, rs) in enumerate(wanted.items())
    ]
    row = df.agg(*aggregates).first()
    return {n: dict(zip(rs, map(float, row[i]))) for i, (n, rs) in enumerate(wanted.items())}


def _disc_sql(name: str, fractions: list[float], condition: str = "") -> str:
    quoted = "`" + name.replace("`", "``") + "`"
    at = ", ".join(f"{f!r}D" for f in fractions)
    return f"percentile_disc(array({at})) WITHIN GROUP (ORDER BY double({quoted})) {condition}"


def _narrowed(df, wanted, counts):
    searches = [_Search(n, r, inside=counts[n]) for n, rs in wanted.items() for r in rs]
    while any(not s.settled for s in searches):
        _narrow_once(df, [s for s in searches if not s.settled])
    open_searches = [s for s in searches if s.value is None]
    if open_searches:
        picks = [
            F.expr(
                _disc_sql(
                    s.name,
                    [(s.rank - s.below + 0.5) / s.inside],
                    f"FILTER (WHERE {_between_sql(s)})",
                )
            ).alias(f"v{i}")
            for i, s in enumerate(open_searches)
        ]
        for s, v in zip(open_searches, df.agg(*picks).first()):
            s.value = float(v[0])
    out: dict[str, dict[int, float]] = {}
    for s in searches:
        out.setdefault(s.name, {})[s.rank] = s.value
    return out


def _between_sql(s: _Search) -> str:
    quoted = "`" + s.name.replace("`", "``") + "`"
    parts = [f"{quoted} IS NOT NULL"]
    if s.low is not None:
        parts.append(f"double({quoted}) > {_literal(s.low)}")
    if s.high is not None:
        parts.append(f"double({quoted}) < {_literal(s.high)}")
    return " AND ".join(parts)


def _literal(v: float) -> str:
    return f"double('{v!r}')"


def _between(c: Column, low: float | None, high: float | None) -> Column:
    inside = c.isNotNull()
    if low is not None:
        inside = inside & (c > F.lit(low))
    if high is not None:
        inside = inside & (c < F.lit(high))
    return inside


def _narrow_once(df: DataFrame, searches: list[_Search]) -> None:
    """One job: count around each search's pivots and sketch between them."""
    aggregates: dict[tuple, Column] = {}
    for s in searches:
        c = col(s.name).cast("double")
        for p in s.pivots or ():
            aggregates[s.name, p, "lt"] = F.count_if(c < F.lit(p))
            aggregates[s.name, p, "le"] = F.count_if(c <= F.lit(p))
        if s.pivots and 2 * SLACK * s.inside <= INTERVAL_VALUES:
            continue  # the interval between the pivots will need no sketch
        low, high = s.pivots or (s.low, s.high)
        within = F.when(_between(c, low, high), c)
        aggregates[s.name, low, high, "n"] = F.count(within)
        aggregates[s.name, low, high, "grid"] = F.kll_sketch_agg_double(within, SKETCH_SIZE)
    keys = list(aggregates)
    # Each task adds one partial row to one of a fixed number of groups, so no
    # single reducer merges the sketches of every task.
    grouped = df.groupBy((F.spark_partition_id() % SKETCH_GROUPS).alias("g")).agg(
        *[aggregates[k].alias(f"a{i}") for i, k in enumerate(keys)]
    )
    rows = grouped.select(
        *[_grid(f"a{i}") if k[-1] == "grid" else F.col(f"a{i}") for i, k in enumerate(keys)]
    ).collect()
    got = {k: [r[i] for r in rows] for i, k in enumerate(keys)}
    previous = None
    for s in sorted(searches, key=lambda s: (s.name, s.rank)):
        sketched = s.pivots or (s.low, s.high)
        if s.pivots:
            _locate(s, got)
        key = (s.name, s.low, s.high)
        s.pivots = None
        if s.settled or sketched != key[1:] or (*key, "grid") not in got:
            continue
        # Neighbouring ranks share pivots, and so share their counts.
        if previous and previous[0] == key and s.rank - previous[1] <= 1:
            s.pivots = previous[2]
        else:
            s.pivots = _next_pivots(s, got[*key, "n"], got[*key, "grid"])
        previous = (key, s.rank, s.pivots)


def _grid(sketch: str) -> Column:
    points = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    filled = F.kll_sketch_get_n_double(sketch) > 0
    return F.when(filled, F.kll_sketch_get_quantile_double(F.col(sketch), points))


def _locate(s: _Search, got: dict) -> None:
    """Move the search into the interval, or onto the pivot, that holds its rank."""
    edges = []
    for p in s.pivots:
        edges += [(p, sum(got[s.name, p, "lt"]), sum(got[s.name, p, "le"]))]
    upper = s.below + s.inside
    for p, lt, le in edges:
        if lt <= s.rank < le:
            s.value = p
            return
        if s.rank < lt:
            s.high, upper = p, lt
            break
        s.low, s.below = p, le
    s.inside = upper - s.below


def _next_pivots(s: _Search, sizes: list[int], grids: list) -> tuple[float, float]:
    points = [(g, n) for g, n in zip(grids, sizes) if n]
    values = np.concatenate([np.asarray(g, dtype=float) for g, _ in points])
    weights = np.concatenate([np.full(len(g), n / len(g)) for g, n in points])
    order = np.argsort(values, kind="stable")
    values, reached = values[order], np.cumsum(weights[order])
    target = s.rank - s.below + 0.5
    slack = SLACK * s.inside
    at = np.searchsorted(reached, [target - slack, target + slack])
    low, high = values[np.minimum(at, len(values) - 1)]
    return float(low), float(high)


def quantile_ranks(count: int, probability: float) -> tuple[int, int, float]:
    """The two ranks a linearly interpolated quantile lies between, and its share."""
    position = (count - 1) * probability
    floor = math.floor(position)
    return floor, min(floor + 1, count - 1), position - floor


def interpolate(low: float, high: float, share: float) -> float:
    if low == high or share == 0:
        return low
    return low + (high - low) * share if share < 0.5 else high - (high - low) * (1 - share)


def quantiles(
    df: DataFrame,
    names: list[str],
    probabilities: list[float],
    counts: dict[str, int] | None = None,
    direct_values: int = DIRECT_VALUES,
) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles; an all-null column gives None."""
    counts = counts or non_null_counts(df, names)
    spots = {
        n: [quantile_ranks(counts[n], p) for p in probabilities] if counts[n] else []
        for n in names
    }
    ranks = {n: [r for lo, hi, _ in at for r in (lo, hi)] for n, at in spots.items()}
    found = order_statistics(df, ranks, counts, direct_values)
    return {
        n: [interpolate(found[n][lo], found[n][hi], share) for lo, hi, share in at]
        if at
        else [None] * len(probabilities)
        for n, at in spots.items()
    }
