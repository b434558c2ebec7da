"""Exact train/test split by a hash of the row key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleamline.types import col

TEST_SHARE = 0.2
PREFIX = 4  # hex digits per histogram level, so at most 65,536 groups


def split_order(key: list[str], seed: int) -> Column:
    """A digest that orders the rows at random but the same way in every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(n).cast("string") for n in key]))


def split_exact(
    df: DataFrame, key: list[str], share: float = TEST_SHARE, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """``(train, test)`` with exactly ``ceil(share * rows)`` test rows.

    ``key`` must identify a row.  The cut is found with two histograms of the
    digest's leading digits, then among the few rows that share both; no sort
    and no window over the table.
    """
    digest = split_order(key, seed)
    hashed = df.select(digest.alias("h"))
    level = _histogram(hashed, 1)
    wanted = math.ceil(share * sum(level.values()))
    if wanted == 0:
        return df, df.limit(0)
    first, before = _bucket_of(level, wanted)
    hashed = hashed.where(F.col("h").startswith(first))
    level = _histogram(hashed, 1 + PREFIX)
    second, before_second = _bucket_of(level, wanted - before)
    if level[second] > 10_000:
        raise ValueError(f"the split key {key} does not identify a row")
    # Rows that agree in 32 bits of the digest: a handful per 2**32 rows.
    last = sorted(r["h"] for r in hashed.where(F.col("h").startswith(first + second)).collect())
    at = wanted - before - before_second - 1
    cut = last[at]
    if at + 1 < len(last) and last[at + 1] == cut:
        raise ValueError(f"the split key {key} does not identify a row")
    return df.where(digest > cut), df.where(digest <= cut)


def _histogram(hashed: DataFrame, start: int) -> dict[str, int]:
    prefix = F.substring("h", start, PREFIX).alias("p")
    rows = hashed.groupBy(prefix).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["p"]: r["n"] for r in rows}


def _bucket_of(level: dict[str, int], wanted: int) -> tuple[str, int]:
    """The bucket that holds the ``wanted``-th row in order, and the rows before it."""
    before = 0
    for p in sorted(level):
        if before + level[p] >= wanted:
            return p, before
        before += level[p]
    raise ValueError("fewer rows than wanted")
