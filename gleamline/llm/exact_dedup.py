"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame functions only.

Every row goes to a run by a hash of its identifier.  A run is collapsed to one row per text,
sorted by digest.  In each round the runs whose numbers agree above the next ``fan_bits`` bits
are merged, equal texts meeting and the smallest identifier staying, until one run is left.  The
verdicts then go down the same tree, so no step gathers more rows of a text than one run has, or
than runs are merged at a time.

Texts count as equal if SHA-256, a second hash and the length in bytes of the normalised text all
agree; each level compares all three.

Defined cases: a null text counts as empty.  A null identifier is larger than any other.  Rows
that repeat identifier and text are copies: one of them is kept.  An empty table gives no rows.
Other columns are passed on by ``drop_duplicates`` and otherwise ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleamline.llm.common import column, fresh, run_count, run_of
from gleamline.session import stage

# Every run of white space except a lone blank, which is right as it is.
UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN_SPACE, " ")


def _keyed(docs: DataFrame, id_col: str, text_col: str, runs: int, names: list[str]) -> DataFrame:
    run, sha, second, size = names
    norm = normalised(column(text_col))
    return docs.withColumns(
        {
            run: run_of(column(id_col), runs),
            sha: F.unhex(F.sha2(norm, 256)),
            second: F.xxhash64(norm),
            size: F.octet_length(norm),
        }
    )


def _verdicts(rows: DataFrame, runs: int, fan_bits: int) -> DataFrame:
    """(run, sha, second, size, keep_id, group_size) from rows of (run, sha, second, size, id)."""
    text = ["sha", "second", "size"]
    level = rows.groupBy("run", *text).agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    levels, bits = [stage(level.sortWithinPartitions("run", "sha"))], runs.bit_length() - 1
    steps = []
    while bits:
        steps.append(min(fan_bits, bits))
        bits -= steps[-1]
        merged = (
            levels[-1]
            .withColumn("run", F.shiftright("run", steps[-1]))
            .groupBy("run", *text)
            .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        )
        levels.append(stage(merged.sortWithinPartitions("run", "sha")))
    verdict = levels.pop()
    for step in reversed(steps):
        child = levels.pop().select(F.col("run").alias("child"), F.shiftright("run", step).alias("run"), *text)
        verdict = child.join(verdict, ["run", *text]).drop("run").withColumnRenamed("child", "run")
        if levels:
            verdict = stage(verdict)
    return verdict


def duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None, fan_bits: int = 2
) -> DataFrame:
    """One row per row of ``docs``: its identifier, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    runs = runs or run_count(docs.sparkSession)
    key = ["run", "sha", "second", "size"]
    only = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    rows = stage(_keyed(only, "id", "text", runs, key).drop("text"))
    verdict = _verdicts(rows, runs, fan_bits)
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("id").asc_nulls_last()))
    return (
        rows.withColumn("nth", first)
        .join(verdict, key)
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            ((F.col("nth") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def drop_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None, fan_bits: int = 2
) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    runs = runs or run_count(docs.sparkSession)
    names = fresh(docs, "run", "sha", "second", "size", "keep_id", "nth")
    key, keep, nth = names[:4], names[4], names[5]
    keyed = _keyed(docs, id_col, text_col, runs, key)
    thin = keyed.select(
        *(F.col(a).alias(b) for a, b in zip(key, ("run", "sha", "second", "size"))), column(id_col).alias("id")
    )
    verdict = _verdicts(stage(thin), runs, fan_bits).select(
        F.col("run").alias(key[0]), F.col("sha").alias(key[1]), F.col("second").alias(key[2]),
        F.col("size").alias(key[3]), F.col("keep_id").alias(keep),
    )
    order = Window.partitionBy(*key).orderBy(column(id_col).asc_nulls_last())
    return (
        keyed.withColumn(nth, F.row_number().over(order))
        .filter(F.col(nth) == 1)
        .join(verdict, key)
        .filter(column(id_col).eqNullSafe(F.col(keep)))
        .select(*map(column, docs.columns))
    )
