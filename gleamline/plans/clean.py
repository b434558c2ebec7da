"""The cleaning runs users call, composed from the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gleamline.functions import text
from gleamline.operators import columns as C
from gleamline.operators import rows as R
from gleamline.operators import stats
from gleamline.plans.suggest import choose_strategy
from gleamline.session import stage
from gleamline.types import Strategy, col, columns_of, conform, is_protected, replace_columns


@dataclass
class RunLog:
    """What a run did, in order; ``affected`` is a row count where one is known."""

    entries: list[tuple[int, str, str | None, int | None]] = field(default_factory=list)

    def add(self, op: str, column: str | None = None, affected: int | None = None) -> None:
        self.entries.append((len(self.entries) + 1, op, column, affected))

    def add_each(self, op: str, names: list[str]) -> None:
        for n in names:
            self.add(op, n)

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            self.entries, "seq int, op string, column string, affected bigint"
        )


@dataclass
class CleanResult:
    data: DataFrame
    log: RunLog

    def log_table(self) -> DataFrame:
        return self.log.table(self.data.sparkSession)


def apply_strategy(df: DataFrame, strategy: Strategy | dict, log: RunLog | None = None):
    """Run a declared strategy in the fixed order; unknown columns are ignored."""
    plan, log = Strategy.of(strategy), log if log is not None else RunLog()
    present = set(df.columns)
    if plan.drop_duplicates:
        df = R.dedupe_rows(df)
    dropped = [n for n in plan.drop_columns if n in present]
    if dropped:
        df = C.drop_columns(df, dropped)
        log.add_each("drop_column", dropped)
    df = C.standardize_text(df, plan.standardize_text)
    log.add_each("standardize_text", [n for n in plan.standardize_text if n in df.columns])
    df = C.extract_numbers(df, plan.extract_numbers)
    extracted = [n for n in plan.extract_numbers if n in df.columns and not is_protected(n)]
    log.add_each("extract_numbers", extracted)
    df = C.fill_unknown(df, plan.fill_unknown)
    log.add_each("fill_unknown", [n for n in plan.fill_unknown if n in df.columns])
    # The fits below scan the table once each: pay for the shuffle only once.
    if plan.drop_duplicates and (plan.fill_mean or plan.remove_outliers):
        df = stage(df)
    df = C.fill_mean(df, plan.fill_mean)
    log.add_each("fill_mean", [n for n in plan.fill_mean if n in df.columns])
    numbers = columns_of(df, "number")
    df = R.remove_outliers(df, plan.remove_outliers)
    log.add_each("remove_outliers", [n for n in plan.remove_outliers if n in numbers])
    return df


def auto_clean(df: DataFrame, log: RunLog | None = None) -> DataFrame:
    """De-duplicate, standardise text, find numbers in text, fill, and cap outliers."""
    log = log if log is not None else RunLog()
    table = stage(R.dedupe_rows(df))
    _log_removed(log, "dedupe_rows", df, table)
    return _auto_columns(table, log)


def _log_removed(log: RunLog, op: str, before: DataFrame, after: DataFrame) -> None:
    """Count both sides without reading a column; a written table counts from its footers."""
    removed = before.count() - after.count()
    if removed:
        log.add(op, None, removed)


def _stage_logged(log: RunLog, op: str, df: DataFrame, filtered) -> DataFrame:
    """``filtered(df)`` staged; the rows it takes away are counted by the same scan.

    ``filtered`` must not shuffle: a task before a shuffle may run again after its executor is lost, and be observed twice.
    An empty result may leave no trace of the observation in its plan, so then the rows before are counted by themselves.
    """
    seen = Observation()
    staged = stage(filtered(df.observe(seen, F.count(F.lit(1)).alias("rows"))))
    after = staged.count()  # from the footers
    removed = (seen.get["rows"] if after else df.count()) - after
    if removed:
        log.add(op, None, removed)
    return staged


def _auto_columns(df: DataFrame, log: RunLog) -> DataFrame:
    # One scan: nulls per column, and cells that parse per unprotected text column.
    texts = columns_of(df, "text")
    candidates = [n for n in texts if not is_protected(n)]
    extracted = {n: C.numeric.extract_number(col(n)) for n in candidates}
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(col(n)).alias(f"n{i}") for i, n in enumerate(df.columns)],
        *[F.count(extracted[n]).alias(f"x{i}") for i, n in enumerate(candidates)],
    ).first()
    rows = row["rows"]
    counts = {n: row[f"n{i}"] for i, n in enumerate(df.columns)}
    parsed = {n: row[f"x{i}"] for i, n in enumerate(candidates)}
    numeric_text = [n for n in candidates if parsed[n] > stats.NUMERIC_SHARE * rows]
    counts.update({n: parsed[n] for n in numeric_text})
    log.add_each("extract_numbers", numeric_text)

    changed = {
        n: extracted[n] if n in numeric_text else text.title_case(text.strip_text(col(n)))
        for n in texts
    }
    df = replace_columns(df, changed)
    numbers = columns_of(df, "number")
    medians, bounds = C.fit_medians_and_caps(df, numbers, counts, rows)
    lacking = [n for n in df.columns if counts[n] < rows]
    rest = [n for n in lacking if n not in numbers]
    df = C.fill_rest(C.apply_fill(df, medians), rest)
    for n in lacking:
        log.add("fill_unknown" if n in rest else "fill_median", n, rows - counts[n])
    log.add_each("cap_outliers", numbers)
    return C.apply_caps(df, bounds)


def finalize(df: DataFrame) -> DataFrame:
    """Round doubles to two places and turn whole null-free ones into bigint."""
    return C.demote_whole_floats(C.round_floats(df))


MODES = ("ai_agent", "auto_smart", "drop_missing", "fill_mean", "remove_outliers", "manual")


def clean(df: DataFrame, mode: str = "auto_smart", strategy: Strategy | dict | str | None = None):
    """A whole cleaning run.

    Null spellings and sparse rows go first in every mode.  ``ai_agent`` runs
    the given strategy, that in a reply's text, or one suggested from the data, and
    falls back to the automatic run when what was given isn't usable: an empty strategy,
    or a text that holds none.  ``manual`` stops after the common steps.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode '{mode}'; one of {', '.join(MODES)}")
    log = RunLog()
    table = C.normalize_nulls(conform(df))
    kept = _stage_logged(log, "drop_sparse_rows", table, R.drop_sparse_rows)

    if mode == "ai_agent":
        plan, outcome = choose_strategy(kept, strategy)
        if plan is not None:
            log.add("load_strategy")
            result = apply_strategy(kept, plan, log)
        else:
            log.add(f"strategy_{outcome}")
            log.add("fallback_auto")
            result = auto_clean(kept, log)
    elif mode == "auto_smart":
        result = auto_clean(kept, log)
    elif mode == "drop_missing":
        result = R.drop_missing(kept)
        log.add("drop_missing")
    elif mode == "fill_mean":
        result = C.fill_mean(kept, columns_of(kept, "number"))
        log.add_each("fill_mean", columns_of(kept, "number"))
    elif mode == "remove_outliers":
        result = R.remove_outliers(kept, columns_of(kept, "number"))
        log.add_each("remove_outliers", columns_of(kept, "number"))
    else:
        result = kept
    return CleanResult(finalize(result), log)
