"""The run history: append one run, read the latest ones."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleamline.types import col

LATEST_RUNS = 10

RUNS_SCHEMA = (
    "user_id bigint, original_filename string, cleaned_filename string, "
    "file_path string, total_rows bigint, created_at timestamp"
)


def user_ids(users: DataFrame, username: str | None = None) -> DataFrame:
    """The id a username stands for: the smallest, as names need not be unique."""
    if username is not None:
        users = users.where(F.col("username") == F.lit(username))
    return users.groupBy("username").agg(F.min("id").alias("user_id"))


def log_run(
    users: DataFrame,
    username: str,
    path: str,
    original: str,
    cleaned: str,
    file_path: str,
    total_rows: int,
    created_at: dt.datetime | None = None,
) -> bool:
    """Append a run to the Parquet history at ``path``; an unknown user adds nothing."""
    spark = users.sparkSession
    found = user_ids(users, username).first()
    if found is None:
        return False
    when = created_at or dt.datetime.now()
    run = (found["user_id"], original, cleaned, file_path, total_rows, when)
    spark.createDataFrame([run], RUNS_SCHEMA).write.mode("append").parquet(path)
    return True


def read_runs(spark, source: str | dict) -> DataFrame:
    """Runs (or users) from a Parquet path, or from JDBC options."""
    if isinstance(source, dict):
        return spark.read.format("jdbc").options(**source).load()
    return spark.read.parquet(source)


def recent_runs(
    runs: DataFrame, users: DataFrame, username: str | None = None, order: tuple[str, ...] = ()
) -> DataFrame:
    """The ten latest runs of a user, or of every user.

    Runs are cut to ten per user before the join, each task keeping its own ten
    first, so a user who owns much of the history is no hot key.  ``order``
    names columns that break ties of the time.
    """
    latest = [F.col("created_at").desc(), *[col(n).desc() for n in order]]
    owners = user_ids(users, username)
    if username is not None:
        # At most one row, so this side is always small enough to broadcast.
        runs = runs.join(F.broadcast(owners), "user_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*latest))
    kept = runs.withColumn("place", place).where(F.col("place") <= LATEST_RUNS)
    return kept.join(owners, "user_id").select(
        "username",
        F.col("place").cast("bigint").alias("place"),
        F.col("original_filename").alias("filename"),
        "cleaned_filename",
        F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("date"),
    )
