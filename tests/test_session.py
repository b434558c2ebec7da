"""What staging leaves on disk."""

import glob
import time

from pyspark.sql import functions as F

from gleamline.session import CLEANUP, scratch, stage


def shuffled(spark) -> set[str]:
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*")}


def left(spark, before: set[str]) -> set[str]:
    """New shuffle files; they may take a moment to go."""
    for _ in range(50):
        if not (new := shuffled(spark) - before):
            break
        time.sleep(0.2)
    return new


def test_staged_tables_leave_no_shuffle_files(spark):
    before = shuffled(spark)
    rows = spark.range(20_000).withColumn("g", F.col("id") % 977)
    sums = rows.groupBy("g").agg(F.sum("id").alias("s"))
    staged = stage(sums.join(rows.hint("merge"), "g"))
    assert not left(spark, before)
    assert staged.count() == 20_000 and staged.filter("s IS NULL").isEmpty()
    before = shuffled(spark)
    with scratch(sums.repartition(5, "s")) as wide:
        assert not left(spark, before)
        assert stage(wide.select("g")).count() == 977
    # A frame that was staged can be read again itself, and other queries keep Spark's setting.
    assert sums.count() == 977 and stage(sums).count() == sums.count()
    assert spark.conf.get(CLEANUP, "false") == "false"
