"""A corpus pipeline: toxic documents go, copies and near copies go, secrets are masked, the rest is packed.

Defined cases of all stages: a null text counts as empty, and is scored, compared and packed like one.  Of rows that
repeat, also without an identifier, one stays.  An empty table gives no rows.  Long texts are handled whole.  Extra
columns are passed on by every stage but the last, whatever their names.  Ties go to the smallest identifier, null last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleamline.llm import exact_dedup, packing, secrets, simhash, toxicity
from gleamline.llm.common import table
from gleamline.llm.queries import vocabulary
from gleamline.session import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, shingle=3, bits=2)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]

# A learned classifier, XXH64 fingerprints and a vocabulary's merges have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES, 1):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = stage(docs)
    return docs
