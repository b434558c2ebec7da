"""Untidy tables derived from the given ones, in SQL that both engines run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from gleamline.types import conform

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    # Null spellings, padding, units, outliers, and every tenth row twice.
    "dirty_orders": """
WITH b AS (
 SELECT o_orderkey AS order_id,
 CASE WHEN o_orderkey % 11 = 0 THEN 'N/A' WHEN o_orderkey % 13 = 0 THEN 'nan'
      WHEN o_orderkey % 3 = 0 THEN '  ' || lower(o_orderpriority) || ' ' ELSE o_orderpriority END AS priority,
 CASE WHEN o_orderkey % 17 = 0 THEN NULL
      WHEN o_orderkey % 2 = 0 THEN '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || ' USD'
      ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END AS price_txt,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS amount,
 CASE WHEN o_orderkey % 23 = 0 THEN 'NULL_' WHEN o_orderkey % 5 = 0 THEN 'Null' ELSE o_orderstatus END AS status,
 CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_custkey % 25 AS DOUBLE) END AS score
 FROM orders)
SELECT * FROM b UNION ALL SELECT * FROM b WHERE order_id % 10 = 0
""",
    # Between none and six nulls in a row of eight cells.
    "dirty_wide": """
SELECT c_custkey AS custkey,
 CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS balance,
 CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS BIGINT) END AS nation_code,
 CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment ELSE 'NAN' END AS segment,
 CASE WHEN c_custkey % 7 > 1 THEN n_name END AS country,
 CASE WHEN c_custkey % 4 > 0 THEN c_acctbal / 8 END AS eighth,
 CASE WHEN c_custkey % 11 > 0 THEN lower(c_mktsegment) ELSE 'n/a' END AS segment_low,
 CASE WHEN c_custkey % 9 > 3 THEN CAST(c_custkey % 40 AS DOUBLE) END AS grade
FROM customer JOIN nation ON c_nationkey = n_nationkey
""",
    # A constant, an all-null column, and gaps at different places.
    "const_cols": """
SELECT p_partkey AS partkey, CAST(p_size AS BIGINT) AS size, p_retailprice AS price,
 CAST(7 AS DOUBLE) AS fixed, CAST(NULL AS DOUBLE) AS nothing,
 CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_retailprice * p_size END AS product,
 CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE sqrt(p_size) END AS root
FROM part
""",
    # Units, ranges, versions, tabs and line breaks around numbers.
    "unit_text": """
SELECT p_partkey AS part_key,
 CASE WHEN p_size % 7 = 0 THEN CAST(p_size AS STRING) || '-' || CAST(p_size + 5 AS STRING) || ' kg'
      WHEN p_size % 7 = 1 THEN CAST(p_size AS STRING) || '.5 Kg'
      WHEN p_size % 7 = 2 THEN '1.' || CAST(p_size AS STRING) || '.3'
      WHEN p_size % 7 = 3 THEN chr(9) || CAST(p_size AS STRING) || chr(10)
      WHEN p_size % 7 = 4 THEN '  -' || CAST(p_size AS STRING) || ' lbs'
      WHEN p_size % 7 = 5 THEN p_name ELSE CAST(p_size AS STRING) || 'e2' END AS weight,
 chr(9) || p_name || ' ' || chr(10) AS label,
 p_brand || ' ' || p_type || '''s o-RING' AS blurb
FROM part
""",
    # Every given column as text, for type inference.
    "text_cells": """
SELECT CAST(l_orderkey AS STRING) AS order_key, CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING) AS quantity,
 CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) || '.25' AS price,
 CASE WHEN l_linenumber = 1 THEN 'NA' ELSE CAST(l_linenumber AS STRING) END AS line,
 CASE WHEN l_returnflag = 'R' THEN 'TRUE' ELSE 'false' END AS returned,
 CASE WHEN l_returnflag = 'R' THEN 'True' WHEN l_returnflag = 'A' THEN 'n/a' ELSE 'False' END AS maybe,
 CASE WHEN l_orderkey % 50 = 0 THEN 'NAN' ELSE CAST(l_partkey AS STRING) END AS part_text,
 CAST(CAST(l_shipdate AS DATE) AS STRING) AS ship_day, 'null' AS blank,
 CAST(l_suppkey AS STRING) || 'd' AS suffixed, l_linestatus AS status
FROM lineitem
""",
    # Classification: does a page of prose count as good?
    "ml_cls": """
SELECT d.doc_id, d.lang, d.source, CAST(d.n_chars AS DOUBLE) AS n_chars,
 CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE CAST(length(d.text) - length(replace(d.text, ' ', '')) AS DOUBLE) END AS blanks,
 CAST(length(d.text) - length(replace(d.text, chr(10), '')) AS DOUBLE) AS breaks,
 CASE WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS verdict
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""",
    # Regression: the price of a part.
    "ml_reg": """
SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, CAST(p_partkey % 1000 AS DOUBLE) AS code,
 CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END AS kind, p_retailprice AS price
FROM part
""",
    # Clustering: no target.
    "ml_clu": """
SELECT c_acctbal, CAST(c_nationkey AS DOUBLE) AS nation, c_mktsegment FROM customer
""",
}


def register(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or an untidy view, in the engine's column types."""
    return conform(register(spark, sf_dir, name))
