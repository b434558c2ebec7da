"""Queries that SQL can express, and what the registry holds."""

import pytest

from checks.compare import compare, oracle_connection
from gleamline.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(spark, oracle_connection(SF_DIR), SF_DIR, QUERIES[name], ORACLE[name])[0] == "ok"


def test_registered():
    from __spark_entry__ import oracle_sql, queries

    assert {*QUERIES, "pipeline"} <= set(queries()) and set(ORACLE) <= set(oracle_sql())
