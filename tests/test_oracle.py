"""Every query with SQL, on the smallest tables, against an in-process DuckDB."""

import pytest

from checks.compare import compare, oracle_connection
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
# Its SQL casts a column that is whole at this scale factor only.
CLEAN_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    if name in ("clean", "clean_fallback"):
        con = oracle_connection(CLEAN_DIR)
        assert compare(spark, con, CLEAN_DIR, QUERIES[name], ORACLE[name])[0] == "ok"
        return
    assert compare(spark, con, SF_DIR, QUERIES[name], ORACLE[name], loose=True)[0] == "ok"


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
