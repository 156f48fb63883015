"""Every registered query runs on the smallest tables; those with a SQL twin must give the same rows."""

import os

import check
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in ORACLE:
        cur = duck.execute(ORACLE[name])
        assert check.compare(rows, df.columns, cur.fetchall(), [d[0] for d in cur.description]) is None
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "seq", "score"]
