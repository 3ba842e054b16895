"""The driver contract: entry() and every registered query run on sf0.001."""

import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns[:2] == ["scope", "name"] and len(rows) >= 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_every_query_runs_and_has_named_columns(spark):
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    for name, fn in qs.items():
        df = fn(spark, SF)
        assert all(c and "(" not in c for c in df.columns), name
        df.limit(5).collect()
