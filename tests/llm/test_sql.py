"""Queries that SQL can express, against their SQL on the smallest given tables."""

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_line_dedup", "op5_quality_rules", "op9_decontamination", "op10_url_filter",
                                  "op11_filter_audit", "op12_warc", "op13_hard_negatives"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    res = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    want = sorted(map(repr, res.fetchall()))
    df = contract.queries()[name](spark, SF)
    assert set(columns) == set(df.columns)
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want
