"""Named queries against their SQL on the smallest given tables."""

import math

import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "orders", "events")
CHEAP = ["fact_log_replay", "label_intervals", "pending_at_basis", "txn_state", "trailing_features",
         "orders_trailing_features", "pcf_compare", "leakage_summary", "training_set_7d", "serve_vector",
         "corrections_feed", "activity_feed", "basis_diff", "train_test_split", "replay_before_after",
         "unlabelled_txns", "velocity_sliding"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    columns = sorted(df.columns)
    res = duck.execute(contract.oracle_sql()[name])
    order = [d[0] for d in res.description]
    assert sorted(order) == columns
    want = sorted(str([normal(row[order.index(c)]) for c in columns]) for row in res.fetchall())
    got = sorted(str([normal(row[c]) for c in columns]) for row in df.collect())
    assert got == want


def test_known_then_differs_from_hindsight_somewhere(spark):
    row = contract.queries()["leakage_summary"](spark, SF).first()
    assert row.differing > 0 and row.overcount > 0
