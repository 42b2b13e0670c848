"""Requests answered from maintained pane aggregates equal those answered from the logs."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from fixtures import D
from knownthen.operators.features import Windows, requests_from, serve
from knownthen.operators.temporal import Basis
from knownthen.sources.facts import FactLogs
from knownthen.sources.serving import ServingPanes
from knownthen.sources.shared import fresh_dir

H = timedelta(hours=1)
WINDOWS = Windows(baseline=timedelta(days=3), fraud=timedelta(days=6))
REQUESTS = "req_id string, account_id string, t timestamp, amount double, country string"


def random_logs(spark, n=300):
    rng = random.Random(6)
    txns, labels = [], []
    for i in range(n):
        ts = D(0) + timedelta(hours=rng.randint(0, 24 * 14), microseconds=rng.choice([0, 0, 1]))
        who = "hot" if rng.random() < .4 else rng.choice(["a", "b", "same", None])
        txns.append(fx.txn(f"t{i}", who, ts, amount=5.0 if who == "same" else rng.choice([None, rng.random() * 100]), country=rng.choice(["GB", "US"])))
        labels.append(fx.label(f"t{i}", False, ts))
        for days in rng.sample(range(1, 9), rng.choice([0, 0, 1, 2, 3])):
            labels.append(fx.label(f"t{i}", rng.random() < .6, ts + timedelta(days=days)))
    accounts = [fx.account(a) for a in ("a", "b", "same")] + [fx.account("hot"), fx.account("hot", "US", D(5), commit=D(5))]
    return FactLogs(spark.createDataFrame(txns, fx.TXN), spark.createDataFrame(accounts, fx.ACCOUNT), spark.createDataFrame(labels, fx.LABEL),
                    spark.createDataFrame([], fx.PENDING))


def values(df):
    return {r.req_id: tuple(round(v, 9) if isinstance(v, float) else v for v in r[5:]) for r in df.collect()}


def test_maintained_panes_equal_the_logs_after_every_commit(spark):
    logs, since = random_logs(spark), None
    panes = ServingPanes(spark, fresh_dir(spark, "panes"), key="string", country="string", buckets=3)
    asked = requests_from(logs.txn).withColumn("t", F.col("t") + F.expr("INTERVAL 3 HOUR")).unionByName(spark.createDataFrame(
        [("q1", None, D(4), 1.0, "GB"), ("q2", "a", None, 1.0, "GB"), ("q3", "nobody", D(4), 1.0, "GB"), ("q4", "a", D(99), 1.0, "GB")], REQUESTS))
    for until in (D(4), D(5), D(9), D(30)):
        panes.update(logs, since, until)
        since = until
        basis = Basis(system_at=until)
        want = serve(asked.filter((F.col("t") <= F.lit(until)) | F.col("req_id").startswith("q")), logs, basis, WINDOWS)
        got = panes.serve(asked.filter((F.col("t") <= F.lit(until)) | F.col("req_id").startswith("q")), WINDOWS)
        assert got.columns == want.columns
        assert values(got) == values(want)


def test_a_request_reads_only_its_bucket_and_account(spark):
    logs = random_logs(spark)
    panes = ServingPanes(spark, fresh_dir(spark, "panes"), key="string", country="string", buckets=4)
    panes.update(logs, None, D(30))
    one = panes.serve(spark.createDataFrame([("q", "a", D(7), 9.0, "GB")], REQUESTS), WINDOWS)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and "PushedFilters: [IsNotNull(account_id), EqualTo(account_id,a)" in plan.replace("In(account_id, [a])", "EqualTo(account_id,a)")
    assert one.count() == 1


def test_windows_are_whole_panes_and_histories_complete(spark):
    logs = random_logs(spark, 5)
    panes = ServingPanes(spark, fresh_dir(spark, "panes"), key="string", country="string")
    with pytest.raises(ValueError, match="whole number"):
        panes.serve(spark.createDataFrame([], REQUESTS), Windows(velocity=H))
    broken = FactLogs(logs.txn, logs.account, logs.label.filter("id <> 't1'"), logs.pending)
    with pytest.raises(Exception, match="no current label"):
        panes.update(broken, None, D(30))
