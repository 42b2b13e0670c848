"""Streams against their batch twins on the same rows."""

import random
from datetime import timedelta

from pyspark.sql import functions as F

from fixtures import D, utc
from knownthen.operators.features import trailing_features
from knownthen.sources.shared import fresh_dir, written
from knownthen.sources.store import FactStore
from knownthen.streaming import events, ingest
from knownthen.streaming.runs import new_run, run_batches, staged_stream


def arrivals(spark, n=400):
    rng = random.Random(11)
    rows = [(i, "hot" if rng.random() < 0.4 else f"a{rng.randint(0, 9)}", D(0) + timedelta(minutes=rng.randint(0, 14_000)),
             float(rng.randint(1, 99))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, account_id string, txn_ts timestamp, amount double")


def pairs(df, *cols):
    return sorted(tuple(utc(v) if hasattr(v, "tzinfo") else v for v in r) for r in df.select(*cols).collect())


def test_velocity_is_exact_even_when_facts_arrive_out_of_order(spark):
    df = arrivals(spark)
    # staging by id mixes event times across micro-batches
    got = ingest.velocity_on_arrival(staged_stream(df.drop("amount"), "id", 3))
    want = trailing_features(df)
    assert pairs(got, "id", "txn_count_24h") == pairs(want, "id", "txn_count_24h")


def test_ticks_settle_each_due_chargeback_once(spark):
    df = spark.createDataFrame(
        [(1, 10, D(1), D(3)), (2, 10, D(2), None), (3, 11, D(4), D(6)), (4, 11, D(5), D(30)), (5, 12, D(9), None)],
        "id long, account_id long, txn_ts timestamp, due timestamp")
    df = df.selectExpr("*", "1D AS amount", "'retail' AS category", "3L AS country")
    store = FactStore(spark, fresh_dir(spark, "store"))
    ingest.ingest_and_settle(staged_stream(df, "txn_ts", 5), store, new_run(spark, "ticks"))
    labels = store.facts("label")
    assert sorted(r.id for r in labels.filter("is_fraud").collect()) == [1, 3]
    assert labels.filter("not is_fraud").count() == 5
    assert sorted((r.id, r.op) for r in store.facts("pending").collect()) == [(1, "del"), (1, "put"), (3, "del"), (3, "put"), (4, "put")]


def test_derived_streams(spark):
    df = arrivals(spark, 200)
    twice = df.unionByName(df)
    once = events.collected(events.delivered_once(staged_stream(twice, "txn_ts", 3), timedelta(days=30)), "append")
    assert pairs(once, "id", "txn_ts") == pairs(df, "id", "txn_ts")
    day = events.collected(events.daily(staged_stream(df, "txn_ts", 3)), "complete", ["day"])
    assert pairs(day, "day", "n") == pairs(events.daily(df), "day", "n")
    late = df.selectExpr("id", "txn_ts + make_interval(0, 0, 0, id % 40) AS confirmed_at")
    joined = events.confirmations_within(
        staged_stream(df.select("id", "txn_ts"), "txn_ts", 2), staged_stream(late, "confirmed_at", 2),
        timedelta(days=30), timedelta(days=90))
    got = events.collected(joined.select("id", "txn_ts", "confirmed_at"), "append")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in df.collect() if r.id % 40 <= 30)
    labels = spark.createDataFrame([(1, False, D(1)), (1, True, D(4)), (2, True, D(1)), (2, False, D(2)), (3, False, D(1))],
                                   "id long, is_fraud boolean, system_from timestamp")
    flips = events.collected(events.flips(staged_stream(labels, "system_from", 2)), "update", ["id"])
    assert [r.id for r in flips.filter("first_seen < confirmed_at").collect()] == [1]


def test_a_batch_has_the_partitions_of_the_session_not_of_the_state(spark):
    seen, partitions = [], "spark.sql.shuffle.partitions"
    stream = staged_stream(arrivals(spark, 20), "txn_ts", 2)
    run_batches(stream, lambda batch, n: seen.append(batch.sparkSession.conf.get(partitions)), run=new_run(spark, "wide", state_partitions=3))
    assert seen == [spark.conf.get(partitions)] * 2


def test_arrivals_are_made_distinct_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(ingest, "written", lambda df, name: made.append(name) or written(df, name))
    batch = arrivals(spark, 20).selectExpr("*", "'x' AS category", "1L AS country", "CAST(NULL AS timestamp) AS due")
    once = ingest.distinct_arrivals(batch.union(batch))
    assert once.count() == 20 and made == ["arrivals"]
    ingest.tick(FactStore(spark, fresh_dir(spark, "store"), key="bigint"), once.withColumn("account_id", F.lit(1).cast("long")), "s", 0, distinct=True)
    assert made == ["arrivals"]
