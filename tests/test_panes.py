"""Windows of many panes stay linear and exact."""

import random
import re
import statistics
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fixtures import D
from knownthen.operators.features import Windows, trailing_features
from knownthen.operators import paned
from knownthen.operators.paned import Latest, Trailing, point_in_time

H = timedelta(hours=1)


def test_hourly_panes_over_ten_years_of_one_key_use_growing_frames_only(spark):
    years = spark.range(24 * 3650).select(
        F.col("id"), F.lit("x").alias("account_id"), F.timestamp_seconds(1_600_000_000 + 3600 * F.col("id") + F.col("id") % 7).alias("txn_ts"),
        (F.col("id") % 1000).cast("double").alias("amount"))
    df = point_in_time(years, [Trailing("w", timedelta(days=90), value="amount", moments=True)], pane=H)
    plan = df._jdf.queryExecution().toString()
    assert not re.search(r"RangeFrame, -\d{2,}|RowFrame, -\d{2,}", plan)
    rows = {r.id: r for r in df.filter("id in (0, 1, 5, 2159, 2160, 50000, 87599)").collect()}
    for i, r in rows.items():
        low = 3600 * i + i % 7 - 90 * 86400
        held = [float(j % 1000) for j in range(max(0, i - 2165), i) if 3600 * j + j % 7 >= low]
        assert r.n_w == len(held)
        assert r.mean_w is None if not held else r.mean_w == pytest.approx(statistics.fmean(held))
        assert r.std_w is None if len(held) < 2 else r.std_w == pytest.approx(statistics.stdev(held))


@pytest.mark.parametrize("width", [2, 3, 12])
def test_equal_values_have_no_spread_and_others_have(spark, width):
    rng = random.Random(width)
    rows, value = [], 0.1
    for i in range(600):
        if rng.random() < .06:
            value = rng.choice([0.1, 0.7, 0.1 + 0.2, None])
        rows.append((i, rng.choice(["a", "b"]), D(0) + timedelta(minutes=rng.randint(0, 20_000)), value))
    rows.sort(key=lambda r: r[2])
    rows = [(i, a, t, None if rng.random() < .1 else 0.3 if (t - D(0)).days % 5 else rng.choice([0.1, 0.3])) for i, (_, a, t, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id long, account_id string, txn_ts timestamp, amount double")
    got = {r.id: (r.n_30d, r.std_30d) for r in trailing_features(df, Windows(velocity=H, baseline=width * H, pane=H)).collect()}
    for i, a, t, _ in rows:
        held = [v for _, b, s, v in rows if b == a and t - width * H <= s < t and v is not None]
        n, std = got[i]
        assert n == len(held)
        if len(held) < 2:
            assert std is None
        elif len(set(held)) == 1:
            assert std == 0.0
        else:
            assert std == pytest.approx(statistics.stdev(held)) and std > 0


def test_partitions_are_not_joined_by_their_compressed_bytes(spark):
    rows = [(i, i % 97, D(i % 50), float(i % 13)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, account_id long, txn_ts timestamp, amount double")
    at = trailing_features(df).select("id", F.spark_partition_id().alias("part"))
    sizes = [r["count"] for r in at.groupBy("part").count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 1000 and sum(sizes) == 2000


def paid(spark, n):
    return spark.range(n).select(F.col("id"), (F.col("id") % 7).alias("account_id"), F.timestamp_seconds(1_700_000_000 + 9000 * F.col("id")).alias("txn_ts"),
                                 F.col("id").cast("double").alias("amount"), F.lit("x").alias("category"))


@pytest.mark.parametrize("key", ["bigint", "string", "double"])
def test_scans_and_totals_read_one_exchange(spark, key):
    txn = paid(spark, 300).withColumn("account_id", F.when(F.col("id") % 50 > 0, F.col("account_id")).cast(key))
    homes = spark.range(7).select(F.col("id").cast(key).alias("account_id"), F.lit("GB").alias("home"), F.timestamp_seconds(F.lit(0)).alias("valid_from"))
    df = point_in_time(txn, [Trailing("w", timedelta(days=3), value="amount", moments=True), Latest("v", homes, ("home",))]).select("id", "n_w", "v")
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan
    # those without an account saw nothing, and nobody saw them
    assert {r.n_w for r in rows if r.id % 50 == 0} == {0} and {r.v for r in rows if r.id % 50 == 0} == {None}
    want = {i: sum(1 for j in range(max(0, i - 28), i) if j % 7 == i % 7 and j % 50) for i in range(300) if i % 50}
    assert {r.id: r.n_w for r in rows if r.id % 50} == want


def test_partitions_follow_the_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(paned, "PARTITION_ROWS", 10)
    txn = paid(spark, 205)
    for sized, number in ((None, 21), (txn.limit(90), 9), (txn.limit(20), 4)):
        df = point_in_time(txn, [Trailing("w", timedelta(days=3))], sized=sized)
        assert re.findall(r"RepartitionByExpression \[__key#\d+L?, __pane#\d+L?\], (\d+)", df._jdf.queryExecution().optimizedPlan().toString())[0] == str(number)
