"""Derived streams that Structured Streaming expresses by itself."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from knownthen.functions.clock import width_us
from knownthen.streaming.runs import Run, new_run, put_batch, run_batches


def _interval(width: timedelta):
    return F.expr(f"INTERVAL {width_us(width)} MICROSECOND")


def _delay(width: timedelta) -> str:
    return f"{width_us(width)} microseconds"


def confirmations_within(txn: DataFrame, confirmed: DataFrame, longest: timedelta, lateness: timedelta) -> DataFrame:
    """Stream-stream join of transactions and their confirmations up to `longest` later;
    the watermarks let both sides forget what can no longer match."""
    left = txn.withWatermark("txn_ts", _delay(lateness)).alias("t")
    right = confirmed.withColumnRenamed("id", "confirmed_id").withWatermark("confirmed_at", _delay(lateness)).alias("c")
    return left.join(right, (F.col("t.id") == F.col("c.confirmed_id"))
                     & (F.col("c.confirmed_at") >= F.col("t.txn_ts"))
                     & (F.col("c.confirmed_at") <= F.col("t.txn_ts") + _interval(longest)))


def delivered_once(stream: DataFrame, lateness: timedelta, time: str = "txn_ts") -> DataFrame:
    """Drops redelivered ids that arrive within the watermark delay of each other."""
    return stream.withWatermark(time, _delay(lateness)).dropDuplicatesWithinWatermark(["id"])


def flips(labels: DataFrame) -> DataFrame:
    """Running first commit of either kind per id (update mode); two instants of state per id."""
    return labels.groupBy("id").agg(
        F.min(F.when(F.col("is_fraud"), F.col("system_from"))).alias("confirmed_at"),
        F.min(F.when(~F.col("is_fraud"), F.col("system_from"))).alias("first_seen"))


def daily(stream: DataFrame) -> DataFrame:
    """Transactions and amount per UTC day."""
    return stream.groupBy(F.window("txn_ts", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")).select(
        F.col("w.start").alias("day"), "n", "amount")


def sliding_velocity(df: DataFrame) -> DataFrame:
    """Transactions per account in 24-hour windows that start every hour (batch or stream)."""
    return df.groupBy("account_id", F.window("txn_ts", "24 hours", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("n")).select("account_id", F.col("w.start").alias("window_start"), "n")


def bursts(stream: DataFrame, gap: timedelta, lateness: timedelta) -> DataFrame:
    """The runs of `operators.sessions.sessions` on a stream, each once the watermark has passed its end; its state is dropped then. Facts later
    than `lateness` are in no run. Partial sessions are merged before the shuffle where the session allows it."""
    session = F.session_window("txn_ts", _delay(gap))
    return (stream.filter(F.col("account_id").isNotNull()).withWatermark("txn_ts", _delay(lateness)).groupBy("account_id", session.alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
            .select("account_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "amount"))


def collected(stream: DataFrame, mode: str, keys: list[str] | None = None, run: Run | None = None) -> DataFrame:
    """Run a derived stream over what is available and read its result.

    With `keys` the last value per key stands (update mode); complete mode keeps the last
    batch only by the same rule. With a `run` that was started before, what it had is there too.
    """
    spark = stream.sparkSession
    run = run or new_run(spark, "derived")
    root = run.folder
    run_batches(stream, lambda batch, n: put_batch(batch, root, "out", n), mode, run)
    out = spark.read.schema(stream.schema).parquet(f"{root}/out")
    if keys is None:
        return out.drop("batch")
    rest = [c for c in out.columns if c not in (*keys, "batch")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, "v.*")
