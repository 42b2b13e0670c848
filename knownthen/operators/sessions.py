"""Bursts of activity: runs of facts of one key with no more than a gap between neighbours."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window, functions as F

from knownthen.functions.clock import DAY, instant, micros, pane_of, width_us
from knownthen.operators.paned import FIRST, adjacent, running_total


def sessions(facts: DataFrame, gap: timedelta, *, key: str = "account_id", at: str = "txn_ts", value: str = "amount",
             pane: timedelta = DAY) -> DataFrame:
    """key, start, end, n and amount of each maximal run of facts whose neighbours are at most `gap` apart; `end` is `gap` after the last.

    As `session_window` gives them, but a busy key is no single task: runs are first found inside (key, pane), where one row per run is
    left of all facts, and only these rows are then chained over the panes. Facts without key or time are in no run.
    """
    us, wide = F.col("__us"), width_us(gap)
    rows = (facts.select(F.col(key), micros(at).alias("__us"), F.col(value).alias("__value"))
            .filter(F.col(key).isNotNull() & us.isNotNull()).withColumn("__pane", pane_of(us, pane)))
    inside = Window.partitionBy(key, "__pane").orderBy("__us")
    new = F.when(us - F.lag("__us").over(inside) <= wide, 0).otherwise(1)
    runs = (rows.withColumn("__new", new).withColumn("__run", F.sum("__new").over(inside.rowsBetween(FIRST, 0)))
            .groupBy(key, "__pane", "__run").agg(F.min("__us").alias("__first"), F.max("__us").alias("__until"),
                                                 F.count(F.lit(1)).alias("n"), F.sum("__value").alias("amount")).drop("__pane", "__run"))
    chained = adjacent(runs, [key], ["__first"], pane_of(F.col("__first"), pane), "__until", "__before", following=False)
    begins = F.when(F.col("__first") - F.col("__before") <= wide, 0).otherwise(1)
    numbered = running_total(chained, [key], ["__first"], pane_of(F.col("__first"), pane), begins.cast("long"), "__run")
    return numbered.groupBy(key, "__run").agg(
        instant(F.min("__first")).alias("start"), instant(F.max("__until") + wide).alias("end"), F.sum("n").alias("n"),
        F.sum("amount").alias("amount")).drop("__run")
