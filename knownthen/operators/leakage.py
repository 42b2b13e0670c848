"""How much a query that ignores when labels became known would leak."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from knownthen.operators.features import HINDSIGHT, KNOWN_THEN, Windows, labelled, newest, prior_fraud, prior_fraud_measure, settled
from knownthen.operators.paned import Trailing, point_in_time
from knownthen.operators.temporal import Basis
from knownthen.functions.rules import as_flag
from knownthen.sources.facts import FactLogs
from knownthen.sources.shared import written


def leaky_counts(logs: FactLogs, basis: Basis, windows: Windows = Windows(),
                 resolved_before: datetime | None = None) -> DataFrame:
    """Prior fraud counted with current outcomes only, whenever they arrived. A transaction without a label fails the read."""
    txn = labelled(settled(logs.transactions(basis), resolved_before).select("id", "account_id", "txn_ts"), logs, basis).drop("learned_at")
    bad = F.when(F.col("is_fraud"), F.col("txn_ts"))  # the label comes with the anchor: no second join for the frauds
    frauds = txn.select("account_id", bad.alias("txn_ts"))
    counted = point_in_time(txn.drop("is_fraud"), [Trailing("leaky", windows.fraud, facts=frauds)], pane=windows.pane)
    return counted.withColumnRenamed("n_leaky", "pcf_leaky")


def leakage_rows(logs: FactLogs, basis: Basis, resolved_before: datetime,
                 windows: Windows = Windows()) -> DataFrame:
    """Both counts of every settled transaction, merged on id, and the difference."""
    free = prior_fraud(logs, basis, windows, resolved_before).select(
        "id", "account_id", "txn_ts", F.col(KNOWN_THEN).alias("leak_free"))
    leaky = leaky_counts(logs, basis, windows, resolved_before).select("id", "pcf_leaky")
    merged = free.join(leaky, "id", "full_outer")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("leak_free", "pcf_leaky")}
    return merged.withColumns(counts).withColumn("over", F.col("pcf_leaky") - F.col("leak_free"))


def leakage_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("rows"),
                    F.count_if(F.col("over") != 0).alias("differing"),
                    F.sum("over").alias("overcount"))


def leakage_examples(rows: DataFrame, limit: int = 8) -> DataFrame:
    return (rows.filter(F.col("over") > 0).orderBy(F.col("over").desc(), "id").limit(limit)
            .select("id", "account_id", "txn_ts", "leak_free", "pcf_leaky", "over"))


def training_totals(logs: FactLogs, basis: Basis, resolved_before: datetime) -> DataFrame:
    rows = labelled(settled(logs.transactions(basis), resolved_before), logs, basis)
    return rows.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if("is_fraud").alias("total_fraud"))


def training_sample(logs: FactLogs, basis: Basis, resolved_before: datetime, limit: int = 60,
                    windows: Windows = Windows(), selected=None) -> DataFrame:
    """The newest settled transactions with both counts; history is read for their accounts only. A `selected` transaction that
    the basis does not show is an error."""
    txn = settled(logs.transactions(basis), resolved_before)
    if selected is not None and logs.transactions(basis).filter(F.col("id") == F.lit(selected)).isEmpty():
        raise ValueError(f"unknown transaction: {selected}")
    anchors = written(newest(labelled(txn, logs, basis).drop("learned_at"), limit), "anchors")
    history = txn.join(anchors.select("account_id").distinct(), "account_id", "left_semi")
    measure = prior_fraud_measure(history, logs.label_timeline(basis), windows.fraud)
    counted = point_in_time(anchors, [measure], pane=windows.pane)
    return counted.select("id", "txn_ts", "account_id", "amount", "country", as_flag("is_fraud").alias("label"),
                          KNOWN_THEN, HINDSIGHT, (F.col(KNOWN_THEN) != F.col(HINDSIGHT)).alias("differs"))
