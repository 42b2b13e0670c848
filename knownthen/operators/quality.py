"""Checks a dataset must pass before its label history is used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from knownthen.operators.temporal import Basis, timeline
from knownthen.sources.facts import FactLogs

LEGACY_TABLE = "fraud_status"


def unlabelled_transactions(logs: FactLogs, basis: Basis = Basis()) -> DataFrame:
    """Transactions visible at the basis that have no current label."""
    return logs.transactions(basis).select("id", "account_id", "txn_ts").join(
        logs.labels(basis).select("id"), "id", "left_anti")


def closed_histories(logs: FactLogs, basis: Basis = Basis()) -> DataFrame:
    """Ids whose last classification has ended: nothing is in force now."""
    return (timeline(logs.label, basis, logs.pane).groupBy("id")
            .agg(F.max(F.coalesce("valid_to", F.lit("9999-12-31").cast("timestamp"))).alias("ends"))
            .filter(F.col("ends") < F.lit("9999-12-31").cast("timestamp")))


def misdated_labels(label_log: DataFrame) -> DataFrame:
    """Label facts that do not apply from the moment they were learned."""
    return label_log.filter(F.col("valid_from") != F.col("system_from"))


def require_label_history(logs: FactLogs, basis: Basis = Basis()) -> None:
    """Reject a dataset in which some transaction has no current label."""
    if not unlabelled_transactions(logs, basis).isEmpty():
        raise RuntimeError("incomplete label history: see unlabelled_transactions()")


def require_current_tables(spark: SparkSession) -> None:
    """Reject a catalog that still holds the legacy status table, before reading anything else."""
    if spark.catalog.tableExists(LEGACY_TABLE):
        raise RuntimeError(f"table {LEGACY_TABLE} belongs to an older data model: start from a fresh dataset")
