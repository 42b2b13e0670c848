"""The fact logs one analysis works on, and appending to them."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from knownthen.functions.clock import DAY, at
from knownthen.operators.temporal import PUT, Basis, known, replayed_timeline, snapshot, timeline
from knownthen.sources.shared import read_if_present, written

TXN_SCHEMA = "account_id {key}, txn_ts timestamp, amount double, category string, country {country}"
PENDING_SCHEMA = "account_id {key}, txn_ts timestamp, due timestamp"
LOG_SCHEMA = "valid_from timestamp, valid_to timestamp, system_from timestamp, seq int, op string"


@dataclass(frozen=True)
class FactLogs:
    """Logs of transactions, accounts, labels and pending chargebacks.

    `replayed`: labels and accounts were written in learned-at order (see
    `replayed_timeline`). `restated`: a transaction id may have been written twice.
    """

    txn: DataFrame
    account: DataFrame
    label: DataFrame
    pending: DataFrame
    replayed: bool = True
    restated: bool = False
    pane: timedelta = DAY

    def transactions(self, basis: Basis) -> DataFrame:
        if self.restated:
            return snapshot(self.txn, basis).drop("valid_to")
        once = (F.col("op") == PUT) & (F.col("seq") == 0) & F.col("valid_to").isNull()
        plain = F.when(once, True).otherwise(F.raise_error(F.lit("transactions were restated: use restated=True")).cast("boolean"))
        return known(self.txn, basis).filter(plain).drop("valid_to", "seq", "op")

    def labels(self, basis: Basis) -> DataFrame:
        return snapshot(self.label, basis)

    def pendings(self, basis: Basis) -> DataFrame:
        return snapshot(self.pending, basis)

    def label_timeline(self, basis: Basis) -> DataFrame:
        return self._timeline(self.label, basis)

    def account_timeline(self, basis: Basis) -> DataFrame:
        return self._timeline(self.account, basis)

    def _timeline(self, log: DataFrame, basis: Basis) -> DataFrame:
        read = replayed_timeline if self.replayed else timeline
        return read(log, basis, self.pane)

    def around(self, accounts: DataFrame, since: datetime | None = None, until: datetime | None = None) -> "FactLogs":
        """The part of these logs that can matter to some accounts over some event time.

        Time bounds prune the scan of transactions, whose ids then narrow the labels, whenever those were learned.
        The filters are semi joins, so a small side is broadcast by size and a large one shuffled.
        """
        txn, account = self.txn, self.account
        if since is not None:
            txn = txn.filter(F.col("txn_ts") >= at(since))
        if until is not None:
            txn = txn.filter(F.col("txn_ts") <= at(until))
        account_ids = accounts.select("account_id").distinct()
        txn = txn.join(account_ids, "account_id", "left_semi")
        return replace(self, label=self.label.join(txn.select("id").distinct(), "id", "left_semi"), txn=txn,
                       account=account.join(account_ids, F.col("id") == F.col("account_id"), "left_semi"))

    def learn(self, *, label: DataFrame | None = None, pending: DataFrame | None = None) -> "FactLogs":
        """These logs with further facts, without writing them."""
        return replace(
            self,
            label=self.label if label is None else self.label.unionByName(label),
            pending=self.pending if pending is None else self.pending.unionByName(pending))


def read_once(logs: FactLogs) -> FactLogs:
    """The logs with transactions and labels written, for those that are costly to derive and read several times."""
    return replace(logs, txn=written(logs.txn, "near"), label=written(logs.label, "near"))


def latest_commit(*logs: DataFrame) -> DataFrame:
    """One row: the newest system time over all logs."""
    stamps = None
    for log in logs:
        one = log.agg(F.max("system_from").alias("system_from"))
        stamps = one if stamps is None else stamps.unionByName(one)
    return stamps.agg(F.max("system_from").alias("latest_commit"))


def next_commit(now: datetime, *logs: DataFrame) -> datetime:
    """System time of the next commit: now, or just after the last one if that is not past."""
    micros = latest_commit(*logs).select(F.unix_micros("latest_commit")).first()[0]
    if micros is None:
        return now
    last = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)
    return max(now, last + timedelta(microseconds=1))


def append_facts(facts: DataFrame, path: str, system_time: datetime) -> None:
    """Commit a batch to the log at `path`, every row stamped with one system time.

    System time only moves forward: the batch must be newer than the log's last commit.
    The log is partitioned by the UTC day of the commit, so the check reads the newest day
    only and a basis leaves later days unread.
    """
    last = _last_commit(facts.sparkSession, path)
    if last is not None and last >= system_time:
        raise ValueError(f"system time {system_time} is not after the last commit {last}")
    stamped = facts.withColumn("system_from", at(system_time))
    (stamped.withColumn("system_day", F.lit(_day(system_time)))
     .write.mode("append").partitionBy("system_day").parquet(path))


def _day(ts: datetime) -> str:
    return ts.astimezone(timezone.utc).strftime("%Y-%m-%d")


def _last_commit(spark: SparkSession, path: str) -> datetime | None:
    stamps = read_if_present(spark, path, "system_from timestamp, system_day string")
    if stamps is None:
        return None
    newest = stamps.agg(F.max("system_day")).first()[0]  # partition values and footers only
    us = stamps.filter(F.col("system_day") == newest).agg(F.max(F.unix_micros("system_from"))).first()[0]
    return None if us is None else datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)


def read_log(spark: SparkSession, path: str, schema: str, system_at: datetime | None = None) -> DataFrame:
    """The log at `path` as known at a system time; one nobody has written to reads as empty."""
    log = read_if_present(spark, path, schema + ", system_day string")
    if log is None:
        return spark.createDataFrame([], schema)
    if system_at is not None:
        log = log.filter((F.col("system_day") <= _day(system_at)) & (F.col("system_from") <= at(system_at)))
    return log.drop("system_day")


def optional_table(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A catalog table, or an empty frame of its schema where it does not exist yet."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)
