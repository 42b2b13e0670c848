"""All fact logs of one analysis in one folder, written by commits that readers see whole or not at all.

A commit writes its facts of every table into new folders, `<table>/attempt=<a>/system_day=<d>`, and then one record into
`commits`. Readers take only facts of attempts that a record names, so what a writer left that died between two tables is never
seen, and a retry writes anew. The record also names the batch of a stream that it holds, so a batch that is delivered again
commits nothing. There is one writer; system time only moves forward.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from knownthen.functions.clock import at
from knownthen.sources.facts import LOG_SCHEMA, PENDING_SCHEMA, TXN_SCHEMA, FactLogs
from knownthen.sources.shared import read_if_present

COMMIT_SCHEMA = "attempt string, system_time timestamp, clock timestamp, source string, batch long"
TABLES = ("txn", "account", "label", "pending")
UNIX = datetime(1970, 1, 1, tzinfo=timezone.utc)
DAY_FORMAT = "yyyy-MM-dd"


@dataclass(frozen=True)
class Commit:
    """A commit record: its stamp, and the newest event time that its writer had seen."""

    system_time: datetime
    clock: datetime


class CommittedTables:
    """Tables below `root`: schema by name, and by name the partition columns with what they are computed from."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], parts: dict[str, dict[str, tuple[str, Column]]]):
        self.spark, self.root, self.schemas, self.parts = spark, root, schemas, parts
        self.columns = {t: [c.split()[0] for c in s.split(", ")] for t, s in schemas.items()}

    # --- commits ---

    def commits(self) -> DataFrame:
        """The records of all commits."""
        records = read_if_present(self.spark, os.path.join(self.root, "commits"), COMMIT_SCHEMA)
        return self.spark.createDataFrame([], COMMIT_SCHEMA) if records is None else records

    def _found(self, records: DataFrame) -> Commit | None:
        row = records.agg(F.max_by(F.struct(F.unix_micros("system_time").alias("s"), F.unix_micros("clock").alias("c")), "system_time").alias("r")).first()
        return None if row.r is None else Commit(*(UNIX + timedelta(microseconds=us) for us in (row.r.s, row.r.c)))

    def last(self) -> Commit | None:
        return self._found(self.commits())

    def committed(self, source: str, batch: int) -> Commit | None:
        """The commit that holds a batch of a stream, if there is one."""
        return self._found(self.commits().filter((F.col("source") == source) & (F.col("batch") == batch)))

    def next_time(self, now: datetime) -> datetime:
        """The stamp of a commit at `now`: just after the last one where that is not past."""
        last = self.last()
        return now if last is None else max(now, last.system_time + timedelta(microseconds=1))

    def commit(self, tables: dict[str, DataFrame], now: datetime, *, clock: datetime | None = None, source: str | None = None,
               batch: int | None = None) -> Commit:
        """Append rows to several tables under one stamp; they appear together, or none does.

        A batch that is already there is not written again; its commit is returned.
        """
        if unknown := set(tables) - set(self.schemas):
            raise ValueError(f"no such tables: {sorted(unknown)}")
        if source is not None and (done := self.committed(source, batch)) is not None:
            return done
        stamp, attempt = self.next_time(now), uuid.uuid4().hex
        for name, rows in tables.items():
            self._write(name, self._stamped(name, rows, stamp), attempt)
        clock = clock or now
        self._record(Row(attempt=attempt, system_time=stamp, clock=clock, source=source, batch=batch))
        return Commit(stamp, clock)

    def _stamped(self, name: str, rows: DataFrame, stamp: datetime) -> DataFrame:
        return rows

    def _write(self, name: str, rows: DataFrame, attempt: str) -> None:
        parts = {p: c for p, (_, c) in self.parts[name].items()}
        (rows.select(*self.columns[name]).withColumns(parts).write.mode("overwrite").partitionBy(*parts)
         .parquet(os.path.join(self.root, name, f"attempt={attempt}")))

    def _record(self, record: Row) -> None:
        """One file, which appears by a rename: the instant of the commit."""
        self.spark.createDataFrame([record], COMMIT_SCHEMA).coalesce(1).write.mode("append").parquet(os.path.join(self.root, "commits"))

    # --- reading ---

    def rows(self, name: str, attempts: list[str] | None = None) -> DataFrame:
        """The committed rows of a table with its partition columns. A reader that knows the attempts names them, so that only their folders
        are looked at and the records are not read again."""
        parts = "".join(f", {p} {kind}" for p, (kind, _) in self.parts[name].items())
        rows = read_if_present(self.spark, os.path.join(self.root, name), f"{self.schemas[name]}, attempt string{parts}")
        if rows is None:
            return self.spark.createDataFrame([], self.schemas[name] + parts)
        if attempts is not None:
            return rows.filter(F.col("attempt").isin(attempts))
        return rows.join(self.commits().select("attempt"), "attempt", "left_semi")


class FactStore(CommittedTables):
    """The logs of `FactLogs` below `root`; `key` and `country` are the types of ids and of countries. Facts carry the stamp of their commit."""

    def __init__(self, spark: SparkSession, root: str, key: str = "bigint", country: str = "bigint"):
        own = {"txn": TXN_SCHEMA, "account": "name string, home_country {country}, tier string", "label": "is_fraud boolean", "pending": PENDING_SCHEMA}
        schemas = {t: f"id {key}, {s.format(key=key, country=country)}, {LOG_SCHEMA}" for t, s in own.items()}
        parts = {t: {"system_day": ("string", F.date_format("system_from", DAY_FORMAT))} for t in TABLES}
        parts["pending"]["due_day"] = ("string", F.date_format("due", DAY_FORMAT))
        super().__init__(spark, root, schemas, parts)

    def _stamped(self, name: str, rows: DataFrame, stamp: datetime) -> DataFrame:
        return rows.withColumn("system_from", at(stamp))

    def import_history(self, tables: dict[str, DataFrame], now: datetime) -> Commit:
        """Facts that bring their own system times, as the first commit."""
        if self.last() is not None:
            raise ValueError("history is imported into an empty store only")
        attempt = uuid.uuid4().hex
        for name, rows in tables.items():
            self._write(name, rows, attempt)
        self._record(Row(attempt=attempt, system_time=now, clock=now, source=None, batch=None))
        return Commit(now, now)

    def facts(self, name: str, system_at: datetime | None = None, due: tuple[datetime | None, datetime] | None = None) -> DataFrame:
        """The committed facts of a table, with those later than `system_at` unread; of pending facts only those due in (from, to] if `due`
        is given. Both prune whole days."""
        rows = self.rows(name)
        if system_at is not None:
            rows = rows.filter((F.col("system_day") <= _day(system_at)) & (F.col("system_from") <= at(system_at)))
        if due is not None:
            low, high = due
            rows = rows.filter((F.col("due_day") <= _day(high)) & (F.col("due") <= at(high)))
            if low is not None:
                rows = rows.filter((F.col("due_day") >= _day(low)) & (F.col("due") > at(low)))
        return rows.select(*self.columns[name])

    def logs(self, system_at: datetime | None = None, **settings) -> FactLogs:
        """The logs as of a system time, for every operator that takes `FactLogs`."""
        return FactLogs(**{t: self.facts(t, system_at) for t in TABLES}, **settings)


def _day(ts: datetime) -> str:
    return ts.astimezone(timezone.utc).strftime("%Y-%m-%d")
