"""Pane aggregates kept up to date by commits, so that a scoring request reads a few rows of its account.

A request's window falls into whole panes and two partial ones. For the whole ones the table `panes` has mergeable moments per (account, pane);
for the others `facts` has the transactions of an account by pane. A commit adds moments of its new transactions and the change of
fraud counts that its labels make; a read adds up what commits wrote. All tables are partitioned by a hash of the account, and
sorted by account inside, so a request reads its own bucket, and of that the row groups of its account.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from knownthen.functions.clock import DAY, at, micros, pane_of, width_us
from knownthen.functions.rules import foreign_flag, zscore
from knownthen.operators.features import Windows, labelled
from knownthen.operators.temporal import Basis, snapshot
from knownthen.sources.facts import FactLogs
from knownthen.sources.store import Commit, CommittedTables

BUCKETS = 64
#: a larger batch of requests reads all buckets; with more commits their records are joined, not listed
FEW_REQUESTS, FEW_COMMITS = 1000, 10_000
#: rows; number, mean, summed squares about it and extremes of the amounts; change of the number of frauds
MOMENTS = "n bigint, k bigint, mean double, m2 double, lo double, hi double, frauds bigint"


class ServingPanes(CommittedTables):
    """`key` and `country` are the types of account ids and of countries."""

    def __init__(self, spark: SparkSession, root: str, key: str = "bigint", country: str = "bigint", pane: timedelta = DAY, buckets: int = BUCKETS):
        self.pane, self.buckets, self._tables = pane, buckets, {}
        schemas = {"panes": f"account_id {key}, pane bigint, {MOMENTS}",
                   "facts": f"account_id {key}, pane bigint, us bigint, n bigint, amount double, frauds bigint",
                   "versions": f"account_id {key}, home_country {country}, valid_from timestamp, until timestamp, seen timestamp"}
        bucket = F.pmod(F.xxhash64("account_id"), F.lit(buckets)).cast("int")
        super().__init__(spark, root, schemas, {t: {"bucket": ("int", bucket)} for t in schemas})

    def _write(self, name: str, rows: DataFrame, attempt: str) -> None:
        bucket = self.parts[name]["bucket"][1]
        order = [c for c in ("account_id", "pane") if c in self.columns[name]]
        super()._write(name, rows.repartition(self.buckets, bucket).sortWithinPartitions(bucket, *order), attempt)

    # --- keeping up ---

    def update(self, logs: FactLogs, since: datetime | None, until: datetime) -> Commit:
        """Bring the tables from what the logs knew at `since` (None: nothing) to what they know at `until`, in one commit.

        Transactions and labels learned in between are read, and the earlier label of those ids. Every transaction needs a label.
        """
        new, old = Basis(system_at=until), None if since is None else Basis(system_at=since)
        txn = logs.transactions(new)
        fresh = labelled(txn if since is None else txn.filter(F.col("system_from") > at(since)), logs, new)
        fresh = fresh.select("id", "account_id", micros("txn_ts").alias("us"), "amount")
        steps = self._fraud_steps(logs, txn, old, new)
        pane = pane_of(F.col("us"), self.pane)
        facts = fresh.select("account_id", "us", F.lit(1).cast("long").alias("n"), "amount", F.lit(0).cast("long").alias("frauds")).unionByName(
            steps.select("account_id", "us", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("amount"), "frauds")).withColumn("pane", pane)
        panes = facts.filter(F.col("account_id").isNotNull() & F.col("us").isNotNull()).groupBy("account_id", "pane").agg(
            F.sum("n").alias("n"), F.count("amount").alias("k"), F.avg("amount").alias("mean"), (F.var_pop("amount") * F.count("amount")).alias("m2"),
            F.min("amount").alias("lo"), F.max("amount").alias("hi"), F.sum("frauds").alias("frauds"))
        homes = logs.account_timeline(new).select(F.col("id").alias("account_id"), "home_country", "valid_from", F.col("valid_to").alias("until"), at(until).alias("seen"))
        if since is not None:  # versions of accounts of which something was learned
            changed = logs.account.filter((F.col("system_from") > at(since)) & (F.col("system_from") <= at(until))).select(F.col("id").alias("account_id")).distinct()
            homes = homes.join(changed, "account_id", "left_semi")
        commit = self.commit({"facts": facts, "panes": panes, "versions": homes}, until)
        self._tables = {}
        return commit

    def _fraud_steps(self, logs: FactLogs, txn: DataFrame, old: Basis | None, new: Basis) -> DataFrame:
        """account_id, us and frauds: +1 where a transaction turned fraud between the bases, -1 where it ceased to be."""
        if old is None:
            changed = snapshot(logs.label, new).filter("is_fraud").select("id", F.lit(1).cast("long").alias("frauds"))
        else:
            learned = logs.label.filter((F.col("system_from") > at(old.system_at)) & (F.col("system_from") <= at(new.system_at))).select("id").distinct()
            some = logs.label.join(learned, "id", "left_semi")
            now = snapshot(some, new).select("id", F.col("is_fraud").alias("now"))
            was = snapshot(some, old).select("id", F.col("is_fraud").alias("was"))
            step = F.coalesce(F.col("now"), F.lit(False)).cast("long") - F.coalesce(F.col("was"), F.lit(False)).cast("long")
            changed = now.join(was, "id", "full_outer").select("id", step.alias("frauds")).filter("frauds <> 0")
        return txn.select("id", "account_id", micros("txn_ts").alias("us")).join(changed, "id").select("account_id", "us", "frauds")

    # --- requests ---

    def refresh(self) -> None:
        """See commits of other writers from now on; a store's own updates are seen anyway. Files are listed here, once."""
        found = [r.attempt for r in self.commits().select("attempt").limit(FEW_COMMITS + 1).collect()]
        self._tables = {name: self.rows(name, found if len(found) <= FEW_COMMITS else None) for name in self.schemas}

    def _asked(self, requests: DataFrame) -> Column:
        """Condition on the rows of the tables: of a few accounts their buckets and rows, of many all."""
        some = requests.select("account_id", self.parts["panes"]["bucket"][1].alias("bucket")).limit(FEW_REQUESTS + 1).collect()
        if len(some) > FEW_REQUESTS:
            return F.lit(True)
        some = {r.account_id: r.bucket for r in some if r.account_id is not None}
        return F.col("bucket").isin(sorted(set(some.values()))) & F.col("account_id").isin(list(some))

    def serve(self, requests: DataFrame, windows: Windows = Windows()) -> DataFrame:
        """The vectors that `features.serve` gives for these requests at the last update: req_id, account_id, t, amount, country, n_30d, mean_30d,
        std_30d and the features.

        `req_id` is unique. A request meets the panes of its account between its first and its own, one row each, and the facts of at most four panes. A
        request without account or instant has empty windows.
        """
        widths = {"velocity": windows.velocity, "baseline": windows.baseline, "fraud": windows.fraud}
        if any(width_us(w) % width_us(self.pane) for w in widths.values()):
            raise ValueError(f"windows are whole numbers of panes of {self.pane}")
        asked = requests.withColumn("__us", micros("t")).withColumn("__pane", pane_of(F.col("__us"), self.pane))
        slim = asked.select("req_id", "account_id", "__us", "__pane", F.coalesce("amount", F.lit(0.0)).alias("__asked"))
        reach = {n: w // self.pane for n, w in widths.items()}
        longest = max(reach.values())
        if not self._tables:
            self.refresh()
        asked_for = self._asked(requests)

        def read(name):
            return self._tables[name].filter(asked_for).drop("bucket", "attempt")

        panes = read("panes").groupBy("account_id", "pane").agg(
            F.sum("n").alias("n"), F.sum("k").alias("k"), *_merged(F.lit(0.0)), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("frauds").alias("frauds"))
        whole = slim.join(panes, "account_id").filter((F.col("pane") < F.col("__pane")) & (F.col("pane") > F.col("__pane") - longest))
        whole = whole.select("req_id", "__asked", "n", "k", "mean", "m2", "lo", "hi", "frauds", *[
            (F.col("pane") > F.col("__pane") - k).alias(f"in_{n}") for n, k in reach.items()])

        edges = slim.withColumn("pane", F.explode(F.array_distinct(F.array("__pane", *[F.col("__pane") - k for k in reach.values()]))))
        facts = read("facts").select("account_id", "pane", "us", "n", "amount", "frauds")
        inside = {n: (F.col("us") < F.col("__us")) & (F.col("us") >= F.col("__us") - width_us(w)) & (
            (F.col("pane") == F.col("__pane")) | (F.col("pane") == F.col("__pane") - reach[n])) for n, w in widths.items()}
        spent, one = F.col("amount"), F.col("amount").isNotNull()
        partial = edges.join(facts, ["account_id", "pane"]).select(
            "req_id", "__asked", "n", F.when(one, 1).otherwise(0).cast("long").alias("k"), spent.alias("mean"), F.when(one, 0.0).alias("m2"),
            spent.alias("lo"), spent.alias("hi"), "frauds", *[c.alias(f"in_{n}") for n, c in inside.items()])

        parts = whole.unionByName(partial)
        base = F.col("in_baseline") & F.col("mean").isNotNull()
        only = lambda c: F.when(base, F.col(c))
        total = parts.groupBy("req_id").agg(
            F.sum(F.when(F.col("in_velocity"), F.col("n")).otherwise(0)).alias("txn_count_24h"),
            F.sum(F.when(F.col("in_fraud"), F.col("frauds")).otherwise(0)).alias("prior_confirmed_fraud"),
            F.sum(only("k")).alias("n_30d"), *_merged(F.col("__asked"), base), F.min(only("lo")).alias("lo"), F.max(only("hi")).alias("hi"))
        std = F.when(F.col("n_30d") < 2, None).when(F.col("lo") == F.col("hi"), 0.0).otherwise(
            F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / (F.col("n_30d") - 1)))
        zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("txn_count_24h", "prior_confirmed_fraud", "n_30d")}
        out = requests.join(total.withColumn("std_30d", std).withColumnRenamed("mean", "mean_30d"), "req_id", "left").withColumns(zero)

        last = F.max("seen").over(Window.partitionBy("account_id"))
        current = read("versions").withColumn("__last", last).filter(F.col("seen") == F.col("__last"))
        homes = slim.join(current, "account_id").filter((micros("valid_from") <= F.col("__us")) & (
            F.col("until").isNull() | (F.col("__us") < micros("until")))).select("req_id", "home_country")
        return (out.join(homes, "req_id", "left").select(
            *requests.columns, "n_30d", "mean_30d", "std_30d", zscore("amount", "mean_30d", "std_30d", "n_30d").alias("amount_zscore"), "txn_count_24h",
            foreign_flag("home_country", "country").alias("foreign"), "prior_confirmed_fraud"))


def _merged(near: Column, of: Column | None = None) -> list[Column]:
    """Mean and summed squares of several parts (k, mean, m2); deviations are taken from a value near them, the same in a group."""
    keep = (lambda c: c) if of is None else (lambda c: F.when(of, c))
    d, k = F.col("mean") - near, keep(F.when(F.col("mean").isNotNull(), F.col("k")))
    count, shift = F.nullif(F.sum(k), F.lit(0)), F.sum(k * d)
    return [(F.max(near) + shift / count).alias("mean"), (F.sum(keep(F.col("m2"))) + F.sum(k * d * d) - shift * shift / count).alias("m2")]
