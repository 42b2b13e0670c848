"""Point-in-time features: for all transactions at once, and for batches of requests."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from typing import Literal

from pyspark.sql import Column, DataFrame, functions as F

from knownthen.functions.clock import DAY, after, at, before
from knownthen.functions.rules import as_flag, foreign_flag, zscore
from knownthen.operators.paned import Active, Latest, Trailing, point_in_time
from knownthen.operators.temporal import Basis
from knownthen.sources.facts import FactLogs
from knownthen.sources.shared import written

FEATURES = ("amount_zscore", "txn_count_24h", "foreign", "prior_confirmed_fraud")
KNOWN_THEN = "prior_confirmed_fraud_as_known_then"
HINDSIGHT = "prior_confirmed_fraud_with_hindsight"
US = timedelta(microseconds=1)

Knowledge = Literal["as_of_decision", "current"]


@dataclass(frozen=True)
class Windows:
    """Trailing widths of velocity, spend baseline and prior fraud. A window reaches back
    inclusively and never contains its own anchor: [t - width, t)."""

    velocity: timedelta = timedelta(hours=24)
    baseline: timedelta = timedelta(days=30)
    fraud: timedelta = timedelta(days=90)
    pane: timedelta = DAY


@dataclass(frozen=True)
class FeatureSpec:
    """A feature by name, meaning, and its value over the columns of one scan."""

    name: str
    description: str
    value: Column


INCOMPLETE = "a transaction has no current label at this basis"

def feature_specs() -> list[FeatureSpec]:
    home = F.col("account_version.home_country")
    return [
        FeatureSpec("amount_zscore", "Amount against the account's own spend in the baseline window.",
                    zscore("amount", "mean_30d", "std_30d", "n_30d")),
        FeatureSpec("txn_count_24h", "Transactions of the account in the velocity window.", F.col("txn_count_24h")),
        FeatureSpec("foreign", "1 if the country is not the account's home country at that instant.",
                    foreign_flag(home, "country")),
        FeatureSpec("prior_confirmed_fraud", "Earlier transactions in the fraud window that are confirmed fraud.",
                    F.col("prior_confirmed_fraud")),
    ]


def feature_catalog(spark) -> DataFrame:
    """Name, description and defining expression of every feature, in model order."""
    return spark.createDataFrame(
        [(i, s.name, s.description, str(s.value)) for i, s in enumerate(feature_specs())],
        "position int, name string, description string, expression string")


def trailing_features(txn: DataFrame, windows: Windows = Windows()) -> DataFrame:
    """txn_count_24h, n/mean/std of the amount over the baseline, and its z-score."""
    scanned = point_in_time(
        txn, [Trailing("velocity", windows.velocity),
              Trailing("baseline", windows.baseline, value="amount", moments=True)], pane=windows.pane)
    return _named(scanned).withColumn("amount_zscore", zscore("amount", "mean_30d", "std_30d", "n_30d"))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"n_velocity": "txn_count_24h", "n_baseline": "n_30d",
                                  "mean_baseline": "mean_30d", "std_baseline": "std_30d"})


def prior_fraud_measure(txn: DataFrame, label_timeline: DataFrame, width: timedelta) -> Active:
    """Prior fraud as each decision could know it, and with the knowledge of the basis.

    A fraud label counts for later transactions of its account from just after its own
    transaction until the window has passed it: as known then only while the label
    holds, with hindsight throughout if it is the current one.
    """
    begin, end = after("txn_ts", US), after("txn_ts", width + US)
    spans = (label_timeline.filter("is_fraud").select("id", "valid_from", "valid_to")
             .join(txn.select("id", "account_id", "txn_ts"), "id")
             .select("account_id", "valid_to", begin.alias("begin"), end.alias("end"),
                     F.greatest("valid_from", begin).alias("start"), F.least("valid_to", end).alias("stop")))
    holds = F.col("start") < F.col("stop")
    spans = spans.select(
        "account_id", F.when(holds, F.col("start")).alias("start"), "stop",
        F.when(F.col("valid_to").isNull(), F.col("begin")).alias("begin"), "end")
    return Active(spans, {KNOWN_THEN: ("start", "stop"), HINDSIGHT: ("begin", "end")})


def prior_fraud(logs: FactLogs, basis: Basis, windows: Windows = Windows(),
                resolved_before: datetime | None = None) -> DataFrame:
    """Both prior-fraud counts for every transaction, labelled or not."""
    txn = settled(logs.transactions(basis), resolved_before)
    measure = prior_fraud_measure(txn, logs.label_timeline(basis), windows.fraud)
    return point_in_time(txn, [measure], pane=windows.pane)


def complete(txn: DataFrame, labels: DataFrame) -> DataFrame:
    """Transactions with the columns of `labels`, which has at most one row per id; one that has no row there fails the read."""
    there = F.coalesce(F.col("__labelled"), F.raise_error(F.lit(INCOMPLETE)).cast("boolean"))
    return txn.join(labels.withColumn("__labelled", F.lit(True)), "id", "left").filter(there).drop("__labelled")


def labelled(txn: DataFrame, logs: FactLogs, basis: Basis) -> DataFrame:
    """Transactions with the `is_fraud` and `learned_at` of their current label. One without fails the read: an incomplete label history
    must not lose transactions in silence."""
    return complete(txn, logs.labels(basis).select("id", "is_fraud", F.col("system_from").alias("learned_at")))


def settled(txn: DataFrame, resolved_before: datetime | None) -> DataFrame:
    return txn if resolved_before is None else txn.filter(F.col("txn_ts") <= at(resolved_before))


def newest(df: DataFrame, limit: int) -> DataFrame:
    """The newest transactions, ties by id: the sort-and-limit runs per partition first."""
    return df.orderBy(F.col("txn_ts").desc(), F.col("id").desc()).limit(limit)


def training_set(
    logs: FactLogs, basis: Basis = Basis(), windows: Windows = Windows(), *,
    since: datetime | None = None, account=None, resolved_before: datetime | None = None,
    limit: int | None = None, knowledge: Knowledge = "as_of_decision",
) -> DataFrame:
    """One row per labelled transaction: features as of its instant, and its label.

    All measures meet in one exchange by (account, pane). Anchor filters apply after the
    scan; `since` cuts the transactions below it to what the widest of their windows can reach. A transaction
    without a current label fails the read.
    """
    txn = settled(logs.transactions(basis), resolved_before)
    if account is not None:
        txn = txn.filter(F.col("account_id") == F.lit(account))
    histories = logs.label_timeline(basis)
    labels = histories.filter(F.col("valid_to").isNull()).select("id", "is_fraud", F.lit(True).alias("labelled"))
    # an incomplete label history fails the read instead of losing transactions
    whole = F.coalesce(F.col("labelled"), F.raise_error(F.lit(INCOMPLETE)).cast("boolean"))
    homes = logs.account_timeline(basis).select(
        F.col("id").alias("account_id"), "home_country", "valid_from", F.col("valid_to").alias("until"))
    recent = txn if since is None else txn.filter(F.col("txn_ts") >= before(at(since), max(windows.baseline, windows.velocity)))
    version = Latest("account_version", homes, ("home_country", "until"))
    moments = dict(value="amount", moments=True)

    if limit is None:
        base = recent.join(labels, "id", "left")
        trailing = [Trailing("velocity", windows.velocity), Trailing("baseline", windows.baseline, **moments)]
        frauds = prior_fraud_measure(txn, histories, windows.fraud)
    else:
        # pick the anchors once (written: `limit` rows), then read only their accounts' history
        lives = homes.select("account_id", "valid_from", "until")
        labelled = recent.join(labels, "id", "left").filter(whole).alias("t")
        alive = labelled.join(
            lives.alias("v"), (F.col("t.account_id") == F.col("v.account_id"))
            & (F.col("v.valid_from") <= F.col("t.txn_ts"))
            & (F.col("v.until").isNull() | (F.col("t.txn_ts") < F.col("v.until"))), "left_semi")
        if since is not None:
            alive = alive.filter(F.col("txn_ts") >= at(since))
        base = written(newest(alive, limit), "anchors")
        accounts = base.select("account_id").distinct()
        facts = recent.join(accounts, "account_id", "left_semi")
        history = txn.join(accounts, "account_id", "left_semi")
        trailing = [Trailing("velocity", windows.velocity, facts=facts, value="amount"),
                    Trailing("baseline", windows.baseline, facts=facts, **moments)]
        frauds = prior_fraud_measure(history, histories, windows.fraud)

    scanned = _named(point_in_time(base, [*trailing, frauds, version], pane=windows.pane, sized=recent))
    current = F.col("account_version").isNotNull() & (
        F.col("account_version.until").isNull() | (F.col("txn_ts") < F.col("account_version.until")))
    kept = scanned.filter(whole & current)
    if since is not None:
        kept = kept.filter(F.col("txn_ts") >= at(since))
    chosen = KNOWN_THEN if knowledge == "as_of_decision" else HINDSIGHT
    kept = kept.withColumn("prior_confirmed_fraud", F.col(chosen))
    return kept.select(
        "id", "account_id", "txn_ts", "amount", "country", as_flag("is_fraud").alias("label"),
        "n_30d", "mean_30d", "std_30d", KNOWN_THEN, HINDSIGHT,
        *[s.value.alias(s.name) for s in feature_specs()])


def serve(requests: DataFrame, logs: FactLogs, basis: Basis = Basis(), windows: Windows = Windows(), *,
          labelled_only: bool = True, known: DataFrame | None = None, extra: list[Active | Trailing] = ()) -> DataFrame:
    """Feature vector of each request (req_id, account_id, t, amount, country) at its own
    instant, with the labels current at the basis.

    `labelled_only` reads history through an inner join with the labels, as the one-query
    form does; without it velocity and baseline see every transaction, as the feature by
    feature form does. Both agree when every transaction has a label. `known` gives the history (id, account_id, t, amount, is_fraud) instead.
    `extra` counts ride along in the same scan.
    """
    txn = logs.transactions(basis).select("id", "account_id", F.col("txn_ts").alias("t"), "amount")
    if known is None:
        known = txn.join(logs.labels(basis).select("id", "is_fraud"), "id")
        facts = known if labelled_only else txn
    else:
        facts = known
    homes = logs.account_timeline(basis).select(
        F.col("id").alias("account_id"), "home_country", "valid_from", F.col("valid_to").alias("until"))
    scanned = point_in_time(
        requests,
        [Trailing("velocity", windows.velocity, facts=facts, value="amount"),
         Trailing("baseline", windows.baseline, facts=facts, value="amount", moments=True),
         Trailing("fraud", windows.fraud, facts=known, where="is_fraud"),
         Latest("account_version", homes, ("home_country", "until")), *extra],
        at="t", pane=windows.pane, sized=txn)
    alive = F.col("account_version.until").isNull() | (F.col("t") < F.col("account_version.until"))
    scanned = (_named(scanned).withColumnRenamed("n_fraud", "prior_confirmed_fraud")
               .withColumn("account_version", F.when(alive, F.col("account_version"))))
    counts = [n for m in extra for n in (m.spans if isinstance(m, Active) else [f"n_{m.name}"])]
    return scanned.select(*requests.columns, "n_30d", "mean_30d", "std_30d", *counts,
                          *[s.value.alias(s.name) for s in feature_specs()])


def requests_from(txn: DataFrame) -> DataFrame:
    """Each transaction as a scoring request at its own instant."""
    return txn.select(F.col("id").alias("req_id"), "account_id", F.col("txn_ts").alias("t"), "amount", "country")
