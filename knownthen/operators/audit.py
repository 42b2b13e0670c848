"""Pending chargebacks: what confirming them would change, confirming, and replay."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from knownthen.functions.clock import after, at, before
from knownthen.functions.rules import CASE_DELTA
from knownthen.operators.features import US, Windows, complete, requests_from, serve
from knownthen.operators.feed import states
from knownthen.operators.model import LinearModel
from knownthen.operators.paned import Active, Trailing
from knownthen.operators.temporal import Basis, DELETE, PUT, snapshots
from knownthen.sources.facts import FactLogs

LOOKBACK = timedelta(days=120)
BURST = timedelta(days=90)
CANDIDATES = 4


def pending_accounts(logs: FactLogs, basis: Basis = Basis()) -> DataFrame:
    return logs.pendings(basis).select("account_id").distinct()


def pending_burst(logs: FactLogs, horizon: datetime, basis: Basis = Basis()) -> DataFrame:
    """Unconfirmed chargebacks of the 90 days before the horizon."""
    t = F.col("txn_ts")
    return logs.pendings(basis).filter((t < at(horizon)) & (t >= before(at(horizon), BURST)))


def audit_candidates(logs: FactLogs, basis: Basis = Basis(), limit: int = 40) -> DataFrame:
    """Newest pairs of a pending chargeback and a later transaction of its account.

    A transaction has a partner iff it is later than the account's first pending one, so
    the newest `limit` such transactions hold the newest `limit` pairs; only those are
    paired up.
    """
    pending = logs.pendings(basis).select(
        F.col("id").alias("fraud_id"), "account_id", F.col("txn_ts").alias("fraud_ts"))
    first = pending.groupBy("account_id").agg(F.min("fraud_ts").alias("first_ts"))
    later = logs.transactions(basis).select(
        F.col("id").alias("later_id"), "account_id", F.col("txn_ts").alias("later_ts"), "amount", "country")
    tops = (later.join(first, "account_id").filter(F.col("later_ts") > F.col("first_ts")).drop("first_ts")
            .orderBy(F.col("later_ts").desc(), F.col("later_id").desc()).limit(limit))
    pairs = pending.join(tops, "account_id").filter(F.col("later_ts") > F.col("fraud_ts"))
    return (pairs.orderBy(F.col("later_ts").desc(), F.col("later_id").desc(), F.col("fraud_id").desc()).limit(limit)
            .select("fraud_id", "account_id", "fraud_ts", "later_id", "later_ts", "amount", "country"))


def newest_per_account(txn: DataFrame, n: int) -> DataFrame:
    """The n newest transactions of each account. Ranks are cut on the map side first, so
    a busy account sends n rows per task."""
    order = Window.partitionBy("account_id").orderBy(F.col("txn_ts").desc(), F.col("id").desc())
    return txn.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= n).drop("__rank")


def pending_before(pending: DataFrame, name: str = "n") -> Active:
    """Counts the account's given pending chargebacks strictly before an instant."""
    return Active(pending.select("account_id", after("txn_ts", US).alias("start"),
                                 F.lit(None).cast("timestamp").alias("stop")), {name: ("start", "stop")})


def _moved(df: DataFrame, model: LinearModel) -> DataFrame:
    """Scores before and after adding the pending ones to prior fraud."""
    after_n = model.prob(prior_confirmed_fraud=F.col("prior_confirmed_fraud") + F.col("n"))
    return (df.withColumn("before", model.prob()).withColumn("after", after_n)
            .withColumn("delta", F.col("after") - F.col("before"))
            .withColumn("model_version", F.lit(model.version)))


def impact_per_account(logs: FactLogs, model: LinearModel, horizon: datetime, basis: Basis = Basis(),
                       windows: Windows = Windows()) -> DataFrame:
    """For each account with a pending burst, the recent transaction whose score would
    move most if the burst were confirmed. All accounts in one plan."""
    burst = pending_burst(logs, horizon, basis)
    sizes = burst.groupBy("account_id").agg(F.count(F.lit(1)).alias("n_account"))
    recent = logs.transactions(basis).filter(F.col("txn_ts") > at(horizon - LOOKBACK))
    subjects = newest_per_account(recent.join(sizes.select("account_id"), "account_id", "left_semi"), CANDIDATES)
    vectors = serve(requests_from(subjects), logs.around(sizes), basis, windows, extra=[pending_before(burst)])
    scored = _moved(vectors, model).filter(F.col("n") > 0)
    best = Window.partitionBy("account_id").orderBy(
        F.round("delta", 12).desc(), F.col("t").desc(), F.col("req_id").desc())
    return (scored.withColumn("__rank", F.row_number().over(best)).filter(F.col("__rank") == 1)
            .join(sizes, "account_id")
            .select("account_id", F.col("req_id").alias("txn_id"), F.col("t").alias("valid_time"), "amount", "country",
                    "before", "after", "delta", "n", "n_account", "model_version"))


def impactful_cases(impacts: DataFrame, limit: int = 12) -> DataFrame:
    return (impacts.filter(F.col("delta") > CASE_DELTA)
            .orderBy(F.round("delta", 12).desc(), "account_id").limit(limit))


def subject_impact(logs: FactLogs, model: LinearModel, subjects: DataFrame, basis: Basis = Basis(),
                   windows: Windows = Windows()) -> DataFrame:
    """Effect on each given transaction of confirming all earlier pending ones of its
    account, however old, and whether it is itself pending."""
    pending = logs.pendings(basis).select("id", "account_id", "txn_ts")
    sizes = pending.groupBy("account_id").agg(F.count(F.lit(1)).alias("n_account"))
    own = pending.select(F.col("id").alias("req_id"), F.lit(True).alias("self_pending"))
    vectors = serve(requests_from(subjects), logs, basis, windows, extra=[pending_before(pending)])
    return (_moved(vectors, model)
            .join(sizes, "account_id", "left").join(own, "req_id", "left")
            .select("account_id", F.col("req_id").alias("txn_id"), F.col("t").alias("valid_time"), "amount", "country",
                    "before", "after", "delta", "n", F.coalesce("n_account", F.lit(0)).alias("n_account"),
                    F.coalesce("self_pending", F.lit(False)).alias("self_pending"), "model_version"))


def account_history(logs: FactLogs, scores: DataFrame, basis: Basis = Basis(), limit: int = 30) -> DataFrame:
    """Newest transactions of each account: state, when it was learned, current score."""
    rows = newest_per_account(states(logs, basis), limit)
    return rows.join(scores.select("id", "p"), "id", "left").select(
        "account_id", "id", F.col("valid_from").alias("ts"), "amount", "country", "state", "learned_at", "p")


def confirm_facts(pending: DataFrame, confirmed_at: datetime) -> tuple[DataFrame, DataFrame]:
    """Label facts and pending deletes of one commit that confirms the given chargebacks."""
    stamp = at(confirmed_at)
    log = [stamp.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), stamp.alias("system_from"),
           F.lit(0).alias("seq")]
    labels = pending.select("id", F.lit(True).alias("is_fraud"), *log, F.lit(PUT).alias("op"))
    deletes = pending.select("id", "account_id", "txn_ts", "due", *log, F.lit(DELETE).alias("op"))
    return labels, deletes


def settle_due(logs: FactLogs, now: datetime, basis: Basis = Basis()) -> tuple[DataFrame, DataFrame]:
    """Facts that settle every pending chargeback due by `now`."""
    return confirm_facts(logs.pendings(basis).filter(F.col("due") <= at(now)), now)


def replay(logs: FactLogs, model: LinearModel, subjects: DataFrame, confirmed_at: datetime,
           basis: Basis = Basis(), windows: Windows = Windows()) -> DataFrame:
    """Confirm all pending chargebacks of the subjects' accounts at `confirmed_at`, and
    score each subject before, after, and rewound to the microsecond before the commit.

    Each prior-fraud count is read from the logs at its own basis with the same model, all in one pass over the labels;
    none is derived from another. The commit holds no transactions or account versions,
    so the other features are read once. Subjects of accounts with nothing pending come
    back unchanged, with zero counts.
    """
    accounts = subjects.select("account_id").distinct()
    pending = logs.pendings(basis).join(accounts, "account_id", "left_semi")
    labels, deletes = confirm_facts(pending, confirmed_at)
    confirmed = logs.learn(label=labels, pending=deletes)
    bases = {"before": basis if basis.system_at is not None else Basis(basis.valid_at, confirmed_at - US), "after": Basis(),
             "reproduced": Basis(system_at=confirmed_at - US)}
    states = snapshots(confirmed.label, bases, ["is_fraud"])
    txn = logs.transactions(basis).select("id", "account_id", F.col("txn_ts").alias("t"), "amount")
    # labels of transactions that the basis does not show belong to none of these
    known = complete(txn, states.filter(F.col("before").isNotNull())).select(
        "id", "account_id", "t", "amount", F.col("before.is_fraud").alias("is_fraud"),
        *[F.coalesce(F.col(f"{n}.is_fraud"), F.lit(False)).alias(f"fraud_{n}") for n in ("after", "reproduced")])
    counts = [Trailing(n, windows.fraud, facts=known, where=f"fraud_{n}") for n in ("after", "reproduced")]
    vector = serve(requests_from(subjects), logs, basis, windows, known=known, extra=[pending_before(pending, "n_prior"), *counts])
    pcf = {"before": F.col("prior_confirmed_fraud"), "after": F.col("n_after"), "reproduced": F.col("n_reproduced")}
    sizes = pending.groupBy("account_id").agg(F.count(F.lit(1)).alias("n_confirmed"))
    return vector.join(sizes, "account_id", "left").select(
        F.col("req_id").alias("txn_id"), "account_id",
        *[model.prob(prior_confirmed_fraud=c).alias(n) for n, c in pcf.items()],
        *[c.alias(f"pcf_{n}") for n, c in pcf.items()],
        F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), "n_prior",
        F.lit(model.version).alias("model_version"))
