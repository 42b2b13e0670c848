"""What changed: corrections, the activity feed, and differences between two bases."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, functions as F

from knownthen.functions.clock import DAY, after, at, before
from knownthen.functions.rules import SCORE_MOVE, recorded_state
from knownthen.operators.features import Windows, complete, labelled, training_set
from knownthen.operators.model import LinearModel, scored
from knownthen.operators.temporal import Basis, PUT, covering, known, snapshots
from knownthen.sources.facts import FactLogs, read_once
from knownthen.sources.shared import written

FAR = datetime(9999, 12, 31, tzinfo=timezone.utc)


def first_flips(label_log: DataFrame, basis: Basis) -> DataFrame:
    """Ids recorded legit before they were first recorded fraud, seen on system time only.

    Two grouped passes over the versions valid at the basis: one keeps the last fact of
    each (id, commit), one takes the first commit of either kind. Both, and a join by id, need one exchange by id.
    """
    facts = covering(known(label_log, basis), basis.valid_at).select("id", "system_from", "seq", "is_fraud", "op").repartition("id")
    commits = facts.groupBy("id", "system_from").agg(F.max_by(F.struct("is_fraud", "op"), "seq").alias("f"))
    stands = F.col("f.op") == PUT
    firsts = commits.groupBy("id").agg(
        F.min(F.when(stands & F.col("f.is_fraud"), F.col("system_from"))).alias("confirmed_at"),
        F.min(F.when(stands & ~F.col("f.is_fraud"), F.col("system_from"))).alias("first_seen"))
    return firsts.filter(F.col("first_seen") < F.col("confirmed_at"))


def corrections(logs: FactLogs, basis: Basis = Basis()) -> DataFrame:
    return (first_flips(logs.label, basis).select("id", "confirmed_at")
            .join(logs.transactions(basis), "id")
            .select("id", "account_id", "amount", "country", F.col("txn_ts").alias("event_at"), "confirmed_at"))


def newest_corrections(logs: FactLogs, basis: Basis = Basis(), limit: int = 40) -> DataFrame:
    return corrections(logs, basis).orderBy(F.col("confirmed_at").desc(), F.col("id").desc()).limit(limit)


def activity_feed(logs: FactLogs, basis: Basis = Basis(), limit: int = 40) -> DataFrame:
    """Newest transactions and newest corrections by when they were learned."""
    def item(df, kind, happened, learned):
        return df.select("id", "account_id", "amount", "country", F.lit(kind).alias("kind"),
                         F.col(happened).alias("happened_at"), F.col(learned).alias("learned_at"))
    txn = logs.transactions(basis).orderBy(F.col("system_from").desc(), F.col("id").desc()).limit(limit)
    both = item(txn, "txn", "valid_from", "system_from").unionByName(
        item(newest_corrections(logs, basis, limit), "correction", "event_at", "confirmed_at"))
    return both.orderBy(F.col("learned_at").desc(), F.col("id").desc(), "kind").limit(limit)


def states(logs: FactLogs, basis: Basis, txn: DataFrame | None = None) -> DataFrame:
    """Every transaction, or those of `txn`, with its recorded state: fraud, pending or legit. One without a current label fails the read."""
    pending = logs.pendings(basis).select("id", F.col("id").alias("pending_id"))
    txn = logs.transactions(basis) if txn is None else txn
    return (labelled(txn, logs, basis).join(pending, "id", "left")
            .select("id", "account_id", "amount", "country", "txn_ts", "valid_from", "system_from", "learned_at",
                    recorded_state("is_fraud", "pending_id").alias("state")))


def data_head(logs: FactLogs, valid_at: datetime, basis: Basis = Basis(), limit: int = 40) -> DataFrame:
    """Newest rows of the day before `valid_at`; labels are read at current valid time."""
    day = (F.col("valid_from") < at(valid_at)) & (F.col("valid_from") >= before(at(valid_at), DAY))
    return _page(logs, basis, day, limit)


def data_page(logs: FactLogs, cursor: tuple[datetime, object], basis: Basis = Basis(), limit: int = 40) -> DataFrame:
    """The page of rows before the cursor (valid_from, id) of the last row of the page above."""
    ts, last_id = cursor
    older = (F.col("valid_from") < at(ts)) | ((F.col("valid_from") == at(ts)) & (F.col("id") < F.lit(last_id)))
    return _page(logs, basis, older, limit)


def _page(logs: FactLogs, basis: Basis, condition, limit: int) -> DataFrame:
    """The newest transactions are chosen first (written: `limit` rows), then only their labels and pending rows are resolved."""
    order = (F.col("valid_from").desc(), F.col("id").desc())
    top = written(logs.transactions(basis).filter(condition).orderBy(*order).limit(limit), "page")
    ids = top.select("id")
    own = replace(logs, label=logs.label.join(ids, "id", "left_semi"), pending=logs.pending.join(ids, "id", "left_semi"))
    return states(own, basis, top).orderBy(*order).select(
        "id", "account_id", "amount", "country", F.col("valid_from").alias("happened_at"), F.col("system_from").alias("recorded_at"),
        F.col("state").alias("label"))


def scored_page(page: DataFrame, logs: FactLogs, model: LinearModel | None, *, live: bool, windows: Windows = Windows()) -> DataFrame:
    """A page of the data view with the model's verdict `p` on each row: the score as of its decision, from the histories of the page's
    accounts only. NULL on a page that is pinned to a basis or below the head, where `live` is false, and for a row that has no account version."""
    if model is None or not live:
        return page.withColumn("p", F.lit(None).cast("double"))
    page = written(page, "page")
    span = page.agg(F.min("happened_at"), F.max("happened_at")).select(
        *[F.unix_micros(c) for c in ("min(happened_at)", "max(happened_at)")]).first()
    if span[0] is None:
        return page.withColumn("p", F.lit(None).cast("double"))
    first, last = (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us) for us in span)
    near = logs.around(page, since=first - max(windows.velocity, windows.baseline, windows.fraud), until=last)
    scores = scored(training_set(near, windows=windows, since=first), model).select("id", "p")
    return page.join(scores, "id", "left")


def basis_diff(logs: FactLogs, older: Basis, newer: Basis) -> DataFrame:
    """Rows that are new at the newer basis, and rows whose state turned to fraud.

    Only what was learned in between can differ: those facts are read first, by their system time, and earlier facts only of their ids,
    whose states at both bases come out of one grouped pass per log. Both bases look at the same valid time.
    """
    if older.valid_at != newer.valid_at or older.system_at is None:
        raise ValueError("bases differ in system time only, and the older one has one")
    def between(log):
        return known(log, newer).filter(F.col("system_from") > at(older.system_at)).select("id")
    learned = between(logs.txn).unionByName(between(logs.label)).unionByName(between(logs.pending)).distinct()
    def both(log, *columns):
        return snapshots(known(log, newer).join(learned, "id", "left_semi"), {"was": older, "now": newer}, list(columns))
    txn = logs.transactions(newer).join(learned, "id", "left_semi").select("id", "account_id", (F.col("system_from") <= at(older.system_at)).alias("there"))
    pending = both(logs.pending, "due").select("id", F.col("was.due").alias("p_was"), F.col("now.due").alias("p_now"))
    rows = complete(txn, both(logs.label, "is_fraud").filter(F.col("now").isNotNull())).join(pending, "id", "left")
    before = F.when(F.col("there") & F.col("was").isNotNull(), recorded_state("was.is_fraud", "p_was"))
    change = (F.when(F.col("state_before").isNull(), "new")
              .when((F.col("state_after") == "fraud") & (F.col("state_before") != "fraud"), "corrected"))
    return (rows.withColumns({"state_before": before, "state_after": recorded_state("now.is_fraud", "p_now")})
            .withColumn("change", change).filter(F.col("change").isNotNull())
            .select("id", "account_id", "state_before", "state_after", "change"))


def moved_scores(logs: FactLogs, model: LinearModel, older: Basis, newer: Basis, windows: Windows = Windows()) -> DataFrame:
    """`score_moves` of current-knowledge scores at two bases, of the transactions that can have moved.

    A fact learned in between matters to its account from its own time until the widest window has passed it, an account version from then
    on; only transactions in such a range of their account are scored, at both bases, from the logs of these accounts.
    """
    def between(log):
        return known(log, newer).filter(F.col("system_from") > at(older.system_at))
    learned = between(logs.label).select("id").unionByName(between(logs.txn).select("id")).distinct()
    events = logs.transactions(newer).select("id", "account_id", "txn_ts").join(learned, "id", "left_semi").select(
        "account_id", F.col("txn_ts").alias("low"), after("txn_ts", max(windows.velocity, windows.baseline, windows.fraud)).alias("high"))
    versions = between(logs.account).select(F.col("id").alias("account_id"), F.col("valid_from").alias("low"), at(FAR).alias("high"))
    ranges = written(events.unionByName(versions).groupBy("account_id").agg(F.min("low").alias("low"), F.max("high").alias("high")), "ranges")
    near = read_once(logs.around(ranges))

    def scores(basis):
        rows = training_set(near, basis, windows, knowledge="current").join(ranges, "account_id")
        return scored(rows.filter(F.col("txn_ts").between(F.col("low"), F.col("high"))), model).select("id", "p")
    return score_moves(scores(older), scores(newer))


def score_moves(before_scores: DataFrame, after_scores: DataFrame) -> DataFrame:
    """Scores (id, p) that are new or moved visibly between two reads."""
    moved = after_scores.withColumnRenamed("p", "p_to").join(
        before_scores.withColumnRenamed("p", "p_from"), "id", "left")
    return moved.filter(F.col("p_from").isNull() | (F.abs(F.col("p_to") - F.col("p_from")) > SCORE_MOVE)
                        ).select("id", "p_from", "p_to")


def status(logs: FactLogs, basis: Basis, now: datetime) -> DataFrame:
    txn = logs.transactions(basis).agg(F.count(F.lit(1)).alias("n_txn"), F.lit(0).alias("n_fraud"))
    fraud = logs.labels(basis).agg(F.lit(0).alias("n_txn"), F.count_if("is_fraud").alias("n_fraud"))
    return txn.unionByName(fraud).agg(
        F.max(at(now)).alias("sim_now"), F.sum("n_txn").alias("n_txn"), F.sum("n_fraud").alias("n_fraud"))


def basis_bounds(txn_log: DataFrame, now: datetime) -> DataFrame:
    return txn_log.agg(
        F.min("valid_from").alias("valid_min"), F.max(at(now)).alias("valid_now"),
        F.min("system_from").alias("system_min"), F.max("system_from").alias("system_now"))
