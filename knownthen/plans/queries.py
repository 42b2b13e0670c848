"""Named queries over the given tables."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta, timezone
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from knownthen.functions.clock import after, at
from knownthen.functions.rules import rounded
from knownthen.operators import audit, feed, leakage, model as models, quality
from knownthen.operators.features import (HINDSIGHT, KNOWN_THEN, Windows, prior_fraud,
                                          requests_from, serve, settled, trailing_features, training_set)
from knownthen.operators.model import LinearModel
from knownthen.operators.paned import Latest, point_in_time
from knownthen.operators.sessions import sessions
from knownthen.operators.temporal import Basis, rectangles, replayed_timeline, snapshot, timeline, versions
from knownthen.sources import driver_tables as given, facts, registry as reg
from knownthen.sources.driver_tables import NOW, OUTCOME_DELAY, PAST, fact_logs, read
from knownthen.sources.shared import fresh_dir, written
from knownthen.sources.serving import ServingPanes
from knownthen.sources.store import FactStore
from knownthen.streaming import events as streams, ingest, timers
from knownthen.streaming.runs import Stage, new_run, staged_stream

LATEST = Basis()
AT_PAST = Basis(system_at=PAST)
SETTLED = NOW - OUTCOME_DELAY
SETTLED_AT_PAST = PAST - OUTCOME_DELAY
SHORT = Windows(baseline=timedelta(days=7), fraud=timedelta(days=14))
CURSOR = (datetime(2024, 1, 15, 12, tzinfo=timezone.utc), 0)
LIMIT = 500
#: Streamed arrivals come in two batches, the first the larger, so that a range split always falls between them; those before WATCHED were there before the stream was.
#: delivered tables come in parts cut here
TICKS = [datetime(2024, 1, d, tzinfo=timezone.utc) for d in (8, 16, 24)]
BURST_GAP = timedelta(hours=8)
HALF, WATCHED = datetime(2024, 1, 20, tzinfo=timezone.utc), datetime(2024, 1, 5, tzinfo=timezone.utc)

# Fixed coefficients, so that scores compare exactly.
MODEL = LinearModel(
    version="fixed-1", mean=(0.0, 1.2, 0.2, 0.9), scale=(1.2, 1.4, 0.4, 1.3),
    coef=(0.8, 0.35, 0.9, 1.1), intercept=-1.5)


def finish(df: DataFrame) -> DataFrame:
    """Comparable output: zone-less UTC times, rounded doubles, long integers."""
    casts = {"timestamp": lambda c: c.cast("timestamp_ntz"), "double": rounded, "int": lambda c: c.cast("long")}
    return df.select(*[casts.get(t, lambda c: c)(F.col(c)).alias(c) for c, t in df.dtypes])


@lru_cache(maxsize=8)
def logs_of(spark: SparkSession, sf: str):
    """The logs of a folder; the lazy plans are built once per session."""
    return fact_logs(spark, sf)


def commit_time(logs):
    return facts.next_commit(NOW, logs.txn, logs.label, logs.pending)


def txn_of(logs):
    return logs.transactions(LATEST)


# --- facts and temporal reads -------------------------------------------------------

def fact_log_replay(spark, sf):
    return given.replay_order(logs_of(spark, sf))


def facts_per_system_day(spark, sf):
    return (fact_log_replay(spark, sf).groupBy("system_from", "table_name")
            .agg(F.count(F.lit(1)).alias("facts"), F.count_if("is_fraud").alias("frauds"),
                 F.count_if(F.col("op") == "del").alias("deletes")))


def append_facts(spark, sf):
    """Two commits of the label log, read back by commit."""
    log = given.labels(read(spark, sf, "events"))
    path = fresh_dir(spark, "label-log")
    early = F.col("system_from") <= at(PAST)
    facts.append_facts(log.filter(early), path, PAST)
    facts.append_facts(log.filter(~early), path, NOW)
    back = facts.read_log(spark, path, "id bigint, is_fraud boolean, " + facts.LOG_SCHEMA)
    return back.groupBy("system_from", "is_fraud").agg(F.count(F.lit(1)).alias("facts"))


def current_txn(spark, sf):
    return txn_of(logs_of(spark, sf)).drop("valid_from")


def basis_label_counts(spark, sf):
    label = logs_of(spark, sf).label
    def counts(basis, name):
        return snapshot(label, basis).agg(
            F.lit(name).alias("basis"), F.count(F.lit(1)).alias("n"), F.count_if("is_fraud").alias("n_fraud"))
    return counts(AT_PAST, "past").unionByName(counts(LATEST, "latest"))


def account_asof(spark, sf):
    moment = datetime(2024, 1, 15, tzinfo=timezone.utc)
    return snapshot(logs_of(spark, sf).account, Basis(valid_at=moment)).select("id", "name", "home_country", "tier", "valid_from")


def label_timeline(spark, sf):
    return timeline_columns(replayed_timeline(logs_of(spark, sf).label, AT_PAST))


def label_intervals(spark, sf):
    return timeline_columns(replayed_timeline(logs_of(spark, sf).label, LATEST))


def label_timeline_corrected(spark, sf):
    return timeline_columns(timeline(given.corrected_labels(read(spark, sf, "events")), LATEST))


def timeline_columns(df):
    return df.select("id", "is_fraud", "valid_from", "valid_to")


def label_versions(spark, sf):
    return versions(given.corrected_labels(read(spark, sf, "events")), LATEST).select(
        "id", "is_fraud", "valid_from", "system_from", "system_to")


def label_rectangles(spark, sf):
    return rectangles(given.corrected_labels(read(spark, sf, "events")))


def pending_current(spark, sf):
    return logs_of(spark, sf).pendings(LATEST).select("id", "account_id", "txn_ts", "due")


def pending_at_basis(spark, sf):
    return logs_of(spark, sf).pendings(AT_PAST).select("id", "account_id", "txn_ts", "due")


def basis_bounds(spark, sf):
    return feed.basis_bounds(logs_of(spark, sf).txn, NOW)


def latest_commit(spark, sf):
    logs = logs_of(spark, sf)
    return facts.latest_commit(logs.txn, logs.label, logs.account, logs.pending)


# --- projections, filters, states --------------------------------------------------

def anchors_filtered(spark, sf):
    """`since` and `settled before` on event time, both inclusive."""
    txn = settled(txn_of(logs_of(spark, sf)), SETTLED)
    return txn.filter(F.col("txn_ts") >= at(SETTLED_AT_PAST)).select("id", "account_id", "txn_ts")


def settled_anchors(spark, sf):
    return settled(txn_of(logs_of(spark, sf)), SETTLED).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def txn_state(spark, sf):
    return feed.states(logs_of(spark, sf), LATEST).select("id", "account_id", "txn_ts", "state", "learned_at")


def status(spark, sf):
    return feed.status(logs_of(spark, sf), LATEST, NOW)


def accounts(spark, sf):
    return snapshot(logs_of(spark, sf).account, LATEST).select("id").orderBy("id")


# --- features -----------------------------------------------------------------------

def trailing(spark, sf):
    return trailing_features(txn_of(logs_of(spark, sf))).select(
        "id", "account_id", "txn_ts", "txn_count_24h", "n_30d", "mean_30d", "std_30d", "amount_zscore")


def trailing_7d(spark, sf):
    return trailing_features(txn_of(logs_of(spark, sf)), SHORT).select(
        "id", "txn_count_24h", F.col("n_30d").alias("n_7d"), F.col("mean_30d").alias("mean_7d"),
        F.col("std_30d").alias("std_7d"), "amount_zscore")


def orders_trailing(spark, sf):
    """Orders have day precision and ties per customer: tied rows do not see each other."""
    orders = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account_id"),
        F.col("o_orderdate").alias("txn_ts"), F.col("o_totalprice").alias("amount"))
    year = Windows(velocity=timedelta(days=90), baseline=timedelta(days=365))
    return trailing_features(orders, year).select(
        "id", F.col("txn_count_24h").alias("n_90d"), F.col("n_30d").alias("n_365d"),
        F.col("mean_30d").alias("mean_365d"), F.col("std_30d").alias("std_365d"), "amount_zscore")


def txn_count_24h(spark, sf):
    return trailing(spark, sf).groupBy("txn_count_24h").agg(F.count(F.lit(1)).alias("txns"))


def amount_zscore(spark, sf):
    return trailing(spark, sf).filter(F.col("n_30d") >= 5).select("id", "n_30d", "amount_zscore")


def foreign_asof(spark, sf):
    logs = logs_of(spark, sf)
    homes = logs.account_timeline(LATEST).withColumnRenamed("id", "account_id")
    seen = point_in_time(txn_of(logs), [Latest("account", homes, ("home_country", "valid_to"))])
    return seen.filter(F.col("account").isNotNull()).select(
        "id", "country", F.col("account.home_country").alias("home_country"),
        F.when(F.col("account.home_country") != F.col("country"), 1).otherwise(0).alias("foreign"))


def foreign_flag(spark, sf):
    return foreign_asof(spark, sf).groupBy("home_country").agg(
        F.count(F.lit(1)).alias("n"), F.sum("foreign").alias("n_foreign"))


def targets(spark, sf):
    logs = logs_of(spark, sf)
    return txn_of(logs).join(logs.labels(LATEST).select("id", "is_fraud"), "id").select(
        "id", F.when(F.col("is_fraud"), 1).otherwise(0).alias("label"))


def pcf_as_known_then(spark, sf):
    return prior_fraud(logs_of(spark, sf), LATEST).select("id", KNOWN_THEN)


def pcf_known_14d(spark, sf):
    return prior_fraud(logs_of(spark, sf), LATEST, SHORT).select("id", KNOWN_THEN, HINDSIGHT)


def pcf_hindsight(spark, sf):
    return prior_fraud(logs_of(spark, sf), LATEST).select("id", HINDSIGHT)


def pcf_leaky(spark, sf):
    return leakage.leaky_counts(logs_of(spark, sf), LATEST).select("id", "pcf_leaky")


def pcf_compare(spark, sf):
    return prior_fraud(logs_of(spark, sf), AT_PAST).select("id", "txn_ts", KNOWN_THEN, HINDSIGHT)


def pcf_corrected(spark, sf):
    """With bounded corrections and late imports in the label history."""
    logs = replace(logs_of(spark, sf), label=given.corrected_labels(read(spark, sf, "events")), replayed=False)
    return prior_fraud(logs, LATEST).select("id", KNOWN_THEN, HINDSIGHT)


def training(spark, sf):
    return training_set(logs_of(spark, sf), LATEST, resolved_before=SETTLED)


def training_short(spark, sf):
    return training_set(logs_of(spark, sf), LATEST, SHORT, since=SETTLED_AT_PAST, resolved_before=SETTLED)


def training_limited(spark, sf):
    return training_set(logs_of(spark, sf), LATEST, resolved_before=SETTLED, limit=LIMIT)


def training_at_basis(spark, sf):
    return training_set(logs_of(spark, sf), AT_PAST, resolved_before=SETTLED_AT_PAST)


def leakage_rows(spark, sf):
    return leakage.leakage_rows(logs_of(spark, sf), LATEST, SETTLED)


def leakage_summary(spark, sf):
    return leakage.leakage_summary(leakage_rows(spark, sf))


def leakage_examples(spark, sf):
    return leakage.leakage_examples(leakage_rows(spark, sf))


def training_totals(spark, sf):
    return leakage.training_totals(logs_of(spark, sf), AT_PAST, SETTLED_AT_PAST)


def training_sample(spark, sf):
    return leakage.training_sample(logs_of(spark, sf), AT_PAST, SETTLED_AT_PAST)


# --- serving and scores --------------------------------------------------------------

def requests(logs):
    """A request six hours after each transaction, for a slightly larger amount."""
    return requests_from(txn_of(logs)).withColumns(
        {"t": after("t", timedelta(hours=6)), "amount": F.col("amount") + 10.0})


def serve_batch(spark, sf):
    logs = logs_of(spark, sf)
    return serve(requests(logs), logs).drop("country")


def serve_vector(spark, sf):
    logs = logs_of(spark, sf)
    return serve(requests(logs), logs, AT_PAST, labelled_only=False).drop("country")


def serve_maintained(spark, sf):
    """The same requests from pane aggregates that two commits have brought up to date."""
    logs, panes = logs_of(spark, sf), ServingPanes(spark, fresh_dir(spark, "serving"))
    panes.update(logs, None, PAST)
    panes.update(logs, PAST, NOW)
    return panes.serve(requests(logs)).drop("country")


def train_serve_parity(spark, sf):
    """Serving every transaction must give the training values under current knowledge."""
    logs = logs_of(spark, sf)
    served = serve(requests_from(txn_of(logs)), logs)
    trained = training_set(logs, knowledge="current")
    pairs = served.alias("s").join(trained.alias("t"), F.col("s.req_id") == F.col("t.id"))
    def differ(c):
        return F.count_if(F.abs(F.col(f"s.{c}") - F.col(f"t.{c}")) > 1e-9).alias(f"{c}_differs")
    return pairs.agg(F.count(F.lit(1)).alias("n"), *[differ(c) for c in models.FEATURES])


def explain(spark, sf):
    return models.explain(training(spark, sf), MODEL).select(
        "id", *[f"contrib_{f}" for f in models.FEATURES], "intercept", "logit", "prob")


def verdicts(spark, sf):
    return models.explain(training(spark, sf), MODEL).groupBy("verdict", "label").agg(F.count(F.lit(1)).alias("n"))


def auc(spark, sf):
    return models.auc(models.scored(training(spark, sf), MODEL))


def score_recent(spark, sf):
    recent = training_set(logs_of(spark, sf), LATEST, since=NOW - timedelta(days=120))
    return models.scored(recent, MODEL).select("id", "p")


def score_account(spark, sf):
    """Current-knowledge score of every transaction, by account."""
    return models.scored(training_set(logs_of(spark, sf), LATEST, knowledge="current"), MODEL).select(
        "account_id", "id", "p")


def scored_frame(spark, sf):
    return models.scored(training_set(logs_of(spark, sf), LATEST, limit=LIMIT), MODEL).select(
        "id", "txn_ts", "label", *models.FEATURES, "p")


def score_moves(spark, sf):
    return feed.moved_scores(logs_of(spark, sf), MODEL, AT_PAST, LATEST)


def train_test_split(spark, sf):
    logs = logs_of(spark, sf)
    labelled = settled(txn_of(logs), SETTLED).join(logs.labels(LATEST).select("id", "is_fraud"), "id")
    return models.split(labelled.select("id", F.when(F.col("is_fraud"), 1).otherwise(0).alias("label")))


def train_guard(spark, sf):
    return models.class_counts(training(spark, sf))


def fit_metrics(spark, sf):
    """What was fitted, and whether the objective is flat there in the direction of each feature."""
    parts = models.extracted(training(spark, sf))
    model = models.fit_parts(parts, "fitted")
    slope = models.gradient(parts, model)
    flat = F.create_map(*[x for f, g in slope.items() for x in (F.lit(f), F.lit(abs(g) < 1e-5))])
    return models.as_frame(spark, model).select("feature", "mean", "scale", "coef", "intercept", "auc", "n_train", "n_fraud",
                                                flat[F.col("feature")].alias("at_optimum"))


def model_store(spark, sf):
    """Fit, store, and score with the artifact loaded back by version and with the fitted one."""
    root = fresh_dir(spark, "models")
    rows = written(training_set(logs_of(spark, sf), LATEST, SHORT, resolved_before=SETTLED), "stored")
    fitted = models.fit(rows, "stored-1")
    reg.store_model(spark, fitted, root, wall=NOW, sim=NOW)
    loaded = reg.load_version(spark, root, "stored-1")
    both = models.scored(models.scored(rows, fitted).withColumnRenamed("p", "before"), loaded)
    return both.select("id", (F.col("p") == F.col("before")).alias("same_score"), F.lit(loaded.version).alias("model_version"))


def model_registry(spark, sf):
    """Registry rows after storing a model of the past basis and one of the latest."""
    root = fresh_dir(spark, "models")
    logs = logs_of(spark, sf)
    for name, basis, until, when in (("past", AT_PAST, SETTLED_AT_PAST, PAST), ("now", LATEST, SETTLED, NOW)):
        rows = training_set(logs, basis, SHORT, resolved_before=until)
        reg.store_model(spark, models.fit(rows, name), root, wall=when, sim=when)
    return reg.registry(spark, root).select("version", "trained_at_wall", "trained_at_sim", "n_train", "n_fraud")


def daily_registry(spark, sf):
    """One registry row per system day: what a model trained that day would have learned from."""
    log = logs_of(spark, sf).label
    days = log.groupBy("system_from").agg(F.count_if(~F.col("is_fraud")).alias("n_train"), F.count_if("is_fraud").alias("n_fraud"))
    return days.select(F.date_format("system_from", "yyyyMMdd").alias("version"),
                       F.col("system_from").alias("trained_at_wall"), "n_train", "n_fraud")


def stored_registry(spark, sf):
    """The daily rows as a stored registry, read back."""
    root = fresh_dir(spark, "daily")
    unknown = {"trained_at_sim": F.col("trained_at_wall"), "auc": F.lit(None).cast("double"), "path": F.lit(None).cast("string")}
    reg.append_rows(daily_registry(spark, sf).withColumns(unknown), root)
    return reg.registry(spark, root).select("version", "trained_at_wall", "n_train", "n_fraud")


def registry_latest(spark, sf):
    return reg.latest(stored_registry(spark, sf))


def registry_version(spark, sf):
    return reg.by_version(stored_registry(spark, sf), "20240115")


# --- feed, pages, differences --------------------------------------------------------

def corrections(spark, sf):
    return feed.corrections(logs_of(spark, sf))


def corrections_feed(spark, sf):
    return feed.newest_corrections(logs_of(spark, sf))


def activity_feed(spark, sf):
    return feed.activity_feed(logs_of(spark, sf))


def data_head(spark, sf):
    return feed.data_head(logs_of(spark, sf), NOW)


def data_head_at_basis(spark, sf):
    return feed.data_head(logs_of(spark, sf), PAST, AT_PAST)


def data_head_scored(spark, sf):
    """The live head with scores, and the same view pinned to a basis without."""
    logs = logs_of(spark, sf)
    def view(valid_at, basis, live):
        return feed.scored_page(feed.data_head(logs, valid_at, basis), logs, MODEL, live=live).withColumn("live", F.lit(live))
    return view(NOW, LATEST, True).unionByName(view(PAST, AT_PAST, False))


def data_page(spark, sf):
    return feed.data_page(logs_of(spark, sf), CURSOR)


def basis_diff(spark, sf):
    return feed.basis_diff(logs_of(spark, sf), AT_PAST, LATEST)


# --- audit ------------------------------------------------------------------------------

def audit_candidates(spark, sf):
    return audit.audit_candidates(logs_of(spark, sf))


def pending_accounts(spark, sf):
    return audit.pending_accounts(logs_of(spark, sf))


def pending_burst(spark, sf):
    return audit.pending_burst(logs_of(spark, sf), NOW).select("id", "account_id", "txn_ts", "due")


def account_history(spark, sf):
    logs = logs_of(spark, sf)
    scores = models.scored(training_set(logs, LATEST, since=NOW - timedelta(days=120), knowledge="current"), MODEL)
    return audit.account_history(logs, scores)


def impact_per_account(spark, sf):
    return audit.impact_per_account(logs_of(spark, sf), MODEL, NOW)


def impactful_cases(spark, sf):
    return audit.impactful_cases(impact_per_account(spark, sf))


def subject_impact(spark, sf):
    logs = logs_of(spark, sf)
    return audit.subject_impact(logs, MODEL, txn_of(logs))


def confirm_account(spark, sf):
    """The facts of one commit that confirms every pending chargeback."""
    logs = logs_of(spark, sf)
    labels, deletes = audit.confirm_facts(logs.pendings(LATEST), commit_time(logs))
    return _commit(labels, deletes)


def settle_due(spark, sf):
    """The facts of a commit four days on that settles what is due by then."""
    labels, deletes = audit.settle_due(logs_of(spark, sf), NOW + timedelta(days=4))
    return _commit(labels, deletes)


def confirm_committed(spark, sf):
    """The same commit written to a store that holds the logs, and read back: label and pending facts of its stamp."""
    logs, store = logs_of(spark, sf), FactStore(spark, fresh_dir(spark, "store"))
    store.import_history({t: getattr(logs, t) for t in ("txn", "account", "label", "pending")}, NOW)
    before = store.logs()
    labels, deletes = audit.confirm_facts(before.pendings(LATEST), NOW)
    stamp = store.commit({"label": labels, "pending": deletes}, NOW).system_time
    of_stamp = F.col("system_from") == at(stamp)
    return _commit(store.facts("label").filter(of_stamp), store.facts("pending").filter(of_stamp)).drop("valid_from")


def _commit(labels, deletes):
    columns = ["id", "valid_from", "system_from", "op"]
    return labels.select(F.lit("label").alias("table_name"), "is_fraud", *columns).unionByName(
        deletes.select(F.lit("pending_chargeback").alias("table_name"), F.lit(None).cast("boolean").alias("is_fraud"),
                       *columns))


def replay_before_after(spark, sf):
    logs = logs_of(spark, sf)
    return audit.replay(logs, MODEL, audit.newest_per_account(txn_of(logs), 1), commit_time(logs))


def replay_all_before_after(spark, sf):
    """The same for every transaction."""
    logs = logs_of(spark, sf)
    return audit.replay(logs, MODEL, txn_of(logs), commit_time(logs))


# --- quality ----------------------------------------------------------------------------

def gapped(spark, sf):
    return replace(logs_of(spark, sf), label=given.gapped_labels(read(spark, sf, "events")))


def unlabelled_txns(spark, sf):
    return quality.unlabelled_transactions(gapped(spark, sf))


def finite_tail_labels(spark, sf):
    return quality.closed_histories(gapped(spark, sf))


def label_time_mismatch(spark, sf):
    log = given.corrected_labels(read(spark, sf, "events"))
    return quality.misdated_labels(log).groupBy("is_fraud").agg(F.count(F.lit(1)).alias("n"))


# --- streams ----------------------------------------------------------------------------

def daily_activity(spark, sf):
    return streams.daily(txn_of(logs_of(spark, sf)))


def velocity_sliding(spark, sf):
    return streams.sliding_velocity(txn_of(logs_of(spark, sf)).select("account_id", "txn_ts"))


def _arrivals(spark, sf):
    return read(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("account_id"), F.col("ts").alias("txn_ts"),
        F.col("value").alias("amount"))


def _late_arrivals(spark, sf):
    """All transactions with what will be charged back; every seventh arrives three days after it happened."""
    truth = given.chargebacks(read(spark, sf, "events"))
    due = F.when(F.col("fraud"), given.days_after(F.col("txn_ts"), F.col("delay")))
    late = F.when(F.col("id") % 7 == 0, 3).otherwise(0)
    return truth.select("id", "account_id", "txn_ts", due.alias("due"), given.days_after(F.col("txn_ts"), late).alias("arrived"))


def _full_arrivals(spark, sf):
    rest = txn_of(logs_of(spark, sf)).select("id", "amount", "category", "country")
    return _late_arrivals(spark, sf).join(rest, "id")


def _delivered(df, clock, once):
    """Add a table to a stream in parts by its clock, and run what `once` makes of the stream after each; the last result."""
    stage, edges = Stage(df.sparkSession, df.schema), [None, *TICKS, None]
    for low, high in zip(edges[:-1], edges[1:]):
        part = df if low is None else df.filter(F.col(clock) >= at(low))
        stage.add(part if high is None else part.filter(F.col(clock) < at(high)))
        result = once(stage.stream())
    return result


def stream_ingest(spark, sf):
    """The facts of ticks, each tick one commit, the stream started anew for each."""
    store, run = FactStore(spark, fresh_dir(spark, "store")), new_run(spark, "ticks")
    _delivered(_full_arrivals(spark, sf), "arrived", lambda s: ingest.ingest_and_settle(s, store, run))
    def facts_of(table, is_fraud):
        return store.facts(table).select(F.lit(table).alias("table_name"), "id", is_fraud.cast("boolean").alias("is_fraud"), "valid_from", "system_from", "op")
    none = F.lit(None)
    return facts_of("txn", none).unionByName(facts_of("label", F.col("is_fraud"))).unionByName(facts_of("pending", none))


def stream_settle(spark, sf):
    """Chargebacks settle as the clock of arrivals passes their due time, those that arrive later at their arrival."""
    run = new_run(spark, "settle")
    return _delivered(_late_arrivals(spark, sf), "arrived", lambda s: streams.collected(timers.settlements(s), "append", run=run))


def stream_confirm_join(spark, sf):
    log = given.labels(read(spark, sf, "events")).filter("is_fraud")
    first = log.groupBy("id").agg(F.min("system_from").alias("confirmed_at"))
    txn = staged_stream(_arrivals(spark, sf).select("id", "txn_ts"), "txn_ts", 2)
    joined = streams.confirmations_within(
        txn, staged_stream(first, "confirmed_at", 2), timedelta(days=30), timedelta(days=60))
    return streams.collected(joined.select("id", "txn_ts", "confirmed_at"), "append")


def stream_velocity(spark, sf):
    return ingest.velocity_on_arrival(staged_stream(_arrivals(spark, sf).drop("amount"), "txn_ts", 3)).select(
        "id", "account_id", "txn_ts", "txn_count_24h")


def stream_score(spark, sf):
    logs = logs_of(spark, sf)
    arrivals = txn_of(logs).select("id", "account_id", "txn_ts", "amount", "country")
    halves = staged_stream(arrivals.withColumn("late", F.col("txn_ts") >= at(HALF)), "late", 2)
    there = arrivals.filter(F.col("txn_ts") < at(WATCHED)).select("id")
    return ingest.score_on_arrival(halves, logs, MODEL, baseline=there).select("id", "p", "model_version")


def stream_score_store(spark, sf):
    """Arrivals scored from the store that they are committed to; it holds accounts and what happened before WATCHED at first."""
    logs, store, run = logs_of(spark, sf), FactStore(spark, fresh_dir(spark, "store")), new_run(spark, "scores")
    store.import_history({"account": logs.account}, given.FIRST_ACCOUNT_VERSION)
    arrivals = written(_full_arrivals(spark, sf).withColumn("half", F.col("txn_ts") >= at(HALF)), "arrivals")
    seed = ingest.tick(store, arrivals.filter(F.col("txn_ts") < at(WATCHED)), "seed", 0)
    stage = Stage(spark, arrivals.schema)
    for half in (False, True):
        stage.add(arrivals.filter(F.col("half") == half))
        scores = ingest.score_as_ingested(stage.stream(), store, MODEL, run, baseline=seed.system_time)
    return scores


def stream_corrections(spark, sf):
    log = given.labels(read(spark, sf, "events")).select("id", "is_fraud", "system_from")
    run = new_run(spark, "flips")
    return _delivered(log, "system_from", lambda s: streams.collected(timers.flips_once(s, timedelta(days=45)), "append", run=run))


def burst_sessions(spark, sf):
    return sessions(txn_of(logs_of(spark, sf)), BURST_GAP)


def stream_burst_sessions(spark, sf):
    """Late arrivals are part of their bursts; bursts that may still grow at the end are not given."""
    amounts = _full_arrivals(spark, sf).select("account_id", "txn_ts", "amount", "arrived")
    run = new_run(spark, "bursts")
    return _delivered(amounts, "arrived", lambda s: streams.collected(streams.bursts(s, BURST_GAP, timedelta(days=3)), "append", run=run))


def stream_dedup(spark, sf):
    once = _arrivals(spark, sf)
    delivered = staged_stream(once.unionByName(once), "txn_ts", 3)
    return streams.collected(streams.delivered_once(delivered, timedelta(days=60)), "append")


def stream_daily(spark, sf):
    return streams.collected(streams.daily(staged_stream(_arrivals(spark, sf), "txn_ts", 3)), "complete", ["day"])


QUERIES = {
    "fact_log_replay": fact_log_replay, "facts_per_system_day": facts_per_system_day, "append_facts": append_facts,
    "current_txn": current_txn, "basis_label_counts": basis_label_counts, "account_asof": account_asof,
    "label_timeline": label_timeline, "label_intervals": label_intervals,
    "label_timeline_corrected": label_timeline_corrected, "label_versions": label_versions,
    "label_rectangles": label_rectangles, "pending_current": pending_current, "pending_at_basis": pending_at_basis,
    "basis_bounds": basis_bounds, "latest_commit": latest_commit,
    "anchors_filtered": anchors_filtered, "settled_anchors": settled_anchors, "txn_state": txn_state,
    "status": status, "accounts": accounts,
    "trailing_features": trailing, "trailing_features_7d": trailing_7d, "orders_trailing_features": orders_trailing,
    "txn_count_24h": txn_count_24h, "amount_zscore": amount_zscore, "foreign_asof": foreign_asof,
    "foreign_flag": foreign_flag, "targets": targets,
    "pcf_as_known_then": pcf_as_known_then, "pcf_known_14d": pcf_known_14d, "pcf_hindsight": pcf_hindsight,
    "pcf_leaky": pcf_leaky, "pcf_compare": pcf_compare, "pcf_corrected": pcf_corrected,
    "training_set": training, "training_set_7d": training_short, "training_set_limited": training_limited,
    "training_set_at_basis": training_at_basis,
    "leakage_rows": leakage_rows, "leakage_summary": leakage_summary, "leakage_examples": leakage_examples,
    "training_totals": training_totals, "training_sample": training_sample,
    "serve_batch": serve_batch, "serve_vector": serve_vector, "serve_maintained": serve_maintained, "train_serve_parity": train_serve_parity,
    "explain": explain, "verdicts": verdicts, "auc": auc, "score_recent": score_recent,
    "score_account": score_account, "scored_frame": scored_frame, "score_moves": score_moves,
    "train_test_split": train_test_split, "train_guard": train_guard, "fit_metrics": fit_metrics,
    "model_store": model_store, "model_registry": model_registry, "registry_latest": registry_latest,
    "registry_version": registry_version,
    "corrections": corrections, "corrections_feed": corrections_feed, "activity_feed": activity_feed,
    "data_head": data_head, "data_head_at_basis": data_head_at_basis, "data_head_scored": data_head_scored, "data_page": data_page,
    "basis_diff": basis_diff,
    "audit_candidates": audit_candidates, "pending_accounts": pending_accounts, "pending_burst": pending_burst,
    "account_history": account_history, "impact_per_account": impact_per_account,
    "impactful_cases": impactful_cases, "subject_impact": subject_impact, "confirm_account": confirm_account,
    "settle_due": settle_due, "replay_before_after": replay_before_after,
    "replay_all_before_after": replay_all_before_after,
    "unlabelled_txns": unlabelled_txns, "finite_tail_labels": finite_tail_labels,
    "label_time_mismatch": label_time_mismatch,
    "daily_activity": daily_activity, "velocity_sliding": velocity_sliding,
    "stream_ingest": stream_ingest, "stream_settle": stream_settle, "stream_confirm_join": stream_confirm_join,
    "stream_velocity": stream_velocity, "stream_score": stream_score, "stream_corrections": stream_corrections,
    "stream_dedup": stream_dedup, "stream_daily": stream_daily, "stream_score_store": stream_score_store,
    "burst_sessions": burst_sessions, "stream_burst_sessions": stream_burst_sessions, "confirm_committed": confirm_committed,
}


def queries():
    return {name: (lambda spark, sf, q=q: finish(q(spark, sf))) for name, q in QUERIES.items()}
