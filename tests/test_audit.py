"""Corrections, confirm and replay, previews, quality checks."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fixtures import ACCOUNT, D, LABEL, PENDING, TXN, US, account, label, pending, txn, utc
from knownthen.functions.rules import recorded_state
from knownthen.operators import audit, feed, quality
from knownthen.operators.features import HINDSIGHT, KNOWN_THEN, Windows, prior_fraud, serve, requests_from
from knownthen.operators.model import LinearModel
from knownthen.operators.temporal import Basis
from knownthen.plans import queries
from knownthen.sources.facts import FactLogs, append_facts, next_commit, optional_table, read_log, LOG_SCHEMA
from knownthen.sources.shared import fresh_dir

SF = "/root/testdata/sf0.001"
MODEL = LinearModel("m1", (0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0), (0.1, 0.1, 0.1, 1.0), -2.0)


def logs_of(spark, txns, labels, pendings=(), accounts=None):
    accounts = accounts or [account(a) for a in sorted({t[1] for t in txns})]
    return FactLogs(spark.createDataFrame(txns, TXN), spark.createDataFrame(accounts, ACCOUNT),
                    spark.createDataFrame(labels, LABEL), spark.createDataFrame(list(pendings), PENDING))


def test_a_flip_is_counted_once_at_its_first_confirmation(spark):
    txns = [txn(t, "a", D(1)) for t in ("charged-back", "stays-legit", "fraud-on-arrival")]
    labels = [label("charged-back", False, D(1)), label("stays-legit", False, D(1)), label("fraud-on-arrival", True, D(1)),
              label("charged-back", True, D(30)), label("charged-back", False, D(40)), label("charged-back", True, D(50)),
              label("stays-legit", True, D(20), D(2), D(3))]  # a bounded correction in the past is no flip now
    rows = feed.corrections(logs_of(spark, txns, labels)).collect()
    assert [(r.id, utc(r.event_at), utc(r.confirmed_at)) for r in rows] == [("charged-back", D(1), D(30))]


def test_confirm_and_replay_at_one_microsecond(spark):
    txns = [txn("confirmed", "a", D(1)), txn("pending", "a", D(1)), txn("anchor", "a", D(20)), txn("other", "b", D(2))]
    labels = [label(t[0], False, t[2]) for t in txns] + [label("confirmed", True, D(30))]
    logs = logs_of(spark, txns, labels, [pending("pending", "a", D(1), D(50))])
    at = next_commit(D(30), logs.txn, logs.label, logs.pending)
    assert at == D(30) + US
    subjects = logs.transactions(Basis()).filter("id in ('anchor', 'other')")
    rows = {r.txn_id: r for r in audit.replay(logs, MODEL, subjects, at).collect()}
    r = rows["anchor"]
    assert (r.pcf_before, r.pcf_after, r.pcf_reproduced) == (1, 2, 1)
    assert r.before == r.reproduced < r.after and (r.n_confirmed, r.n_prior) == (1, 1)
    other = rows["other"]
    assert other.before == other.after == other.reproduced and (other.n_confirmed, other.n_prior) == (0, 0)

    # the rewound read of the confirmed logs is a full serving read like any other
    new_labels, deletes = audit.confirm_facts(logs.pendings(Basis()), at)
    confirmed = logs.learn(label=new_labels, pending=deletes)
    again = serve(requests_from(subjects), confirmed, Basis(system_at=at - US), labelled_only=False)
    assert {x.req_id: x.prior_confirmed_fraud for x in again.collect()}["anchor"] == 1
    assert confirmed.pendings(Basis()).count() == 0 and confirmed.pendings(Basis(system_at=D(30))).count() == 1
    late = {x.id: x for x in prior_fraud(confirmed, Basis()).collect()}["anchor"]
    assert (late[KNOWN_THEN], late[HINDSIGHT]) == (0, 2)  # at D20 neither was known
    true_labels = confirmed.label.filter("is_fraud and id = 'pending'").collect()
    assert [(utc(x.valid_from), utc(x.system_from)) for x in true_labels] == [(at, at)]


def test_previews_count_what_they_define(spark):
    txns = [txn("old", "a", D(0)), txn("p1", "a", D(100)), txn("p2", "a", D(110)), txn("s", "a", D(120)),
            txn("q", "b", D(100)), txn("only", "b", D(90))]
    pendings = [pending("old", "a", D(0), D(130)), pending("p1", "a", D(100), D(130)), pending("p2", "a", D(110), D(130)),
                pending("q", "b", D(100), D(130))]
    logs = logs_of(spark, txns, [label(t[0], False, t[2]) for t in txns], pendings)
    impacts = {r.account_id: r for r in audit.impact_per_account(logs, MODEL, D(121)).collect()}
    assert set(impacts) == {"a"}  # nothing in b is later than its pending one
    assert (impacts["a"].txn_id, impacts["a"].n, impacts["a"].n_account) == ("s", 2, 2)  # 90 days bound
    subject = {r.txn_id: r for r in audit.subject_impact(logs, MODEL, logs.transactions(Basis())).collect()}
    assert (subject["s"].n, subject["s"].n_account, subject["s"].self_pending) == (3, 3, False)
    assert (subject["p2"].n, subject["p2"].self_pending) == (2, True)
    assert subject["s"].after > subject["s"].before
    assert [r.txn_id for r in audit.impactful_cases(audit.impact_per_account(logs, MODEL, D(121))).collect()] == ["s"]
    pairs = [(r.fraud_id, r.later_id) for r in audit.audit_candidates(logs, limit=4).collect()]
    assert pairs == [("p2", "s"), ("p1", "s"), ("old", "s"), ("p1", "p2")]


def test_pages_split_ties_once_and_states(spark):
    txns = [txn(f"t{i}", "a", D(3)) for i in range(5)] + [txn("z", "a", D(2))]
    labels = [label(t[0], t[0] == "t1", t[2]) for t in txns]
    logs = logs_of(spark, txns, labels, [pending("t2", "a", D(3), D(9)), pending("t1", "a", D(3), D(9))])
    first = feed.data_page(logs, (D(4), ""), limit=3).collect()
    last = first[-1]
    second = feed.data_page(logs, (utc(last.happened_at), last.id), limit=3).collect()
    assert [r.id for r in first + second] == ["t4", "t3", "t2", "t1", "t0", "z"]
    assert {r.id: r.label for r in first + second} == {"t4": "legit", "t3": "legit", "t2": "pending", "t1": "fraud",
                                                       "t0": "legit", "z": "legit"}
    head = feed.data_head(logs, D(3) + US, limit=10).collect()
    assert {r.id for r in head} == {"t0", "t1", "t2", "t3", "t4"}


def test_label_history_guard(spark):
    one = [txn("a", "x", D(1)), txn("b", "x", D(3))]
    def check(txns, labels, basis=Basis()):
        quality.require_label_history(replace(logs_of(spark, one, [label("a", False, D(1))]),
                                              txn=spark.createDataFrame(txns, TXN),
                                              label=spark.createDataFrame(labels, LABEL)), basis)
    check([], [])
    check(one[:1], [label("a", False, D(1))])
    check(one, [label("a", False, D(1))], Basis(system_at=D(2)))
    check(one[:1], [label("a", False, D(1), D(1), D(2))], Basis(system_at=D(0)))
    for txns, labels in ((one[:1], []), (one, [label("a", False, D(1))]), (one[:1], [label("a", False, D(1), D(1), D(2))])):
        with pytest.raises(RuntimeError, match="incomplete label history"):
            check(txns, labels)


def test_legacy_table_is_rejected_and_missing_tables_are_empty(spark):
    quality.require_current_tables(spark)
    assert optional_table(spark, "pending_chargeback", "id string").count() == 0
    spark.range(1).createOrReplaceTempView("fraud_status")
    try:
        with pytest.raises(RuntimeError, match="older data model"):
            quality.require_current_tables(spark)
    finally:
        spark.catalog.dropTempView("fraud_status")


def test_appending_moves_system_time_forward_only(spark):
    path, schema = fresh_dir(spark, "log"), "id string, is_fraud boolean, " + LOG_SCHEMA
    assert read_log(spark, path, schema).count() == 0
    batch = spark.createDataFrame([label("a", False, D(1))], LABEL)
    append_facts(batch, path, D(1))
    with pytest.raises(ValueError, match="not after the last commit"):
        append_facts(batch, path, D(1))
    append_facts(spark.createDataFrame([label("a", True, D(2))], LABEL), path, D(1) + US)
    log = read_log(spark, path, schema)
    assert [utc(r.system_from) for r in log.orderBy("system_from").collect()] == [D(1), D(1) + US]
    append_facts(batch, path, D(3))
    early = read_log(spark, path, schema, system_at=D(2))
    assert early.count() == 2
    plan = early._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(system_day" in plan and "PushedFilters: [IsNotNull(system_from)" in plan


def test_three_states(spark):
    df = spark.createDataFrame([(True, 1, "fraud"), (False, 1, "pending"), (False, None, "legit"), (None, None, "legit")],
                               "f boolean, p int, want string")
    assert df.filter(recorded_state("f", "p") != F.col("want")).count() == 0


def test_replay_of_all_transactions(spark):
    """The query has a row for every transaction, with counts by brute force."""
    logs = queries.logs_of(spark, SF)
    txns = logs.transactions(Basis()).select("id", "account_id", "txn_ts").collect()
    fraud = {r.id for r in logs.labels(Basis()).filter("is_fraud").collect()}
    due = logs.pendings(Basis()).select("id", "account_id", "txn_ts").collect()
    waiting = {r.id for r in due}
    got = {r.txn_id: r for r in queries.queries()["replay_all_before_after"](spark, SF).collect()}
    assert set(got) == {t.id for t in txns} and len(txns) > len({t.account_id for t in txns})
    by_account = {}
    for t in txns:
        by_account.setdefault(t.account_id, []).append(t)
    for t in txns:
        r = got[t.id]
        past = [x.id for x in by_account[t.account_id] if t.txn_ts - Windows().fraud <= x.txn_ts < t.txn_ts]
        assert (r.pcf_before, r.pcf_reproduced) == (sum(x in fraud for x in past),) * 2
        assert r.pcf_after == sum(x in fraud or x in waiting for x in past) and r.before == r.reproduced
        own = [x for x in due if x.account_id == t.account_id]
        assert (r.n_confirmed, r.n_prior) == (len(own), sum(x.txn_ts < t.txn_ts for x in own))
    newest = queries.queries()["replay_before_after"](spark, SF).collect()
    assert newest and all(got[r.txn_id] == r for r in newest)
