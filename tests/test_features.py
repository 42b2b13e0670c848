"""Hand-computed histories: trailing windows, known-then counts, account versions."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import Window, functions as F

from fixtures import ACCOUNT, D, LABEL, PENDING, TXN, US, account, label, txn
from knownthen.operators.features import HINDSIGHT, KNOWN_THEN, Windows, prior_fraud, serve, trailing_features, training_set
from knownthen.operators.paned import Active, Latest, Trailing, point_in_time
from knownthen.operators.temporal import Basis
from knownthen.sources.facts import FactLogs


def fact_logs(spark, txns, labels, accounts, **kw):
    return FactLogs(spark.createDataFrame(txns, TXN), spark.createDataFrame(accounts, ACCOUNT),
                    spark.createDataFrame(labels, LABEL), spark.createDataFrame([], PENDING), **kw)


def by_id(df):
    return {r.id: r for r in df.collect()}


def first_labels(txns):
    return [label(t[0], False, t[2]) for t in txns]


def test_trailing_windows_and_edges(spark):
    hour = timedelta(hours=1)
    txns = [txn(f"a{i}", "acct-a", D(d), a) for i, (d, a) in enumerate([(0, 10.), (1, 20.), (2, 30.), (10, 40.), (40, 50.)])]
    txns += [txn("b0", "acct-b", D(1), 99.)]
    # two at one instant; one exactly 24 h later; one a microsecond after that
    txns += [txn("c0", "c", D(3)), txn("c1", "c", D(3)), txn("c2", "c", D(4)), txn("c3", "c", D(4) + US)]
    txns += [txn("c4", "c", D(33)), txn("c5", "c", D(33) + US)]
    # equal amounts, then a large one: no spread
    txns += [txn(f"e{i}", "e", D(1) + i * hour, 0.1) for i in range(5)] + [txn("e5", "e", D(2), 7.)]
    # four priors are too few, five are enough and the score is clipped
    txns += [txn(f"f{i}", "f", D(1) + i * hour, 10. + i % 2) for i in range(5)]
    txns += [txn("f5", "f", D(1) + 6 * hour, 1e6)]
    # no account version at the event time
    txns += [txn("g0", "g", D(5))]
    accounts = [account(a) for a in ("acct-a", "acct-b", "c", "e", "f")] + [account("g", valid_from=D(9))]
    logs = fact_logs(spark, txns, first_labels(txns), accounts)
    rows = by_id(training_set(logs))
    expect = {"a0": (0, 0, None), "a1": (1, 1, 10.), "a2": (1, 2, 15.), "a3": (0, 3, 20.), "a4": (0, 1, 40.),
              "b0": (0, 0, None)}
    for k, want in expect.items():
        assert (rows[k].txn_count_24h, rows[k].n_30d, rows[k].mean_30d) == want, k
        assert rows[k].amount_zscore == 0.0
    assert (rows["c0"].txn_count_24h, rows["c1"].txn_count_24h) == (0, 0)
    assert (rows["c2"].txn_count_24h, rows["c3"].txn_count_24h) == (2, 1)
    assert (rows["c4"].n_30d, rows["c5"].n_30d) == (4, 3)  # c0, c1 lie exactly 30 days back
    assert rows["e5"].std_30d == 0.0 and rows["e5"].amount_zscore == 0.0
    assert rows["f4"].n_30d == 4 and rows["f4"].amount_zscore == 0.0
    assert rows["f5"].n_30d == 5 and rows["f5"].amount_zscore == 8.0
    assert rows["a0"].n_30d == 0 and "g0" not in rows

    requests = spark.createDataFrame(
        [(t[0], t[1], t[2], t[3], t[5]) for t in txns],
        "req_id string, account_id string, t timestamp, amount double, country string")
    served = {r.req_id: r for r in serve(requests, logs).collect()}
    assert served["g0"].foreign == 0
    for k, r in rows.items():
        assert (served[k].txn_count_24h, served[k].amount_zscore) == (r.txn_count_24h, pytest.approx(r.amount_zscore))


def histories():
    """Awkward label histories of one account, in the order they were learned."""
    txns = [txn("reconfirmed", "a1", D(5)), txn("reversed", "a1", D(6)), txn("late", "a1", D(7)),
            txn("anchor", "a1", D(20)), txn("after-reversal", "a1", D(50))]
    labels = first_labels(txns) + [
        label("reconfirmed", True, D(10)), label("reversed", True, D(11)), label("reconfirmed", True, D(40)),
        label("reversed", False, D(41)), label("late", True, D(150))]
    return txns, labels


@pytest.mark.parametrize("replayed", [True, False])
def test_known_then_against_hindsight(spark, replayed):
    txns, labels = histories()
    logs = fact_logs(spark, txns, labels, [account("a1")], replayed=replayed)
    at_100 = by_id(prior_fraud(logs, Basis(system_at=D(100))))
    assert (at_100["anchor"][KNOWN_THEN], at_100["anchor"][HINDSIGHT]) == (2, 1)
    assert at_100["after-reversal"][KNOWN_THEN] == 1
    if replayed:
        at_200 = by_id(prior_fraud(logs, Basis(system_at=D(200))))
        assert at_200["anchor"][HINDSIGHT] == 2
        extract = by_id(training_set(logs, Basis(system_at=D(100)), limit=10))
        for k, r in extract.items():
            assert (r[KNOWN_THEN], r[HINDSIGHT]) == (at_100[k][KNOWN_THEN], at_100[k][HINDSIGHT])


def test_imported_timeline_and_inclusive_90_days(spark):
    days = (9, 10, 19, 20, 29, 30, 91, 92)
    txns = [txn("fraud", "a1", D(1), commit=D(100))] + [txn(f"d{d}", "a1", D(d), commit=D(100)) for d in days]
    txns += [txn("self", "solo", D(10))]
    labels = [label("fraud", f, D(100), D(lo), hi and D(hi), i) for i, (lo, hi, f) in enumerate(
        [(1, 10, False), (10, 20, True), (20, 30, False), (30, None, True)])]
    labels += [label(f"d{d}", False, D(100), D(d)) for d in days] + [label("self", True, D(10))]
    got = by_id(prior_fraud(fact_logs(spark, txns, labels, [account("a1")], replayed=False), Basis(system_at=D(150))))
    assert [got[f"d{d}"][KNOWN_THEN] for d in days] == [0, 1, 1, 0, 0, 1, 1, 0]
    assert [got[f"d{d}"][HINDSIGHT] for d in days[:6]] == [1] * 6
    assert (got["self"][KNOWN_THEN], got["self"][HINDSIGHT]) == (0, 0)


def test_late_import_and_correction_keep_every_older_basis(spark):
    txns = [txn("fraud", "a1", D(1)), txn("anchor-12", "a1", D(12)), txn("anchor-20", "a1", D(20))]
    labels = first_labels(txns) + [label("fraud", True, D(40), D(10)), label("fraud", False, D(50), D(10), D(15))]
    logs = fact_logs(spark, txns, labels, [account("a1", valid_from=D(1))], replayed=False)
    def counts(day):
        rows = by_id(prior_fraud(logs, Basis(system_at=D(day))))
        return {k: (r[KNOWN_THEN], r[HINDSIGHT]) for k, r in rows.items()}
    assert counts(35) == {"fraud": (0, 0), "anchor-12": (0, 0), "anchor-20": (0, 0)}
    at_45, at_55 = counts(45), counts(55)
    assert at_45["anchor-12"] == (1, 1)
    assert at_55["anchor-12"] == (0, 1) and at_55["anchor-20"][0] == 1
    assert by_id(training_set(logs, Basis(system_at=D(45))))["fraud"].label == 1
    request = spark.createDataFrame([("r", "a1", D(12), 100., "GB")],
                                    "req_id string, account_id string, t timestamp, amount double, country string")
    served = [serve(request, logs, Basis(system_at=D(d)), labelled_only=False).first().prior_confirmed_fraud
              for d in (12, 45, 55)]
    assert served == [0, 1, 1]


def test_account_version_at_the_event_without_fan_out(spark):
    txns = [txn(f"t{d}", "a1", D(d), commit=D(1)) for d in (5, 10, 20)]
    accounts = [account("a1", "GB", D(0), D(10), commit=D(1)), account("a1", "FR", D(10), commit=D(1), seq=1)]
    logs = fact_logs(spark, txns, [label(t[0], False, D(1)) for t in txns], accounts, replayed=False)
    rows = by_id(training_set(logs, Basis(system_at=D(100))))
    assert {k: r.foreign for k, r in rows.items()} == {"t5": 0, "t10": 1, "t20": 1}


def test_an_old_basis_never_changes(spark):
    txns = [txn(f"t{d}", "acc1", D(d), 10. * d) for d in range(1, 13)]
    labels = first_labels(txns) + [label("t2", True, D(4)), label("t3", True, D(5))]
    later = {
        "more frauds": ([], [label("t5", True, D(30)), label("t6", True, D(30))]),
        "overturned": ([], [label("t2", False, D(31))]),
        "bounded": ([], [label("t2", False, D(31), D(4), D(8))]),
        "future anchor": ([txn("late1", "acc1", D(45), commit=D(20))], [label("t7", True, D(30)), label("late1", False, D(20))]),
        "restated": ([txn("t4", "acc1", D(4), 99999., commit=D(32))], []),
    }
    def extract(more_txns, more_labels, basis):
        logs = fact_logs(spark, txns + more_txns, labels + more_labels, [account("acc1")], replayed=False, restated=True)
        rows = training_set(logs, Basis(system_at=basis), since=D(0), resolved_before=D(13)).collect()
        return sorted(map(str, rows))
    base = extract([], [], D(25))
    everything = [sum((v[i] for k, v in later.items() if k != "overturned"), []) for i in (0, 1)]
    assert any(f"{KNOWN_THEN}=1" in r or f"{KNOWN_THEN}=2" in r for r in base)
    assert extract(*everything, D(25)) == base
    assert extract(*later["overturned"], D(25)) == base
    assert extract(*later["more frauds"], D(35)) != base
    assert extract(*later["bounded"], D(35)) != base


def test_hot_account_spreads_over_panes_and_matches_frames(spark):
    """One account holds most rows; results equal Spark's own range frames at any pane width."""
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.8 else f"a{rng.randint(0, 20)}",
             D(0) + timedelta(minutes=rng.randint(0, 60 * 24 * 20)), float(rng.randint(1, 9))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, account_id string, txn_ts timestamp, amount double").repartition(4).cache()
    us, day = F.unix_micros("txn_ts"), 86_400_000_000
    frame = lambda d: Window.partitionBy("account_id").orderBy(us).rangeBetween(-d * day, -1)
    want = {r.id: r for r in df.select(
        "id", F.count("id").over(frame(1)).alias("c"), F.avg("amount").over(frame(7)).alias("m"),
        F.stddev_samp("amount").over(frame(7)).alias("s")).collect()}
    hours = Windows(velocity=timedelta(days=1), baseline=timedelta(days=7), pane=timedelta(hours=1))
    for windows in (hours, Windows(velocity=timedelta(days=1), baseline=timedelta(days=7))):
        for r in trailing_features(df, windows).collect():
            w = want[r.id]
            assert (r.txn_count_24h, r.mean_30d, r.std_30d) == (w.c, pytest.approx(w.m), pytest.approx(w.s, abs=1e-9)), r
    scan = trailing_features(df, hours)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__key" in scan and "hashpartitioning(account_id" not in scan


def test_measures_over_separate_facts(spark):
    anchors = spark.createDataFrame([(1, "k", D(10)), (2, "none", D(10))], "id int, account_id string, txn_ts timestamp")
    spans = spark.createDataFrame([("k", D(1), None), ("k", D(1), D(10)), ("k", D(10), D(11)), ("k", None, D(99))],
                                  "account_id string, start timestamp, stop timestamp")
    versions = spark.createDataFrame([("k", D(2), "old"), ("k", D(10), "new"), ("k", D(10) + US, "later")],
                                     "account_id string, valid_from timestamp, v string")
    facts = spark.createDataFrame([("k", D(9), 1.), ("k", D(8), 2.), ("k", D(10), 3.), ("k", D(3), None)],
                                  "account_id string, txn_ts timestamp, x double")
    got = by_id(point_in_time(anchors, [
        Active(spans, {"open": ("start", "stop")}), Latest("version", versions, ("v",)),
        Trailing("w", timedelta(days=7), facts=facts, value="x", moments=True),
        Trailing("c", timedelta(days=7), facts=facts)]))
    assert (got[1].open, got[1].version.v, got[1].n_w, got[1].mean_w, got[1].n_c) == (2, "new", 2, 1.5, 3)
    assert (got[2].open, got[2].version, got[2].n_w, got[2].mean_w, got[2].n_c) == (0, None, 0, None, 0)
    with pytest.raises(ValueError, match="whole number of panes"):
        point_in_time(anchors, [Trailing("w", timedelta(hours=36))])
