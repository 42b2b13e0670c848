"""Pages with scores, and scores that moved between two bases."""

import random
from datetime import timedelta

import pytest

import fixtures as fx
from fixtures import D
from knownthen.operators import feed
from knownthen.operators.features import Windows, training_set
from knownthen.operators.model import LinearModel, scored
from knownthen.operators.temporal import Basis
from knownthen.sources.facts import FactLogs

MODEL = LinearModel("m", (1.0, 1.0, 0.0, 0.5), (1.0, 2.0, 1.0, 1.0), (0.4, 0.3, 0.8, 1.2), -0.5)
WINDOWS = Windows(velocity=timedelta(days=1), baseline=timedelta(days=3), fraud=timedelta(days=6))


def logs_of(spark, n=160):
    rng = random.Random(12)
    txns, labels = [], []
    for i in range(n):
        ts = D(0) + timedelta(hours=rng.randint(0, 24 * 20))
        who = rng.choice(["a", "b", "c", "quiet"])
        txns.append(fx.txn(f"t{i:03}", who, ts, amount=rng.random() * 50, country=rng.choice(["GB", "US"])))
        labels.append(fx.label(f"t{i:03}", False, ts))
        if rng.random() < .3 and who != "quiet":
            labels.append(fx.label(f"t{i:03}", True, ts + timedelta(days=rng.randint(1, 8))))
    accounts = [fx.account(a) for a in ("a", "b", "c", "quiet")] + [fx.account("b", "US", D(12), commit=D(12))]
    return FactLogs(spark.createDataFrame(txns, fx.TXN), spark.createDataFrame(accounts, fx.ACCOUNT), spark.createDataFrame(labels, fx.LABEL),
                    spark.createDataFrame([], fx.PENDING))


def test_moved_scores_equal_the_full_difference(spark):
    logs = logs_of(spark)
    for older, newer in ((D(10), D(16)), (D(22), D(40))):
        old, new = Basis(system_at=older), Basis(system_at=newer)
        full = feed.score_moves(*[scored(training_set(logs, b, WINDOWS, knowledge="current"), MODEL).select("id", "p") for b in (old, new)])
        want = {r.id: (r.p_from, r.p_to) for r in full.collect()}
        got = {r.id: (r.p_from, r.p_to) for r in feed.moved_scores(logs, MODEL, old, new, WINDOWS).collect()}
        assert want and got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_a_live_page_has_scores_and_a_pinned_one_has_none(spark):
    logs = logs_of(spark)
    page = feed.data_head(logs, D(15), limit=4)
    rows = feed.scored_page(page, logs, MODEL, live=True, windows=WINDOWS).collect()
    want = {r.id: r.p for r in scored(training_set(logs, windows=WINDOWS), MODEL).collect()}
    assert len(rows) == 4 and all(r.p == pytest.approx(want[r.id]) for r in rows)
    assert {r.p for r in feed.scored_page(page, logs, MODEL, live=False).collect()} == {None}
    assert {r.p for r in feed.scored_page(page, logs, None, live=True).collect()} == {None}
    assert feed.scored_page(feed.data_head(logs, D(-5)), logs, MODEL, live=True).count() == 0
