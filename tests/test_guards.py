"""Nothing is dropped in silence: anchors, old facts, restated logs, incomplete histories, scratch folders."""

from datetime import timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from fixtures import ACCOUNT, D, LABEL, PENDING, TXN, account, label, txn, utc
from knownthen.operators import audit, feed, leakage
from knownthen.operators.features import Windows, prior_fraud, serve, training_set
from knownthen.operators.model import LinearModel
from knownthen.operators.quality import closed_histories
from knownthen.operators.temporal import Basis, versions
from knownthen.sources import shared
from knownthen.sources.facts import FactLogs
from knownthen.streaming.ingest import score_on_arrival
from knownthen.streaming.runs import staged_stream


def fact_logs(spark, txns, labels, accounts, **kw):
    return FactLogs(spark.createDataFrame(txns, TXN), spark.createDataFrame(accounts, ACCOUNT),
                    spark.createDataFrame(labels, LABEL), spark.createDataFrame([], PENDING), **kw)


def test_an_unlabelled_transaction_fails_the_read_where_it_is_visible(spark):
    txns = [txn("a", "x", D(1)), txn("b", "x", D(5))]
    logs = fact_logs(spark, txns, [label("a", False, D(1))], [account("x")])
    assert [r.id for r in training_set(logs, Basis(system_at=D(3))).collect()] == ["a"]
    for limit in (None, 5):
        with pytest.raises(Exception, match="no current label"):
            training_set(logs, limit=limit).collect()


def test_every_read_of_labels_fails_on_an_incomplete_history(spark):
    logs = fact_logs(spark, [txn("a", "x", D(1)), txn("b", "x", D(5))], [label("a", False, D(1))], [account("x")])
    model = LinearModel("m", (0.0,) * 4, (1.0,) * 4, (0.0,) * 4, 0.0)
    reads = {
        "states": lambda b: feed.states(logs, b), "leaky": lambda b: leakage.leaky_counts(logs, b),
        "leakage": lambda b: leakage.leakage_rows(logs, b, D(9)), "totals": lambda b: leakage.training_totals(logs, b, D(9)),
        "sample": lambda b: leakage.training_sample(logs, b, D(9)), "page": lambda b: feed.data_head(logs, D(6), b),
        "replay": lambda b: audit.replay(logs, model, logs.transactions(b), D(9), b)}
    for name, read in reads.items():
        assert read(Basis(system_at=D(3))).count() >= (name != "page"), name
        with pytest.raises(Exception, match="no current label"):
            read(Basis()).collect()
    # what the horizon leaves out needs no label
    assert leakage.training_totals(logs, Basis(), D(3)).first().total_rows == 1


def test_a_selected_transaction_must_be_visible(spark):
    txns = [txn("a", "x", D(1)), txn("b", "x", D(5))]
    logs = fact_logs(spark, txns, [label(t[0], False, t[2]) for t in txns], [account("x")])
    assert leakage.training_sample(logs, Basis(), D(9), selected="b").count() == 2
    with pytest.raises(ValueError, match="unknown transaction"):
        leakage.training_sample(logs, Basis(system_at=D(3)), D(9), selected="b")


def test_since_keeps_what_the_widest_window_reaches(spark):
    txns = [txn(f"t{i}", "x", D(i)) for i in range(12)]
    logs = fact_logs(spark, txns, [label(t[0], False, t[2]) for t in txns], [account("x")])
    windows = Windows(velocity=timedelta(days=10), baseline=timedelta(days=2))
    rows = {r.id: r.txn_count_24h for r in training_set(logs, windows=windows, since=D(10)).collect()}
    assert rows == {"t10": 10, "t11": 10}


def test_anchors_without_account_have_empty_windows(spark):
    txns = [txn("a", "x", D(1)), txn("b", None, D(2)), txn("c", None, D(2)), txn("d", "x", D(3))]
    logs = fact_logs(spark, txns, [label(t[0], True, D(1)) for t in txns], [account("x")])
    counts = {r.id: (r.prior_confirmed_fraud_as_known_then, r.prior_confirmed_fraud_with_hindsight) for r in prior_fraud(logs, Basis()).collect()}
    assert counts == {"a": (0, 0), "b": (0, 0), "c": (0, 0), "d": (1, 1)}
    asked = spark.createDataFrame([("q1", None, D(4), 1.0, "GB"), ("q2", "x", None, 1.0, "GB"), ("q3", "x", D(4), 1.0, "US"), ("q1", None, D(4), 1.0, "GB")],
                                  "req_id string, account_id string, t timestamp, amount double, country string")
    rows = sorted((r.req_id, r.n_30d, r.mean_30d, r.foreign, r.prior_confirmed_fraud) for r in serve(asked, logs).collect())
    assert rows == [("q1", 0, None, 0, 0), ("q1", 0, None, 0, 0), ("q2", 0, None, 0, 0), ("q3", 2, 100.0, 1, 2)]


def test_restated_and_deleted_transactions(spark):
    gone = txn("b", "x", D(2), commit=D(6), seq=1)[:-1] + ("del",)
    txns = [txn("a", "x", D(1)), txn("b", "x", D(2)), gone, txn("a", "x", D(1), amount=7.0, commit=D(6), seq=1)]
    labels = [label("a", False, D(1)), label("b", False, D(2))]
    with pytest.raises(Exception, match="restated"):
        fact_logs(spark, txns, labels, [account("x")]).transactions(Basis()).collect()
    logs = fact_logs(spark, txns, labels, [account("x")], restated=True)
    assert [(r.id, r.amount) for r in logs.transactions(Basis()).collect()] == [("a", 7.0)]
    assert logs.transactions(Basis(system_at=D(3))).count() == 2


def test_a_correction_cuts_the_versions_it_leaves(spark):
    rows = spark.createDataFrame([label("a", False, D(1)), label("a", True, D(4), D(2), D(5), 1)], LABEL)
    assert [(r.is_fraud, utc(r.valid_from)) for r in versions(rows, Basis()).collect()] == [(False, D(5))]


def test_a_history_with_a_finite_tail_is_reported(spark):
    logs = fact_logs(spark, [], [label("a", False, D(1), valid_to=D(9)), label("b", False, D(1))], [])
    assert [(r.id, utc(r.ends)) for r in closed_histories(logs).collect()] == [("a", D(9))]


def test_old_labels_count_and_later_ones_do_not(spark):
    """A label imported long before its transaction is used; one learned after a batch is not."""
    txns = [txn("old", "x", D(50)), txn("mid", "x", D(51)), txn("new", "x", D(52))]
    labels = [label("old", True, D(1)), label("mid", False, D(51)), label("mid", True, D(60)), label("new", False, D(52))]
    logs = fact_logs(spark, txns, labels, [account("x")])
    model = LinearModel("m", (0.0,) * 4, (1.0,) * 4, (0.0, 0.0, 0.0, 1.0), 0.0)
    arrivals = logs.transactions(Basis()).select("id", "account_id", "txn_ts", "amount", "country")
    there = arrivals.filter(F.col("id") == "old").select("id")
    scores = {r.id: r.p for r in score_on_arrival(staged_stream(arrivals, "txn_ts", 1), logs, model, baseline=there).collect()}
    assert set(scores) == {"mid", "new"}
    assert scores["new"] == pytest.approx(scores["mid"]) and scores["new"] == pytest.approx(0.7310585786)


def test_scratch_needs_a_shared_folder_unless_local():
    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder or default), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(session("spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared.shared_dir(session("local-cluster[2,1,1024]"))
    assert shared.shared_dir(session("yarn", "hdfs:///scratch")) == "hdfs:///scratch" and shared.shared_dir(session("local[4]"))
