import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import D
from knownthen.operators.features import FEATURES, feature_catalog
from knownthen.operators.model import LinearModel, auc, class_counts, explain, extracted, fit, scored, split, train, train_window
from knownthen.sources import registry
from knownthen.sources.shared import fresh_dir


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = int(rng.random() < 0.2)
        out.append((i, y, rng.gauss(0.8 * y, 1), float(rng.randint(0, 4) + y), float(rng.random() < 0.1 + 0.4 * y),
                    float(rng.randint(0, 2) + y)))
    return out


SCHEMA = "id long, label int, amount_zscore double, txn_count_24h double, foreign double, prior_confirmed_fraud double"


def test_fit_solves_the_penalised_balanced_objective(spark):
    df = spark.createDataFrame(rows(400), SCHEMA)
    model = fit(df, "v1")
    parts = [r for r in split(df).collect() if not r.is_test]
    x = np.array([[r[f] for f in FEATURES] for r in parts])
    y = np.array([r.label for r in parts], dtype=float)
    x = (x - x.mean(0)) / x.std(0)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    a = np.c_[x, np.ones(len(y))]
    beta = np.zeros(5)
    penalty = np.diag([1.0] * 4 + [0.0])
    for _ in range(50):  # Newton steps on the summed loss plus half the squared norm
        p = 1 / (1 + np.exp(-a @ beta))
        grad = a.T @ (w * (p - y)) + penalty @ beta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + penalty
        beta -= np.linalg.solve(hess, grad)
    assert model.coef == pytest.approx(tuple(beta[:4]), abs=1e-5)
    assert model.intercept == pytest.approx(beta[4], abs=1e-5)
    assert model.auc > 0.7 and (model.n_train, model.n_fraud) == (400, sum(r[1] for r in rows(400)))

    # two models at one clock: the newer wall time is the latest, both load by version
    root = fresh_dir(spark, "models")
    assert registry.load_latest(spark, root) is None
    registry.store_model(spark, model, root, wall=D(1), sim=D(1))
    other = LinearModel("v2", model.mean, model.scale, model.coef, 0.5, model.auc, 1, 1)
    registry.store_model(spark, other, root, wall=D(2), sim=D(1))
    assert registry.load_latest(spark, root) == other
    assert registry.load_version(spark, root, "v1") == model
    with pytest.raises(ValueError, match="unknown model version"):
        registry.load_version(spark, root, "v3")
    with pytest.raises(Exception):
        registry.store_model(spark, other, root, wall=D(3), sim=D(3))


def test_split_is_exact_per_class(spark):
    parts = split(spark.createDataFrame(rows(500), SCHEMA)).groupBy("label").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    assert all(r.t == math.floor(0.3 * r.n) for r in parts)


def test_auc_counts_pairs(spark):
    rng = random.Random(5)
    data = [(int(rng.random() < 0.4), round(rng.random(), 1)) for _ in range(200)]
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    got = auc(spark.createDataFrame(data, "label int, p double")).first().auc
    assert got == pytest.approx(want)
    assert auc(spark.createDataFrame([(1, 0.5)], "label int, p double")).first().auc is None


def test_explain_sums_to_the_logit_and_guards(spark):
    model = LinearModel("m", (1.0, 2.0, 0.0, 0.0), (2.0, 1.0, 1.0, 1.0), (0.5, -1.0, 2.0, 1.0), -0.25)
    df = spark.createDataFrame(rows(20), SCHEMA)
    for r in explain(df, model).collect():
        parts = [model.coef[i] * (r[f] - model.mean[i]) / model.scale[i] for i, f in enumerate(FEATURES)]
        assert r.logit == pytest.approx(sum(parts) + model.intercept)
        assert r.prob == pytest.approx(1 / (1 + math.exp(-r.logit)))
        assert r.verdict == ("fraud" if r.prob >= 0.5 else "legit")
    assert {r.p for r in scored(df, None).collect()} == {0.0}
    few = spark.createDataFrame([(i, int(i < 3), 0.0, 0.0, 0.0, 0.0) for i in range(10)], SCHEMA)
    counts = class_counts(few).first()
    assert (counts.n, counts.n_fraud, counts.can_train, counts.can_fit) == (10, 3, False, True)
    assert train(few, "x") is None
    assert train_window(few.filter("label = 0"), "x") is None
    with pytest.raises(ValueError, match="past knowledge basis"):
        train_window(few, "x", historical=True, persist=True)
    catalog = feature_catalog(spark).orderBy("position").collect()
    assert tuple(r.name for r in catalog) == FEATURES


def test_passes_of_a_fit_do_not_hash_ids_again(spark):
    training = spark.createDataFrame(rows(200), ["id", "label", *FEATURES])
    parts = extracted(training)
    assert "md5" not in parts._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id for r in parts.filter("is_test").collect()} == {r.id for r in split(training).filter("is_test").collect()}
