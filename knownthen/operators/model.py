"""Fit, evaluate, explain and apply a logistic regression over the features."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from math import floor

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from knownthen.functions.rules import logistic, verdict
from knownthen.operators.features import FEATURES
from knownthen.operators.paned import total_in_order
from knownthen.sources.shared import written

TEST_SHARE = 0.3
MIN_TRAINING_FRAUDS = 5
MIN_PER_CLASS = 2
#: hex digits by which hash prefixes grow, and rows that may share the last one
PREFIX, FEW = 3, 10_000


@dataclass(frozen=True)
class LinearModel:
    """Coefficients over standardised features; a handful of numbers per version."""

    version: str
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coef: tuple[float, ...]
    intercept: float
    auc: float | None = None
    n_train: int | None = None
    n_fraud: int | None = None

    def contribution(self, i: int, value: Column) -> Column:
        return self.coef[i] * ((value - self.mean[i]) / self.scale[i])

    def logit(self, **replaced: Column) -> Column:
        terms = [self.contribution(i, replaced.get(f, F.col(f)).cast("double")) for i, f in enumerate(FEATURES)]
        return sum(terms, F.lit(self.intercept))

    def prob(self, **replaced: Column) -> Column:
        return logistic(self.logit(**replaced))


def explain(df: DataFrame, model: LinearModel) -> DataFrame:
    """Per-feature log-odds contributions, their sum with the intercept, and the verdict."""
    parts = {f"contrib_{f}": model.contribution(i, F.col(f).cast("double")) for i, f in enumerate(FEATURES)}
    return (df.withColumns(parts)
            .withColumn("intercept", F.lit(model.intercept))
            .withColumn("logit", sum((F.col(c) for c in parts), F.lit(model.intercept)))
            .withColumn("prob", logistic("logit"))
            .withColumn("verdict", verdict("prob")))


def scored(df: DataFrame, model: LinearModel | None) -> DataFrame:
    """Adds the model's probability `p`; 0 while no model exists."""
    return df.withColumn("p", F.lit(0.0) if model is None else model.prob())


def split(training: DataFrame) -> DataFrame:
    """Adds `is_test`: the first 30 % of each class in hash order of the id, exact per class and reproducible.

    The last row of the share is found by counting hash prefixes, longer ones where many rows share one; then a comparison tells
    the parts apart, so no class is numbered, sorted or moved. `training` is read once more per prefix length.
    """
    hashed = training.withColumn("__h", F.md5(F.col("id").cast("string")))
    is_test = F.lit(False)
    for label, (h, last) in share_ends(hashed).items():
        is_test = is_test | ((F.col("label") == label) & ((F.col("__h") < h) | ((F.col("__h") == h) & (F.col("id") <= F.lit(last)))))
    return hashed.withColumn("is_test", is_test).drop("__h")


def share_ends(hashed: DataFrame) -> dict:
    """Hash and id of the last row of the held-out share of each class that has one."""
    wanted, prefix, ends = None, {}, {}
    for digits in range(PREFIX, 33, PREFIX):
        start = F.substring("__h", 1, digits)
        inside = hashed if wanted is None else hashed.filter(reduce(
            lambda x, y: x | y, [(F.col("label") == label) & F.startswith("__h", F.lit(p)) for label, p in prefix.items()]))
        counts: dict = {}
        for r in inside.groupBy("label", start.alias("p")).count().collect():
            counts.setdefault(r["label"], []).append((r["p"], r["count"]))
        if wanted is None:  # 30 % of each class
            wanted = {label: floor(TEST_SHARE * sum(n for _, n in rows) + 1e-9) for label, rows in counts.items()}
            prefix = {label: "" for label, k in wanted.items() if k}
        last, widest = {}, 0
        for label in prefix:
            for p, n in sorted(counts[label]):
                if wanted[label] <= n:
                    last[label], widest = p, max(widest, n)
                    break
                wanted[label] -= n
        prefix = last
        if widest <= FEW:
            break
    for label, p in prefix.items():
        k = wanted[label]
        row = (hashed.filter((F.col("label") == label) & F.startswith("__h", F.lit(p))).select("__h", "id").orderBy("__h", "id").limit(k)
               .agg(F.max(F.struct("__h", "id")).alias("end")).first().end)
        ends[label] = (row["__h"], row["id"])
    return ends


def auc(scores: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    """Exact rank AUC: ties count half. Scores are grouped first, then accumulated over ranges of equal numbers of them, so no task
    sees all and skewed scores are spread as even ones are."""
    by_score = scores.groupBy(F.col(score).alias("__s")).agg(
        F.sum(F.col(label).cast("double")).alias("__pos"), F.sum(1.0 - F.col(label)).alias("__neg"))
    low = total_in_order(by_score, ["__s"], F.col("__neg"), "__upto")
    wins = F.sum(F.col("__pos") * (F.col("__upto") - F.col("__neg") / 2))
    pairs = F.nullif(F.sum("__pos") * F.sum("__neg"), F.lit(0.0))
    return low.agg((wins / pairs).alias("auc"))


def class_counts(training: DataFrame) -> DataFrame:
    """Sizes a fit depends on, and whether they suffice to train and to fit a window."""
    n, fraud = F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))
    return training.agg(
        n.alias("n"), fraud.alias("n_fraud"),
        (fraud >= MIN_TRAINING_FRAUDS).alias("can_train"),
        ((fraud >= MIN_PER_CLASS) & (n - fraud >= MIN_PER_CLASS)).alias("can_fit"))


def extracted(training: DataFrame) -> DataFrame:
    """id, label, features and is_test, written: evaluated once, read by every pass of a fit. The flag is written too, so that no pass hashes the
    ids again."""
    rows = written(training.select("id", "label", *[F.col(f).cast("double").alias(f) for f in FEATURES]), "extract")
    return written(split(rows), "parts")


def fit(training: DataFrame, version: str) -> LinearModel:
    """Standardise by population deviation, balance the classes, fit with an L2 penalty of
    1 on the summed loss, and measure AUC on the held-out part."""
    return fit_parts(extracted(training), version)


def fit_parts(parts: DataFrame, version: str) -> LinearModel:
    """The same from `extracted` rows: one aggregation for sizes and moments, one per Newton step, one for the AUC."""
    stats = {r.is_test: r for r in parts.groupBy("is_test").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"),
        *[F.avg(f).alias(f"m_{f}") for f in FEATURES],
        *[F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES]).collect()}
    learn = stats[False]
    mean = tuple(learn[f"m_{f}"] for f in FEATURES)
    scale = tuple(learn[f"s_{f}"] or 1.0 for f in FEATURES)
    train = parts.filter(~F.col("is_test")).select(
        F.col("label").cast("double").alias("y"), class_weight(learn["n"], learn["pos"]).alias("w"),
        *[((F.col(f) - mean[i]) / scale[i]).alias(f"x{i + 1}") for i, f in enumerate(FEATURES)])
    theta = newton(train, len(FEATURES))
    model = LinearModel(version, mean, scale, tuple(theta[1:]), theta[0])
    held_out = auc(scored(parts.filter("is_test"), model)).first()["auc"]
    return replace(model, auc=held_out, n_train=sum(r["n"] for r in stats.values()), n_fraud=sum(r["pos"] for r in stats.values()))


def class_weight(n: int, pos: int) -> Column:
    """Both classes weigh the same in all."""
    return F.when(F.col("label") == 1, n / (2 * pos) if pos else 0.0).otherwise(n / (2 * (n - pos)) if n > pos else 0.0)


def newton(train: DataFrame, k: int, penalty: float = 1.0, steps: int = 50, tol: float = 1e-10) -> list[float]:
    """Intercept and coefficients of the weighted logistic loss of (y, w, x1..xk) plus penalty / 2 times the squared coefficients.

    Each step is one aggregation of the gradient, the Hessian and the loss, (k + 1)(k + 4) / 2 + 1 numbers; where a step made the loss larger it
    is halved. The driver solves the k + 1 equations.
    """
    size = range(k + 1)
    x = [F.lit(1.0), *[F.col(f"x{i}") for i in range(1, k + 1)]]
    ridge = np.diag([0.0] + [penalty] * k)

    def sums(theta):
        z = F.lit(float(theta[0])) + reduce(lambda a, b: a + b, [float(theta[i]) * x[i] for i in range(1, k + 1)])
        rows = train.withColumn("z", z).withColumn("p", logistic("z")).withColumns(
            {"r": F.col("w") * (F.col("p") - F.col("y")), "h": F.col("w") * F.col("p") * (1 - F.col("p")),
             "loss": F.col("w") * (F.log1p(F.exp(-F.abs("z"))) + F.greatest("z", F.lit(0.0)) - F.col("y") * F.col("z"))})
        row = rows.agg(F.sum("loss").alias("loss"), *[F.sum(F.col("r") * x[i]).alias(f"g{i}") for i in size],
                       *[F.sum(F.col("h") * x[i] * x[j]).alias(f"h{i}{j}") for i in size for j in size if i <= j]).first()
        hessian = np.array([[row[f"h{min(i, j)}{max(i, j)}"] for j in size] for i in size]) + ridge
        return row["loss"] + theta @ ridge @ theta / 2, np.array([row[f"g{i}"] for i in size]) + ridge @ theta, hessian

    theta, move, best = np.zeros(k + 1), np.zeros(k + 1), np.inf
    for _ in range(steps):
        loss, slope, hessian = sums(theta)
        if loss > best + 1e-9 * abs(best):
            move /= 2
            theta = theta + move
            continue
        best, move = min(best, loss), np.linalg.solve(hessian, slope)
        theta = theta - move
        if np.abs(move).max() < tol:
            break
    return [float(t) for t in theta]


def gradient(parts: DataFrame, model: LinearModel) -> dict[str, float]:
    """Slope of the fitted objective per training row of `extracted` rows along each coefficient: zero at its optimum."""
    part = scored(parts.filter(~F.col("is_test")), model)
    sums = part.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum((F.col("p") - F.col("label")) * (F.col(f) - model.mean[i]) / model.scale[i]).alias(f) for i, f in enumerate(FEATURES)]).collect()
    n = sum(r["n"] for r in sums)
    return {f: (sum(r[f] * n / (2 * r["n"]) for r in sums) + model.coef[i]) / n for i, f in enumerate(FEATURES)}


def train(training: DataFrame, version: str) -> LinearModel | None:
    """Fit unless there are too few confirmed frauds to learn from."""
    return fit(training, version) if class_counts(training).first()["can_train"] else None


def train_window(training: DataFrame, version: str, *, historical: bool = False,
                 persist: bool = False) -> LinearModel | None:
    """Fit on a window of data; a model of a past knowledge basis is a preview only."""
    if historical and persist:
        raise ValueError("a preview at a past knowledge basis is never persisted")
    return fit(training, version) if class_counts(training).first()["can_fit"] else None


def as_frame(spark, model: LinearModel) -> DataFrame:
    """One row per feature: mean, scale, coefficient, and the model-wide numbers."""
    rows = [(model.version, f, model.mean[i], model.scale[i], model.coef[i], model.intercept, model.auc,
             model.n_train, model.n_fraud) for i, f in enumerate(FEATURES)]
    return spark.createDataFrame(
        rows, "version string, feature string, mean double, scale double, coef double, intercept double, "
              "auc double, n_train long, n_fraud long")
