"""Model artifacts and the registry that names them."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from knownthen.functions.clock import at
from knownthen.operators.features import FEATURES
from knownthen.operators.model import LinearModel, as_frame
from knownthen.sources.shared import read_if_present

REGISTRY_SCHEMA = ("version string, trained_at_wall timestamp, trained_at_sim timestamp, auc double, "
                   "n_train long, n_fraud long, path string")


def store_model(spark: SparkSession, model: LinearModel, root: str, *, wall: datetime, sim: datetime) -> None:
    """Write the artifact, then register it; a version is written once and never changed."""
    path = os.path.join(root, "models", model.version)
    as_frame(spark, model).coalesce(1).write.mode("errorifexists").parquet(path)
    row = spark.range(1).select(
        F.lit(model.version).alias("version"), at(wall).alias("trained_at_wall"), at(sim).alias("trained_at_sim"),
        F.lit(model.auc).cast("double").alias("auc"), F.lit(model.n_train).cast("long").alias("n_train"),
        F.lit(model.n_fraud).cast("long").alias("n_fraud"), F.lit(path).alias("path"))
    append_rows(row, root)


def append_rows(rows: DataFrame, root: str) -> None:
    rows.coalesce(1).write.mode("append").parquet(os.path.join(root, "registry"))


def registry(spark: SparkSession, root: str) -> DataFrame:
    rows = read_if_present(spark, os.path.join(root, "registry"), REGISTRY_SCHEMA)
    return spark.createDataFrame([], REGISTRY_SCHEMA) if rows is None else rows


def latest(models: DataFrame) -> DataFrame:
    """The registry row trained last, or no row."""
    newest = F.max_by(F.struct(*models.columns), F.struct("trained_at_wall", "version"))
    return models.agg(newest.alias("m")).filter(F.col("m").isNotNull()).select("m.*")


def by_version(models: DataFrame, version: str) -> DataFrame:
    return models.filter(F.col("version") == version)


def load(spark: SparkSession, row) -> LinearModel:
    """Read the few coefficient rows of a registered artifact."""
    parts = {r.feature: r for r in spark.read.parquet(row.path).collect()}
    ordered = [parts[f] for f in FEATURES]
    one = ordered[0]
    return LinearModel(one.version, tuple(r["mean"] for r in ordered), tuple(r["scale"] for r in ordered),
                       tuple(r["coef"] for r in ordered), one.intercept, one.auc, one.n_train, one.n_fraud)


def load_latest(spark: SparkSession, root: str) -> LinearModel | None:
    row = latest(registry(spark, root)).first()
    return None if row is None else load(spark, row)


def load_version(spark: SparkSession, root: str, version: str) -> LinearModel:
    row = by_version(registry(spark, root), version).first()
    if row is None:
        raise ValueError(f"unknown model version: {version}")
    return load(spark, row)
