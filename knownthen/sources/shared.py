"""The cluster's shared scratch folder, for tables that cut long lineages."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Where it is unset, a temporary folder, but only if driver and executors are one process:
    executors of a cluster would each write to their own disk."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="knownthen-"))
    return _local[0]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder below one folder per application, which can be
    removed once the application has ended."""
    own = f"knownthen-{spark.sparkContext.applicationId}"
    return os.path.join(shared_dir(spark), own, f"{name}-{uuid.uuid4().hex}")


def read_if_present(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The Parquet table at `path`, or None where nobody has written one yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: later reads prune its columns, a lost
    executor only re-reads files, and plans built on it stay small."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
