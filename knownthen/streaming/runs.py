"""Starting bounded runs of a stream and reading what they wrote.

State and outputs live in the shared folder. Every `foreachBatch` writer below puts the
rows of micro-batch n into the folder `batch=n` and overwrites it when the batch is
retried, so a lost executor or driver never duplicates a fact.
"""

from __future__ import annotations

import os
import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from knownthen.sources.shared import fresh_dir, read_if_present


def staged_stream(df: DataFrame, order: str, files: int = 4) -> DataFrame:
    """A table as an unbounded source: files by range of `order`, one file per micro-batch."""
    spark = df.sparkSession
    path = fresh_dir(spark, "stage")
    df.repartitionByRange(files, order).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


class Stage:
    """A folder that a stream reads and to which tables are added, each a batch of many files."""

    def __init__(self, spark: SparkSession, schema):
        self.spark, self.schema, self.path = spark, schema, fresh_dir(spark, "stage")

    def add(self, df: DataFrame) -> None:
        df.select(*self.schema.names).write.mode("append").parquet(self.path)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.path)


_starting = threading.Lock()


@dataclass(frozen=True)
class Run:
    """Where a stream keeps its checkpoint and outputs, and when it takes new data.

    A run that is started again with the same folder goes on where it stopped. `every` is the time between micro-batches, such as
    '1 minute'; None takes what is there now and ends.
    """

    folder: str
    every: str | None = None
    state_partitions: int | None = None

    @property
    def checkpoint(self) -> str:
        return os.path.join(self.folder, "checkpoint")


def new_run(spark: SparkSession, name: str, **settings) -> Run:
    return Run(fresh_dir(spark, name), **settings)


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], run: Run, mode: str = "append") -> StreamingQuery:
    """Begin, or go on with, a run of a stream.

    State is split once and for all when a folder is first used, by default into one partition per core of the cluster. A
    stream takes its settings from the session as it starts; they are set for that moment only, one start at a time.
    """
    spark, partitions = stream.sparkSession, "spark.sql.shuffle.partitions"
    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", run.checkpoint)
    writer = writer.trigger(availableNow=True) if run.every is None else writer.trigger(processingTime=run.every)
    with _starting:
        usual = spark.conf.get(partitions)
        spark.conf.set(partitions, str(run.state_partitions or spark.sparkContext.defaultParallelism))
        try:
            return writer.start()
        finally:
            spark.conf.set(partitions, usual)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", run: Run | None = None) -> None:
    """Process everything available now in micro-batches, then stop.

    The partitions into which a stream's state is split are as many for ever; what `each` does with a batch has the session's own number.
    """
    partitions = "spark.sql.shuffle.partitions"
    usual = stream.sparkSession.conf.get(partitions)

    def work(batch: DataFrame, batch_id: int) -> None:
        conf = batch.sparkSession.conf  # of the stream's own copy of the session
        of_state = conf.get(partitions)
        conf.set(partitions, usual)
        try:
            each(batch, batch_id)
        finally:
            conf.set(partitions, of_state)

    start(stream, work, run or new_run(stream.sparkSession, "run"), mode).awaitTermination()


def batch_path(root: str, table: str, batch_id: int) -> str:
    return os.path.join(root, table, f"batch={batch_id}")


def put_batch(df: DataFrame, root: str, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(batch_path(root, table, batch_id))


def table_so_far(spark: SparkSession, root: str, table: str, schema) -> DataFrame:
    """All batches of a table; its `batch` column tells which one wrote a row."""
    rows = read_if_present(spark, os.path.join(root, table), schema)
    if rows is None:
        return spark.createDataFrame([], schema).selectExpr("*", "cast(null as int) AS batch")
    return rows
