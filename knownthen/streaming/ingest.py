"""Transactions arriving: facts of a tick, settlement, velocity and scores.

The fact log is the state. A micro-batch appends what it learned and reads the log for
the rest, so nothing is dropped for being late and one busy account is no bigger a task
than in the batch operators.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, functions as F

from knownthen.functions.clock import at, instant, micros, pane_of, width_us
from knownthen.operators.features import Windows, requests_from, serve
from knownthen.operators.model import LinearModel, scored
from knownthen.operators.paned import Trailing, point_in_time
from knownthen.operators.temporal import Basis, DELETE, PUT, snapshot
from knownthen.sources.facts import FactLogs, read_once
from knownthen.sources.shared import written
from knownthen.sources.store import Commit, FactStore
from knownthen.streaming.runs import Run, new_run, put_batch, run_batches, table_so_far

UNIX = datetime(1970, 1, 1, tzinfo=timezone.utc)
ARRIVALS = ("id", "account_id", "txn_ts", "amount", "category", "country", "due")


def distinct_arrivals(batch: DataFrame) -> DataFrame:
    """The arrivals of a batch that have an id, each once, written."""
    return written(batch.select(*ARRIVALS).filter(F.col("id").isNotNull()).dropDuplicates(["id"]), "arrivals")


def tick(store: FactStore, batch: DataFrame, source: str, batch_id: int, distinct: bool = False) -> Commit:
    """Commit a batch of arrivals and everything it makes due, under one stamp.

    `batch` has the columns `ARRIVALS`; `due` is NULL unless the transaction will be charged back. The commit holds the transactions, a
    first 'legit' label of each, pending rows of the chargebacks, and for each pending one that is due by the newest event time seen
    so far a 'fraud' label and the end of its pending. What became due since the last tick is read by its due day; what
    was due by then was settled in a tick before. A batch that is already in the store changes nothing. `distinct`: the batch
    comes from `distinct_arrivals`.
    """
    done = store.committed(source, batch_id)
    if done is not None:
        return done
    arrived = batch if distinct else distinct_arrivals(batch)
    last = store.last()
    newest = arrived.agg(F.max(micros("txn_ts"))).first()[0]
    seen = [UNIX + timedelta(microseconds=newest)] if newest is not None else []
    seen += [last.clock] if last else []
    now = max(seen, default=UNIX)
    stamp = at(store.next_time(now))

    def fact(df, valid_from, seq, op):
        return df.withColumns({"valid_from": valid_from, "valid_to": F.lit(None).cast("timestamp"), "seq": F.lit(seq), "op": F.lit(op)})

    charged = arrived.filter(F.col("due").isNotNull()).select("id", "account_id", "txn_ts", "due")
    waiting = snapshot(store.facts("pending", due=(last.clock if last else None, now)), Basis()).select("id", "account_id", "txn_ts", "due")
    due = waiting.unionByName(charged.filter(F.col("due") <= at(now)))
    labels = fact(arrived.select("id", F.lit(False).alias("is_fraud")), stamp, 0, PUT).unionByName(
        fact(due.select("id", F.lit(True).alias("is_fraud")), stamp, 1, PUT))
    pending = fact(charged, F.col("txn_ts"), 0, PUT).unionByName(fact(due, stamp, 1, DELETE))
    return store.commit({"txn": fact(arrived.drop("due"), F.col("txn_ts"), 0, PUT), "label": labels, "pending": pending}, now,
                        clock=now, source=source, batch=batch_id)


def ingest_and_settle(stream: DataFrame, store: FactStore, run: Run, source: str = "arrivals") -> None:
    """Each micro-batch is one tick and one commit of the store. Started again with the same run, it goes on."""
    def arrive(batch: DataFrame, batch_id: int) -> None:
        tick(store, batch, source, batch_id)

    run_batches(stream, arrive, run=run)


def score_as_ingested(stream: DataFrame, store: FactStore, model: LinearModel, run: Run, windows: Windows = Windows(),
                      source: str = "arrivals", baseline: datetime | None = None) -> DataFrame:
    """Commit each micro-batch as a tick, then score its transactions from the store at the basis of that commit: id, p, model_version.

    What arrived before is their history, whatever its batch. Transactions that were in the store at `baseline` are neither committed nor
    scored again; redelivered batches score the same rows from the same basis and replace them.
    """
    spark = stream.sparkSession
    schema = "id {}, p double, model_version string".format(stream.schema["id"].dataType.simpleString())

    def arrive(batch: DataFrame, batch_id: int) -> None:
        if baseline is not None:
            there = store.facts("txn", baseline).select("id")
            batch = batch.join(there, "id", "left_anti")
        new = distinct_arrivals(batch)
        commit = tick(store, new, source, batch_id, distinct=True)
        span = new.agg(F.min(micros("txn_ts")), F.max(micros("txn_ts"))).first()
        reach = max(windows.velocity, windows.baseline, windows.fraud)
        first, last = (UNIX + timedelta(microseconds=us or 0) for us in span)
        near = read_once(store.logs(commit.system_time, pane=windows.pane).around(new, since=first - reach, until=last))
        vectors = serve(requests_from(new), near, Basis(system_at=commit.system_time), windows)
        put_batch(scored(vectors, model).select(
            F.col("req_id").alias("id"), "p", F.lit(model.version).alias("model_version")), run.folder, "scores", batch_id)

    run_batches(stream, arrive, run=run)
    return spark.read.schema(schema).parquet(f"{run.folder}/scores").drop("batch")


def velocity_on_arrival(stream: DataFrame, windows: Windows = Windows(), run: Run | None = None) -> DataFrame:
    """Exact trailing count per transaction, kept right as facts arrive in any order.

    A new fact changes the count of its account's transactions up to one width later.
    Each batch recomputes the (account, pane) cells it touches and the ones within reach,
    and the newest value of each transaction stands.
    """
    spark = stream.sparkSession
    run = run or new_run(spark, "velocity")
    root = run.folder
    reach = windows.velocity // windows.pane
    schema = stream.select("id", "account_id", "txn_ts").schema

    def arrive(batch: DataFrame, batch_id: int) -> None:
        put_batch(batch.select("id", "account_id", "txn_ts"), root, "txn", batch_id)
        span = batch.agg(F.min(micros("txn_ts")), F.max(micros("txn_ts"))).first()
        margin = 2 * width_us(windows.velocity) + width_us(windows.pane)
        near = F.lit(False) if span[0] is None else F.col("txn_ts").between(
            instant(F.lit(span[0] - margin)), instant(F.lit(span[1] + margin)))
        log = (table_so_far(spark, root, "txn", schema).filter((F.col("batch") <= batch_id) & near).drop("batch")
               .withColumn("cell", pane_of(micros("txn_ts"), windows.pane)))
        touched = batch.select("account_id", F.explode(F.sequence(
            pane_of(micros("txn_ts"), windows.pane),
            pane_of(micros("txn_ts"), windows.pane) + reach)).alias("cell")).distinct()
        anchors = log.join(touched, ["account_id", "cell"], "left_semi")
        needed = touched.select("account_id", F.explode(F.sequence(
            F.col("cell") - reach, F.col("cell"))).alias("cell")).distinct()
        facts = log.join(needed, ["account_id", "cell"], "left_semi")
        counted = point_in_time(anchors.select("id", "account_id", "txn_ts"),
                                [Trailing("velocity", windows.velocity, facts=facts)], pane=windows.pane)
        put_batch(counted.select("id", "account_id", "txn_ts", F.col("n_velocity").alias("txn_count_24h")),
                  root, "counts", batch_id)

    run_batches(stream, arrive, run=run)
    counts = spark.read.parquet(f"{root}/counts")
    last = F.max_by(F.struct("account_id", "txn_ts", "txn_count_24h"), "batch")
    return counts.groupBy("id").agg(last.alias("c")).select("id", "c.*")


def score_on_arrival(stream: DataFrame, logs: FactLogs, model: LinearModel,
                     windows: Windows = Windows(), baseline: DataFrame | None = None, run: Run | None = None) -> DataFrame:
    """Score each new transaction once per model version, each batch as of its newest instant: with the labels
    and transactions known by then, and none that were learned later.

    Transactions already in `baseline` (ids) were there before the stream was watched;
    the batch form scores those. Redelivered ids and retried batches add nothing.
    """
    spark = stream.sparkSession
    run = run or new_run(spark, "scores")
    root = run.folder
    schema = "id {}, p double, model_version string".format(stream.schema["id"].dataType.simpleString())

    def arrive(batch: DataFrame, batch_id: int) -> None:
        done = table_so_far(spark, root, "scores", schema).filter(
            (F.col("model_version") == model.version) & (F.col("batch") < batch_id)).select("id").join(
            batch.select("id"), "id", "left_semi")  # the batch is the small side of the history
        new = batch.dropDuplicates(["id"]).join(done, "id", "left_anti")
        if baseline is not None:
            new = new.join(baseline.select("id"), "id", "left_anti")
        span = new.agg(F.min(micros("txn_ts")), F.max(micros("txn_ts"))).first()
        reach = max(windows.velocity, windows.baseline, windows.fraud)
        first, last = (UNIX + timedelta(microseconds=us or 0) for us in span)
        near = read_once(logs.around(new, since=first - reach, until=last))
        vectors = serve(requests_from(new), near, Basis(system_at=last), windows)
        put_batch(scored(vectors, model).select(
            F.col("req_id").alias("id"), "p", F.lit(model.version).alias("model_version")), root, "scores", batch_id)

    run_batches(stream, arrive, run=run)
    return spark.read.schema(schema).parquet(f"{root}/scores").drop("batch")
