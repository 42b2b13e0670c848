"""Fact logs derived from the given event and customer tables.

Events are transactions. A third of the 'error' events are chargebacks, confirmed 2-10
days later, some overturned and some of those confirmed again. Facts arrive in
learned-at order, floored to the UTC day of their arrival, and stop at NOW.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from knownthen.functions.clock import at, utc_day
from knownthen.operators.temporal import DELETE, PUT, as_log
from knownthen.sources.facts import FactLogs

# Fixed values of the derivation.
NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
PAST = datetime(2024, 1, 20, tzinfo=timezone.utc)
OUTCOME_DELAY = timedelta(days=10)
FIRST_ACCOUNT_VERSION = datetime(2023, 1, 1, tzinfo=timezone.utc)
SECOND_ACCOUNT_VERSION = datetime(2024, 1, 1, tzinfo=timezone.utc)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table with zone-less timestamps read as UTC instants."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c)
                       for c, t in df.dtypes])


def days_after(ts, n):
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(86_400_000_000) * n)


def transactions(events: DataFrame, customer: DataFrame) -> DataFrame:
    home = customer.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("home"))
    country = F.when(F.col("event_id") % 10 == 0, (F.col("home") + 7) % 25).otherwise(F.col("home"))
    txn = events.join(home, "user_id", "left").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("account_id"), F.col("ts").alias("txn_ts"),
        F.col("value").alias("amount"), F.col("event_type").alias("category"), country.alias("country"))
    return as_log(txn, valid_from=F.col("txn_ts"), system_from=utc_day("txn_ts"))


def accounts(customer: DataFrame) -> DataFrame:
    """Home country of each customer; every fourth one moves once in January 2024."""
    key = F.col("c_custkey")
    moved = F.struct(
        ((F.col("c_nationkey") + 1) % 25).alias("home_country"),
        days_after(at(SECOND_ACCOUNT_VERSION), key % 30).alias("valid_from"))
    first = F.struct(F.col("c_nationkey").alias("home_country"), at(FIRST_ACCOUNT_VERSION).alias("valid_from"))
    rows = customer.select(
        key.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("tier"),
        F.explode(F.when(key % 4 == 0, F.array(first, moved)).otherwise(F.array(first))).alias("v"))
    rows = rows.select("id", "name", "v.home_country", "tier", F.col("v.valid_from").alias("__from"))
    return as_log(rows, valid_from=F.col("__from"), system_from=F.col("__from")).drop("__from")


def chargebacks(events: DataFrame) -> DataFrame:
    """Every event with the truth about it: is it fraud, when is it confirmed."""
    k = F.call_function("div", F.col("event_id"), F.lit(3))
    return events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("account_id"), F.col("ts").alias("txn_ts"),
        ((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)).alias("fraud"),
        k.alias("k"), (2 + k % 9).alias("delay"), utc_day("ts").alias("seen"),
    ).withColumn("confirmed", days_after(F.col("seen"), F.col("delay")))


def _facts(events: DataFrame, cases: list) -> DataFrame:
    """Label log from (condition, is_fraud, learned, valid_from, valid_to, seq, op) cases."""
    open_end = F.lit(None).cast("timestamp")
    facts = [F.when(condition, F.struct(
        F.lit(fraud).cast("boolean").alias("is_fraud"), valid_from.alias("valid_from"),
        (open_end if valid_to is None else valid_to).alias("valid_to"), learned.alias("system_from"),
        F.lit(seq).alias("seq"), F.lit(op).alias("op")))
        for condition, fraud, learned, valid_from, valid_to, seq, op in cases]
    return (chargebacks(events).select("id", F.explode(F.array(*facts)).alias("f"))
            .filter(F.col("f").isNotNull()).select("id", "f.*").filter(F.col("system_from") <= at(NOW)))


def _replayed_cases() -> list:
    fraud, k, seen, confirmed = F.col("fraud"), F.col("k"), F.col("seen"), F.col("confirmed")
    overturned, again = days_after(confirmed, 5), days_after(confirmed, 10)
    return [
        (F.lit(True), False, seen, seen, None, 0, PUT),
        (fraud, True, confirmed, confirmed, None, 0, PUT),
        (fraud & (k % 7 == 0), False, overturned, overturned, None, 0, PUT),
        (fraud & (k % 14 == 0), True, again, again, None, 0, PUT),
    ]


def labels(events: DataFrame) -> DataFrame:
    """Label facts as they were learned: never backdated, never bounded."""
    return _facts(events, _replayed_cases())


def corrected_labels(events: DataFrame) -> DataFrame:
    """The same with bounded corrections and backdated late imports."""
    fraud, k, seen, confirmed = F.col("fraud"), F.col("k"), F.col("seen"), F.col("confirmed")
    return _facts(events, _replayed_cases() + [
        (fraud & (k % 5 == 0), False, days_after(confirmed, 4), confirmed, days_after(confirmed, 2), 1, PUT),
        (fraud & (k % 11 == 0), True, days_after(confirmed, 6), days_after(seen, 1), None, 2, PUT),
    ])


def gapped_labels(events: DataFrame) -> DataFrame:
    """The same as `labels` with some histories deleted after confirmation, and some whose facts all end."""
    fraud, k, seen, confirmed = F.col("fraud"), F.col("k"), F.col("seen"), F.col("confirmed")
    gone, ends = days_after(confirmed, 1), fraud & (k % 17 == 0)
    usual = [(condition & ~ends, *rest) for condition, *rest in _replayed_cases()[:2]]
    return _facts(events, usual + [
        (ends, False, seen, seen, confirmed, 0, PUT), (ends, True, confirmed, confirmed, days_after(confirmed, 3), 0, PUT),
        (fraud & (k % 13 == 0), None, gone, gone, None, 1, DELETE)])


def pending_chargebacks(events: DataFrame) -> DataFrame:
    """Chargebacks in flight from the day of the event until their confirmation."""
    fraud = chargebacks(events).filter("fraud")
    rows = fraud.select(
        "id", "account_id", "txn_ts", days_after(F.col("txn_ts"), F.col("delay")).alias("due"),
        F.explode(F.array(
            F.struct(F.col("txn_ts").alias("v"), F.col("seen").alias("s"), F.lit(0).alias("n"), F.lit(PUT).alias("o")),
            F.struct(F.col("confirmed").alias("v"), F.col("confirmed").alias("s"), F.lit(1).alias("n"),
                     F.lit(DELETE).alias("o")))).alias("f"))
    return rows.select(
        "id", "account_id", "txn_ts", "due", F.col("f.v").alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_to"), F.col("f.s").alias("system_from"),
        F.col("f.n").alias("seq"), F.col("f.o").alias("op")).filter(F.col("system_from") <= at(NOW))


def fact_logs(spark: SparkSession, sf_dir: str) -> FactLogs:
    events, customer = read(spark, sf_dir, "events"), read(spark, sf_dir, "customer")
    return FactLogs(txn=transactions(events, customer), account=accounts(customer),
                    label=labels(events), pending=pending_chargebacks(events))


def replay_order(logs: FactLogs) -> DataFrame:
    """All facts of all logs as one table of (table, id, fact); system_from tells when each was learned."""
    def tagged(log, name, is_fraud):
        return log.select(F.lit(name).alias("table_name"), "id", is_fraud.cast("boolean").alias("is_fraud"),
                          "valid_from", "system_from", "op")
    no = F.lit(None)
    return (tagged(logs.account, "account", no).unionByName(tagged(logs.txn, "txn", no))
            .unionByName(tagged(logs.label, "label", F.col("is_fraud")))
            .unionByName(tagged(logs.pending, "pending_chargeback", no)))
