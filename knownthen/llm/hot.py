"""Joining rows to their group when one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: hash buckets of keys; at most so many rows tell how finely the keys of a bucket are dealt
BUCKETS = 4096
#: rows of a key that one salt carries, about
TARGET = 50_000


def dealt_join(rows: DataFrame, groups: DataFrame, key: str, size: str, by: Column, target: int = TARGET) -> DataFrame:
    """Left join of `rows` to `groups`, which has one row per `key` with its number of rows in `size`.

    A key of more than `target` rows is dealt by the hash of `by` over as many salts as it needs, and its group row is
    repeated for each. The number of salts is set for hash buckets of keys, so that what is broadcast has at most
    `BUCKETS` rows; all other rows have one salt. Rows whose key is null or has no group come back with nulls.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    fine = (groups.filter(F.col(size) > target).groupBy(bucket.alias("_bucket"))
            .agg(F.max(F.ceil(F.col(size) / target)).alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1).cast("long"))
    left = (rows.withColumn("_bucket", bucket).join(F.broadcast(fine), "_bucket", "left")
            .withColumn("_salt", F.pmod(F.xxhash64(by), salts)).drop("_bucket", "_salts"))
    right = (groups.withColumn("_bucket", bucket).join(F.broadcast(fine), "_bucket", "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_bucket", "_salts"))
    return left.join(right, [key, "_salt"], "left").drop("_salt")
