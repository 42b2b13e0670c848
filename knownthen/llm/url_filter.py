"""URL filter: a blocked Bloom filter in front of an exact hash join.

A list entry is a host and the start of a path. It fits a URL of that host, or of a subdomain,
whose path starts so. Every URL has a few candidate keys (a suffix of its host and a start of its
path); the filter, one 64-bit word per block, passes those that may be listed, and the join with
the list removes the false positives. The longest entry that fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The filter travels with each task: at most 2**20 words (8 MB). Longer lists only raise its rate of
#: false positives, which the join removes.
MAX_BLOCKS = 1 << 20
BITS_PER_KEY = 16
#: Hosts are cut into labels; a DNS name has at most 127.
SALTS = 16


def split_url(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path of a URL; both empty where it is null or has no `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.regexp_extract(rest, r"^([^?#]*)", 1)
    slash = F.locate("/", rest)
    host = F.when(slash > 0, F.substring(rest, F.lit(1), slash - 1)).otherwise(rest)
    path = F.when(slash > 0, F.substring(rest, slash, F.length(rest))).otherwise("")
    return F.translate(host, UPPER, UPPER.lower()), path


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def mask_of(key: Column) -> Column:
    """Four bits of a word, taken from a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    out = F.lit(0).cast("long")
    for i in range(4):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def bloom_words(keys: DataFrame, blocks: int) -> DataFrame:
    """One row with the filter of column `key`: an array of `blocks` words."""
    words = (keys.select(block_of(F.col("key"), blocks).cast("long").alias("id"), mask_of(F.col("key")).alias("mask"))
             .groupBy("id").agg(F.bit_or("mask").alias("bits")))
    every = keys.sparkSession.range(blocks).join(words, "id", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))),
                                 lambda x: x["bits"]).alias("words"))


def judge(pages: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """`pages` with host, path, rule and verdict.

    listed: action (allow or block), host, path. Of equal entries, block wins over allow.
    A URL that no entry fits has a null rule and the verdict allow. Null and scheme-less URLs have an
    empty host and path; repeated rows are judged each; an empty list allows all. Columns of `pages` named like
    the new ones are replaced.
    """
    listed = (listed.groupBy(F.concat(F.col("host"), F.lit("\n"), F.col("path")).alias("key"))
              .agg(F.max("action").alias("action"), F.first("host").alias("h"), F.first("path").alias("p"))
              .select("key", "action", F.concat("h", "p").alias("rule")))
    sizes = listed.agg(F.count("*").alias("n"),
                       F.collect_set(F.length(F.substring_index("key", "\n", -1))).alias("lengths")).first()
    blocks = 1
    while blocks * 64 < sizes.n * BITS_PER_KEY and blocks < MAX_BLOCKS:
        blocks *= 2
    host, path = split_url(F.col(url))
    at = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = [F.substring("path", 1, n) for n in sorted(sizes.lengths)]
    keys = F.flatten(F.transform(suffixes, lambda s: F.array(*[F.concat(s, F.lit("\n"), x) for x in starts]))
                     if starts else F.array(F.array().cast("array<string>")))
    words = bloom_words(listed, blocks).scalar()  # one value in the condition, never a column of the rows
    key = F.col("key")
    possible = F.element_at(words, block_of(key, blocks) + 1).bitwiseAND(mask_of(key)) == mask_of(key)
    # salted: one entry may fit a large share of all URLs
    asked = (at.select("host", "path", F.explode(F.array_distinct(keys)).alias("key")).filter(possible).distinct()
             .withColumn("_salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS))))
    salted = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    fits = asked.join(salted, ["key", "_salt"])
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), "rule", "action")).alias("_best"))
    out = at.join(best, ["host", "path"], "left")
    return out.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")], "host", "path",
                      F.col("_best.rule").alias("rule"), F.coalesce("_best.action", F.lit("allow")).alias("verdict"))
