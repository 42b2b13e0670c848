"""Bitemporal reads over append-only fact logs.

A log row asserts `payload` for `id` over the valid interval [valid_from, valid_to)
(`valid_to` NULL = open), learned at `system_from`; `seq` orders facts of one commit and
`op` is 'put' or 'del'. A later fact supersedes earlier ones wherever their valid
intervals overlap, from its own system time on.

Every read takes a `Basis`, so all logs of a plan can be cut at the same two instants.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from knownthen.functions.clock import DAY, at, instant, micros, pane_of
from knownthen.operators.paned import FIRST, adjacent
from knownthen.sources.shared import written

LOG_COLUMNS = ("valid_from", "valid_to", "system_from", "seq", "op")
PUT, DELETE = "put", "del"
_OPEN = 2**62  # stands for an open valid_to among microsecond keys


@dataclass(frozen=True)
class Basis:
    """Where to read: `valid_at` None is the open tail ("now"), `system_at` None the latest."""

    valid_at: datetime | None = None
    system_at: datetime | None = None

    def known_at(self, system_at: datetime | None) -> "Basis":
        return replace(self, system_at=system_at)


def as_log(df: DataFrame, *, valid_from: Column, system_from: Column, valid_to: Column | None = None,
           seq: Column | None = None, op: str = PUT) -> DataFrame:
    """Attach the five log columns to a payload."""
    return df.select(
        "*",
        valid_from.alias("valid_from"),
        (F.lit(None).cast("timestamp") if valid_to is None else valid_to).alias("valid_to"),
        system_from.alias("system_from"),
        (F.lit(0) if seq is None else seq).cast("int").alias("seq"),
        F.lit(op).alias("op"),
    )


def payload_of(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c not in ("id", *LOG_COLUMNS, "system_to")]


def known(log: DataFrame, basis: Basis) -> DataFrame:
    """Facts already committed at the basis; the filter reaches the Parquet scan."""
    if basis.system_at is None:
        return log
    return log.filter(F.col("system_from") <= at(basis.system_at))


def covers(valid_at: datetime | None) -> Column:
    """Does the half-open valid interval of a fact contain the instant?"""
    if valid_at is None:
        return F.col("valid_to").isNull()
    t = at(valid_at)
    return (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to")))


def covering(df: DataFrame, valid_at: datetime | None) -> DataFrame:
    """Facts whose half-open valid interval contains the instant."""
    return df.filter(covers(valid_at))


def snapshot(log: DataFrame, basis: Basis) -> DataFrame:
    """The row of each id in force at the basis: the last fact covering the valid instant.

    One grouped maximum, combined on the map side, so a much-restated id costs its
    reducer one row per map task.
    """
    kept = [c for c in log.columns if c not in ("id", "seq")]
    newest = F.max_by(F.struct(*kept), F.struct("system_from", "seq"))
    return (covering(known(log, basis), basis.valid_at)
            .groupBy("id").agg(newest.alias("f"))
            .filter(F.col("f.op") == PUT)
            .select("id", "f.*").drop("op"))


def snapshots(log: DataFrame, bases: dict[str, Basis], columns: list[str]) -> DataFrame:
    """id and, for each named basis, a struct of `columns` of the row in force there, NULL where there is none: `snapshot` at several bases in
    one grouped pass. Ids with no row at any of them are left out."""
    kept = F.struct(*columns, "op")
    when = {name: covers(b.valid_at) & (F.lit(True) if b.system_at is None else F.col("system_from") <= at(b.system_at)) for name, b in bases.items()}
    newest = [F.max_by(F.when(c, kept), F.when(c, F.struct("system_from", "seq"))).alias(name) for name, c in when.items()]
    states = log.groupBy("id").agg(*newest)
    put = {n: F.when(F.col(f"{n}.op") == PUT, F.struct(*[F.col(f"{n}.{c}").alias(c) for c in columns])) for n in bases}
    return states.select("id", *[c.alias(n) for n, c in put.items()]).filter(F.coalesce(*bases).isNotNull())


def versions(log: DataFrame, basis: Basis, pane: timedelta = DAY) -> DataFrame:
    """Every version ever believed at the valid instant, with its system interval; valid time is cut to where it was
    believed, so the tail that a bounded correction leaves begins where the correction ends."""
    return covering(rectangles(known(log, basis), pane), basis.valid_at)


def replayed_timeline(log: DataFrame, basis: Basis, pane: timedelta = DAY) -> DataFrame:
    """Valid timeline at a system basis of a log written in learned-at order.

    Such a log holds open-ended facts only and never reaches behind an earlier fact of
    the same id, so each fact ends where the next begins. A log that breaks this fails
    the query instead of giving a wrong timeline; use `timeline` for it.
    """
    chained = adjacent(known(log, basis), ["id"], ["system_from", "seq"],
                       pane_of(micros("system_from"), pane), "valid_from", "__next")
    bad = F.col("valid_to").isNotNull() | (F.col("__next") < F.col("valid_from"))
    until = F.when(bad, F.raise_error(F.lit("log is not in learned-at order: read it with timeline()"))
                   .cast("timestamp")).otherwise(F.col("__next"))
    return (chained.withColumn("valid_to", until).drop("__next")
            .filter(F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to")))
            .filter(F.col("op") == PUT).drop("seq", "op"))


def timeline(log: DataFrame, basis: Basis, pane: timedelta = DAY) -> DataFrame:
    """Valid timeline at a system basis of any log (corrections, bounded facts, deletes)."""
    return rectangles(known(log, basis), pane).filter(F.col("system_to").isNull()).drop("system_to")


def rectangles(log: DataFrame, pane: timedelta = DAY) -> DataFrame:
    """Maximal valid x system rectangles in which each fact is the one believed.

    Seen per id, facts are horizontal segments over valid time stacked in commit order,
    and a fact is believed at a valid instant until the next segment above it there is
    committed. That neighbour only changes where some segment starts or ends, so it is
    enough to look up neighbours at those edges: each segment is stored at O(log n)
    dyadic blocks of edge positions, an edge looks into the O(log n) blocks around it.
    No fact is paired with every edge it spans, and a lone fact of an id needs none of this.
    `seq` must be unique in (id, commit).
    """
    facts = log.select(
        "*", F.struct(micros("system_from").alias("commit"), "seq").alias("__ord"),
        micros("valid_from").alias("__from"), F.coalesce(micros("valid_to"), F.lit(_OPEN)).alias("__to"),
    ).filter(F.col("__from") < F.col("__to"))
    all_placed = written(_placed(facts.select("id", "__ord", "__from", "__to"), pane), "placed")
    lone, placed = all_placed.filter("__facts = 1"), all_placed.filter("__facts > 1")

    entries = placed.select("id", "__ord", F.explode(_cover("__lo", "__hi")).alias("b")).select(
        "id", "b.level", "b.block", "__ord", F.lit(None).cast(_PROBE).alias("__probe"))
    looked_up = placed.select("id", "__ord", "__top", F.explode(F.array(
        F.struct(F.col("__lo").alias("pos"), F.col("__from").alias("at"), F.lit(True).alias("start")),
        F.when(F.col("__to") < _OPEN, F.struct(
            F.col("__hi").alias("pos"), F.col("__to").alias("at"), F.lit(False).alias("start"))))).alias("__probe"))
    probes = looked_up.filter(F.col("__probe").isNotNull()).select(
        "id", "__ord", "__probe", F.explode(_path("__probe.pos", "__top")).alias("b")).select(
        "id", "b.level", "b.block", "__ord", "__probe")
    around = (_neighbours(entries.unionByName(probes), ["id", "level", "block"], pane)
              .groupBy("id", "__ord", "__probe")
              .agg(F.max("__below").alias("__below"), F.min("__above").alias("__above")))

    # (segment, edge) -> segment above it from there on
    starts = F.col("__probe.start")
    changes = around.select("id", F.col("__probe.at").alias("__at"), F.explode(F.array(
        F.when(starts, F.struct(F.col("__ord").alias("o"), F.col("__above").alias("up"))),
        F.when(F.col("__below").isNotNull(), F.struct(
            F.col("__below").alias("o"), F.when(starts, F.col("__ord")).otherwise(F.col("__above")).alias("up"))),
    )).alias("c")).filter(F.col("c").isNotNull()).groupBy("id", F.col("c.o").alias("__ord"), "__at").agg(
        F.min("c.up.commit").alias("__until"))

    # join neighbouring pieces that end at the same commit
    at_pane = pane_of(F.col("__at"), pane)
    pieces = written(changes.withColumn("__same", F.struct("__until")), "pieces")
    pieces = adjacent(pieces, ["id", "__ord"], ["__at"], at_pane, "__same", "__before", following=False)
    pieces = pieces.filter(F.col("__before").isNull() | ~F.col("__before").eqNullSafe(F.col("__same")))
    pieces = adjacent(pieces, ["id", "__ord"], ["__at"], at_pane, "__at", "__next")
    unknown = F.lit(None).cast("long")
    pieces = pieces.select("id", "__ord", "__at", "__until", "__next").unionByName(lone.select(
        "id", "__ord", F.col("__from").alias("__at"), unknown.alias("__until"), unknown.alias("__next")))

    payload = payload_of(log)
    finish = F.coalesce("__next", "__to")
    return (
        pieces.join(facts.select("id", "__ord", "__to", "op", "system_from", *payload), ["id", "__ord"])
        .filter((F.col("op") == PUT) & (F.col("__until").isNull() | (F.col("__ord.commit") < F.col("__until"))))
        .select("id", *payload, instant("__at").alias("valid_from"),
                F.when(finish < _OPEN, instant(finish)).alias("valid_to"),
                "system_from", instant("__until").alias("system_to")))


_PROBE = "struct<pos:bigint,at:bigint,start:boolean>"


def _placed(facts: DataFrame, pane: timedelta) -> DataFrame:
    """Each fact with the positions of its two edges among the distinct edges of its id."""
    ends = facts.select("id", "__ord", F.explode(F.array(
        F.struct(F.col("__from").alias("at"), F.lit(True).alias("start")),
        F.struct(F.col("__to").alias("at"), F.lit(False).alias("start")))).alias("e")).select(
        "id", "__ord", "e.at", "e.start", pane_of(F.col("e.at"), pane).alias("__pane"))
    inside = Window.partitionBy("id", "__pane").orderBy("at")
    ranked = ends.withColumn("__rank", F.dense_rank().over(inside))
    of_id = Window.partitionBy("id")
    earlier = (ends.groupBy("id", "__pane").agg(
        F.count_distinct("at").alias("__n"), F.count_if("start").alias("__starts")).select(
        "id", "__pane", F.sum("__n").over(of_id).alias("__top"), F.sum("__starts").over(of_id).alias("__facts"),
        F.coalesce(F.sum("__n").over(of_id.orderBy("__pane").rowsBetween(FIRST, -1)), F.lit(0)).alias("__skip")))
    position = F.col("__rank") + F.col("__skip")
    return ranked.join(earlier, ["id", "__pane"]).groupBy("id", "__ord").agg(
        F.max("__top").alias("__top"), F.max("__facts").alias("__facts"),
        F.max(F.when(F.col("start"), position)).alias("__lo"), F.max(F.when(~F.col("start"), position)).alias("__hi"),
        F.max(F.when(F.col("start"), F.col("at"))).alias("__from"), F.max(F.when(~F.col("start"), F.col("at"))).alias("__to"))


def _bits(n: Column) -> Column:
    """Position of the highest set bit of a positive number."""
    return F.length(F.bin(n)) - 1


def _cover(lo: str, hi: str) -> Column:
    """Dyadic blocks (level, block) that exactly tile positions [lo, hi)."""
    lo, hi = F.col(lo), F.col(hi)

    def at_level(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        left = F.call_function("shiftright", lo + size - 1, k)
        right = F.call_function("shiftright", hi, k)
        odd_left, odd_right = F.pmod(left, F.lit(2)), F.pmod(right, F.lit(2))
        block = lambda b: F.struct(k.alias("level"), b.alias("block"))
        return F.array(F.when((left < right) & (odd_left == 1), block(left)),
                       F.when((left + odd_left < right) & (odd_right == 1), block(right - 1)))

    tiles = F.flatten(F.transform(F.sequence(F.lit(0), _bits(hi - lo)), at_level))
    return F.filter(tiles, lambda b: b.isNotNull())


def _path(pos: str, top: str) -> Column:
    """All dyadic blocks that contain a position."""
    return F.transform(
        F.sequence(F.lit(0), _bits(F.col(top))),
        lambda k: F.struct(k.alias("level"), F.call_function("shiftright", F.col(pos), k).alias("block")))


def _neighbours(df: DataFrame, keys: list[str], pane: timedelta) -> DataFrame:
    """For probe rows: the nearest entries committed before and after their own fact."""
    is_entry = F.col("__probe").isNull()
    df = df.withColumns({"__pane": pane_of(F.col("__ord.commit"), pane), "__entry": F.when(is_entry, F.col("__ord")),
                         "__last": is_entry})  # a fact's own entry sorts after its probe either way
    inside = Window.partitionBy(*keys, "__pane")
    below = F.max("__entry").over(inside.orderBy("__ord", "__last").rowsBetween(FIRST, -1))
    above = F.min("__entry").over(inside.orderBy(F.col("__ord").desc(), "__last").rowsBetween(FIRST, -1))
    scanned = df.select("*", below.alias("__below"), above.alias("__above"))
    of_key = Window.partitionBy(*keys)
    beyond = (df.groupBy(*keys, "__pane").agg(F.max("__entry").alias("__max"), F.min("__entry").alias("__min"))
              .select(*keys, "__pane",
                      F.max("__max").over(of_key.orderBy("__pane").rowsBetween(FIRST, -1)).alias("__max"),
                      F.min("__min").over(of_key.orderBy(F.col("__pane").desc()).rowsBetween(FIRST, -1)).alias("__min")))
    return (scanned.filter(F.col("__probe").isNotNull()).join(beyond, [*keys, "__pane"], "left")
            .withColumn("__below", F.coalesce("__below", "__max"))
            .withColumn("__above", F.coalesce("__above", "__min"))
            .select(*keys, "__ord", "__probe", "__below", "__above"))
