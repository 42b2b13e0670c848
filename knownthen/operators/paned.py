"""Ordered scans that survive a hot key.

A window partitioned by account puts all rows of one account into one task, and Spark
re-aggregates a sliding frame for every row. Here each key is split into time panes.
Rows are windowed inside (key, pane) with growing frames only, which Spark evaluates
incrementally; what happened in other panes arrives as one pre-aggregated row per
(key, pane). Work is linear in rows, and no task holds more than one pane of a key
or one row per pane of it.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType

from knownthen.functions.clock import DAY, width_us
from knownthen.sources.shared import written

FIRST = Window.unboundedPreceding

_KEY, _PANE, _AT, _KIND, _X, _ROW = "__key", "__pane", "__at", "__kind", "__x", "__row"
_ANCHOR = 0
#: anchors without key or instant are spread over so many groups, from a pane on that no instant reaches
_LOST_PANES, _LOST = 4096, 1 << 50
#: types of keys for which a value can stand in for NULL; others are wrapped
_PLAIN = ("tinyint", "smallint", "int", "bigint", "string")
#: of the table that is counted, about so many rows go into one partition of a scan; they take 200 to 400 MB there with what they contribute
PARTITION_ROWS = 150_000


@dataclass(frozen=True)
class Trailing:
    """Facts of the anchor's key in [t - width, t).

    Adds `n_<name>`, and with `moments` also `mean_<name>` and `std_<name>` of `value`.
    `facts=None` means the anchors are the facts. Facts need the key and time columns; `where` names a flag of theirs that
    has to be set. Windows over the same frame read it once, whatever their flags and values.
    """

    name: str
    width: timedelta
    facts: DataFrame | None = None
    value: str | None = None
    moments: bool = False
    where: str | None = None


@dataclass(frozen=True)
class Active:
    """Adds `<name>` for each entry of `spans`: how many of the key's intervals
    [start, stop) contain t. A NULL start is no interval, a NULL stop an open one."""

    intervals: DataFrame
    spans: dict[str, tuple[str, str]]


@dataclass(frozen=True)
class Latest:
    """Adds `<name>`: struct of `columns` of the key's last version with start <= t."""

    name: str
    versions: DataFrame
    columns: tuple[str, ...]
    start: str = "valid_from"


def point_in_time(
    anchors: DataFrame,
    measures: list[Trailing | Active | Latest],
    *,
    key: str = "account_id",
    at: str = "txn_ts",
    pane: timedelta = DAY,
    sized: DataFrame | None = None,
) -> DataFrame:
    """Anchors with every measure evaluated at their own instant, in one exchange.

    Anchors and all contributions are shuffled together by (key, pane); one ascending
    and one descending scan read that exchange, and so do the totals per pane. An anchor
    without a key or instant has empty windows; it is dealt by its own hash, and facts like it are left out. A fact leaves a window `width` after it happened,
    so a copy shifted by `width` meets, in the anchor's own pane, exactly the anchors
    that still see it: the window is (head of own pane) + (whole panes between) +
    (shifted facts not yet expired).

    The exchange has `spark.sql.shuffle.partitions` partitions, or more where there are more rows than so many can hold: the rows of `sized` are
    counted for that, which has about as many as the larger of anchors and facts and is cheaper to count than these may be. None: the anchors.
    """
    trailing = [m for m in measures if isinstance(m, Trailing)]
    active = [m for m in measures if isinstance(m, Active)]
    latest = [m for m in measures if isinstance(m, Latest)]
    for m in trailing:
        if width_us(m.width) % width_us(pane):
            raise ValueError(f"{m.name}: width {m.width} is not a whole number of panes of {pane}")
    own_values = {m.value for m in trailing if m.facts is None and m.value}
    if len(own_values) > 1:
        raise ValueError("anchors can contribute one value column")

    kinds = count(1)
    step = width_us(pane)
    instant = f"unix_micros(`{at}`)"
    slot = {m.name: f"__v{i}" for i, m in enumerate(latest)}
    nothing = {m.name: F.lit(None).cast(m.versions.select(*m.columns).schema).alias(slot[m.name]) for m in latest}
    no_row = F.lit(None).cast(ArrayType(anchors.schema)).alias(_ROW)

    def contribution(df, copies, *, row=None, version=None):
        """One row (key, at, pane, kind, x, versions, row) per copy (kind, instant, x)."""
        copied = ", ".join(f"named_struct('kind', {k}, 'at', {t}, 'x', CAST({x} AS DOUBLE))" for k, t, x in copies)
        kind = dict(df.dtypes)[key]
        wide = df.select(
            F.expr(f"coalesce(`{key}`, CAST(0 AS {kind}))" if kind in _PLAIN else f"struct(`{key}`)").alias(_KEY),
            F.col(key).isNull().alias("__none"), F.expr(f"explode(array({copied}))").alias("__c"),
            *[F.struct(*m.columns).alias(slot[m.name]) if version is m else nothing[m.name] for m in latest],
            no_row if row is None else row.alias(_ROW))
        lost = "(__c.at IS NULL OR __none)"
        return wide.where(f"__c IS NOT NULL AND NOT {lost}" if row is None else f"NOT {lost} OR __c.kind = {_ANCHOR}").selectExpr(
            _KEY, f"__c.at AS {_AT}",
            f"coalesce(CASE WHEN {lost} THEN {'0' if row is None else f'{_LOST} + pmod(xxhash64(to_json({_ROW})), {_LOST_PANES})'} "
            f"ELSE (__c.at - pmod(__c.at, {step})) div {step} END, 0) AS {_PANE}",
            f"__c.kind AS {_KIND}", f"CASE WHEN NOT {lost} THEN __c.x END AS {_X}", *slot.values(),
            _ROW if row is None else f"CASE WHEN __c.kind = {_ANCHOR} THEN array({_ROW}) END AS {_ROW}")

    head: dict[str, int] = {}
    tail: dict[str, int] = {}
    code: dict[str, int] = {}

    def entering_and_leaving(group, h, value, where=None):
        when = f"CASE WHEN `{where}` THEN {instant} END" if where else instant
        copies = [(h, when, value)]
        for m in group:
            head[m.name], tail[m.name] = h, next(kinds)
            copies.append((tail[m.name], f"{when} + {width_us(m.width)}", value))
        return copies

    # anchors, doubling as their own facts where asked; then other facts, with one set of
    # head rows for all windows over the same frame, value and flag
    own = [m for m in trailing if m.facts is None]
    own_value = f"`{own_values.pop()}`" if own_values else "NULL"
    parts = [contribution(anchors, entering_and_leaving(own, _ANCHOR, own_value), row=F.struct(*anchors.columns))]
    shared: dict[int, dict[tuple, list[Trailing]]] = {}
    for m in trailing:
        if m.facts is not None:
            shared.setdefault(id(m.facts), {}).setdefault((m.value, m.where), []).append(m)
    for groups in shared.values():
        copies = []
        for (value, where), group in groups.items():
            copies += entering_and_leaving(group, next(kinds), f"`{value}`" if value else "NULL", where)
        parts.append(contribution(group[0].facts, copies))
    for m in active:
        copies = []
        for name, (start, stop) in m.spans.items():
            code[name] = k = next(kinds)
            copies += [(k, f"unix_micros(`{start}`)", 1),
                       (k, f"CASE WHEN `{start}` IS NOT NULL THEN unix_micros(`{stop}`) END", -1)]
        parts.append(contribution(m.intervals, copies))
    counted = list(code)
    for m in latest:
        code[m.name] = k = next(kinds)
        parts.append(contribution(m.versions, [(k, f"unix_micros(`{m.start}`)", "NULL")], version=m))
    # a number that is asked for is kept: Spark would join partitions by their compressed bytes, of which sorted rows and their windows take a hundredfold
    usual = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = max(usual, -(-(anchors if sized is None else sized).count() // PARTITION_ROWS))
    # both scans and the totals read one exchange only if they ask for the same: keys and panes are never NULL, so that no join adds a
    # filter below; rows are arrays, of which no field is left out; and the totals count all columns that the scans use
    rows = reduce(DataFrame.unionByName, parts).repartition(number, _KEY, _PANE)

    # inside the pane: what came before, and what has not expired yet
    in_pane = f"PARTITION BY {_KEY}, {_PANE} ORDER BY {_AT}"
    earlier = f"OVER ({in_pane} RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    until = f"OVER ({in_pane} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    unexpired = f"OVER ({in_pane} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    heads = sorted(set(head.values()))
    with_moments = {head[m.name] for m in trailing if m.moments}
    scanned = rows.selectExpr(
        "*", *[c for h in heads for c in _state(h, h in with_moments, f"__h{h}", earlier)],
        *[f"sum({_of(code[n])}) {until} AS __a_{n}" for n in counted],
        *[f"last({slot[m.name]}, true) {until} AS __l_{m.name}" for m in latest])
    if trailing:
        scanned = scanned.selectExpr(
            "*", *[c for m in trailing for c in _state(tail[m.name], m.moments, f"__t_{m.name}", unexpired)])

    # one row per pane of a key, then what the panes before it add
    used = ", ".join([_AT, _ROW, *slot.values(), *([_X] if with_moments or counted else [])])
    panes = rows.groupBy(_KEY, _PANE).agg(*map(F.expr, [
        f"count(CASE WHEN {_KIND} = {_ANCHOR} THEN struct({used}) END) AS __anchors",
        *[c for h in heads for c in _state(h, h in with_moments, f"__p{h}")],
        *[f"sum({_of(code[n])}) AS __a_{n}" for n in counted],
        *[_newest(m, slot[m.name], code[m.name]) for m in latest]])).repartition(number, _KEY)
    of_key = f"PARTITION BY {_KEY}"
    panes = panes.selectExpr("*", *[
        f"sum(__p{h}_n * __p{h}_mean) OVER ({of_key}) / nullif(sum(__p{h}_n) OVER ({of_key}), 0) AS __c{h}"
        for h in sorted(with_moments)], *[
        f"__p{h}_lo <> lead(__p{h}_lo) IGNORE NULLS OVER ({of_key} ORDER BY {_PANE}) AS __turn{h}" for h in sorted(with_moments)])
    # a pane leaves a window as many panes later as that is wide: a copy of it, taken off from there on
    leaving = {m.name: i for i, m in enumerate((m for m in trailing if m.width // pane >= 2), 1)}
    copies = ", ".join([f"named_struct('copy', 0, 'at', {_PANE})"] + [
        f"named_struct('copy', {leaving[m.name]}, 'at', {_PANE} + {m.width // pane})" for m in trailing if m.name in leaving])
    if leaving:
        panes = panes.selectExpr("*", f"explode(array({copies})) AS __of").selectExpr(
            *[c for c in panes.columns if c not in (_PANE, "__anchors")], f"__of.at AS {_PANE}", "__of.copy AS __copy", "CASE WHEN __of.copy = 0 THEN __anchors END AS __anchors")
    else:
        panes = panes.selectExpr("*", "0 AS __copy")
    before = f"OVER ({of_key} ORDER BY {_PANE} RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    own_pane = lambda x: f"CASE WHEN __copy = 0 THEN {x} END"
    panes = panes.selectExpr(
        "*", *[c for m in trailing for c in _inside(m, head[m.name], leaving.get(m.name), of_key)],
        *[f"sum({own_pane(f'__a_{n}')}) {before} AS __b_{n}" for n in counted],
        *[f"last({own_pane(f'__l_{m.name}')}, true) {before} AS __k_{m.name}" for m in latest]).where("__anchors > 0")
    panes = panes.selectExpr(_KEY, _PANE, *[c for m in trailing for c in _between(m, head[m.name], m.name in leaving)],
                             *[f"__b_{n}" for n in counted], *[f"__k_{m.name}" for m in latest])

    joined = scanned.where(f"{_KIND} = {_ANCHOR}").join(panes, [_KEY, _PANE], "left")
    out = []
    for m in trailing:
        out += _merged(m, (f"__h{head[m.name]}", f"__t_{m.name}", f"__m_{m.name}"))
    out += [f"CAST(coalesce(__a_{n}, 0) + coalesce(__b_{n}, 0) AS BIGINT) AS `{n}`" for n in counted]
    out += [f"coalesce(__l_{m.name}, __k_{m.name}) AS `{m.name}`" for m in latest]
    # an anchor that no account or instant places saw nothing
    lost = f"{_PANE} >= {_LOST}"
    names = [(x.rpartition(" AS ")[0], x.rpartition(" AS ")[2]) for x in out]
    zero = {f"`{n}`" for n in (*counted, *(f"n_{m.name}" for m in trailing))}
    out = [f"CASE WHEN {lost} THEN {'0' if n in zero else 'NULL'} ELSE {x} END AS {n}" for x, n in names]
    return joined.selectExpr(f"element_at({_ROW}, 1) AS {_ROW}", *out).selectExpr(f"{_ROW}.*", *[n for _, n in names])


def _of(kind: int) -> str:
    return f"CASE WHEN {_KIND} = {kind} THEN {_X} END"


def _state(kind: int, moments: bool, prefix: str, over: str = "") -> list[str]:
    """Rows of one kind and, with moments, mergeable count, mean and spread of their value."""
    cols = {"rows": f"count(CASE WHEN {_KIND} = {kind} THEN 1 END)"}
    if moments:
        x = _of(kind)
        cols |= {"n": f"count({x})", "mean": f"avg({x})", "var": f"var_pop({x})", "lo": f"min({x})", "hi": f"max({x})"}
    return [f"{c} {over} AS {prefix}_{name}" for name, c in cols.items()]


def _newest(m: Latest, slot: str, kind: int) -> str:
    """Columns of the pane's last version; plain maxima keep the aggregation hashed."""
    since = f"CASE WHEN {_KIND} = {kind} THEN {_AT} END"
    fields = ", ".join(f"'{c}', max_by({slot}.`{c}`, {since})" for c in m.columns)
    return f"CASE WHEN max({since}) IS NOT NULL THEN named_struct({fields}) END AS __l_{m.name}"


def _inside(m: Trailing, h: int, copy: int | None, of_key: str) -> list[str]:
    """Sums over the whole panes strictly between the window's first and last pane: over what came before less what has left, so only growing
    frames are used, whose work is linear however many panes a window spans."""
    if copy is None:
        return []
    p, out = f"__p{h}", f"__i_{m.name}"
    before = f"OVER ({of_key} ORDER BY {_PANE} RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    left = f"OVER ({of_key} ORDER BY {_PANE} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    d, turns = f"({p}_mean - __c{h})", f"CAST(coalesce(__turn{h}, false) AS INT)"
    sums = {"rows": f"{p}_rows"}
    lasts = {}
    if m.moments:  # deviations from the key's own mean keep the sums small
        sums |= {"n": f"{p}_n", "d": f"{p}_n * {d}", "q": f"{p}_n * ({p}_var + {d} * {d})", "mixed": f"CAST({p}_lo <> {p}_hi AS INT) + {turns}"}
        lasts = {"turn": turns, "lo": f"{p}_lo"}
    return [f"coalesce(sum(CASE WHEN __copy = 0 THEN {x} END) {before}, 0) - coalesce(sum(CASE WHEN __copy = {copy} THEN {x} END) {left}, 0) AS {out}_{n}"
            for n, x in sums.items()] + [f"last(CASE WHEN __copy = 0 AND {p}_n > 0 THEN {x} END, true) {before} AS {out}_{n}" for n, x in lasts.items()]


def _between(m: Trailing, h: int, wide: bool) -> list[str]:
    """State of these panes from their sums.

    Extremes matter only where all values are equal. They are if no pane holds two values and no pane but the last differs from the
    next one, which counts tell exactly; else the highest is given as infinite.
    """
    p, out = f"__i_{m.name}", f"__m_{m.name}"
    cols = {"rows": f"{p}_rows" if wide else "0"}
    if m.moments and wide:
        n, same = f"nullif({p}_n, 0)", f"{p}_mixed = coalesce({p}_turn, 0)"
        cols |= {"n": f"{p}_n", "mean": f"__c{h} + {p}_d / {n}", "var": f"greatest(0D, {p}_q / {n} - {p}_d / {n} * {p}_d / {n})",
                 "lo": f"CASE WHEN {p}_n > 0 THEN {p}_lo END",
                 "hi": f"CASE WHEN {p}_n > 0 THEN CASE WHEN {same} THEN {p}_lo ELSE CAST('Infinity' AS DOUBLE) END END"}
    elif m.moments:
        cols |= {"n": "0", "mean": "0D", "var": "0D", "lo": "CAST(NULL AS DOUBLE)", "hi": "CAST(NULL AS DOUBLE)"}
    return [f"{c} AS {out}_{name}" for name, c in cols.items()]


def _merged(m: Trailing, parts: tuple[str, ...]) -> list[str]:
    """Columns of one window from its three disjoint parts."""
    total = lambda f: "(" + " + ".join(f.format(p=p) for p in parts) + ")"
    if not m.moments:
        return [f"CAST({total('coalesce({p}_rows, 0)')} AS BIGINT) AS `n_{m.name}`"]
    n = total("coalesce({p}_n, 0)")
    mean = f"({total('coalesce({p}_n * {p}_mean, 0D)')} / nullif({n}, 0))"
    m2 = total(f"coalesce({{p}}_n * ({{p}}_var + ({{p}}_mean - {mean}) * ({{p}}_mean - {mean})), 0D)")
    lo, hi = (f"{f}({', '.join(f'{p}_{c}' for p in parts)})" for f, c in (("least", "lo"), ("greatest", "hi")))
    # equal values have no spread at all, whatever the rounding of the partial means
    std = f"CASE WHEN {n} < 2 THEN NULL WHEN {lo} = {hi} THEN 0D ELSE sqrt({m2} / nullif({n} - 1, 0)) END"
    return [f"CAST({n} AS BIGINT) AS `n_{m.name}`", f"{mean} AS `mean_{m.name}`", f"{std} AS `std_{m.name}`"]


# --- row-to-row scans --------------------------------------------------------------


def running_total(df: DataFrame, keys: list[str], order: list[str], pane: Column,
                  value: Column, out: str) -> DataFrame:
    """Sum of `value` up to and including each row, in `order`; `pane` must follow `order`."""
    df = df.withColumn(_PANE, pane).withColumn(_X, value)
    inside = Window.partitionBy(*keys, _PANE).orderBy(*order).rowsBetween(FIRST, 0)
    past = Window.partitionBy(*keys).orderBy(_PANE).rowsBetween(FIRST, -1)
    totals = df.groupBy(*keys, _PANE).agg(F.sum(_X).alias("__sum"))
    carry = totals.select(*keys, _PANE, F.sum("__sum").over(past).alias("__carry"))
    return (df.withColumn(out, F.sum(_X).over(inside))
            .join(carry, [*keys, _PANE], "left")
            .withColumn(out, F.col(out) + F.coalesce("__carry", F.lit(0)))
            .drop(_PANE, _X, "__carry"))


def total_in_order(df: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """Sum of `value` up to and including each row in `order` over the whole table, which must be unique in `order`.

    Rows are dealt by ranges of `order` with about as many in each, and written; each range adds what the ones before it
    sum to, one number per range.
    """
    dealt = written(df.withColumn(_X, value).repartitionByRange(*order).withColumn(_PANE, F.spark_partition_id()), "ranges")
    before = Window.orderBy(_PANE).rowsBetween(FIRST, -1)  # over one row per range
    carry = dealt.groupBy(_PANE).agg(F.sum(_X).alias("__sum")).select(_PANE, F.sum("__sum").over(before).alias("__carry"))
    inside = Window.partitionBy(_PANE).orderBy(*order).rowsBetween(FIRST, 0)
    return (dealt.withColumn(out, F.sum(_X).over(inside)).join(carry, _PANE)
            .withColumn(out, F.col(out) + F.coalesce("__carry", F.lit(0))).drop(_PANE, _X, "__carry"))


def numbered(df: DataFrame, keys: list[str], order: list[str], pane: Column, out: str) -> DataFrame:
    """Row number from 1 within `keys`."""
    return running_total(df, keys, order, pane, F.lit(1).cast("long"), out)


def adjacent(df: DataFrame, keys: list[str], order: list[str], pane: Column,
             value: str, out: str, *, following: bool = True) -> DataFrame:
    """`value` of the next (or previous) row in `order`, as a struct field-safe column."""
    df = df.withColumn(_PANE, pane)
    inside = Window.partitionBy(*keys, _PANE).orderBy(*order)
    shift, edge = (F.lead, "__first") if following else (F.lag, "__last")
    mark = F.row_number().over(inside) == 1 if following else F.lead(F.lit(1)).over(inside).isNull()
    scanned = df.select("*", shift(F.struct(value)).over(inside).alias(out), mark.alias(edge))
    edges = scanned.filter(F.col(edge)).select(*keys, _PANE, F.struct(value).alias("__edge"))
    beyond = edges.select(*keys, _PANE, shift("__edge").over(Window.partitionBy(*keys).orderBy(_PANE)).alias("__edge"))
    return (scanned.join(beyond, [*keys, _PANE], "left")
            .withColumn(out, F.coalesce(out, "__edge")[value])
            .drop(_PANE, edge, "__edge"))
