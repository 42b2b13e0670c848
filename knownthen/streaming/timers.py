"""Keyed state that acts when its time comes: settlements, and corrections whose state is forgotten.

Time is the watermark of the arrival (commit) clock, not of event time, so that a fact with an old event time is no late row:
nothing is dropped for it. State is kept per id, a few numbers each, so a busy account is spread over all tasks; an id
leaves the state when its time comes. Ids that differ in their last three digits only share a call and a timer: the functions run once per such
group that has rows or a due id in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from knownthen.functions.clock import instant, micros, width_us

NO_TIME = -1  # stands for an instant that is not known yet


def _clocked(stream: DataFrame, clock: str, lateness: timedelta) -> DataFrame:
    return stream.withWatermark(clock, f"{width_us(lateness)} microseconds")


def _kept(condition: Column, clock: str) -> Column:
    """A condition that names the clock, so that it stays above the watermark and rows that fail it still move the clock."""
    return F.when(F.col(clock).isNotNull(), condition).otherwise(False)


def _neighbours(id_: str) -> Column:
    """The id without its last three digits. A call of a state function costs milliseconds whatever it holds, so neighbours share one; a group
    holds 1111 whole numbers at most, so groups grow in number with the ids and not in size. Other ids are alone."""
    return F.regexp_replace(F.col(id_).cast("string"), "(?<=.)[0-9]{1,3}$", "").alias("id")


def _due_ms(state: GroupState, at_us: int) -> int:
    """When an id is looked at again: once the watermark is past an instant."""
    return max(at_us // 1000, state.getCurrentWatermarkMs() + 1)


def _hold(state: GroupState, held: dict) -> None:
    """Keep what is held of the ids, lists that end with their due times, and wake up for the first of them."""
    if not held:
        state.remove()
        return
    state.update(([*held], *([*column] for column in zip(*held.values()))))
    state.setTimeoutTimestamp(max(min(one[-1] for one in held.values()), state.getCurrentWatermarkMs() + 1))


def _held(state: GroupState) -> dict:
    return {one: list(rest) for one, *rest in zip(*state.get)} if state.exists else {}


def settlements(facts: DataFrame, clock: str = "arrived", lateness: timedelta = timedelta(0)) -> DataFrame:
    """id, account_id, due and settled_at of each pending fact, once: when the clock has passed `due`, or at its arrival if it was due by then.

    `facts` has id, account_id, due (NULL: never pending) and the clock, by which it may be out of order by `lateness`; what comes later is
    dropped. All facts move the clock. An id that is delivered again while it waits, or in one batch, settles once, by its first arrival.
    Timers have the precision of the watermark: a millisecond.
    """
    pending = _clocked(facts, clock, lateness).filter(_kept(F.col("due").isNotNull() & F.col("id").isNotNull(), clock))
    kinds = dict(pending.dtypes)
    key, account = kinds["id"], kinds["account_id"]
    # as text, since a missing number would make its neighbours floating-point
    rows = pending.select(_neighbours("id"), F.col("id").alias("one"), F.col("account_id").cast("string").alias("account_id"), clock,
                          micros("due").alias("due_us"), micros(clock).alias("arrived_us"))

    def settle(which: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, first, out = _held(state), {}, []
        for pdf in () if state.hasTimedOut else batches:
            for one, *row in zip(*(pdf[c].tolist() for c in ("one", "account_id", "due_us", "arrived_us"))):
                if one in held:
                    held[one][-1] = _due_ms(state, held[one][1])
                elif one not in first or row[2] < first[one][2]:
                    first[one] = row
        for one in [one for one, (*_, due_ms) in held.items() if due_ms < state.getCurrentWatermarkMs()]:
            account_id, due, _ = held.pop(one)
            out.append((one, account_id, due, due))
        for one, (account_id, due, arrived) in first.items():
            if due <= arrived:
                out.append((one, account_id, due, arrived))
            else:
                held[one] = [account_id, due, _due_ms(state, due)]
        _hold(state, held)
        if out:
            yield pd.DataFrame(out, columns=["id", "account_id", "due_us", "settled_us"])

    out = rows.groupBy("id").applyInPandasWithState(
        settle, f"id {key}, account_id string, due_us long, settled_us long",
        f"ids array<{key}>, account_id array<string>, due_us array<long>, due_ms array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("id", F.col("account_id").cast(account).alias("account_id"), instant("due_us").alias("due"), instant("settled_us").alias("settled_at"))


def flips_once(labels: DataFrame, horizon: timedelta, clock: str = "system_from", lateness: timedelta = timedelta(0)) -> DataFrame:
    """id, first_seen and confirmed_at of each id that was recorded legit before it was first recorded fraud, once.

    `labels` has id, is_fraud and the commit time. An id is forgotten when nothing was recorded of it for `horizon`; what comes after
    that starts anew, so `horizon` has to cover the time in which outcomes arrive. Where commits may be out of order
    by `lateness`, a flip waits until no earlier record can come.
    """
    kept = _clocked(labels, clock, lateness).filter(_kept(F.col("is_fraud").isNotNull() & F.col("id").isNotNull(), clock))
    rows = kept.select(_neighbours("id"), F.col("id").alias("one"), "is_fraud", clock, micros(clock).alias("us"))
    key, ordered, keep = dict(kept.dtypes)["id"], lateness == timedelta(0), width_us(horizon)

    def follow(which: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, met, out, watermark = _held(state), set(), [], state.getCurrentWatermarkMs()
        for pdf in () if state.hasTimedOut else batches:
            for one, is_fraud, us in zip(pdf["one"].tolist(), pdf["is_fraud"].tolist(), pdf["us"].tolist()):
                met.add(one)
                now = held.setdefault(one, [NO_TIME, NO_TIME, NO_TIME, False, 0])
                now[2] = max(now[2], us)
                now[is_fraud] = us if now[is_fraud] == NO_TIME else min(now[is_fraud], us)
        for one in [*met, *(one for one, now in held.items() if one not in met and now[-1] < watermark)]:
            legit, fraud, last, told, _ = now = held[one]
            passed = ordered or fraud // 1000 < watermark
            flipped = NO_TIME not in (legit, fraud) and legit < fraud
            if flipped and not told and passed:
                now[3] = told = True
                out.append((one, legit, fraud))
            if one not in met and (last + keep) // 1000 < watermark:
                del held[one]
            else:
                now[-1] = _due_ms(state, fraud if flipped and not told else last + keep)
        _hold(state, held)
        if out:
            yield pd.DataFrame(out, columns=["id", "first_us", "confirmed_us"])

    out = rows.groupBy("id").applyInPandasWithState(
        follow, f"id {key}, first_us long, confirmed_us long",
        f"ids array<{key}>, legit array<long>, fraud array<long>, last array<long>, told array<boolean>, due_ms array<long>", "append",
        GroupStateTimeout.EventTimeTimeout)
    return out.select("id", instant("first_us").alias("first_seen"), instant("confirmed_us").alias("confirmed_at"))
