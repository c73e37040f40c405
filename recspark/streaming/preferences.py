"""Preference state carried across turns in a Structured Streaming job."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recspark.operators.state import DEFAULT_COUNT, DEFAULT_MODE, HARD_GENRES, ID_FIELDS, MAX_COUNT, SCALARS, SOFT_GENRES

OUTPUT = "session_id bigint, turn int, field string, value string"
# since: turn of the last soft replacement; soft: (field, turn, value); fixed: (field, value); scalars: (field, turn, value);
# dated: (turn, year_min, year_max) of every patch with a year; miscounted: some patch asked for too few or too many
STATE = (
    "since int, last int, soft array<struct<field: string, turn: int, value: string>>, "
    "fixed array<struct<field: string, value: string>>, scalars array<struct<field: string, turn: int, value: string>>, "
    "dated array<struct<turn: int, year_min: int, year_max: int>>, miscounted boolean"
)


def _given(values: Iterable) -> list:
    """The values of a column or list, with None for what is missing."""
    return [None if v is None or v != v else v for v in values]


def _text(value) -> str:
    return value if isinstance(value, str) else str(int(value))


def _years_cross(dated: set) -> bool:
    """Does the state after any turn have year_min above year_max."""
    low = high = None
    ordered = sorted(dated, key=lambda d: (d[0], str(d)))
    for n, (turn, new_low, new_high) in enumerate(ordered):
        low, high = (low if new_low is None else new_low), (high if new_high is None else new_high)
        done = n + 1 == len(ordered) or ordered[n + 1][0] > turn
        if done and low is not None and high is not None and low > high:
            return True
    return False


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int | None = None) -> Iterator[pd.DataFrame]:
    """Merge the new patches of one session, whatever their order, and emit the state after them."""
    if state.hasTimedOut:
        state.remove()
        return
    since, last, soft, fixed, scalars, dated, miscounted, newest = -1, -1, set(), set(), {}, set(), False, None
    if state.exists:
        since, last, old_soft, old_fixed, old_scalars, old_dated, miscounted = state.get
        soft, fixed, dated = ({tuple(row) for row in old} for old in (old_soft, old_fixed, old_dated))
        scalars = {f: (t, v) for f, t, v in old_scalars}
    for batch in batches:
        newest = max(newest or 0, int(pd.Timestamp(batch["event_time"].max()).timestamp() * 1000))
        # Sessions are many and small: plain loops, no pandas call for each field of each of them.
        turns = [int(t) for t in batch["turn"].tolist()]
        last = max(last, *turns)
        since = max([since, *(t for t, r in zip(turns, _given(batch["replace_soft"].tolist())) if r)])
        for f in (*ID_FIELDS, *HARD_GENRES):
            fixed.update((f, _text(v)) for own in batch[f].tolist() if own is not None for v in _given(own) if v is not None)
        for f in SOFT_GENRES:
            soft.update((f, t, _text(v)) for t, own in zip(turns, batch[f].tolist()) if own is not None for v in _given(own) if v is not None)
        for f in SCALARS:
            for t, v in zip(turns, _given(batch[f].tolist())):
                if v is not None and t >= scalars.get(f, (-1, ""))[0]:
                    scalars[f] = (t, _text(v))
        years = zip(turns, *([None if v is None else int(v) for v in _given(batch[c].tolist())] for c in ("year_min", "year_max")))
        dated.update(y for y in years if y[1:] != (None, None))
        miscounted = bool(miscounted or any(v is not None and not 1 <= v <= MAX_COUNT for v in _given(batch["requested_count"].tolist())))
    errors = ["a patch leaves year_min above year_max"] if _years_cross(dated) else []
    errors += [f"requested_count must be 1 to {MAX_COUNT}"] if miscounted else []
    soft = {s for s in soft if s[1] >= since}
    state.update((since, last, sorted(soft), sorted(fixed), sorted((f, t, v) for f, (t, v) in scalars.items()),
                  sorted(dated, key=str), miscounted))
    if idle_ms is not None and newest is not None and newest + idle_ms > state.getCurrentWatermarkMs():
        state.setTimeoutTimestamp(newest + idle_ms)
    defaults = {"requested_count": str(DEFAULT_COUNT), "ranking_mode": DEFAULT_MODE}
    rows = set(fixed) | {(f, v) for f, _, v in soft}
    rows |= {(f, scalars[f][1] if f in scalars else defaults[f]) for f in SCALARS if f in scalars or f in defaults}
    rows |= {("error", message) for message in errors}
    out = pd.DataFrame(sorted(rows), columns=["field", "value"])
    out.insert(0, "turn", last)
    out.insert(0, "session_id", key[0])
    yield out


def preference_stream(patches: DataFrame, watermark: str = "1 day", idle_days: float | None = None) -> DataFrame:
    """Streaming patches to the state of each touched session after every micro-batch.

    The result of the last output per session equals the batch fold of all
    accepted rows. Patches may come in any order; rows older than the watermark
    are dropped. Every patch is checked in turn order, as the batch fold does; where that
    raises, a session here gets a row ``(error, message)`` and other sessions go on. A session keeps its state for good, or for ``idle_days`` of event
    time after its last patch if given.
    """
    source = patches.withWatermark("event_time", watermark)
    idle_ms = None if idle_days is None else int(idle_days * 24 * 3600 * 1000)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _advance(key, batches, state, idle_ms)

    return source.groupBy("session_id").applyInPandasWithState(
        advance, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout
    )
