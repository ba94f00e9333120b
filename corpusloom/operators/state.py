"""Machines over the ordered events of a key: a sliding-window limiter, a token bucket, a least-recently-used store.

A machine is a start and a step, a function without side effects from (state, event) to (state, answer), where states are tuples of plain values.
In batch a key's sorted rows stream through one task and only its state is held: each answer depends on the ones before, so a key isn't split; keys run side by side. The same machines run on streams
(streaming/state.py), where `fields` names the columns that keep a state and `until` says when it is no different from none.

Cases: null keys are one key; events of one time are taken by event_id, rows that repeat are events of their own. An event behind its key's clock is taken at the clock. Unknown kinds
are an error. An empty table gives an empty result. Other columns than the named ones are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000


class Machine(NamedTuple):
    """start; step(state, *event) gives (state, answer). answers, fields: DDL of an answer and of a state. until: microseconds from which a state may be forgotten."""

    start: tuple
    step: Callable[..., tuple[tuple, tuple]]
    answers: str
    fields: str
    until: Callable[[tuple], int]


def _unknown(kind: str) -> None:
    raise ValueError(f"unknown kind of event: {kind!r}")


def limiter(limit: int, window: int) -> Machine:
    """At most limit checks in any window of so many seconds; refused ones don't count, forget takes the last one back. A limit of 0 or less allows all.

    State: the times that count, rising. Answers: allowed, remaining (-1: no limit), retry_after in seconds; allowed is null for forget.
    """
    span = window * SECOND

    def step(state: tuple, at: int, kind: str) -> tuple[tuple, tuple]:
        times = tuple(t for t in state[0] if t > at - span)
        if kind == "forget":
            kept = state[0][:-1]
            return (kept,), (None, limit - len(kept) if limit > 0 else -1, None)
        if kind != "check":
            _unknown(kind)
        if limit <= 0:
            return state, (True, -1, 0.0)
        if len(times) >= limit:
            return (times,), (False, 0, (times[0] + span - at) / 1e6)
        return ((*times, at),), (True, limit - len(times) - 1, 0.0)

    return Machine(((),), step, "allowed boolean, remaining long, retry_after double", "times array<long>", lambda s: s[0][-1] + span if s[0] else 0)


def token_bucket(per_minute: int, share: float = 0.9, patience: int = 3600) -> Machine:
    """Tokens that come back over time: share of per_minute is the capacity, which a minute fills.

    reserve (request, amount): a wish, cut to the capacity, waits until it is met; what follows counts from then. settle (request, amount): what the
    request took in the end; the rest of its reservation comes back, more is charged, within an empty and a full bucket. A request that is settled twice, or that nobody
    reserved, changes nothing, nor does one after patience seconds, when its reservation is forgotten.

    State: tokens left, at what time (none yet: null), and the open requests: names, reservations, since when. Answers: available after the event, seconds waited (null for settle).
    """
    most = max(1.0, per_minute * share)

    def step(state: tuple, at: int, kind: str, request: str | None, amount: float) -> tuple[tuple, tuple]:
        level, clock, *listed = state
        now = at if clock is None else max(at, clock)
        if clock is not None:
            level = min(most, level + (now - clock) / 60e6 * most)
        held = [x for x in zip(*listed, strict=True) if x[2] > now - patience * SECOND]
        if kind == "reserve":
            wish = min(float(amount), most)
            short = max(0.0, wish - level)
            now, level = now + short / most * 60e6, max(level, wish) - wish
            held = [*held, (request, wish, int(now))] if request is not None else held
            waited = round((now - at) / 1e6, 4)
        elif kind == "settle":
            back = next((r for name, r, _ in held if name == request), None)
            if back is not None:
                level = max(0.0, min(most, level + back - amount))
                held = [x for x in held if x[0] != request]
            waited = None
        else:
            _unknown(kind)
        names, wishes, since = zip(*held, strict=True) if held else ((), (), ())
        return (level, now, names, wishes, since), (round(level, 4), waited)

    start = (most, None, (), (), ())
    return Machine(start, step, "available double, waited double", "level double, clock double, requests array<string>, reserved array<double>, since array<long>", lambda s: int(max([s[1] or 0, *s[4]])) + max(60, patience if s[4] else 0) * SECOND)


def recent(size: int, keep: int = 86_400) -> Machine:
    """The values that were used last, size at most. get: whether a value is there, which keeps it; put: it is there now, and what it pushed out; look: get, and put where it wasn't.

    State: values, least recent first; hits; misses; when. Answers: hit (null for put), evicted, hits, misses. A stream forgets the store of a key after keep seconds without an event.
    """

    def step(state: tuple, at: int, kind: str, value: str) -> tuple[tuple, tuple]:
        values, hits, misses, clock = state
        if kind not in ("get", "put", "look"):
            _unknown(kind)
        there = value in values
        if kind != "put":
            hits, misses = hits + there, misses + (not there)
        out = None
        if there or kind != "get":
            values = (*(v for v in values if v != value), value)
            if len(values) > size:
                out, *values = values
        return (tuple(values), hits, misses, max(at, clock)), (None if kind == "put" else there, out, hits, misses)

    return Machine(((), 0, 0, 0), step, "hit boolean, evicted string, hits long, misses long", "kept array<string>, hits long, misses long, clock long", lambda s: s[3] + keep * SECOND)


_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}


def run(events: DataFrame, machine: Machine, *arguments: str) -> DataFrame:
    """user_id, event_id and the answers of a machine to events (user_id, event_id, at in microseconds, the columns named in arguments)."""
    names, kinds = zip(*(x.split() for x in machine.answers.split(", ")), strict=True)
    rows_in = events.select("user_id", "event_id", "at", *arguments)
    key = rows_in.schema["user_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), machine.start
        for batch in batches:
            out = []
            for user, _, *event in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if user != last:
                    last, state = user, machine.start
                state, answer = machine.step(state, *event)
                out.append(answer)
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], *(pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds, strict=True))], ["user_id", "event_id", *names])

    dealt = rows_in.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")
    return dealt.mapInArrow(rows, f"user_id {key}, event_id long, {machine.answers}")


def limited(events: DataFrame, limit: int, window: int) -> DataFrame:
    """event_id, allowed, remaining (-1: no limit), retry_after (seconds) of events (user_id, event_id, at, and kind, if it isn't always check)."""
    rows = events if "kind" in events.columns else events.withColumn("kind", F.lit("check"))
    return run(rows, limiter(limit, window), "kind").drop("user_id")


def bucket(events: DataFrame, per_minute: int, share: float = 0.9) -> DataFrame:
    """event_id, available after it and seconds waited of events: (user_id, event_id, at, want), or with kind, request and amount."""
    rows = events
    if "kind" not in events.columns:
        rows = events.withColumns({"kind": F.lit("reserve"), "request": F.lit(None).cast("string"), "amount": F.col("want").cast("double")})
    return run(rows, token_bucket(per_minute, share), "kind", "request", "amount").drop("user_id")


def cached(events: DataFrame, size: int) -> DataFrame:
    """event_id, hit of looks at values, events (user_id, event_id, at, v)."""
    rows = events.select("user_id", "event_id", "at", F.lit("look").alias("kind"), F.col("v").cast("string").alias("v"))
    return run(rows, recent(size), "kind", "v").select("event_id", "hit")


def document_id(content):
    """What a file is kept under: the same for equal files."""
    return F.substring(F.sha2(content, 256), 1, 16)


def documents(events: DataFrame, size: int = 32) -> DataFrame:
    """event_id, document_id, hit, evicted, hits, misses of a store's uploads (kind put, with content) and reads (kind get, with document_id), events (user_id, event_id, at, kind, content, document_id)."""
    rows = events.withColumn("document_id", F.when(F.col("kind") == "put", document_id(F.col("content"))).otherwise(F.col("document_id")))
    ids = rows.select("event_id", "document_id")
    return run(rows, recent(size), "kind", "document_id").drop("user_id").join(ids, "event_id")
