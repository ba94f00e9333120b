"""The machines of operators/state.py on streams: a state is columns of its own kind, and goes when event time says that it is no different from none.

Events of a micro-batch are taken in order of time; those behind the watermark are dropped by Spark, as late ones are. An event that comes after a later one of its key, but before the watermark, is taken
when it comes, so batches that follow each other in time give what a batch run gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators import state as batch


def _plain(x: object) -> object:
    """A value as a machine knows it: Python's own, lists as tuples, missing as None."""
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist"):
        x = x.tolist() if hasattr(x, "tolist") else x
        return tuple(map(_plain, x)) if isinstance(x, (list, tuple)) else _plain(x)
    return None if x is None or x is pd.NA or x is pd.NaT or x != x else x


def run(events: DataFrame, machine: batch.Machine, *arguments: str, late: str = "10 minutes") -> DataFrame:
    """As operators.state.run, for a stream of events (user_id, event_id, at, arguments). late: how far behind the latest event others may come."""
    names = [x.split()[0] for x in machine.answers.split(", ")]
    rows_in = events.select("user_id", "event_id", "at", *arguments, F.timestamp_micros(F.col("at")).alias("event_time")).withWatermark("event_time", late)
    key_kind = rows_in.schema["user_id"].dataType.simpleString()

    def step(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = tuple(map(_plain, held.get)) if held.exists else machine.start
        out = []
        rows = pd.concat(list(parts)).sort_values(["at", "event_id"])  # a key's events of one micro-batch
        for event, *given in rows[["event_id", "at", *arguments]].itertuples(index=False, name=None):
            state, answer = machine.step(state, *map(_plain, given))
            out.append((key[0], _plain(event), *answer))
        held.update(tuple(list(x) if isinstance(x, tuple) else x for x in state))
        held.setTimeoutTimestamp(max(machine.until(state) // 1000, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", *names])

    schema = f"user_id {key_kind}, event_id long, {machine.answers}"
    return rows_in.groupBy("user_id").applyInPandasWithState(step, schema, machine.fields, "append", GroupStateTimeout.EventTimeTimeout)


def limited(events: DataFrame, limit: int, window: int) -> DataFrame:
    rows = events if "kind" in events.columns else events.withColumn("kind", F.lit("check"))
    return run(rows, batch.limiter(limit, window), "kind").drop("user_id")


def bucket(events: DataFrame, per_minute: int, share: float = 0.9) -> DataFrame:
    """Of events (user_id, event_id, at, kind, request, amount)."""
    return run(events, batch.token_bucket(per_minute, share), "kind", "request", "amount").drop("user_id")


def documents(events: DataFrame, size: int = 32) -> DataFrame:
    """Of events (user_id, event_id, at, kind, document_id)."""
    return run(events, batch.recent(size), "kind", "document_id").drop("user_id")
