"""Machines by hand and as DataFrames, in batch and as streams with expiry."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import state
from corpusloom.plans import catalogue
from corpusloom.streaming import state as streamed

SF = "/root/testdata/sf0.001"
S = state.SECOND


def follow(machine, *events):
    at, out = machine.start, []
    for event in events:
        at, answer = machine.step(at, *event)
        out.append(answer)
    return at, out


def test_limiter():
    machine = state.limiter(3, 10)
    now, out = follow(machine, *[(S, "check")] * 4)
    assert [x[:2] for x in out] == [(True, 2), (True, 1), (True, 0), (False, 0)] and out[3][2] == 10.0
    now, back = machine.step(now, S, "forget")
    assert back == (None, 1, None) and machine.step(now, S, "check")[1][:2] == (True, 0)
    assert machine.step(now, 11 * S, "check")[1][:2] == (True, 2)  # the window is over at its very end
    assert follow(machine, (1, "forget"))[1] == [(None, 3, None)]
    assert follow(state.limiter(0, 10), (1, "check"))[1] == [(True, -1, 0.0)]
    with pytest.raises(ValueError):
        machine.step(now, 1, "else")


def test_bucket():
    machine = state.token_bucket(8000)
    now, out = follow(machine, (0, "reserve", "a", 9000.0))
    assert out == [(0.0, 0.0)]  # cut to the capacity
    now, out = machine.step(now, 0, "settle", "a", 6800.0)
    assert out == (400.0, None)
    assert machine.step(now, 0, "settle", "a", 0.0)[1] == (400.0, None)  # a second time changes nothing
    assert machine.step(now, 0, "settle", "nobody", 0.0)[1] == (400.0, None)
    now, out = machine.step(now, 0, "reserve", "b", 520.0)
    assert out == (0.0, 1.0)  # 120 tokens a second
    assert machine.step(now, S, "settle", "b", 9999.0)[1] == (0.0, None)  # charged, but not below empty
    assert machine.step(now, S, "settle", "b", 0.0)[1] == (520.0, None)
    late = machine.step(now, 4000 * S, "settle", "b", 0.0)
    assert late[1] == (7200.0, None) and late[0][2] == ()  # its reservation was forgotten


def test_recent():
    machine = state.recent(2)
    now, out = follow(machine, *[(i, "look", v) for i, v in enumerate("abacb")])
    assert out == [(False, None, 0, 1), (False, None, 0, 2), (True, None, 1, 2), (False, "b", 1, 3), (False, "a", 1, 4)]
    now, out = follow(machine, (0, "put", "a"), (1, "put", "b"), (2, "get", "a"), (3, "put", "c"), (4, "get", "b"), (5, "get", "a"), (6, "put", "a"))
    assert [x[:2] for x in out] == [(None, None), (None, None), (True, None), (None, "b"), (False, None), (True, None), (None, None)] and now[:3] == (("c", "a"), 2, 1)


def test_documents(spark):
    """Equal files have one id; the one that wasn't used for longest goes."""
    rows = [(1, 1, 1, "put", b"one", None), (1, 2, 2, "put", b"two", None), (1, 3, 3, "put", b"one", None), (1, 4, 4, "put", b"three", None)]
    ids = {name: spark.createDataFrame([(name,)], "c binary").select(state.document_id(F.col("c"))).first()[0] for name in (b"one", b"two", b"three")}
    rows += [(1, 5, 5, "get", None, ids[b"two"]), (1, 6, 6, "get", None, ids[b"one"]), (2, 7, 1, "get", None, ids[b"one"])]
    found = {r.event_id: r for r in state.documents(spark.createDataFrame(rows, "user_id long, event_id long, at long, kind string, content binary, document_id string"), 2).collect()}
    assert found[1].document_id == found[3].document_id == ids[b"one"] and found[4].evicted == ids[b"two"]
    assert [found[i].hit for i in (5, 6, 7)] == [False, True, False] and (found[6].hits, found[6].misses) == (1, 1)


def test_odd_events(spark):
    schema = "user_id long, event_id long, at long, kind string, x int"
    assert state.limited(spark.createDataFrame([], schema), 3, 10).collect() == []
    rows = [(None, 1, 5, "check", 0)] * 3 + [(None, 2, 5, "check", 0), (1, 3, 5, "check", 0)]
    found = state.limited(spark.createDataFrame(rows, schema), 3, 10).collect()
    assert sorted((r.event_id, r.allowed) for r in found) == [(1, True)] * 3 + [(2, False), (3, True)]


def stream(spark, tmp_path, rows, build, name):
    """Runs a stream over files of rows, one a micro-batch, and gives what it answered."""
    for i, part in enumerate(rows):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:02d}"))
    source = spark.readStream.schema(rows[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = build(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "kept")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return sorted(tuple(r) for r in spark.table(name).collect()), [p.get("stateOperators", [{}])[0].get("numRowsTotal") for p in (x if isinstance(x, dict) else x.jsonValue if isinstance(x.jsonValue, dict) else __import__("json").loads(x.json) for x in query.recentProgress) if p.get("stateOperators")]


def thirds(events):
    rows = events.orderBy("at", "event_id").collect()
    return [events.sparkSession.createDataFrame(rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3], events.schema) for i in range(3)]


def test_limiter_streams(spark, tmp_path):
    events = catalogue.table(spark, SF, "events").selectExpr("user_id", "event_id", "unix_micros(cast(ts AS timestamp)) AS at", "CASE WHEN event_type = 'error' THEN 'forget' ELSE 'check' END AS kind")
    found, _ = stream(spark, tmp_path, thirds(events), lambda s: streamed.limited(s, 3, 24 * 3600), "limited")
    assert found == sorted(tuple(r) for r in state.limited(events, 3, 24 * 3600).collect())


def test_bucket_streams(spark, tmp_path):
    events = catalogue.table(spark, SF, "events").selectExpr("user_id", "event_id", "unix_micros(cast(ts AS timestamp)) AS at", "CASE WHEN event_id % 3 = 0 THEN 'settle' ELSE 'reserve' END AS kind", "string(event_id div 3) AS request", "double(event_id % 4000) AS amount")
    found, _ = stream(spark, tmp_path, thirds(events), lambda s: streamed.bucket(s, 8000), "bucket")
    assert found == sorted(tuple(r) for r in state.bucket(events, 8000).collect())


def test_states_expire(spark, tmp_path):
    """Keys that event time has passed by are forgotten: the state of a stream is that of its recent keys."""
    hour = 3600 * S
    parts = [spark.createDataFrame([(100 * d + u, 1000 * d + u, (1 + d) * 48 * hour + u, "check") for u in range(20)], "user_id long, event_id long, at long, kind string") for d in range(4)]
    found, kept = stream(spark, tmp_path, parts, lambda s: streamed.limited(s, 3, 3600), "expiring")
    assert len(found) == 80 and all(r[1] for r in found)
    assert kept and max(kept) <= 40 and kept[-1] <= 20
