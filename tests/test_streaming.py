import datetime as dt
import json
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docketry.operators import metering as M
from docketry.operators import schedule as H
from docketry.sources import request_log as Q
from docketry.streaming import limiter as S
from docketry.streaming import traffic as V

T0 = dt.datetime(2026, 3, 1, 10, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def drain(stream, name, tmp_path, mode="append"):
    """Run a stream over what is there now and return its rows."""
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"state-{name}")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.table(name)


def as_stream(spark, rows, schema, tmp_path, name, parts=1):
    folder = tmp_path / name
    frame = spark.createDataFrame(rows, schema)
    for i in range(parts):
        frame.filter(F.pmod(F.lit(0) + F.col(frame.columns[-1]), F.lit(parts)) == i).drop(frame.columns[-1]).coalesce(1).write.mode(
            "append").parquet(str(folder))
    out = frame.drop(frame.columns[-1])
    return out, spark.readStream.schema(out.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_third_request_denied_until_the_window_has_passed(spark, tmp_path):
    rows = [("a", i, at(s), 0) for i, s in enumerate([0, 10, 20, 59, 60, 61])]
    batch, stream = as_stream(spark, rows, "client STRING, id BIGINT, ts TIMESTAMP, part INT", tmp_path, "limits")
    expected = [(0, True, 0), (1, True, 0), (2, False, 40_000), (3, False, 1_000), (4, True, 0), (5, True, 0)]
    got = M.rate_limit(batch, 2, 60_000).orderBy("id").collect()
    assert [(r.id, r.allowed, r.retry_after_ms) for r in got] == expected
    live = drain(S.rate_limit_stream(stream, 2, 60_000), "limits", tmp_path).orderBy("id").collect()
    assert [(r.id, r.allowed, r.retry_after_ms) for r in live] == expected


def brute_force_limiter(rows, limit, window):
    state, out = {}, {}
    for client, key, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        t = int(ts.timestamp() * 1000)
        start, used = state.get(client, (None, 0))
        if start is None or t >= start + window:
            state[client], out[key] = (t, 1), 0
        elif used < limit:
            state[client], out[key] = (start, used + 1), 0
        else:
            out[key] = max(1, start + window - t)
    return out


@pytest.mark.parametrize("gap", [7, 61])
def test_limiter_equals_brute_force_with_one_hot_client(spark, gap):
    rows = [("hot" if i % 3 == 0 else f"c{i % 5}", i, at((i * i * gap) % 5003)) for i in range(600)]
    frame = spark.createDataFrame(rows, "client STRING, id BIGINT, ts TIMESTAMP")
    got = {r.id: r.retry_after_ms for r in M.rate_limit(frame, 2, 60_000).collect()}
    assert got == brute_force_limiter(rows, 2, 60_000)


def test_slot_guard_stream_equals_batch(spark, tmp_path):
    day = dt.date(2026, 3, 5)
    rows = [(f"h{i}", i, f"case{i}", f"j{i % 3}", day, f"{10 + i % 4}:00", 0) for i in range(40)]
    schema = "id STRING, seq BIGINT, case_id STRING, judge_id STRING, hearing_date DATE, slot STRING, part INT"
    batch, stream = as_stream(spark, rows, schema, tmp_path, "bookings")
    live = drain(S.schedule_stream(stream), "bookings", tmp_path)
    want = {(r.id, r.accepted, r.incumbent_case) for r in H.schedule(batch).collect()}
    assert {(r.id, r.accepted, r.incumbent_case) for r in live.collect()} == want
    assert sum(1 for r in want if r[1]) == 12


def test_metrics_stream_equals_batch(spark, tmp_path):
    lines = [
        json.dumps({"ts": at(i * 7).isoformat(), "requestId": f"r{i}", "method": "GET", "path": f"/api/cases/{i}",
                    "status": 200 if i % 5 else 404, "durationMs": float(i), "client": "c"})
        for i in range(60)
    ] + ["not json"]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n".join(lines))
    stream = V.metrics_stream(Q.read_request_log(spark, str(tmp_path / "log"), stream=True), "1 minute")
    live = drain(stream, "metrics", tmp_path, "complete")
    log = Q.read_request_log(spark, str(tmp_path / "log"))
    assert log.count() == 60
    want = {
        (r.window_start, r.status_class, r.requests, r.max_ms)
        for r in V.metrics_stream(log, "1 minute").collect()
    }
    assert {(r.window_start, r.status_class, r.requests, r.max_ms) for r in live.collect()} == want
    assert {r.path_key for r in live.collect()} == {"/api/cases/:id"}


def test_sliding_and_session_windows(spark):
    rows = [(at(s), "GET", "/x", 200, 1.0) for s in (0, 10, 100)]
    log = spark.createDataFrame(rows, "ts TIMESTAMP, method STRING, path STRING, status INT, duration_ms DOUBLE")
    assert V.metrics_stream(log, session_gap="30 seconds").count() == 2
    assert V.metrics_stream(log, "1 minute", "30 seconds").agg(F.sum("requests")).first()[0] == 6


def test_activity_stream_drops_repeats_and_fills_titles(spark, tmp_path):
    records = [
        {"id": "1", "kind": "search", "ts": at(0).isoformat(), "payload": {"query": "land", "results": "5x"}},
        {"id": "1", "kind": "search", "ts": at(1).isoformat(), "payload": {"query": "land", "results": "5"}},
        {"id": "2", "kind": "upload", "ts": at(2).isoformat(), "payload": {"filename": ""}},
        {"id": "3", "kind": "view", "ts": at(3).isoformat(), "payload": {"caseTitle": "A v B"}},
        {"id": "4", "kind": "other", "ts": at(3).isoformat(), "payload": {}},
    ]
    (tmp_path / "activity").mkdir()
    (tmp_path / "activity" / "a.json").write_text("\n".join(json.dumps(r) for r in records))
    stream = V.activity_stream(Q.read_activity(spark, str(tmp_path / "activity"), stream=True))
    got = sorted((r.id, r.type, r.title, r.results) for r in drain(stream, "activity", tmp_path).collect())
    assert got == [("1", "search", "land", 5), ("2", "upload", "Uploaded Document", 0), ("3", "view", "A v B", None)]


def test_audit_sink_keeps_the_newest(spark, tmp_path):
    rows = [(f"a{i:03d}", at(i), i % 3) for i in range(30)]
    _, stream = as_stream(spark, rows, "id STRING, ts TIMESTAMP, part INT", tmp_path, "audit", parts=3)
    target = str(tmp_path / "tail")
    query = (
        stream.writeStream.foreachBatch(V.audit_sink(target, 7)).trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "audit-state")).start()
    )
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    kept = sorted(r.id for r in spark.read.parquet(f"{target}/version={last}").collect())
    assert kept == [f"a{i:03d}" for i in range(23, 30)]


def state_rows(stream, name, tmp_path):
    """Rows left in the state after everything was read."""
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / f"state-{name}")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]


def test_clients_leave_the_state_by_event_time(spark, tmp_path):
    rows = [(f"c{i % 4}", i, at(i * 10), 0) for i in range(40)] + [("late", 99, at(100_000), 0)]
    batch, stream = as_stream(spark, rows, "client STRING, id BIGINT, ts TIMESTAMP, part INT", tmp_path, "expiring")
    left = state_rows(S.rate_limit_stream_expiring(stream, 2, 60_000, "1 minute"), "expiring", tmp_path)
    got = {(r.id, r.allowed, r.retry_after_ms) for r in spark.table("expiring").collect()}
    assert got == {(r.id, r.allowed, r.retry_after_ms) for r in M.rate_limit(batch, 2, 60_000).collect()}
    # The watermark has passed the windows of all but the last client.
    full = state_rows(S.rate_limit_stream(stream, 2, 60_000), "lasting", tmp_path)
    assert full == 5 and left < full


def test_slots_leave_the_state_after_their_day(spark, tmp_path):
    days = [dt.date(2026, 3, 5), dt.date(2026, 4, 5)]
    rows = [(f"h{i}", i, f"case{i}", f"j{i % 3}", days[i % 2], f"{10 + i % 4}:00", at(86_400 * 20 * (i % 2) + i), 0) for i in range(40)]
    schema = "id STRING, seq BIGINT, case_id STRING, judge_id STRING, hearing_date DATE, slot STRING, ts TIMESTAMP, part INT"
    batch, stream = as_stream(spark, rows, schema, tmp_path, "asked")
    left = state_rows(S.schedule_stream_expiring(stream), "asked", tmp_path)
    got = {(r.id, r.accepted, r.incumbent_case) for r in spark.table("asked").collect()}
    assert got == {(r.id, r.accepted, r.incumbent_case) for r in H.schedule(batch).collect()}
    full = state_rows(S.schedule_stream(stream.drop("ts")), "kept", tmp_path)
    assert full == 12 and left < 2 * full


def test_slots_of_a_day_share_one_state_value(spark, tmp_path):
    """A day's slots are held together over batches: one state row and one timer for any number of slots."""
    day = dt.date(2026, 3, 5)
    rows = [(f"h{i:02}", i, f"case{i}", "j", day, f"{i % 15}:00", at(i), i // 25) for i in range(50)]
    schema = "id STRING, seq BIGINT, case_id STRING, judge_id STRING, hearing_date DATE, slot STRING, ts TIMESTAMP, part INT"
    batch, stream = as_stream(spark, rows, schema, tmp_path, "shared_day")
    left = state_rows(S.schedule_stream_expiring(stream), "shared_day", tmp_path)
    got = {(r.id, r.accepted, r.incumbent_case) for r in spark.table("shared_day").collect()}
    assert got == {(r.id, r.accepted, r.incumbent_case) for r in H.schedule(batch).collect()}
    assert sum(1 for r in got if r[1]) == 15 and left < 15


def test_judges_of_a_group_are_guarded_in_one_call():
    """A call holds the day of many judges, with one state value and one timer, and equals a loop over their rows."""
    state, timers = [], []
    holders = SimpleNamespace(get=lambda: state[-1] if state else None, update=state.append, exists=lambda: bool(state))
    guard = S.ExpiringGuard(7)
    guard.init(SimpleNamespace(getValueState=lambda *_: holders, registerTimer=timers.append))
    day, held = dt.date(2026, 3, 5), {}
    for part in range(2):
        frame = pd.DataFrame([
            (f"j{i % 4}" if i % 7 else None, day, f"{i % 3}:00", f"h{i % 50}", f"case{i}", 99 - i) for i in range(part * 40, part * 40 + 60)],
            columns=["judge_id", "hearing_date", "slot", "id", "case_id", "seq"])
        want = []
        for r in frame.sort_values(["seq", "id"]).itertuples():
            holder = held.setdefault((r.judge_id, r.slot), (r.id, r.case_id))
            want.append((r.judge_id, day, r.slot, r.id, r.case_id, holder[0] == r.id, None if holder[0] == r.id else holder[1]))
        got = pd.concat(list(guard.handleInputRows((day, 0), iter([frame[:25], frame[25:]]), None)))
        assert [tuple(r) for r in got.itertuples(index=False)] == want
    assert len(timers) == 1 and len(state) == 1 and set(zip(*state[0][:2])) == set(held)
    # A batch without a new slot leaves the state as it is.
    list(guard.handleInputRows((day, 0), iter([frame]), None))
    assert len(state) == 1


def test_late_rows_are_counted_once(spark, tmp_path):
    out = str(tmp_path / "late")
    write = V.late_sink(out, "1 minute", "1 minute")
    frame = lambda seconds: spark.createDataFrame([(at(s),) for s in seconds], "ts TIMESTAMP")
    write(frame([0, 300]), 0)
    for _ in range(2):
        write(frame([10, 20, 239, 241, 400]), 1)
    write(frame([350, 5]), 2)
    got = {(r.window_start, r.late) for r in spark.read.parquet(f"{out}/late").select("window_start", "late").collect()}
    assert got == {(at(0), 2), (at(180), 1), (at(0), 1)}
