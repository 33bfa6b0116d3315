from datetime import timedelta

from pyspark.sql import functions as F

from lograft.functions import text
from lograft.operators import sessions, status
from models import NOW, event, frame


def story(spark):
    """Two sessions of device a (the first fails), one of b that shut down; a capture error between."""
    at = lambda s: NOW + timedelta(seconds=s)
    rows = [
        event(1, "a", "session_start", "collection session started (backend=cli)", "a1", at(0)),
        event(2, "a", "log", "INFO reading", "a1", at(1)), event(3, "a", "log", "[00:00:01][I][app:1]: hello", "a1", at(2)),
        event(4, "a", "connected", "device connection established", "a1", at(2)),
        event(5, "b", "session_start", "collection session started (backend=api)", "b1", at(3)),
        event(6, "a", "collector_error", "logs exited with code 1", "a1", at(10)),
        event(7, "a", "disconnected", "exited with code 1 (2 lines this session)", "a1", at(10)),
        event(8, "a", "retry_scheduled", "retry in 2.0s (attempt 1) at 2024-06-01T00:00:12.000000Z", "a1", at(10)),
        event(9, "a", "collector_error", "configuration capture failed: x", "config-capture", at(11)),
        event(10, "a", "session_start", "collection session started (backend=cli)", "a2", at(13)),
        event(11, "b", "log", "Successfully connected to b", "b1", at(14)),
        event(12, "b", "disconnected", "collector shutting down (1 lines this session)", "b1", at(20)),
    ]
    df = frame(spark, rows)
    return text.parse(df, only=df.event_type == "log")


def test_sessions_gaps_and_connections(spark):
    log = story(spark)
    table = {r.session_id: r for r in sessions.derive(log).collect()}
    assert set(table) == {"a1", "a2", "b1"}
    assert (table["a1"].end_reason, table["a1"].line_count) == ("exited with code 1", 2) and table["a2"].ended_at is None
    gap = sessions.gaps(log).collect()
    assert [(r.session_id, r.gap_seconds) for r in gap] == [("a2", 2.0)]  # the capture error counts as an event
    assert {r.session_id: r.id for r in sessions.first_connected(log).collect()} == {"a1": 3, "b1": 11}
    assert {r.session_id: (r.stored_lines, r.said_lines) for r in sessions.disconnect_check(log).collect()}["a1"] == (2, 2)


def test_status_from_events(spark):
    got = {r.device: r for r in status.from_events(story(spark)).collect()}
    a, b = got["a"], got["b"]
    assert (a.state, a.session_id, a.attempts, a.last_error) == ("connecting", "a2", 2, "logs exited with code 1")
    assert (b.state, b.session_id, b.last_error) == ("stopped", None, "collector shutting down")
    before = status.from_events(story(spark).filter("id <= 8")).filter("device = 'a'").first()
    assert (before.state, before.next_retry_at, before.session_id) == ("backoff", "2024-06-01T00:00:12.000000Z", None)


def test_assigned_sessions_keep_the_retry_row(spark):
    got = {r.id: r.session_id for r in sessions.assign_sessions(story(spark)).select("id", "session_id").collect()}
    assert got[8] == "a-1" and got[10] == "a-2" and got[5] == "b-1"


def test_throttled_last_line(spark):
    rows = [event(i, raw="[00:00:00][I][a:1]: x" if i >= 5 else "plain") for i in range(1, 131)]
    df = frame(spark, rows)
    row = sessions.last_lines(text.parse(df)).first()
    assert row.connected_at == NOW + timedelta(seconds=5) and row.last_line_at == NOW + timedelta(seconds=100)
    assert row.exact_last_line_at == NOW + timedelta(seconds=130) and row.lines == 130


def test_failure_excerpt(spark):
    lines = ["INFO Reading", "Failed config", "  wifi: [REDACTED]", *(f"  rendered {i}" for i in range(30)), "  Error reading missing-file.yaml",
             "", *(f"  trailing {i}" for i in range(20))]
    rows = [event(i, raw=l) for i, l in enumerate(lines, 1)] + [event(100, kind="collector_error", raw="exit 2")]
    row = sessions.failure_excerpt(frame(spark, rows)).first()
    numbered = {i: l for i, l in enumerate(lines, 1) if i <= 8 or i > len(lines) - 16 or i in (2, 34)}
    wanted, previous = [], 0
    for i, l in sorted(numbered.items()):
        if not l:
            continue
        if previous and i > previous + 1:
            wanted.append(f"... {i - previous - 1} lines omitted ...")
        wanted.append(l)
        previous = i
    assert row.excerpt == "\n".join(wanted) and "missing-file.yaml" in row.excerpt and "trailing 19" in row.excerpt


def test_backoff(spark):
    rows, start = [], NOW
    for n, seconds in enumerate([0, 0, 0, 0, 0, 31, 1]):
        rows.append(("d", f"s{n}", n, start, start + timedelta(seconds=seconds)))
    df = spark.createDataFrame(rows, "device string, session_id string, first_id long, started_at timestamp_ntz, ended_at timestamp_ntz")
    rule = dict(initial=1, maximum=8, multiplier=2, jitter=0.5, reset_after=30)
    got = sessions.backoff_audit(df, **rule).orderBy("first_id").collect()
    assert [r.base_delay for r in got] == [1, 2, 4, 8, 8, 1, 2] and [r.attempt for r in got] == [1, 2, 3, 4, 5, 1, 2]
    assert (got[1].min_delay, got[1].max_delay) == (1, 3)
    halves = sessions.backoff_audit(
        df.filter("first_id >= 3"), previous=spark.createDataFrame([("d", 3)], "device string, attempt long"), **rule)
    assert [r.attempt for r in halves.orderBy("first_id").collect()] == [4, 5, 1, 2]
    events = frame(spark, [event(1, "d", "retry_scheduled", "retry in 2.4s (attempt 2) at x", "s1"), event(2, "d", "retry_scheduled", "retry in 9.0s (attempt 3) at x", "s2")])
    assert {r.session_id: r.ok for r in sessions.retry_check(events, sessions.backoff_audit(df, **rule)).collect()} == {"s1": True, "s2": False}


def test_crash_and_idle(spark):
    rows = [("d", "s1", 1, NOW, None, None), ("d", "s2", 5, NOW + timedelta(60), NOW + timedelta(61), "bye"), ("d", "s3", 9, NOW + timedelta(70), None, None)]
    df = spark.createDataFrame(rows, "device string, session_id string, first_id long, started_at timestamp_ntz, ended_at timestamp_ntz, end_reason string")
    got = {r.session_id: (r.ended_at, r.end_reason) for r in sessions.close_crashed(df).collect()}
    assert got == {"s1": (NOW + timedelta(60), "collector_crashed_or_killed"), "s2": (NOW + timedelta(61), "bye"), "s3": (None, None)}
    log = frame(spark, [event(1, ts=NOW), event(2, ts=NOW + timedelta(seconds=5)), event(3, ts=NOW + timedelta(seconds=20))])
    assert [(r.id, r.silent_seconds) for r in sessions.idle_breaks(log, 10).collect()] == [(3, 15.0)]
    assert sessions.idle_breaks(log, 0).count() == 0


def test_update_fold_and_attempts(spark):
    columns = "seq long, ts timestamp_ntz, device string, kind string, state string, address string, backend string, source string, error string, session_id string, next_retry_at string, last_line_at string, attempts long"
    u = lambda seq, kind="status", state=None, address=None, error=None, session=None, retry=None, attempts=None: (
        seq, NOW + timedelta(seconds=seq), "d", kind, state, address, None, None, error, session, retry, None, attempts)
    rows = [u(1, state="starting", address="10.0.0.1"), u(2, "attempt", session="s1"), u(3, state="connected", session="s1"),
            u(4, state="backoff", error="boom", retry="later"), u(5, "attempt", session="s2"), u(6, state="connected", session="s2")]
    df = spark.createDataFrame(rows, columns)
    row = status.fold_updates(status.count_attempts(df)).first()
    assert (row.state, row.address, row.attempts, row.last_error, row.next_retry_at, row.session_id) == ("connected", "10.0.0.1", 2, "boom", None, "s2")
    assert row.last_error_at == NOW + timedelta(seconds=4) and row.updated_at == NOW + timedelta(seconds=6)
    import pytest
    with pytest.raises(Exception, match="unknown device"):
        status.count_attempts(df.filter("seq > 1")).collect()
    stopped = status.stop_all(status.fold_updates(df), F.lit("2024-06-02 00:00:00").cast("timestamp_ntz")).first()
    assert (stopped.state, stopped.session_id, stopped.next_retry_at) == ("stopped", None, None)
    assert status.rollup(status.fold_updates(df), frame(spark, [])).first().log_span == "-"


def test_device_selection(spark):
    import pytest
    known = spark.createDataFrame([("ok",), ("bad name",), ("ok",)], "device string")
    assert [r.device for r in status.selected_devices(known).collect()] == ["ok"]
    assert sorted(r.device for r in status.selected_devices(known, ["x", "x", "y"]).collect()) == ["x", "y"]
    with pytest.raises(ValueError):
        status.selected_devices(known, ["../etc/passwd"])
