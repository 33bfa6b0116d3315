import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from lograft.functions import redaction, text
from lograft.operators import search, sessions, snapshots, status
from lograft.sources import lines, store
from lograft.streaming import changes, ingest, lifecycle, tail
from models import NOW, event, frame, ids
from test_sessions import story
from test_snapshots import table


def finish(query):
    assert query.awaitTermination(120)


def files_of(df, folder, cuts):
    """One parquet file per slice of ids, oldest first, so that every slice is its own micro-batch."""
    bounds = [-1, *cuts, 10**9]
    for low, high in zip(bounds, bounds[1:]):
        df.filter((F.col("id") > low) & (F.col("id") <= high)).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return df.schema


def test_tail_resumes_and_readers_are_independent(spark, tmp_path):
    log = text.parse(frame(spark, [event(i, "a" if i % 2 else "b", raw=f"line {i}") for i in range(1, 21)]))
    folder = str(tmp_path / "log")
    schema = files_of(log.filter("id <= 10"), folder, [4])

    def poll(name, **filters):
        rows = tail.new_rows(spark, folder, schema, files_per_poll=1, **filters)
        finish(tail.start(rows, str(tmp_path / name), str(tmp_path / f"{name}-at"), once=True))
        return ids(spark.read.parquet(str(tmp_path / name)))

    assert poll("one", after=tail.cursor(3, "6")) == [7, 8, 9, 10] and poll("two", device="a", q="LINE") == [1, 3, 5, 7, 9]
    log.filter("id > 10").write.mode("append").parquet(folder)
    assert poll("one", after=6) == list(range(7, 21)) and poll("two", device="a", q="LINE") == list(range(1, 20, 2))
    for bad in ("x", "-1"):
        with pytest.raises(ValueError):
            tail.cursor(0, bad)


def test_ingest_keeps_ids_dense_and_secrets_hidden_across_batches(spark, tmp_path):
    folder, target = tmp_path / "in" / "dev-1", str(tmp_path / "log")
    folder.mkdir(parents=True)
    parts = ["[00:00:01][I][a:1]: hello\nkey: |\n  secret-a\n", "  secret-b\r\nshown\n-----BEGIN PRIVATE KEY-----\npem-c\n",
             "pem-d\n-----END PRIVATE KEY-----\nWARNING see ftp://u:pw@h/\n"]

    def run():
        stream = lines.device_sessions_of_files(lines.read_lines(spark, str(tmp_path / "in"), streaming=True, files_per_batch=1))
        finish(ingest.start(stream, target, str(tmp_path / "state"), str(tmp_path / "at"), once=True))

    for n, part in enumerate(parts[:2]):
        (folder / f"s1.{n}.log").write_text(part)
        time.sleep(0.05)
    run()
    (folder / "s1.2.log").write_text(parts[2])
    run()
    log = spark.read.parquet(target).orderBy("id").collect()
    assert [r.id for r in log] == list(range(1, 11)) and {(r.device, r.session_id) for r in log} == {("dev-1", "s1")}
    assert [r.raw for r in log] == ["[00:00:01][I][a:1]: hello", "key: [REDACTED]", "", "", "shown", "[REDACTED]", "", "", "", "WARNING see ftp://[REDACTED]@h/"]
    assert (log[0].level, log[0].component, log[-1].level) == ("INFO", "a", "WARNING")


def test_ingest_hides_the_secrets_of_each_device(spark, tmp_path):
    for device in ("a", "b"):
        (tmp_path / "in" / device).mkdir(parents=True)
        (tmp_path / "in" / device / "s1.0.log").write_text("token-of-a and token-of-b\n")
    secrets = spark.createDataFrame([("a", "token-of-a"), ("b", "token-of-b")], "device string, value string")
    stream = lines.device_sessions_of_files(lines.read_lines(spark, str(tmp_path / "in"), streaming=True, files_per_batch=1))
    finish(ingest.start(stream, str(tmp_path / "log"), str(tmp_path / "state"), str(tmp_path / "at"), once=True, device_secrets=secrets))
    got = {r.device: r.raw for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert got == {"a": "[REDACTED] and token-of-b", "b": "token-of-a and [REDACTED]"}


def test_lifecycle_equals_batch(spark, tmp_path):
    more = [event(100 + i, "a", raw=f"[00:00:00][I][x:1]: {i}", session="a2") for i in range(120)]
    log = story(spark).unionByName(text.parse(frame(spark, more))).withColumn("ts", F.col("ts").cast("timestamp")).cache()
    schema = files_of(log, str(tmp_path / "log"), [3, 7, 9, 150])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    out = str(tmp_path / "out")
    finish(lifecycle.start(stream.filter("session_id <> 'config-capture'"), out, str(tmp_path / "at"), once=True))
    got = {r.session_id: r for r in lifecycle.current(spark, out).collect()}
    assert lifecycle.current(spark, out).count() == len(got)
    for r in sessions.derive(log).collect():
        assert (got[r.session_id].started_at, got[r.session_id].ended_at, got[r.session_id].lines, got[r.session_id].end_reason) == (
            r.started_at, r.ended_at, r.line_count, r.end_reason)
    for r in sessions.last_lines(log).collect():
        assert (got[r.session_id].connected_at, got[r.session_id].last_line_at, got[r.session_id].exact_last_line_at) == (
            r.connected_at, r.last_line_at, r.exact_last_line_at)
    assert ids(spark.read.parquet(f"{out}/connected")) == ids(sessions.first_connected(log))


def arriving(spark, tmp_path, batches):
    """A stream with one micro-batch for each list of events."""
    rows = [text.parse(frame(spark, b)).withColumn("ts", F.col("ts").cast("timestamp")) for b in batches]
    for part in rows:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        time.sleep(0.05)
    whole = spark.read.parquet(str(tmp_path / "log"))
    return whole, spark.readStream.schema(rows[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))


def fleet():
    """Two devices, three sessions, a line that comes after the end of its session, and a quiet hour at the end."""
    at = lambda i, device, session, kind="log", message="line", **kw: event(
        i, device, kind, "[00:00:00][I][x:1]: up" if kw.pop("proof", False) else message, session, message=message, **kw)
    return [
        [at(1, "a", "a1", "session_start", "collection session started (backend=cli)"), at(2, "b", "b1", "session_start", "x", address="10.0.0.1"),
         at(3, "a", "a1", proof=True), at(6, "b", "b1", "collector_error", "no route")],
        [at(8, "a", "a1", "disconnected", "device gone (2 lines this session)"), at(9, "a", "a1", "retry_scheduled", "retry in 2.0s (attempt 1) at soon"),
         at(10, "b", "b1", "disconnected", "collector shutting down (0 lines this session)")],
        [at(4, "a", "a1"), at(7, "a", "a1"), at(20, "a", "a2", "session_start", "x", address="10.0.0.2"), at(21, "a", "a2", "connected", "device connected")],
        [at(900, "a", "a2"), at(901, "b", "b2", "session_start", "x")],
        [at(5000, "a", "a2", proof=True)],
    ]


def test_late_line_of_an_ended_session_and_state_that_is_forgotten(spark, tmp_path):
    whole, stream = arriving(spark, tmp_path, fleet())
    query = lifecycle.start(stream, str(tmp_path / "out"), str(tmp_path / "at"), once=True, late=60)
    finish(query)
    assert len([p for p in query.recentProgress if p.numInputRows]) == 5
    got = {r.session_id: r for r in lifecycle.current(spark, str(tmp_path / "out")).collect()}
    assert lifecycle.current(spark, str(tmp_path / "out")).count() == 4
    for r in sessions.derive(whole).collect():
        assert (got[r.session_id].lines, got[r.session_id].ended_at, got[r.session_id].end_reason) == (r.line_count, r.ended_at, r.end_reason)
    assert got["a1"].lines == 3 and got["a1"].end_reason == "device gone" and got["a2"].connected_id == 5000
    assert query.lastProgress.stateOperators[0].numRowsTotal == 2  # a2 and b2 are open


def test_status_equals_batch(spark, tmp_path):
    whole, stream = arriving(spark, tmp_path, fleet())
    finish(lifecycle.start_status(stream, str(tmp_path / "out"), str(tmp_path / "at"), once=True, late=60))
    got = lifecycle.latest(spark, str(tmp_path / "out"), "device").drop("newest_line_at")
    want = status.from_events(whole)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    # after the second micro-batch b was stopped and a waited for its retry
    second = {r.device: r for r in spark.read.parquet(str(tmp_path / "out")).filter("batch = 1").collect()}
    assert (second["b"].state, second["b"].last_error, second["a"].state, second["a"].next_retry_at) == ("stopped", "no route", "backoff", "soon")


def test_gaps_are_told_by_timers(spark, tmp_path):
    whole, stream = arriving(spark, tmp_path, fleet())
    writer = lifecycle.gap_rows(stream, late=60).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    finish(writer.option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start())
    columns = ("device", "session_id", "id", "previous", "ts", "gap_seconds", "message")
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(sessions.gaps(whole)) and len(rows(sessions.gaps(whole))) == 2


def test_retry_audit_equals_batch(spark, tmp_path):
    rows = [(d, f"{d}{n}", 2 * n + k, NOW + timedelta(seconds=100 * n), NOW + timedelta(seconds=100 * n + (40 if n == 3 else 1)))
            for k, d in enumerate("ab") for n in range(8)]
    df = spark.createDataFrame(rows, "device string, session_id string, first_id long, started_at timestamp_ntz, ended_at timestamp_ntz")
    schema = files_of(df.withColumn("id", F.col("first_id")), str(tmp_path / "in"), [2, 3, 9])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rule = dict(initial=1, maximum=8, reset_after=30)
    finish(lifecycle.audit_retries(stream, str(tmp_path / "out"), str(tmp_path / "at"), once=True, **rule))
    plain = lambda d: sorted((r.session_id, r.attempt, r.base_delay) for r in d.collect())
    assert plain(spark.read.parquet(str(tmp_path / "out" / "audit"))) == plain(sessions.backoff_audit(df, **rule))


def test_snapshot_changes_equal_batch(spark, tmp_path):
    df = table(spark, [(i, "ab"[i % 2], "AABBA"[i % 5]) for i in range(20)] + [(30, "c", "A")])
    schema = files_of(df, str(tmp_path / "in"), [3, 4, 11])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    finish(changes.snapshot_changes(stream, str(tmp_path / "out"), str(tmp_path / "at"), once=True))
    assert ids(spark.read.parquet(str(tmp_path / "out" / "changes"))) == ids(snapshots.changed(df))


def test_idle_sessions_on_a_stream(spark, tmp_path):
    at = [0, 10, 25, 200, 210, 900]
    log = frame(spark, [event(i, ts=NOW + timedelta(seconds=s)) for i, s in enumerate(at)]).withColumn("ts", F.col("ts").cast("timestamp"))
    log.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    writer = changes.idle_sessions(stream, 60).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True)
    finish(writer.start())
    got = sorted((r.silent_since, r.rows) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(NOW + timedelta(seconds=25), 3), (NOW + timedelta(seconds=210), 2)]
    breaks = {r.silent_since for r in sessions.idle_breaks(log, 60).collect()}
    assert {g[0] for g in got} == breaks


def test_stored_log_prunes_days(spark, tmp_path):
    log = text.parse(frame(spark, [event(i, ts=NOW + timedelta(hours=i)) for i in range(72)]))
    store.append(log, str(tmp_path / "log"))
    stored = store.read(spark, str(tmp_path / "log"))
    found = search.page(stored, start="2024-06-02T03:00:00Z", end="2024-06-02T05:00:00Z", level=None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and ids(found) == [27, 28]


def test_many_keys_share_a_bucket_of_state(spark, tmp_path, monkeypatch):
    """Calls and state rows are bounded by the number of buckets, not of sessions or devices."""
    monkeypatch.setattr(lifecycle, "BUCKETS", 3)
    at = lambda i, n, k, kind, message="x": event(i, f"d{n}", kind, f"[00:00:00][I][x:1]: {i}", f"d{n}-{k}", message=message)
    days = [[x for n in range(20) for x in (
        at(1000 * k + 10 * n, n, k, "session_start"), *[at(1000 * k + 10 * n + j, n, k, "log") for j in (1, 2)],
        *([at(1000 * k + 10 * n + 5, n, k, "disconnected", "device gone (2 lines this session)")] if n % 2 else []))] for k in range(4)]
    whole, stream = arriving(spark, tmp_path, days)
    query = lifecycle.start(stream, str(tmp_path / "sessions"), str(tmp_path / "at-1"), once=True, late=60)
    finish(query)
    assert 1 <= query.lastProgress.stateOperators[0].numRowsTotal <= 3
    plain = lambda df, *columns: sorted(map(tuple, df.select(*columns).collect()))
    current = lifecycle.current(spark, str(tmp_path / "sessions")).withColumnRenamed("lines", "line_count")
    columns = ("session_id", "device", "started_at", "ended_at", "line_count")
    assert plain(current.filter("ended_at IS NOT NULL"), *columns) == plain(sessions.derive(whole).filter("ended_at IS NOT NULL"), *columns)
    assert current.count() == 80
    query = lifecycle.start_status(stream, str(tmp_path / "status"), str(tmp_path / "at-2"), once=True, late=60)
    finish(query)
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 3
    want = status.from_events(whole)
    key = lambda row: tuple(map(str, row))
    got = lifecycle.latest(spark, str(tmp_path / "status"), "device").select(*want.columns)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    writer = lifecycle.gap_rows(stream, late=60).writeStream.format("parquet").option("path", str(tmp_path / "gaps"))
    query = writer.option("checkpointLocation", str(tmp_path / "at-3")).trigger(availableNow=True).start()
    finish(query)
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 3
    newest = whole.agg(F.max("ts")).first()[0] - timedelta(seconds=60)
    columns = ("device", "session_id", "id", "previous", "ts", "gap_seconds")
    assert plain(spark.read.parquet(str(tmp_path / "gaps")), *columns) == plain(sessions.gaps(whole).filter(F.col("ts") < F.lit(newest)), *columns)


def test_retry_attempts_share_a_bucket_of_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lifecycle, "BUCKETS", 3)
    rows = [(f"d{n}", f"d{n}-{k}", 100 * k + n, NOW, NOW + timedelta(seconds=40 if (n + k) % 5 == 0 else 1)) for n in range(20) for k in range(6)]
    df = spark.createDataFrame(rows, "device string, session_id string, first_id long, started_at timestamp_ntz, ended_at timestamp_ntz")
    schema = files_of(df.withColumn("id", F.col("first_id")), str(tmp_path / "in"), [150, 320])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = lifecycle.audit_retries(stream, str(tmp_path / "out"), str(tmp_path / "at"), once=True, reset_after=30)
    finish(query)
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 3
    plain = lambda d: sorted((r.session_id, r.attempt) for r in d.collect())
    assert plain(spark.read.parquet(str(tmp_path / "out" / "audit"))) == plain(sessions.backoff_audit(df, reset_after=30))
