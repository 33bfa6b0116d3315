"""Sessions, device status, gaps and reconnect delays kept up to date from a stream of events.

Every fold has its state in Spark's state store. A call of a stateful function costs milliseconds, however little it does, so sessions and devices are
dealt by hash to ``BUCKETS`` groups: a micro-batch makes one call for each bucket it has rows of, not one for each key, and what a bucket keeps is a
list with one entry per session or device. Rows are first reduced inside each task (one row per key and Arrow batch), so a device that sends a third of
all rows shuffles little. What is kept is the same whatever the order in which rows arrive: counts, extremes by id, and the last lines of a session.

Times are timestamps with zone. ``late`` is the watermark in seconds: rows that arrive further behind the newest one may be dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lograft import fixed
from lograft.functions import text, times
from lograft.operators import sessions
from lograft.session import ship
from lograft.streaming import state

LATE = 3600
#: Groups that keys are dealt to; a stream has to go on with the number it was started with.
BUCKETS = 512
#: Stands for a missing whole number, so that columns stay whole numbers in pandas.
NONE = -(1 << 63)

ONCE, STEADY = {"availableNow": True}, {"processingTime": "1 second"}
STEPS = ("session_start", "connected", "disconnected", "retry_scheduled")


def _facts(events: DataFrame) -> DataFrame:
    """What the folds look at, with texts only where one is needed; times in microseconds."""
    kind, message = F.col("event_type"), F.col("message")
    return events.select(
        "id", F.unix_micros("ts").alias("us"), "device", "session_id", "address", kind.alias("kind"),
        (sessions.is_log() & text.looks_connected(F.col("device_time"), message)).alias("proof"),
        F.when(kind == "disconnected", text.disconnect_fields(message)["reason"])
        .when(kind == "retry_scheduled", text.retry_fields(message)["retry_at"])
        .when(kind == "collector_error", message).alias("said"),
    )


def _reduced(rows: DataFrame, reduce, schema: str, late: int) -> DataFrame:
    """Rows reduced per key inside each task; ``at`` is the newest time of a reduced row and carries the watermark."""
    ship(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield reduce(pdf.sort_values("id", kind="stable"))

    parts = rows.mapInPandas(run, f"{schema}, newest long")
    return parts.withColumn("at", F.timestamp_micros("newest")).drop("newest").withWatermark("at", f"{int(late)} seconds")


def _bucketed(rows: DataFrame, key: str, fold, out: str, entry: str, mode: str, timeout: str) -> DataFrame:
    """``fold`` run per bucket of ``key``; the state of a bucket is a list of ``entry``, whose first field is the key."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").applyInPandasWithState(fold, out, f"kept array<struct<{entry}>>", mode, timeout)


def _kept(held: GroupState) -> dict:
    """Entries of a bucket by key, each without its key."""
    return {entry[0]: tuple(entry[1:]) for entry in held.get[0]} if held.exists else {}


def _tuples(pdf: pd.DataFrame, names: list[str]) -> Iterator[tuple]:
    return zip(*(pdf[c].tolist() for c in names))


def _whole(values: pd.Series, index: pd.Index) -> pd.Series:
    return values.reindex(index, fill_value=NONE)


def _later(a: int, b: int) -> int:
    return max(a, b)  # NONE is below everything


def _earlier(a: int, b: int) -> int:
    return b if a == NONE else a if b == NONE else min(a, b)


# --- sessions ---

_SESSION = ("device string, first_us long, start_us long, end_us long, bye_id long, reason string, lines long, "
            "connected_id long, connected_us long, tail_ids array<long>, tail_us array<long>")
_SESSION_OUT = ("session_id string, device string, started_us long, ended_us long, end_reason string, lines long, connected_id long, "
                "connected_us long, last_us long, exact_us long, newly boolean")


def _session_parts(stride: int):
    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        by = pdf.groupby("session_id", sort=False)
        out = by.agg(device=("device", "first"), first_us=("us", "min"), newest=("us", "max"))
        of = lambda rows: rows.groupby("session_id", sort=False)
        logs, byes = pdf[pdf.kind == "log"], pdf[pdf.kind == "disconnected"]
        proofs = of(logs[logs.proof]).head(1).set_index("session_id")
        last_bye = of(byes).tail(1).set_index("session_id")
        out["start_us"] = _whole(of(pdf[pdf.kind == "session_start"]).us.min(), out.index)
        out["end_us"] = _whole(of(byes).us.max(), out.index)
        out["bye_id"] = _whole(last_bye.id, out.index)
        out["reason"] = last_bye.said.reindex(out.index).astype(object)
        out["lines"] = of(logs).size().reindex(out.index, fill_value=0)
        out["connected_id"], out["connected_us"] = _whole(proofs.id, out.index), _whole(proofs.us, out.index)
        tails = of(logs).tail(stride).sort_values("session_id", kind="stable")
        ends = of(tails).size().cumsum()
        spans = dict(zip(ends.index, map(slice, [0, *ends.tolist()], ends.tolist())))
        for name, column in (("tail_ids", "id"), ("tail_us", "us")):
            values = tails[column].tolist()
            out[name] = [values[spans[s]] if s in spans else [] for s in out.index]
        return out.reset_index()[["session_id", *[x.split()[0] for x in _SESSION.split(", ")], "newest"]]

    return reduce


def _merged_session(a: tuple, b: tuple, stride: int) -> tuple:
    (device, first, start, end, bye, reason, lines, cid, cat, ids, us) = a
    (device_b, first_b, start_b, end_b, bye_b, reason_b, lines_b, cid_b, cat_b, ids_b, us_b) = b
    if cid == NONE or NONE < cid_b < cid:
        cid, cat = cid_b, cat_b
    tail = sorted([*zip(ids, us), *zip(ids_b, us_b)])[-stride:]
    return (device or device_b, _earlier(first, first_b), _earlier(start, start_b), _later(end, end_b), max(bye, bye_b),
            reason_b if bye_b > bye else reason, lines + int(lines_b), cid, cat, [int(i) for i, _ in tail], [int(u) for _, u in tail])


def _session_fold(stride: int, late: int):
    unseen = (None, NONE, NONE, NONE, NONE, None, 0, NONE, NONE, [], [])
    names = ["session_id", *[x.split()[0] for x in _SESSION.split(", ")]]

    def shown(session: str, now: tuple, was_connected: int) -> tuple:
        device, first, start, end, _, reason, lines, cid, cat, ids, us = now
        # the newest line whose number is a multiple of the stride counts, if it is not in front of the connecting one
        back, last = lines % stride, cat
        if cid != NONE and len(ids) > back and lines >= stride and ids[-1 - back] >= cid:
            last = us[-1 - back]
        show = lambda x: None if x == NONE else x
        return (session, device, first if start == NONE else start, show(end), reason, lines, show(cid), show(cat), show(last),
                us[-1] if us else None, cid != NONE and was_connected == NONE)

    def fold(_: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        watermark, known, connected = held.getCurrentWatermarkMs(), _kept(held), {}
        if not held.hasTimedOut:
            for pdf in frames:
                for session, device, first, start, end, bye, reason, lines, cid, cat, ids, us in _tuples(pdf, names):
                    part = (device, int(first), int(start), int(end), int(bye), reason, int(lines), int(cid), int(cat), list(ids), list(us))
                    before = known.get(session, (*unseen, NONE))
                    connected.setdefault(session, before[7])
                    known[session] = (*_merged_session(before[:-1], part, stride), before[-1])
        for session in connected:
            *now, until = known[session]
            if now[3] != NONE:  # kept for lines that come late, then forgotten
                until = max(now[3] // 1000 + late * 1000, watermark + 1)
            known[session] = (*now, until)
        left = {s: now for s, now in known.items() if now[-1] == NONE or now[-1] >= watermark}
        if left:
            held.update(([(s, *now) for s, now in left.items()],))
            ended = [now[-1] for now in left.values() if now[-1] != NONE]
            if ended:
                held.setTimeoutTimestamp(min(ended))
        elif held.exists:
            held.remove()
        if connected:
            yield pd.DataFrame([shown(s, known[s][:-1], was) for s, was in connected.items()],
                               columns=[x.split()[0] for x in _SESSION_OUT.split(", ")], dtype=object)

    return fold


def session_updates(events: DataFrame, late: int = LATE, stride: int = fixed.LAST_LINE_STRIDE) -> DataFrame:
    """The session table as a stream of updates: a session's row as of now, each time it changes.

    An ended session stays in the state until the watermark is ``late`` seconds behind its end, so a late line is counted and opens no second session.
    Open sessions stay until they end.
    """
    parts = _reduced(_facts(events), _session_parts(stride), f"session_id string, {_SESSION}", late)
    rows = _bucketed(parts, "session_id", _session_fold(stride, late), _SESSION_OUT, f"session_id string, {_SESSION}, until long", "update",
                     GroupStateTimeout.EventTimeTimeout)
    at = lambda c, name: F.timestamp_micros(c).alias(name)
    return rows.select(
        "session_id", "device", at("started_us", "started_at"), at("ended_us", "ended_at"), "end_reason", "lines", "connected_id",
        at("connected_us", "connected_at"), at("last_us", "last_line_at"), at("exact_us", "exact_last_line_at"), "newly")


def _written(rows: DataFrame, fold, checkpoint: str, once: bool) -> StreamingQuery:
    writer = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(state.each_batch(fold))
    return writer.trigger(**(ONCE if once else STEADY)).start()


def start(events: DataFrame, out: str, checkpoint: str, once: bool = False, late: int = LATE) -> StreamingQuery:
    """Write session rows and ``connected`` events below ``out``; a repeated micro-batch replaces its own files."""
    def write(batch: DataFrame, number: int) -> None:
        connected = batch.filter("newly").select("session_id", "device", F.col("connected_id").alias("id"), "connected_at")
        state.output(connected, f"{out}/connected", number)
        state.output(batch.drop("newly"), f"{out}/sessions", number)

    return _written(session_updates(events, late), write, checkpoint, once)


def latest(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The newest row of every key that a stream of updates has written."""
    rows = spark.read.parquet(folder)
    newest = F.max_by(F.struct(*[c for c in rows.columns if c != "batch"]), "batch").alias("_row")
    return rows.groupBy(key).agg(newest).select("_row.*")


def current(spark: SparkSession, out: str) -> DataFrame:
    """Ended and open sessions as of the last finished micro-batch."""
    return latest(spark, f"{out}/sessions", "session_id")


# --- device status ---

_STATUS = ("address string, seen_id long, line_us long, step_id long, step string, step_session string, step_us long, retry_at string, "
           "error_id long, error_session string, error_us long, error string, bye_id long, bye_session string, bye_us long, reason string, starts long")
_STATUS_NAMES = [x.split()[0] for x in _STATUS.split(", ")]
#: Groups of columns that are replaced together by the row with the greater id, which stands first.
_BY_ID = (("seen_id", "address"), ("step_id", "step", "step_session", "step_us", "retry_at"),
          ("error_id", "error_session", "error_us", "error"), ("bye_id", "bye_session", "bye_us", "reason"))
_STATUS_OUT = ("device string, address string, state string, session_id string, updated_us long, last_error string, error_us long, "
               "attempts long, next_retry_at string, line_us long")


def _status_parts(pdf: pd.DataFrame) -> pd.DataFrame:
    newest = lambda rows: rows.groupby("device", sort=False).tail(1).set_index("device")
    out = pdf.groupby("device", sort=False).agg(newest=("us", "max"))
    last, step = newest(pdf), newest(pdf[pdf.kind.isin(STEPS)])
    error = newest(pdf[(pdf.kind == "collector_error") & (pdf.session_id != fixed.CAPTURE_SESSION)])
    bye = newest(pdf[pdf.kind == "disconnected"])
    words = lambda s: s.reindex(out.index).astype(object)
    out["address"], out["seen_id"] = words(last.address), _whole(last.id, out.index)
    out["line_us"] = _whole(pdf[pdf.kind == "log"].groupby("device", sort=False).us.max(), out.index)
    for name, rows, said in (("step", step, "retry_at"), ("error", error, "error"), ("bye", bye, "reason")):
        out[f"{name}_id"], out[f"{name}_us"] = _whole(rows.id, out.index), _whole(rows.us, out.index)
        out[f"{name}_session"], out[said] = words(rows.session_id), words(rows.said)
    out["step"] = words(step.kind)
    out["starts"] = pdf[pdf.kind == "session_start"].groupby("device", sort=False).size().reindex(out.index, fill_value=0)
    return out.reset_index()[["device", *_STATUS_NAMES, "newest"]]


def _shown_status(device: str, now: dict) -> tuple:
    step, bye, error = now["step"], now["bye_id"], now["error_id"]
    by_reason = bye != NONE and (error == NONE or now["bye_session"] != now["error_session"] and bye > error)
    shown = {"session_start": "connecting", "connected": "connected", None: "starting"}
    condition = "stopped" if step == "disconnected" and now["reason"] == fixed.SHUTDOWN_REASON else shown.get(step, "backoff")
    fault = (now["reason"], now["bye_us"]) if by_reason else (now["error"], now["error_us"])
    show = lambda x: None if x == NONE else x
    return (
        device, now["address"], condition, now["step_session"] if step in ("session_start", "connected") else None, show(now["step_us"]),
        fault[0], show(fault[1]), now["starts"], now["retry_at"] if step == "retry_scheduled" else None, show(now["line_us"]))


def _status_fold(_: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    kinds = dict(x.split() for x in _STATUS.split(", "))
    unseen = {c: NONE if kinds[c] == "long" else None for c in _STATUS_NAMES} | {"starts": 0}
    known, changed = {device: dict(zip(_STATUS_NAMES, entry)) for device, entry in _kept(held).items()}, {}
    for pdf in frames:
        for r in pdf.to_dict("records"):
            now = changed[r["device"]] = known.setdefault(r["device"], dict(unseen))
            for group in _BY_ID:
                if r[group[0]] > now[group[0]]:
                    now |= {c: int(r[c]) if kinds[c] == "long" else r[c] for c in group}
            now["line_us"] = _later(now["line_us"], int(r["line_us"]))
            now["starts"] += int(r["starts"])
    held.update(([(device, *(now[c] for c in _STATUS_NAMES)) for device, now in known.items()],))
    yield pd.DataFrame([_shown_status(device, now) for device, now in changed.items()],
                       columns=[x.split()[0] for x in _STATUS_OUT.split(", ")], dtype=object)


def status_updates(events: DataFrame, late: int = LATE) -> DataFrame:
    """Device status as a stream of updates, with the columns of ``status.from_events`` and the time of the newest line."""
    parts = _reduced(_facts(events), _status_parts, f"device string, {_STATUS}", late)
    rows = _bucketed(parts, "device", _status_fold, _STATUS_OUT, f"device string, {_STATUS}", "update", GroupStateTimeout.NoTimeout)
    at = lambda c, name: F.timestamp_micros(c).alias(name)
    return rows.select(
        "device", "address", "state", "session_id", at("updated_us", "updated_at"), "last_error", at("error_us", "last_error_at"),
        "attempts", "next_retry_at", at("line_us", "newest_line_at"))


def start_status(events: DataFrame, out: str, checkpoint: str, once: bool = False, late: int = LATE) -> StreamingQuery:
    """Write status rows below ``out``; ``latest(spark, out, "device")`` reads the present status."""
    return _written(status_updates(events, late), lambda batch, number: state.output(batch, out, number), checkpoint, once)


# --- gaps ---

_POINT = "point string, first_id long, last_us long, start_id long, start_us long"
_GAP_STATE = "device string, points array<struct<point: string, first_id: long, last_us: long, start_id: long, start_us: long>>, floor_us long"
_GAP_OUT = "device string, session_id string, id long, previous_us long, us long"


def _gap_parts(pdf: pd.DataFrame) -> pd.DataFrame:
    capture = pdf.session_id == fixed.CAPTURE_SESSION
    pdf = pdf.assign(point=pdf.session_id.where(~capture, pdf.session_id + "/" + pdf.id.astype(str)))
    key = ["device", "point"]
    out = pdf.groupby(key, sort=False).agg(first_id=("id", "min"), last_us=("us", "max"))
    starts = pdf[pdf.kind == "session_start"].groupby(key, sort=False).agg(start_id=("id", "min"), start_us=("us", "min"))
    out["start_id"], out["start_us"] = _whole(starts.start_id, out.index), _whole(starts.start_us, out.index)
    out["newest"] = out["last_us"]
    return out.reset_index()


def _settled(device: str, known: dict[str, list], floor: int, watermark: int, out: list[tuple]) -> int:
    """Tell the starts of a device that the watermark has passed, and drop the points in front of the last of them; returns the new floor."""
    told = -NONE - 1
    points = sorted(known.values(), key=lambda p: p[1])
    previous, at, last = floor, 0, None
    for p in points:
        if p[4] in (NONE, told) or p[4] // 1000 >= watermark:
            continue
        # all rows up to this start have arrived: earlier points are settled
        while points[at][1] < p[1]:
            previous, at = max(previous, points[at][2]), at + 1
        if previous != NONE:
            out.append((device, p[0], p[3], previous, p[4]))
        p[4], last = told, p[1]  # the point stays until a later start is settled
    for p in points[:at]:
        if p[1] < last and p[4] in (NONE, told):
            floor = max(floor, known.pop(p[0])[2])
    return floor


def _gap_fold(_: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    known = {device: ({p[0]: list(p) for p in points}, floor) for device, (points, floor) in _kept(held).items()}
    if not held.hasTimedOut:
        for pdf in frames:
            for device, point, first, last, start_id, start in _tuples(pdf, ["device", *[x.split()[0] for x in _POINT.split(", ")]]):
                points, _ = known.setdefault(device, ({}, NONE))
                p = points.setdefault(point, [point, int(first), NONE, NONE, NONE])
                p[1], p[2] = min(p[1], int(first)), max(p[2], int(last))
                if p[3] == NONE or start_id != NONE:
                    p[3], p[4] = _earlier(p[3], int(start_id)), _earlier(p[4], int(start))
    watermark, out = held.getCurrentWatermarkMs(), []
    left = [(device, points, _settled(device, points, floor, watermark, out)) for device, (points, floor) in known.items()]
    held.update(([(device, [tuple(p) for p in points.values()], floor) for device, points, floor in left],))
    waiting = [p[4] // 1000 for _, points, _ in left for p in points.values() if p[4] not in (NONE, -NONE - 1)]
    if waiting:
        held.setTimeoutTimestamp(max(min(waiting), watermark))
    if out:
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _GAP_OUT.split(", ")])


def gap_rows(events: DataFrame, late: int = LATE) -> DataFrame:
    """At each session start, the silence since the device's last event; a timer tells it once the watermark has passed the start.

    Until then rows of earlier sessions may still come. The state of a device is one entry for each session since the last settled start.
    """
    parts = _reduced(_facts(events), _gap_parts, f"device string, {_POINT}", late)
    rows = _bucketed(parts, "device", _gap_fold, _GAP_OUT, _GAP_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    previous, ts = F.timestamp_micros("previous_us"), F.timestamp_micros("us")
    return rows.select(
        "device", "session_id", "id", previous.alias("previous"), ts.alias("ts"), times.exact_seconds(previous, ts).alias("gap_seconds"),
        text.gap_text(times.format_ts(previous), times.format_ts(ts)).alias("message"))


# --- reconnect delays ---

def _attempt_fold(_: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    known = {device: attempt for device, (attempt,) in _kept(held).items()}
    rows = pd.concat(list(frames)).sort_values(["first_id", "session_id"])
    attempts = []
    for device, healthy in zip(rows.device.tolist(), rows.healthy.tolist()):
        known[device] = 1 if healthy else known.get(device, 0) + 1
        attempts.append(known[device])
    held.update((list(known.items()),))
    yield rows.assign(attempt=attempts)[["device", "session_id", "first_id", "attempt"]]


def attempts(ended: DataFrame, reset_after: float = 60.0) -> DataFrame:
    """Ended sessions with the number of the reconnect attempt after each; a session of ``reset_after`` seconds starts anew (0 = never)."""
    ship(ended.sparkSession)
    healthy = times.exact_seconds(F.col("started_at"), F.col("ended_at")) >= F.lit(float(reset_after)) if reset_after else F.lit(False)
    rows = ended.filter(F.col("ended_at").isNotNull()).select("device", "session_id", "first_id", healthy.alias("healthy"))
    return _bucketed(rows, "device", _attempt_fold, "device string, session_id string, first_id long, attempt long", "device string, attempt long",
                     "append", GroupStateTimeout.NoTimeout)


def audit_retries(ended: DataFrame, out: str, checkpoint: str, once: bool = False, **retry) -> StreamingQuery:
    """Expected reconnect delays for a stream of ended sessions; the attempt counter is the state."""
    rule = {k: retry[k] for k in ("initial", "maximum", "multiplier", "jitter") if k in retry}
    rows = sessions.with_delays(attempts(ended, **{k: retry[k] for k in ("reset_after",) if k in retry}), **rule)
    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: state.output(batch, f"{out}/audit", number))
    return writer.trigger(**(ONCE if once else STEADY)).start()
