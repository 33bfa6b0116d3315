"""Sessions, gaps, connection and idle analysis, failure excerpts and reconnect audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograft import fixed
from lograft.functions import text, times
from lograft.plans import ordered
from lograft.plans.salted import salted_join
from lograft.session import shared_dir


def is_log() -> Column:
    return F.col("event_type") == "log"


def is_start() -> Column:
    return F.col("event_type") == "session_start"


def assign_sessions(events: DataFrame, order: str = "id") -> DataFrame:
    """Number sessions per device for rows without a session id; 0 is before the first start."""
    starts = ordered.running_count("_starts", is_start())
    numbered = ordered.scan(events, ["device"], order, [starts])
    return numbered.withColumn("session_id", F.concat_ws("-", "device", "_starts")).drop("_starts")


def derive(events: DataFrame) -> DataFrame:
    """The session table: start, end, reason and number of log lines.

    All rows go through a hash aggregate over numbers only; texts, which would force a sort, are
    taken from what is left of them: one row per (session, address), and the disconnect rows.
    """
    kept = events.filter(F.col("session_id") != fixed.CAPTURE_SESSION)
    parts = kept.groupBy("session_id", "device", "address").agg(
        F.min("id").alias("_first"), F.max("id").alias("_last"), F.min("ts").alias("_ts"),
        F.min(F.when(is_start(), F.col("ts"))).alias("_start"),
        F.max(F.when(F.col("event_type") == "disconnected", F.col("ts"))).alias("_end"), F.count_if(is_log()).alias("_lines"),
    )
    table = parts.groupBy("session_id", "device").agg(
        F.max_by("address", "_last").alias("address"), F.min("_first").alias("first_id"),
        F.coalesce(F.min("_start"), F.min("_ts")).alias("started_at"), F.max("_end").alias("ended_at"),
        F.sum("_lines").alias("line_count"),
    )
    byes = kept.filter(F.col("event_type") == "disconnected").groupBy("session_id").agg(F.max_by("message", "id").alias("_bye"))
    return table.join(byes, "session_id", "left").withColumn(
        "end_reason", text.disconnect_fields(F.col("_bye"))["reason"]).drop("_bye")


def line_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.count_if(is_log()).alias("line_count"))


def attempts(events: DataFrame) -> DataFrame:
    return events.groupBy("device").agg(F.count_if(is_start()).alias("attempts"))


def line_numbers(events: DataFrame) -> DataFrame:
    """1-based line number per session, blank lines included."""
    return ordered.ranked(events.filter(is_log()), ["session_id"], "id", "line_no")


def gaps(events: DataFrame) -> DataFrame:
    """At each session start, the silence since the device's last stored event of any kind.

    Sessions of a device follow each other, so a session counts as one point at its first id and
    only sessions, not rows, are ordered. Configuration captures run beside sessions and stay
    single rows.
    """
    beside = F.when(F.col("session_id") == fixed.CAPTURE_SESSION, F.col("id"))
    points = events.groupBy("device", "session_id", beside.alias("_row")).agg(
        F.min("id").alias("first_id"), F.max("ts").alias("_last"),
        F.min(F.when(is_start(), F.col("id"))).alias("id"), F.min(F.when(is_start(), F.col("ts"))).alias("ts"),
    )
    found = ordered.scan(
        points, ["device"], "first_id", [ordered.running_max("previous", F.col("_last"), inclusive=False)]
    ).filter(F.col("id").isNotNull() & F.col("previous").isNotNull())
    return found.select(
        "device", "session_id", "id", "previous", "ts",
        times.exact_seconds(F.col("previous"), F.col("ts")).alias("gap_seconds"),
        text.gap_text(times.format_ts(F.col("previous")), times.format_ts(F.col("ts"))).alias("message"),
    )


def first_connected(events: DataFrame) -> DataFrame:
    """The first log line of a session that proves a connection; at most one per session."""
    proof = is_log() & text.looks_connected(F.col("device_time"), F.col("message"))
    return events.filter(proof).groupBy("session_id", "device").agg(
        F.min("id").alias("id"), F.min_by("ts", "id").alias("connected_at"))


def last_lines(events: DataFrame, stride: int = fixed.LAST_LINE_STRIDE) -> DataFrame:
    """Per session the connect time, the throttled last-line time and the exact one."""
    logs = events.filter(is_log()).select(
        "session_id", "device", "id", "ts",
        text.looks_connected(F.col("device_time"), F.col("message")).alias("_proof"),
    )
    numbered = ordered.scan(logs, ["session_id"], "id", [
        ordered.running_count("n"), ordered.running_count("_proofs", F.col("_proof")),
    ])
    connect = F.col("_proof") & (F.col("_proofs") == 1)
    stored = connect | ((F.col("_proofs") > 0) & (F.col("n") % stride == 0))
    return numbered.groupBy("session_id", "device").agg(
        F.min(F.when(connect, F.col("ts"))).alias("connected_at"),
        F.max_by("ts", F.when(stored, F.col("id"))).alias("last_line_at"),
        F.max_by("ts", "id").alias("exact_last_line_at"),
        F.count("*").alias("lines"),
    )


def close_crashed(sessions: DataFrame) -> DataFrame:
    """End sessions left open although the device started another one later."""
    following = ordered.scan(sessions, ["device"], "first_id", [ordered.next_seen("_next", F.col("started_at"))])
    crashed = F.col("ended_at").isNull() & F.col("_next").isNotNull()
    return following.select(
        *[c for c in sessions.columns if c not in ("ended_at", "end_reason")],
        F.when(crashed, F.col("_next")).otherwise(F.col("ended_at")).alias("ended_at"),
        F.when(crashed, F.coalesce("end_reason", F.lit(fixed.CRASH_REASON))).otherwise(F.col("end_reason")).alias("end_reason"),
    )


def idle_breaks(events: DataFrame, idle_seconds: float) -> DataFrame:
    """Silences longer than the idle limit inside one session; 0 turns the check off."""
    rows = events.select("session_id", "device", "id", "ts")
    if not idle_seconds:
        return rows.filter(F.lit(False)).select(
            "session_id", "device", "id", F.col("ts").alias("silent_since"), F.col("ts").alias("resumed_at"),
            F.lit(0.0).alias("silent_seconds"),
        )
    paired = ordered.scan(rows, ["session_id"], "id", [ordered.last_seen("_previous", F.col("ts"), inclusive=False)])
    silent = times.exact_seconds(F.col("_previous"), F.col("ts"))
    return paired.filter(silent > idle_seconds).select(
        "session_id", "device", "id", F.col("_previous").alias("silent_since"), F.col("ts").alias("resumed_at"),
        silent.alias("silent_seconds"),
    )


def failure_excerpt(events: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """First, last and diagnostic lines of each failed session, gaps between them marked.

    Lines are numbered and chosen without their texts: per line a session, an id and two marks are kept, so its text is searched once. Every
    session keeps at most 8 + 16 + 8 lines; only for these the texts are fetched and grouped by session.
    """
    shared_dir(events.sparkSession)
    if failed is None:
        failed = events.filter(F.col("event_type") == "collector_error")
    logs = events.filter(is_log())
    marks = logs.select("session_id", "id", text.is_diagnostic(F.col("raw")).alias("_diag"), (F.length("raw") > 0).alias("_told"))
    marks = salted_join(marks, failed.select("session_id").distinct(), ["session_id"], "left_semi").checkpoint()
    placed = ordered.scan(marks, ["session_id"], "id", [
        ordered.running_count("n"), ordered.group_count("_all"),
        ordered.running_count("_d", F.col("_diag")), ordered.group_count("_d_all", F.col("_diag")),
    ])
    wanted = (
        (F.col("n") <= fixed.EXCERPT_FIRST) | (F.col("_all") - F.col("n") < fixed.EXCERPT_LAST)
        | (F.col("_diag") & (F.col("_d_all") - F.col("_d") < fixed.EXCERPT_DIAGNOSTIC))
    )
    chosen = placed.filter(wanted & F.col("_told")).select("session_id", "id", "n")
    shown = chosen.join(logs.select("session_id", "id", text.first_chars(F.col("raw")).alias("line")), ["session_id", "id"])
    skipped = F.col("n") - F.lag("n").over(Window.partitionBy("session_id").orderBy("n")) - 1
    piece = F.when(skipped > 0, F.concat(F.format_string("... %d lines omitted ...\n", skipped), F.col("line")))
    pieces = shown.select("session_id", "n", F.coalesce(piece, F.col("line")).alias("piece"))
    return pieces.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("_pieces")
    ).select(
        "session_id", F.size("_pieces").cast("long").alias("shown_lines"),
        F.array_join(F.col("_pieces.piece"), "\n").alias("excerpt"),
    )


def backoff_audit(
    sessions: DataFrame, initial: float = 2.0, maximum: float = 300.0, multiplier: float = 2.0,
    jitter: float = 0.2, reset_after: float = 60.0, previous: DataFrame | None = None,
) -> DataFrame:
    """Expected reconnect delay after each ended session, with its jitter bounds.

    A session of at least ``reset_after`` seconds resets the attempt counter (0 = never).
    ``previous`` (device, attempt) is where the counters stand before these sessions.
    """
    ended = sessions.filter(F.col("ended_at").isNotNull())
    healthy = times.exact_seconds(F.col("started_at"), F.col("ended_at")) >= F.lit(float(reset_after))
    if not reset_after:
        healthy = F.lit(False)
    counted = ordered.ranked(
        ended.select("device", "session_id", "first_id", healthy.alias("_healthy")), ["device"], "first_id", "_k"
    )
    since = ordered.scan(counted, ["device"], "first_id", [ordered.last_seen("_reset", F.when(F.col("_healthy"), F.col("_k")))])
    started = F.lit(1)
    if previous is not None:
        since = since.join(previous.select("device", F.col("attempt").alias("_before")), "device", "left")
        started = 1 - F.coalesce("_before", F.lit(0))
    counted = since.select("device", "session_id", "first_id", (F.col("_k") - F.coalesce("_reset", started) + 1).alias("attempt"))
    return with_delays(counted, initial, maximum, multiplier, jitter)


def with_delays(
    attempts: DataFrame, initial: float = 2.0, maximum: float = 300.0, multiplier: float = 2.0, jitter: float = 0.2,
) -> DataFrame:
    """Sessions numbered by attempt, with the expected delay after each and its jitter bounds."""
    base = F.least(F.lit(float(maximum)), F.lit(float(initial)) * F.pow(F.lit(float(multiplier)), F.col("attempt") - 1))
    floor = F.lit(0.05)
    return attempts.select(
        "device", "session_id", "first_id", "attempt", base.alias("base_delay"),
        F.greatest(floor, base * (1 - jitter)).alias("min_delay"), F.greatest(floor, base * (1 + jitter)).alias("max_delay"),
    )


def retry_check(events: DataFrame, expected: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Compare announced retry delays with the audit (the text keeps one decimal)."""
    said = events.filter(F.col("event_type") == "retry_scheduled").select(
        "session_id", text.retry_fields(F.col("message")).alias("_r")
    ).select("session_id", "_r.*").withColumnRenamed("attempt", "said_attempt")
    within = F.col("delay").between(F.col("min_delay") - tolerance, F.col("max_delay") + tolerance)
    return expected.join(said, "session_id").withColumn("ok", within & (F.col("said_attempt") == F.col("attempt")))


def disconnect_check(events: DataFrame) -> DataFrame:
    """Compare the line count a disconnect message states with the stored lines."""
    said = F.max_by("message", F.when(F.col("event_type") == "disconnected", F.col("id")))
    return events.groupBy("session_id").agg(
        F.count_if(is_log()).alias("stored_lines"), said.alias("_said")
    ).select("session_id", "stored_lines", text.disconnect_fields(F.col("_said"))["lines"].alias("said_lines"))
