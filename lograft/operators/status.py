"""Device status: roll-up over the log, update fold, status derived from events, device lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograft import fixed
from lograft.functions import text, times
from lograft.operators.sessions import is_log, is_start

STICKY = ("address", "backend", "source", "last_line_at", "attempts")


def log_summary(events: DataFrame) -> DataFrame:
    return events.filter(is_log()).groupBy("device").agg(
        F.count("*").alias("log_count"), F.min("ts").alias("first_log_at"), F.max("ts").alias("last_log_at")
    )


def last_event(events: DataFrame) -> DataFrame:
    return events.groupBy("device").agg(F.max("ts").alias("last_event_at"))


def rollup(status: DataFrame, events: DataFrame) -> DataFrame:
    """Every status row with its log count, first and last log time, span and display error.

    The log is reduced to one row per device before the join.
    """
    joined = status.join(log_summary(events), "device", "left")
    return joined.select(
        *[F.col(c) for c in status.columns], F.coalesce("log_count", F.lit(0)).alias("log_count"),
        "first_log_at", "last_log_at",
        times.log_span(F.col("first_log_at"), F.col("last_log_at")).alias("log_span"),
        display_error(F.col("state"), F.col("last_error")).alias("shown_error"),
    )


def display_error(state: Column, last_error: Column) -> Column:
    return F.when(state == "connected", F.lit("none")).otherwise(F.coalesce(F.nullif(last_error, F.lit("")), F.lit("none")))


def fold_updates(updates: DataFrame) -> DataFrame:
    """Apply a log of partial updates, in ``seq`` order, to one row per device.

    State, session, retry time and update time always take the latest update, also when it is null.
    The rest only changes when an update gives a value.
    """
    latest = F.max_by(F.struct("state", "session_id", "next_retry_at", F.col("ts").alias("updated_at")), "seq")
    sticky = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in STICKY]
    fault = F.max_by(F.struct(F.col("error"), "ts"), F.when(F.col("error").isNotNull(), F.col("seq")))
    folded = updates.groupBy("device").agg(latest.alias("_l"), fault.alias("_f"), *sticky)
    return folded.select(
        "device", "address", "backend", "source", F.col("_l.state").alias("state"),
        F.col("_l.session_id").alias("session_id"), F.col("_l.updated_at").alias("updated_at"), "last_line_at",
        F.col("_f.error").alias("last_error"), F.col("_f.ts").alias("last_error_at"),
        F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"), F.col("_l.next_retry_at").alias("next_retry_at"),
    )


def count_attempts(updates: DataFrame) -> DataFrame:
    """Turn attempt-start rows (``kind`` = attempt) into plain updates carrying the attempt number.

    The number is one more than before; a row that sets attempts restarts the count there. An
    attempt of a device without an earlier row is an error.
    """
    from lograft.plans import ordered

    is_attempt = F.col("kind") == "attempt"
    numbered = ordered.scan(updates, ["device"], "seq", [
        ordered.running_count("_n", is_attempt), ordered.running_count("_rows", inclusive=False),
    ])
    based = ordered.scan(numbered, ["device"], "seq", [
        ordered.last_seen("_set", F.when(F.col("attempts").isNotNull(), F.struct("attempts", "_n"))),
    ])
    count = F.col("_n") - F.coalesce("_set._n", F.lit(0)) + F.coalesce("_set.attempts", F.lit(0))
    unknown = F.raise_error(F.format_string("connection attempt for unknown device %s", F.col("device"))).cast("long")
    return based.select(
        *[F.col(c) for c in updates.columns if c not in ("attempts", "state", "next_retry_at")],
        F.when(is_attempt, F.lit("connecting")).otherwise(F.col("state")).alias("state"),
        F.when(~is_attempt, F.col("next_retry_at")).alias("next_retry_at"),
        F.when(is_attempt & (F.col("_rows") == 0), unknown).when(is_attempt, count).otherwise(F.col("attempts")).alias("attempts"),
    )


def stop_all(status: DataFrame, now: Column) -> DataFrame:
    changed = {
        "state": F.lit("stopped"), "session_id": F.lit(None), "next_retry_at": F.lit(None), "updated_at": now,
    }
    kinds = {f.name: f.dataType for f in status.schema}
    return status.select(*[changed[c].cast(kinds[c]).alias(c) if c in changed else F.col(c) for c in status.columns])


def from_events(events: DataFrame) -> DataFrame:
    """Status of every device as its events tell it.

    Only collector events carry texts that matter, and they are few; log lines just prove that the
    device exists and where, for which a hash aggregate per (device, address) is enough.
    """
    kind = F.col("event_type")
    places = events.groupBy("device", "address").agg(F.max("id").alias("_last")).groupBy("device").agg(
        F.max_by("address", "_last").alias("address"))
    steps = kind.isin("session_start", "connected", "disconnected", "retry_scheduled")
    seen = F.struct("id", "event_type", "session_id", "ts", "message")
    latest = lambda cond: F.max_by(seen, F.when(cond, F.col("id")))
    own_error = (kind == "collector_error") & (F.col("session_id") != fixed.CAPTURE_SESSION)
    told = events.filter(~is_log()).groupBy("device").agg(
        latest(steps).alias("_step"), latest(own_error).alias("_error"), latest(kind == "disconnected").alias("_bye"),
        F.count_if(is_start()).alias("_starts"),
    )
    per_device = places.join(told, "device", "left").withColumn("attempts", F.coalesce("_starts", F.lit(0)))
    step = F.col("_step.event_type")
    reason = text.disconnect_fields(F.col("_bye.message"))["reason"]
    by_reason = F.col("_bye.id").isNotNull() & (
        F.col("_error.id").isNull()
        | ((F.col("_bye.session_id") != F.col("_error.session_id")) & (F.col("_bye.id") > F.col("_error.id")))
    )
    stopped = (step == "disconnected") & (reason == fixed.SHUTDOWN_REASON)
    live = step.isin("session_start", "connected")
    return per_device.select(
        "device", "address",
        F.when(step == "session_start", "connecting").when(step == "connected", "connected").when(stopped, "stopped")
        .when(step.isNull(), "starting").otherwise("backoff").alias("state"),
        F.when(live, F.col("_step.session_id")).alias("session_id"), F.col("_step.ts").alias("updated_at"),
        F.when(by_reason, reason).otherwise(F.col("_error.message")).alias("last_error"),
        F.when(by_reason, F.col("_bye.ts")).otherwise(F.col("_error.ts")).alias("last_error_at"),
        "attempts",
        F.when(step == "retry_scheduled", text.retry_fields(F.col("_step.message"))["retry_at"]).alias("next_retry_at"),
    )


def known_devices(events: DataFrame, status: DataFrame) -> DataFrame:
    return events.select("device").distinct().unionByName(status.select("device")).distinct()


def selected_devices(known: DataFrame, requested: Sequence[str] | None = None) -> DataFrame:
    """Requested names (unknown ones included) or all known ones that are valid names."""
    if requested:
        for name in requested:
            check_device_name(name)
        spark = known.sparkSession
        known = spark.createDataFrame([(n,) for n in dict.fromkeys(requested)], "device string")
    return known.filter(text.valid_device_name(F.col("device"))).distinct()


def check_device_name(name: str) -> str:
    import re

    if not re.match(fixed.DEVICE_NAME, name):
        raise ValueError(f"invalid device name {name!r}")
    return name
