"""Row predicates of search, tail and export."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lograft import fixed
from lograft.functions import text, times


def _all(conditions: Sequence[Column]) -> Column:
    result = F.lit(True)
    for condition in conditions:
        result = result & condition
    return result


def time_range(events: DataFrame, start: str | datetime | None, end: str | datetime | None, ts: str = "ts") -> list[Column]:
    """``start <= ts < end``; a date-partitioned table also gets the matching partition predicate."""
    kind = events.schema[ts].dataType
    dated = "event_date" in events.columns
    found = []
    if start:
        low = times.instant(start, kind)
        found.append(F.col(ts) >= low)
        if dated:
            found.append(F.col("event_date") >= low.cast("date"))
    if end:
        high = times.instant(end, kind)
        found.append(F.col(ts) < high)
        if dated:
            found.append(F.col("event_date") <= high.cast("date"))
    return found


def levels_from(minimum: str) -> tuple[str, ...]:
    if minimum not in fixed.LEVELS:
        raise ValueError(f"unknown level {minimum!r}")
    return fixed.LEVELS[fixed.LEVELS.index(minimum):]


def log_filter(
    events: DataFrame, *, device: str | None = None, start: str | datetime | None = None,
    end: str | datetime | None = None, level: str | None = None, event_type: str | None = None,
    q: str | None = None, after: int | None = None,
) -> Column:
    """The conjunction of all given filters; arguments are checked before anything is read."""
    conditions = []
    if device:
        conditions.append(F.col("device") == device)
    conditions += time_range(events, start, end)
    if level:
        conditions.append(F.col("level").isin(*levels_from(level)))
    if event_type:
        if event_type not in fixed.EVENT_TYPES:
            raise ValueError(f"unknown event type {event_type!r}")
        conditions.append(F.col("event_type") == event_type)
    if after is not None:
        if int(after) < 0:
            raise ValueError("after must be a non-negative integer")
        conditions.append(F.col("id") > int(after))
    if q:
        conditions.append(text.contains_ascii_folded(F.col("raw"), q))
    return _all(conditions)


def session_overlap(start: Column | None, end: Column | None) -> Column:
    """Sessions touching [start, end): open ones always do, the end of a session is inclusive."""
    conditions = []
    if start is not None:
        conditions.append(F.col("ended_at").isNull() | (F.col("ended_at") >= start))
    if end is not None:
        conditions.append(F.col("started_at") < end)
    return _all(conditions)


def older_than(ts: str, days: float, now: str | datetime, df: DataFrame) -> Column:
    """``ts < now - days``; days may be fractional, now is an argument so results repeat.

    On a table with days the same rule is also given for the day, so later days are not read.
    """
    cutoff = age_cutoff(days, now, df.schema[ts].dataType)
    if ts == "ts" and "event_date" in df.columns:
        return (F.col(ts) < cutoff) & (F.col("event_date") <= F.to_date(cutoff))
    return F.col(ts) < cutoff


def cutoff_moment(days: float, now: str | datetime) -> datetime:
    return (times.parse_argument(now) if isinstance(now, str) else now) - timedelta(days=days)


def age_cutoff(days: float, now: str | datetime, like: T.DataType) -> Column:
    return times.instant(cutoff_moment(days, now), like)


def discovery_match(
    name: Column, names: Sequence[str] = (), prefixes: Sequence[str] = (), excluded: Sequence[str] = (),
    allow_all: bool = False,
) -> Column:
    """Excluded names win, then allow-all, then an exact name or any prefix; case is ignored."""
    low = F.lower(name)
    wanted = F.lit(allow_all) | low.isin([n.lower() for n in names])
    for prefix in prefixes:
        wanted = wanted | F.startswith(low, F.lit(prefix.lower()))
    return ~low.isin([n.lower() for n in excluded]) & wanted


def export_file(name: Column, prefix: str, suffix: str = ".tar.gz") -> Column:
    """Loose rule for deletion: prefix and suffix only."""
    return F.startswith(name, F.lit(prefix)) & F.endswith(name, F.lit(suffix))


def listed_export(name: Column, prefix: str, suffix: str = ".tar.gz") -> Column:
    """Strict rule for listing: time stamp and eight hex digits between prefix and suffix."""
    return F.rlike(name, F.lit(f"^{re.escape(prefix)}[0-9]{{8}}T[0-9]{{6}}Z-[0-9a-f]{{8}}{re.escape(suffix)}$"))
