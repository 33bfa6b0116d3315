"""Paged search and tail slices over the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograft import fixed
from lograft.functions import text
from lograft.operators.filters import log_filter
from lograft.plans import ordered

SEARCH_COLUMNS = ("id", "ts", "device", "session_id", "event_type", "level", "component", "message", "raw")


def clamp_page(page: int, size: int | None) -> tuple[int, int]:
    return max(1, page), max(1, size) if size else fixed.PAGE_SIZE_DEFAULT


def view(events: DataFrame) -> DataFrame:
    return events.select(*SEARCH_COLUMNS, text.strip_ansi(F.col("raw")).alias("clean"))


def newest_first(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("id"))


def before(events: DataFrame, ts, row_id: int) -> Column:
    """Keyset cursor: everything older than the given row."""
    moment = F.lit(ts).cast(events.schema["ts"].dataType)
    return (F.col("ts") < moment) | ((F.col("ts") == moment) & (F.col("id") < row_id))


def page(events: DataFrame, page: int = 1, size: int | None = None, cursor=None, **filters) -> DataFrame:
    """One page, newest first, with ``has_next`` on every row (one row more is looked at, not all).

    ``cursor`` = (ts, id) of the last row of the previous page continues from there. Every later page
    number is turned into such a cursor by counting, so the rows before it are never held.
    """
    page, size = clamp_page(page, size)
    matching = events.filter(log_filter(events, **filters))
    offset = (page - 1) * size
    if cursor is not None:
        matching = matching.filter(before(events, *cursor))
    elif offset:
        keys = matching.select("ts", "id")
        last = ordered.locate(keys, max(0, keys.count() - offset) + 1, ordered.time_levels(), ["ts", "id"])
        if last is None:  # nothing matches
            return view(matching.limit(0)).withColumn("has_next", F.lit(False))
        matching = matching.filter(before(events, last["ts"], last["id"]))
    taken = newest_first(matching.select(*SEARCH_COLUMNS)).limit(size + 1)
    # at most size + 1 rows from here on
    place = F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("id")))
    marked = taken.select("*", place.alias("_place"), (F.count("*").over(Window.partitionBy()) > size).alias("has_next"))
    return newest_first(
        marked.filter(F.col("_place") <= size)
        .select(*SEARCH_COLUMNS, text.strip_ansi(F.col("raw")).alias("clean"), "has_next")
    )


def tail(events: DataFrame, after: int, limit: int = fixed.TAIL_LIMIT, **filters) -> DataFrame:
    """The next rows past a cursor, oldest first."""
    return view(events.filter(log_filter(events, after=after, **filters)).orderBy("id").limit(limit)).orderBy("id")


def high_water(events: DataFrame) -> DataFrame:
    return events.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("high_water_id"))


def tail_view(events: DataFrame, size: int = fixed.PAGE_SIZE_DEFAULT, **filters) -> DataFrame:
    """Newest rows shown oldest first, each with the cursor a live tail continues from.

    Rows and cursor are two scans of one version: a stored log is the list of files it had when it was read (``store.read``), so rows that are
    appended in between are in neither and come with the tail.
    """
    size = max(1, size)
    newest = newest_first(events.filter(log_filter(events, **filters)).select(*SEARCH_COLUMNS)).limit(size)
    return view(newest).withColumn("cursor", high_water(events).scalar()).orderBy("ts", "id")


def tail_text(rows: DataFrame, ts_text: Column) -> DataFrame:
    line = text.tail_line(
        ts_text, F.col("device"), F.col("level"), F.col("component"), F.col("event_type"), F.col("clean")
    )
    return rows.select("id", line.alias("line"))


def event_json(rows: DataFrame, ts_text: Column) -> Column:
    """One JSON object per event; nulls are written and other alphabets are kept."""
    fields = [ts_text.alias("ts") if c == "ts" else F.col(c) for c in (*SEARCH_COLUMNS, "clean")]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
