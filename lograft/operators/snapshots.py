"""Configuration snapshots: change detection, as-of lookup, retention and capture decisions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograft.operators import filters
from lograft.plans import folds, ordered
from lograft.plans.salted import salted_join


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def latest(rows: DataFrame, key: str = "device", order: str = "id") -> DataFrame:
    """The newest row per key, as a partially aggregated max rather than a sort."""
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_row"))
    return newest.select("_row.*")


def changed(snapshots: DataFrame) -> DataFrame:
    """Snapshots whose content differs from the device's previous one; A, B, A keeps all three."""
    hashed = snapshots if "content_hash" in snapshots.columns else snapshots.withColumn(
        "content_hash", content_hash(F.col("content")))
    previous = ordered.last_seen("_previous", F.struct("content_hash"), inclusive=False)
    return ordered.scan(hashed, ["device"], "id", [previous]).filter(
        F.col("_previous").isNull() | ~F.col("_previous.content_hash").eqNullSafe(F.col("content_hash"))
    ).drop("_previous")


def keep_last(snapshots: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` snapshots per device; every task cuts to ``n`` before the shuffle."""
    place = F.row_number().over(Window.partitionBy("device").orderBy(F.desc("id")))
    return snapshots.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def prune(snapshots: DataFrame, now: str, max_age_days: float | None = None, last: int | None = 20) -> DataFrame:
    """Survivors: age first, then the newest of what remains."""
    if max_age_days:
        snapshots = snapshots.filter(~filters.older_than("captured_at", max_age_days, now, snapshots))
    return keep_last(snapshots, last) if last else snapshots


def in_effect(snapshots: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Snapshots inside [start, end) and, per device, the one in effect when the window opened."""
    inside = snapshots
    for condition in filters.time_range(snapshots, start, end, "captured_at"):
        inside = inside.filter(condition)
    if not start:
        return inside
    earlier = snapshots.filter(filters.time_range(snapshots, None, start, "captured_at")[0])
    return latest(earlier).unionByName(inside)


def capture_triggers(
    polls: DataFrame, interval_seconds: float = 0.0, on_startup: bool = True, on_change: bool = False,
    stored: DataFrame | None = None, bits: int = 18,
) -> DataFrame:
    """Which polls of a device's source fingerprint cause a capture, and why.

    ``polls``: device, seq (unique long, in time order), ts, source_hash. A device's first poll is a
    ``startup`` capture; with ``on_startup`` off it only sets the baseline, from the hash in
    ``stored`` if there is one. Later a different hash is ``source changed``; otherwise a capture is
    ``scheduled`` once the interval since the last one has passed.
    """
    seen = ordered.scan(polls, ["device"], "seq", [
        ordered.last_seen("_before", F.struct("ts", "source_hash"), inclusive=False),
        ordered.running_count("_n"),
    ])
    base = F.col("_before.source_hash")
    if stored is not None and not on_startup:
        known = stored.select("device", F.col("source_hash").alias("_stored"))
        seen = salted_join(seen, known, ["device"], "left")
        base = F.when(F.col("_n") == 2, F.coalesce("_stored", base)).otherwise(base)
    first = F.col("_n") == 1
    change = ~first & F.lit(on_change) & (base != F.col("source_hash"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    kept = seen.select(
        "device", "seq", "ts", "source_hash", micros.alias("_t"), first.alias("_first"),
        F.when(first & F.lit(on_startup), "startup").when(change, "source changed").alias("reason"),
        (first | change | (micros - F.unix_micros(F.col("_before.ts").cast("timestamp")) >= int(interval_seconds * 1e6)))
        .alias("_fresh"),
    )
    if not interval_seconds:
        return kept.filter(F.col("reason").isNotNull()).select("device", "seq", "ts", "source_hash", "reason")
    due = _due(kept.select("device", "seq", "_t", "_fresh"), int(interval_seconds * 1e6), bits)
    # a due poll without another reason is scheduled; a first poll that is no capture set the baseline
    reason = F.coalesce("reason", F.when(F.col("_due") & ~F.col("_first"), F.lit("scheduled")))
    return kept.join(due, "seq", "left").select("device", "seq", "ts", "source_hash", reason.alias("reason")).filter(
        F.col("reason").isNotNull()
    )


def _picks(t: np.ndarray, fresh: np.ndarray, last: int | None, interval: int) -> list[int]:
    """Positions due, given the last capture before: every fresh poll, else one per interval."""
    picked, at = [], 0
    marks = np.flatnonzero(fresh)
    while True:
        later = len(t) if last is None else max(at, int(np.searchsorted(t, last + interval)))
        mark = int(np.searchsorted(marks, at))
        at = min(later, int(marks[mark]) if mark < len(marks) else len(t))
        if at >= len(t):
            return picked
        picked.append(at)
        last, at = int(t[at]), at + 1


def _due(polls: DataFrame, interval: int, bits: int) -> DataFrame:
    """Polls that restart or complete an interval, per device in ``seq`` order.

    A ``_fresh`` poll captures whatever happened before. Devices are walked in chunks: what a chunk
    does to the time of the last capture is known once its last fresh poll is; a chunk without one
    needs, per possible first pick, where the picks end, and the first pick lies within one
    interval of the chunk's first poll. Those summaries are chained per device.
    """
    group = ["device", "_chunk"]
    rows = folds.arranged(polls.withColumn("_chunk", F.shiftright("seq", bits)), group, ["seq"])
    arrays = lambda columns: (np.array(columns["_t"]), np.array(columns["_fresh"], dtype=bool))

    def summarise(frames):
        for key, columns in folds.groups(frames, group):
            t, fresh = arrays(columns)
            if fresh.any():
                yield (*key, [], [], int(t[_picks(t, fresh, None, interval)[-1]]))
                continue
            after, ends = np.searchsorted(t, t + interval), t.copy()
            for i in range(len(t) - 1, -1, -1):
                if after[i] < len(t):
                    ends[i] = ends[after[i]]
            reach = min(len(t), int(np.searchsorted(t, t[0] + interval)) + 1)
            yield (*key, t[:reach].tolist(), ends[:reach].tolist(), None)

    ends = folds.walk(
        rows, summarise, "device string, _chunk long, firsts array<long>, lasts array<long>, closing long")

    def chain(frames):
        current, last = None, None
        for key, columns in folds.runs(frames, ["device"]):
            if key != current:
                current, last = key, None
            for chunk, firsts, lasts, closing in zip(*(columns[c] for c in ("_chunk", "firsts", "lasts", "closing"))):
                yield (*key, chunk, last)
                if not pd.isna(closing):
                    last = int(closing)
                elif last is not None:
                    at = int(np.searchsorted(firsts, last + interval))
                    last = int(lasts[at]) if at < len(firsts) else last

    starts = folds.walk(folds.arranged(ends, ["device"], ["_chunk"]), chain, "device string, _chunk long, last long")

    def mark(frames):
        for _, columns in folds.groups(frames, group):
            last = columns["last"][0]
            picked = _picks(*arrays(columns), None if pd.isna(last) else int(last), interval)
            yield from ((columns["seq"][i], True) for i in picked)

    begun = folds.arranged(rows.join(starts, group), group, ["seq"])
    return folds.walk(begun, mark, "seq long, _due boolean")
