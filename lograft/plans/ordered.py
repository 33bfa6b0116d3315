"""Ordered per-key work that survives a key holding a third of all rows.

``Window.partitionBy(device).orderBy(id)`` sends every row of a device to one task. Row ids are
unique, so ``id >> bits`` cuts any key into chunks of at most ``2**bits`` rows, whatever the data
looks like. Each chunk is summarised (a map-side combined aggregate), the summaries are carried
forward in a window with one row per chunk, and the row-level window runs inside a chunk only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BITS = 22
_CHUNK = "_chunk"


@dataclass(frozen=True)
class Carry:
    """One running value: how a chunk, earlier chunks and rows of the same chunk are merged."""

    name: str
    value: Column
    chunk: Callable[[Column, Column], Column]
    merge: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    inclusive: bool = True
    forward: bool = False
    whole: bool = False


def running_sum(name: str, value: Column, inclusive: bool = True) -> Carry:
    return Carry(
        name, value, lambda v, _: F.sum(v), F.sum,
        lambda early, near: F.coalesce(early, F.lit(0)) + F.coalesce(near, F.lit(0)), inclusive,
    )


def running_count(name: str, condition: Column | None = None, inclusive: bool = True) -> Carry:
    one = F.lit(1) if condition is None else F.when(condition, 1).otherwise(0)
    return running_sum(name, one.cast("long"), inclusive)


def running_max(name: str, value: Column, inclusive: bool = True) -> Carry:
    return Carry(name, value, lambda v, _: F.max(v), F.max, lambda e, n: F.greatest(e, n), inclusive)


def last_seen(name: str, value: Column, inclusive: bool = True) -> Carry:
    """The latest non-null value so far (wrap in a struct to keep nulls)."""
    return Carry(
        name, value, lambda v, o: F.max_by(v, F.when(v.isNotNull(), o)),
        lambda v: F.last(v, ignorenulls=True), lambda e, n: F.coalesce(n, e), inclusive,
    )


def next_seen(name: str, value: Column) -> Carry:
    """The nearest non-null value in later rows."""
    return Carry(
        name, value, lambda v, o: F.min_by(v, F.when(v.isNotNull(), o)),
        lambda v: F.last(v, ignorenulls=True), lambda e, n: F.coalesce(n, e), False, forward=True,
    )


def group_count(name: str, condition: Column | None = None) -> Carry:
    """The total of the whole group, on every row."""
    one = F.lit(1) if condition is None else F.when(condition, 1).otherwise(0)
    return Carry(
        name, one.cast("long"), lambda v, _: F.sum(v), F.sum, lambda e, n: e, whole=True,
    )


def scan(
    df: DataFrame, keys: Sequence[str], order: str, carries: Sequence[Carry], bits: int = CHUNK_BITS,
    chunk: Column | None = None, ties: Sequence[str] = (),
) -> DataFrame:
    """Add every carry to ``df``, per ``keys`` in ``order`` (a unique long). Keys must not be null.

    For another order give ``chunk``, an expression monotone in it, and the tie-breaking columns.
    """
    keys, position = list(keys), F.col(order)
    group = [*keys, _CHUNK]
    rows = df.select(
        "*", (F.shiftright(position, bits) if chunk is None else chunk).alias(_CHUNK),
        *[c.value.alias(f"_v_{c.name}") for c in carries],
    )
    chunks = rows.groupBy(*group).agg(
        *[c.chunk(F.col(f"_v_{c.name}"), position).alias(f"_s_{c.name}") for c in carries]
    )
    per_key = Window.partitionBy(*keys)
    inside = Window.partitionBy(*group)
    start, before, here = Window.unboundedPreceding, -1, Window.currentRow

    def early(c: Carry) -> Column:
        if c.whole:
            frame = per_key
        else:
            by = F.desc(_CHUNK) if c.forward else F.asc(_CHUNK)
            frame = per_key.orderBy(by).rowsBetween(start, before)
        return c.merge(F.col(f"_s_{c.name}")).over(frame).alias(f"_e_{c.name}")

    def near(c: Carry) -> Column:
        by = [F.desc(o) if c.forward else F.asc(o) for o in (order, *ties)]
        frame = inside.orderBy(*by).rowsBetween(start, here if c.inclusive else before)
        return c.merge(F.col(f"_v_{c.name}")).over(frame).alias(f"_n_{c.name}")

    carried = chunks.select(*group, *[early(c) for c in carries])
    local = rows.select("*", *[near(c) for c in carries if not c.whole])
    return local.join(carried, group).select(
        *[F.col(c) for c in df.columns],
        *[
            c.combine(
                F.col(f"_e_{c.name}"), F.lit(None) if c.whole else F.col(f"_n_{c.name}")
            ).alias(c.name)
            for c in carries
        ],
    )


def ranked(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "rn", bits: int = CHUNK_BITS
) -> DataFrame:
    """1-based position of each row inside its key, oldest first."""
    return scan(df, keys, order, [running_count(name)], bits)


def nth_newest(
    df: DataFrame, keys: Sequence[str], order: str, n: str, name: str = "cut", bits: int = CHUNK_BITS
) -> DataFrame:
    """Per key the ``order`` value of the ``n``-th newest row (``n`` is a column, constant per key).

    Keys with fewer rows are absent. Only the one chunk that holds the wanted row is ranked.
    """
    group = [*keys, _CHUNK]
    rows = df.select(*keys, n, order, F.shiftright(F.col(order), bits).alias(_CHUNK))
    counts = rows.groupBy(*group).agg(F.count("*").alias("_size"), F.max(n).alias("_n"))
    newer = Window.partitionBy(*keys).orderBy(F.desc(_CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    hit = (
        counts.select(*group, "_n", "_size", F.coalesce(F.sum("_size").over(newer), F.lit(0)).alias("_newer"))
        .filter((F.col("_newer") < F.col("_n")) & (F.col("_newer") + F.col("_size") >= F.col("_n")))
        .select(*group, "_n", "_newer")
    )
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(order)))
    return (
        rows.drop(n).join(hit, group)
        .select(*keys, order, "_n", "_newer", place.alias("_place"))
        .filter(F.col("_place") + F.col("_newer") == F.col("_n"))
        .select(*keys, F.col(order).alias(name))
    )


def locate(df: DataFrame, n: int, levels: Sequence[Column], target: Sequence[str], bits: int = CHUNK_BITS):
    """The ``target`` values of the ``n``-th smallest row, or None if there are fewer rows.

    ``levels`` go from coarse to fine and must be monotone in the sort order of ``target``. Every
    level is a count per value of the level inside the one value the previous level settled on, so
    the driver sees one row per level and no task ranks more than one such value.
    """
    small = 1 << bits
    for level in levels:
        sizes = df.groupBy(level.alias("_level")).agg(F.count("*").alias("_size"))
        running = Window.orderBy("_level").rowsBetween(Window.unboundedPreceding, 0)
        found = (
            sizes.withColumn("_upto", F.sum("_size").over(running))
            .filter(F.col("_upto") >= n).orderBy("_level").limit(1).collect()
        )
        if not found:
            return None
        value, size, upto = found[0]
        df, n = df.filter(level == F.lit(value)), n - (upto - size)
        if size <= small:
            break
    else:
        raise ValueError("the finest level has to identify a row")
    place = F.row_number().over(Window.orderBy(*target))
    return df.select(*target, place.alias("_place")).filter(F.col("_place") == n).first()


def time_levels(ts: str = "ts", order: str = "id", bits: int = CHUNK_BITS) -> list[Column]:
    """Levels for (ts, id): hour, second, instant, id chunk, id. Each has a bounded fan-out."""
    return [
        F.date_trunc("hour", F.col(ts)), F.date_trunc("second", F.col(ts)), F.col(ts),
        F.shiftright(F.col(order), bits), F.col(order),
    ]


def id_levels(order: str = "id", bits: int = CHUNK_BITS) -> list[Column]:
    return [F.shiftright(F.col(order), bits), F.col(order)]
