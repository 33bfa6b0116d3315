"""Rows beside the list of values that their key has, where a key may hold a large part of the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograft.session import ship

BITS = 20


def with_values(
    rows: DataFrame, column: str, values: DataFrame, key: str, order: str, make: Callable[[list[str]], Callable[[str], str]], bits: int = BITS,
) -> DataFrame:
    """``column`` of every row replaced by ``make(values of the row's key)``; ``values`` has the columns (key, value).

    A key is cut into chunks of ``order`` (unique longs), and its values are repeated for the chunks there are, so they meet their rows in as many
    tasks as a hot key needs. Values stand in front of the rows of their chunk: each task builds a chunk's helper once and then streams the rows.
    Null texts stay null; a key without values still goes through ``make``. ``column`` travels once, not also inside the row.
    """
    ship(rows.sparkSession)
    others = {c: f"c{i}" for i, c in enumerate(rows.columns) if c != column}
    row = F.struct(*[F.col(f"`{c}`").alias(place) for c, place in others.items()])
    dealt = rows.select(
        F.col(key).alias("key"), F.shiftright(F.col(order), bits).alias("chunk"), F.lit(1).alias("part"), F.col(column).alias("text"), row.alias("row"))
    chunks = dealt.select("key", "chunk").distinct()
    told = values.select(F.col(key).alias("key"), F.col("value").cast("string").alias("text")).filter("text IS NOT NULL").join(chunks, "key").select(
        "key", "chunk", F.lit(0).alias("part"), "text", F.lit(None).cast(dealt.schema["row"].dataType).alias("row"))
    sorted_ = dealt.unionByName(told).repartition("key", "chunk").sortWithinPartitions("key", "chunk", "part").select("key", "chunk", "part", "text", "row")

    def run(batches) -> Iterator:
        import pyarrow as pa

        at, held, helper = None, [], None
        for batch in batches:
            out, kept = [], []
            keys, places, parts, texts = (batch.column(i).to_pylist() for i in range(4))
            for i, (k, place, part, text) in enumerate(zip(keys, places, parts, texts)):
                if (k, place) != at:
                    at, held, helper = (k, place), [], None
                if not part:
                    held.append(text)
                    continue
                if helper is None:
                    helper = make(held)
                kept.append(i)
                out.append(None if text is None else helper(text))
            if kept:
                yield pa.RecordBatch.from_arrays([batch.column(4).take(pa.array(kept)), pa.array(out, pa.string())], names=["row", "text"])

    made = sorted_.mapInArrow(run, f"row {dealt.schema['row'].dataType.simpleString()}, text string")
    return made.select(*[F.col("text").alias(c) if c == column else F.col("row")[others[c]].alias(c) for c in rows.columns])
