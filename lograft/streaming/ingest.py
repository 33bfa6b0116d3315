"""From raw device output to the stored event log."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lograft.functions import redaction, text
from lograft.operators import redact
from lograft.sources import lines as line_source
from lograft.sources import store
from lograft.streaming import state

BLOCKS = "device string, session_id string, pem boolean, block int"


def with_ids(rows: DataFrame, high_water: int) -> DataFrame:
    """Dense ids above ``high_water`` in the order (file time, file, place in the file).

    The row number inside a file split comes with the scan; only the list of splits is ordered.
    """
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    split = ["file_time", "file_path", "file_start"]
    splits = rows.groupBy(*split).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    based = splits.select(*split, "_first", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + high_water + 1).alias("_base"))
    return rows.join(based, split).withColumn("id", F.col("_base") + F.col("_at") - F.col("_first")).drop("_at", "_first", "_base")


def ingest_batch(
    batch: DataFrame, number: int, target: str, state_dir: str, extra_keys: Sequence[str] = (),
    patterns: Sequence[str] = (), secrets: Iterable[str] = (), device_secrets: DataFrame | None = None,
) -> None:
    spark = batch.sparkSession
    marks = state.read(spark, f"{state_dir}/marks", number, "high_water long").first()
    high_water = marks[0] if marks else 0
    rows = with_ids(line_source.clean_lines(batch), high_water).withColumnRenamed("value", "raw")
    before = state.read(spark, f"{state_dir}/blocks", number, BLOCKS)
    shown, closing = redact.redact_lines(rows, ["device", "session_id"], "id", "raw", extra_keys, patterns, secrets, before,
                                        device_secrets=device_secrets)
    events = text.parse(shown.withColumn("address", F.lit(None).cast("string")).withColumn("event_type", F.lit("log")))
    state.output(store.stored_form(events), target, number, "event_date")
    open_blocks = closing.filter(F.col("pem") | (F.col("block") != redaction.NO_BLOCK))
    state.write(open_blocks.select("device", "session_id", "pem", "block"), f"{state_dir}/blocks", number)
    state.write(rows.agg((F.count("*") + high_water).alias("high_water")), f"{state_dir}/marks", number)


def start(lines: DataFrame, target: str, state_dir: str, checkpoint: str, once: bool = False, **rules) -> StreamingQuery:
    """``lines`` is a stream from ``sources.lines`` with device and session_id.

    The receipt time is the time of the micro-batch, so many rows share it; order by (ts, id). A
    secret that spans lines is recognised across micro-batches because the block state is kept.
    ``device_secrets`` (device, value) is a stored table, read anew for every micro-batch.
    """
    stamped = lines.withColumn("ts", F.current_timestamp())
    writer = stamped.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        state.each_batch(lambda batch, number: ingest_batch(batch, number, target, state_dir, **rules)))
    return writer.trigger(**({"availableNow": True} if once else {"processingTime": "1 second"})).start()
