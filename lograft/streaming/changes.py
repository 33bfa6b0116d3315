"""Snapshot change feed and idle detection on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lograft.operators import snapshots
from lograft.streaming import state

LATEST = "device string, id long, content_hash string"


def snapshot_changes(stored: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Snapshots that differ from the device's previous one.

    The last row of every device is put before the batch, which then runs as a batch query.
    """
    def fold(batch: DataFrame, number: int) -> None:
        before = state.read(batch.sparkSession, f"{out}/latest", number, LATEST)
        rows = batch.withColumn("content_hash", snapshots.content_hash(F.col("content"))).withColumn("_new", F.lit(True))
        joined = rows.unionByName(before.withColumn("_new", F.lit(False)), allowMissingColumns=True)
        state.output(snapshots.changed(joined).filter("_new").drop("_new"), f"{out}/changes", number)
        state.write(snapshots.latest(joined.select("device", "id", "content_hash")), f"{out}/latest", number)

    writer = stored.writeStream.option("checkpointLocation", checkpoint).foreachBatch(state.each_batch(fold))
    return writer.trigger(**({"availableNow": True} if once else {"processingTime": "1 second"})).start()


def idle_sessions(events: DataFrame, idle_seconds: int, late: str = "1 minute") -> DataFrame:
    """Stretches of activity that ended in silence of at least ``idle_seconds``.

    ``ts`` has to be a timestamp with zone. Rows that arrive more than ``late`` behind the newest
    one are dropped, as the watermark says.
    """
    gap = f"{int(idle_seconds)} seconds"
    active = events.withWatermark("ts", late).groupBy("session_id", "device", F.session_window("ts", gap).alias("_w"))
    return active.agg(F.count("*").alias("rows")).select(
        "session_id", "device", F.col("_w.start").alias("active_from"),
        (F.col("_w.end") - F.expr(f"INTERVAL {int(idle_seconds)} SECONDS")).alias("silent_since"), "rows",
    )
