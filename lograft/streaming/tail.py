"""Live tail: new rows that match the search filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lograft.operators import search
from lograft.operators.filters import log_filter

POLL = "500 milliseconds"


def cursor(after: int = 0, last_seen: str | None = None) -> int:
    """Where a reader resumes: the last id it saw, else the parameter."""
    try:
        value = int(last_seen) if last_seen else int(after)
    except ValueError:
        value = -1
    if value < 0:
        raise ValueError("after must be a non-negative integer")
    return value


def new_rows(spark: SparkSession, path: str, schema: T.StructType, files_per_poll: int = 200, **filters) -> DataFrame:
    """The event log as a stream, filtered like a search; a fresh reader starts after an id."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_poll).parquet(path)
    return search.view(events.filter(log_filter(events, **filters)))


def start(rows: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Every reader is a query of its own; its checkpoint is its cursor."""
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": POLL}
    return writer.trigger(**trigger).start()
