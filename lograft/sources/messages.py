"""Multi-line messages received as one text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograft.functions import text


def message_lines(received: DataFrame, message: str = "message", ts: str = "ts") -> DataFrame:
    """One row per line of each message, stamped with the receipt time; ``part`` counts from 0."""
    lines = F.posexplode(text.stamped_parts(F.col(message), F.col(ts))).alias("part", "raw")
    return received.select("*", lines).drop(message).withColumn("part", F.col("part").cast("long"))
