"""Plain text copies of the event log, one folder per device, and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograft import fixed
from lograft.functions import times

ROWS_PER_FILE = 1_000_000


def copy_lines(events: DataFrame) -> DataFrame:
    """``<ts> <raw>``; collector events are marked, their line ends and backslashes escaped, and a retry notice is shortened."""
    shown = F.when(
        F.col("event_type") == "retry_scheduled", F.regexp_extract("raw", r"^retry in [0-9.]+s", 0)
    ).otherwise(F.col("raw"))
    marked = F.when(F.col("event_type") == "log", F.col("raw")).otherwise(
        F.concat(F.lit(fixed.RAW_COPY_MARK), F.col("event_type"), F.lit(": "), F.replace(F.replace(shown, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))))
    return events.select("device", "id", F.concat_ws(" ", times.format_ts(F.col("ts")), marked).alias("value"))


def write(events: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Text files in id order; files are bounded in rows and a busy device is split over tasks."""
    lines = copy_lines(events).repartitionByRange("device", "id").sortWithinPartitions("device", "id")
    lines.select("value", "device").write.mode("overwrite").partitionBy("device").option(
        "maxRecordsPerFile", rows_per_file).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.schema("value string, device string").option("lineSep", "\n").text(path)
    pattern = rf"(?s)^(\S+) (?:{fixed.RAW_COPY_MARK}({'|'.join(fixed.EVENT_TYPES[1:])}): )?(.*)$"
    field = lambda i: F.regexp_extract("value", pattern, i)
    plain = F.replace(F.replace(F.replace(field(3), F.lit("\\\\"), F.lit("\0")), F.lit("\\n"), F.lit("\n")), F.lit("\0"), F.lit("\\"))
    return lines.select(
        "device", field(1).try_cast("timestamp").alias("ts"), F.coalesce(F.nullif(field(2), F.lit("")), F.lit("log")).alias("event_type"),
        F.when(field(2) == "", field(3)).otherwise(plain).alias("raw"),
    )
