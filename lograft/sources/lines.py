"""Raw device output as lines, for batch and streaming reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograft import fixed


def read_lines(spark: SparkSession, path: str, streaming: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """Lines split at ``\\n`` only, with where they came from.

    A lone ``\\r`` inside a line stays; a last line without an end is a line like any other.
    """
    reader = (spark.readStream if streaming else spark.read).format("text").option("lineSep", "\n")
    reader = reader.option("recursiveFileLookup", "true")
    if streaming and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("file_start"),
        F.col("_metadata.file_modification_time").alias("file_time"),
    )


def clean_lines(lines: DataFrame, value: str = "value", limit: int = fixed.MAX_LINE_BYTES) -> DataFrame:
    """Cut over-long lines into pieces of at most ``limit`` bytes, replace bad UTF-8, drop trailing ``\\r``.

    A cut that falls into a character moves in front of it.
    """
    data = F.col(value).cast("binary")
    last = F.greatest(F.lit(0), F.ceil(F.octet_length(value) / limit).cast("int") - 1)
    pieces = lines.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    follows = lambda at: F.hex(F.substr(data, at + 1, F.lit(1))).rlike("^[89AB]")
    back = lambda at: F.when(follows(at), F.when(follows(at - 1), F.when(follows(at - 2), 3).otherwise(2)).otherwise(1)).otherwise(0)
    place = lambda at: at - F.when((at > 0) & (at < F.octet_length(value)), back(at)).otherwise(0)
    start, end = place(F.col("piece") * limit), place((F.col("piece") + 1) * limit)
    text = F.make_valid_utf8(F.substr(data, start + 1, end - start).cast("string"))
    return pieces.withColumn(value, F.regexp_replace(text, r"\r+\z", ""))


def device_sessions_of_files(lines: DataFrame) -> DataFrame:
    """Device and session from ``.../<device>/<session>[.part].log``."""
    pattern = r"([^/]+)/([^/]+?)(?:\.[0-9]+)?\.log$"
    return lines.select(
        "*", F.regexp_extract("file_path", pattern, 1).alias("device"), F.regexp_extract("file_path", pattern, 2).alias("session_id")
    )
