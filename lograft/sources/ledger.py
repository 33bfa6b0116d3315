"""A table to which a batch can be appended again without doubling rows.

Every attempt writes to a folder of its own. It counts once the ledger has an entry ``batch -> attempt``, a small file written last, and readers join
the data with the entries. So a batch that failed half-way leaves rows that nobody sees, and one that is repeated after success adds nothing. With
``file``, the column that names each row's source file, the ledger also keeps which files are in: rows of those are left out by an anti-join, also
when they come again under another batch.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograft.sources import files

_BATCH, _ATTEMPT = "_ledger_batch", "_ledger_attempt"


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """(batch, attempt) of what counts."""
    if not files.names(spark, f"{path}/ledger"):
        return spark.createDataFrame([], f"{_BATCH} string, {_ATTEMPT} string")
    entries = spark.read.text(f"{path}/ledger", wholetext=True).select(F.col("_metadata.file_name").alias(_BATCH), "value")
    return entries.filter(F.endswith("value", F.lit("\n"))).select(_BATCH, F.rtrim(F.regexp_replace("value", "\n", "")).alias(_ATTEMPT))


def _counted(spark: SparkSession, path: str, part: str) -> DataFrame | None:
    """Rows of all attempts below ``path/part`` that count, without their marks."""
    if not files.names(spark, f"{path}/{part}"):
        return None
    rows = spark.read.option("mergeSchema", "true").parquet(f"{path}/{part}")
    # one entry a batch; a shuffle would bring a whole batch to one task
    kept = rows.join(F.broadcast(_entries(spark, path)), [_BATCH, _ATTEMPT], "left_semi")
    return kept.drop(_BATCH, _ATTEMPT)


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All rows appended so far; ``schema`` is what an empty table has."""
    rows = _counted(spark, path, "data")
    if rows is None:
        if schema is None:
            raise ValueError(f"nothing has been appended to {path}")
        return spark.createDataFrame([], schema)
    return rows


def known_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows) of the source files that are in."""
    known = _counted(spark, path, "sources")
    return spark.createDataFrame([], "file string, rows long") if known is None else known


def append(rows: DataFrame, path: str, batch: str, file: str | None = None) -> bool:
    """Append the rows of a batch once; False if the batch was there already."""
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9-]*", batch):
        raise ValueError("a batch is named by letters, digits and hyphens, with a letter first")
    spark = rows.sparkSession
    if files.read_text(spark, f"{path}/ledger/{batch}") is not None:
        return False
    attempt = f"a{uuid.uuid4().hex}"
    here = f"{_BATCH}={batch}/{_ATTEMPT}={attempt}"
    if file is not None:
        # only names meet in a shuffle, as a file may hold a large part of the rows; those that come again are few enough to be sent to the rows
        again = rows.select(file).distinct().join(known_files(spark, path).select(F.col("file").alias(file)), file, "left_semi")
        rows = rows.join(F.broadcast(again), file, "left_anti").select(*rows.columns)
    rows.write.parquet(f"{path}/data/{here}")
    if file is not None:
        written = spark.read.schema(rows.schema).parquet(f"{path}/data/{here}")
        written.groupBy(F.col(file).alias("file")).agg(F.count("*").alias("rows")).write.parquet(f"{path}/sources/{here}")
    return files.write_text(spark, f"{path}/ledger/{batch}", attempt)


def clean(spark: SparkSession, path: str) -> None:
    """Remove attempts that never counted; not while a batch is being appended."""
    counted = {(r[_BATCH], r[_ATTEMPT]) for r in _entries(spark, path).collect()}
    for part in ("data", "sources"):
        for batch in files.names(spark, f"{path}/{part}"):
            for attempt in files.names(spark, f"{path}/{part}/{batch}"):
                if (batch.partition("=")[2], attempt.partition("=")[2]) not in counted:
                    files.remove(spark, f"{path}/{part}/{batch}/{attempt}")
