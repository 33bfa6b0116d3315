"""The stored event log: parquet by day, with the parsed fields and row sizes kept."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograft.operators import retention
from lograft.sources import files, ledger

STORED_COLUMNS = ("id", *retention.EVENT_FIELDS)


def stored_form(events: DataFrame) -> DataFrame:
    rows = events.select(*STORED_COLUMNS)
    return rows.select("*", retention.logical_bytes(rows).alias("row_bytes"), F.to_date("ts").alias("event_date"))


def append(events: DataFrame, path: str, mode: str = "append") -> None:
    """Range partitioning on (day, id) keeps files sorted by id and splits a day that is too big."""
    rows = stored_form(events).repartitionByRange("event_date", "id").sortWithinPartitions("event_date", "id")
    rows.write.mode(mode).partitionBy("event_date").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_snapshots(snapshots: DataFrame, path: str, batch: str) -> bool:
    """Append a batch of snapshots once; ``ledger.read`` reads them."""
    return ledger.append(snapshots, path, batch)


def _day_files(spark: SparkSession, path: str, day: str) -> list[str]:
    folder = f"event_date={day}"
    return [f"{folder}/{name}" for name in files.names(spark, f"{path}/{folder}") if not name.startswith(("_", "."))]


def apply_retention(spark: SparkSession, path: str, journal: str, policy: retention.Policy, now: str) -> None:
    """Delete what ``policy`` reaches as of ``now`` from the log at ``path``; days that lose no row stay as they are.

    The thresholds are worked out once and kept in the folder ``journal``, with the files of the days they touch. Survivors of those files
    are staged beside them; only then the days are changed, one after the other: staged files come in, the files they were read from go. A run
    that stopped anywhere is continued by calling this again, by the same thresholds, although the log has changed meanwhile. Files that others
    append to a day in the meantime stay. At the end the journal is removed.
    """
    told = files.read_text(spark, f"{journal}/plan")
    if told is None:
        plan = retention.Plan(read(spark, path), policy, now)
        touched = plan.deleted().select(F.col("event_date").cast("string")).distinct()
        days = {r[0]: _day_files(spark, path, r[0]) for r in touched.collect()}
        files.write_text(spark, f"{journal}/plan", json.dumps({"plan": plan.stored(), "days": days}))
    else:
        kept = json.loads(told)
        days = kept["days"]
    if days and files.read_text(spark, f"{journal}/staged") is None:
        log = spark.read.option("basePath", path).parquet(*[f"{path}/{name}" for own in days.values() for name in own])
        if told is not None:
            plan = retention.Plan.restored(log, kept["plan"])
        survivors = plan.label(log).filter("policy IS NULL").drop("policy")
        rows = survivors.repartitionByRange("event_date", "id").sortWithinPartitions("event_date", "id")
        rows.write.mode("overwrite").partitionBy("event_date").parquet(f"{journal}/staging")
        files.write_text(spark, f"{journal}/staged", "")
    for day, own in sorted(days.items()):
        if files.read_text(spark, f"{journal}/done-{day}") is None:
            _swap(spark, path, f"{journal}/staging", day, own)
            files.write_text(spark, f"{journal}/done-{day}", "")
    files.remove(spark, journal)
    spark.catalog.refreshByPath(path)


def _swap(spark: SparkSession, path: str, staging: str, day: str, own: list[str]) -> None:
    for name in _day_files(spark, staging, day):
        files.move_into(spark, f"{staging}/{name}", f"{path}/event_date={day}")
    for name in own:
        files.remove(spark, f"{path}/{name}")
    if not _day_files(spark, path, day):
        files.remove(spark, f"{path}/event_date={day}")
