"""Sanitised exports: event, session, status and snapshot rows, files and their manifest."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograft import fixed
from lograft.functions import redaction, text, times
from lograft.operators import filters, snapshots
from lograft.operators.status import check_device_name, known_devices, selected_devices
from lograft.plans.salted import salted_join
from lograft.session import shared_dir, ship
from lograft.sources import files

ROWS_PER_FILE = 1_000_000
#: What Spark escapes in the name of a partition's folder.
_ESCAPED = re.compile("[\\x01-\\x1f\\x7f\"#%'*/:=?\\\\{\\[\\]^]")


def check_range(start: str | None, end: str | None) -> None:
    low, high = (times.parse_argument(t) if t else None for t in (start, end))
    if low and high and low >= high:
        raise ValueError(f"the range from {start} to {end} holds no time")


def _of_devices(rows: DataFrame, devices: Sequence[str] | DataFrame | None) -> DataFrame:
    if devices is None:
        return rows
    if isinstance(devices, DataFrame):
        return salted_join(rows, devices.select("device").distinct(), ["device"], "left_semi").select(*rows.columns)
    return rows.filter(F.col("device").isin([check_device_name(d) for d in devices]) if devices else F.lit(False))


def _inside(events: DataFrame, devices, start, end) -> DataFrame:
    check_range(start, end)
    rows = _of_devices(events, devices).filter(text.valid_device_name(F.col("device")))
    for condition in filters.time_range(events, start, end):
        rows = rows.filter(condition)
    return rows


def event_rows(events: DataFrame, devices=None, start: str | None = None, end: str | None = None) -> DataFrame:
    rows = _inside(events, devices, start, end)
    fields = [F.col("ts").alias("timestamp") if c == "timestamp" else F.col(c) for c in fixed.EXPORT_COLUMNS]
    return rows.select(*fields, text.strip_ansi(F.col("raw")).alias("clean"))


def event_counts(events: DataFrame, devices=None, start: str | None = None, end: str | None = None) -> DataFrame:
    return _inside(events, devices, start, end).groupBy("device").agg(F.count("*").alias("events"))


def session_rows(sessions: DataFrame, devices=None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Sessions that touch the window, by start time."""
    check_range(start, end)
    kind = sessions.schema["started_at"].dataType
    bounds = [times.instant(t, kind) if t else None for t in (start, end)]
    return _of_devices(sessions, devices).filter(filters.session_overlap(*bounds)).orderBy("started_at")


def status_rows(status: DataFrame, devices=None) -> DataFrame:
    return _of_devices(status, devices).orderBy("device")


def snapshot_rows(
    stored: DataFrame, start: str | None = None, end: str | None = None, devices=None,
    extra_keys: Sequence[str] = (), patterns: Sequence[str] = (), secrets: Iterable[str] = (),
) -> DataFrame:
    """Snapshots of the window and the ones in effect at its start, redacted once more."""
    rows = snapshots.in_effect(_of_devices(stored, devices), start, end)
    path = F.concat(F.lit("configs/"), F.col("device"), F.lit("/"), times.file_stamp(F.col("captured_at")), F.lit("-"), F.col("id"), F.lit(".yaml"))
    clean = redaction.redact_document(F.col("content"), extra_keys, patterns, secrets)
    return rows.select("id", "device", "captured_at", path.alias("path"), clean.alias("content"))


# --- files ---

def _ordered(rows: DataFrame) -> DataFrame:
    """A range partitioning on (device, timestamp, id) splits a large device over many tasks.

    The number of tasks is given, as what they cost goes by the files they make and not by bytes.
    """
    by = ("device", "timestamp", "id")
    ordered = rows.repartitionByRange(_tasks(rows), *by).sortWithinPartitions(*by)
    return ordered.select(*[times.format_ts(F.col(c)).alias(c) if c == "timestamp" else F.col(c) for c in rows.columns])


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def write_events(rows: DataFrame, path: str) -> None:
    """JSON Lines per device, in (timestamp, id) order; the part numbers of a device's files follow the order of its rows."""
    (
        _ordered(rows).withColumn("of_device", F.col("device")).write.mode("overwrite").partitionBy("of_device")
        .option("ignoreNullFields", "false").option("maxRecordsPerFile", ROWS_PER_FILE).json(path)
    )


def _folder(**values: str | None) -> str:
    return "/".join(f"{k}={_ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', v) if v else '__HIVE_DEFAULT_PARTITION__'}" for k, v in values.items())


def _filed(rows: DataFrame, keys: dict[str, str], at: str, ending: str, most: int | None = None) -> DataFrame:
    """Write ``line`` of sorted partitions below the folder ``at`` of a mounted file system, and tell keys, path, size, sha256 and lines of every file.

    Folders and files are named as Spark's partitioned writer names them, ``keys`` being folder key -> column. Spark starts a process for every folder
    and file it makes on such a file system, and a reader has to list and open all of them again; a task makes one in a fraction of that, and reads it
    for its digest while it is there. A file gets its name once it is whole, so a repeated task writes the same files again.
    """
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        current, number, lines, out = None, 0, 0, None

        def result():
            out.close()
            name = f"{_folder(**dict(zip(keys, current)))}/part-{part:05d}-c{number:03d}{ending}"
            with open(out.name, "rb") as done:
                sha, size = hashlib.file_digest(done, "sha256").hexdigest(), os.fstat(done.fileno()).st_size
            os.replace(out.name, f"{at}/{name}")
            return (*current, name, size, sha, lines)

        def told(results):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*results), [*[pa.string()] * (len(keys) + 1), pa.int64(), pa.string(), pa.int64()])],
                names=[*keys.values(), "path", "size", "sha256", "lines"])

        for batch in batches:
            results = []
            for *key, line in zip(*(batch.column(c).to_pylist() for c in (*keys.values(), "line"))):
                if key != current or lines == most:
                    if out:
                        results.append(result())
                    number = number + 1 if key == current else 0
                    current, lines = key, 0
                    folder = f"{at}/{_folder(**dict(zip(keys, key)))}"
                    os.makedirs(folder, exist_ok=True)
                    out = open(f"{folder}/_part-{part:05d}-{attempt}", "wb")
                out.write(line + b"\n")
                lines += 1
            if results:
                yield told(results)
        if out:
            yield told([result()])

    spark = rows.sparkSession
    ship(spark)
    shared_dir(spark)
    files.remove(spark, at)
    names = ", ".join(f"{c} string" for c in keys.values())
    written = rows.select(*keys.values(), F.col("line").cast("binary").alias("line")).mapInArrow(
        run, f"{names}, path string, size long, sha256 string, lines long").checkpoint()
    files.mark(spark, f"{at}/_SUCCESS")
    return written


def _written_events(rows: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Write the events below ``root``/logs; digests of the files and (device, events)."""
    spark, path = rows.sparkSession, f"{root}/logs"
    at = files.mounted(spark, path)
    if at is None:
        write_events(rows, path)
        return digest_tree(spark, root, ["logs"]), spark.read.schema("device string").json(path).groupBy("device").agg(F.count("*").alias("events"))
    lines = _ordered(rows).select("device", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))
    written = _filed(lines, {"of_device": "device"}, at, ".json", ROWS_PER_FILE)
    digests = written.select(F.concat(F.lit("logs/"), "path").alias("path"), "size", "sha256", F.col("lines").alias("records"))
    return digests, written.groupBy("device").agg(F.sum("lines").alias("events"))


def write_rows(rows: DataFrame, path: str) -> None:
    stamped = [
        times.format_ts(F.col(f.name)).alias(f.name) if f.dataType.typeName().startswith("timestamp") else F.col(f.name)
        for f in rows.schema
    ]
    rows.select(*stamped).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _snapshot_lines(rows: DataFrame) -> DataFrame:
    file = F.substring_index("path", "/", -1)
    return rows.select(F.regexp_replace("content", r"\n\z", "").alias("content"), "device", file.alias("file"))


def write_snapshots(rows: DataFrame, path: str) -> None:
    """One text file per snapshot, below a folder per device. A file ends with a line end, also where its content has none."""
    _snapshot_lines(rows).write.mode("overwrite").partitionBy("device", "file").option("lineSep", "\n").text(path)


def _written_snapshots(rows: DataFrame, root: str) -> DataFrame:
    """Write the snapshots below ``root``/configs; digests of the files."""
    spark, path = rows.sparkSession, f"{root}/configs"
    at = files.mounted(spark, path)
    if at is None:
        write_snapshots(rows, path)
        return digest_tree(spark, root, ["configs"])
    by = ("device", "file")
    lines = _snapshot_lines(rows).repartition(_tasks(rows), *by).sortWithinPartitions(*by).select(
        *by, F.coalesce("content", F.lit("")).alias("line"))
    written = _filed(lines, {c: c for c in by}, at, ".txt")
    return written.select(F.concat(F.lit("configs/"), "path").alias("path"), "size", "sha256", F.lit(None).cast("long").alias("records"))


def _hashed(batches):
    """Per file of a sorted partition: bytes and lines read, and SHA-256 of the lines without and with a line end after the last one."""
    import pyarrow as pa

    at, length, digest, size, lines = None, 0, None, 0, 0

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "length", "joined", "lines", "bare", "ended"])

    def result():
        bare = digest.hexdigest()
        digest.update(b"\n")
        return (at, length, size, lines, bare, digest.hexdigest())

    for batch in batches:
        done = []
        for path, whole, line in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "line"))):
            if path != at:
                if at is not None:
                    done.append(result())
                at, length, digest, size, lines = path, whole, hashlib.sha256(line), len(line), 1
            else:
                digest.update(b"\n")
                digest.update(line)
                size, lines = size + 1 + len(line), lines + 1
        if done:
            yield told(done)
    if at is not None:
        yield told([result()])


def digest_tree(spark, root: str, folders: Sequence[str] = ()) -> DataFrame:
    """path below ``root``, size, sha256 and records (of JSON Lines files) of every file that has content, or of those in some folders.

    Files are read as lines, in splits, and their lines are hashed in order as a stream, so no file is held as a whole and none is too large.
    """
    ship(spark)
    shown = ~F.substring_index("path", "/", -1).rlike("^[._]")
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text([f"{root}/{f}" for f in folders] or root).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("length"),
        F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("line")).filter(shown)
    ordered = lines.repartition("path").sortWithinPartitions("path", "start", "place").select("path", "length", "line")
    told = ordered.mapInArrow(_hashed, "path string, length long, joined long, lines long, bare string, ended string")
    sha = F.when(F.col("joined") == F.col("length"), F.col("bare")).otherwise(F.col("ended"))
    inside = F.substring_index("path", root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    records = F.when(F.endswith("path", F.lit(".json")), F.col("lines"))
    return told.select(inside.alias("path"), F.col("length").alias("size"), sha.alias("sha256"), records.alias("records"))


def export(
    root: str, events: DataFrame, sessions: DataFrame, status: DataFrame, stored: DataFrame | None = None,
    devices: Sequence[str] | DataFrame | None = None, start: str | None = None, end: str | None = None, created_at: str = "",
    **redaction_rules,
) -> DataFrame:
    """Write a whole export below ``root`` and its manifest; returns the per-file digests."""
    spark = events.sparkSession
    check_range(start, end)
    if not isinstance(devices, DataFrame):
        devices = devices or None  # an empty request means all
        chosen = selected_devices(known_devices(events, status), devices)
    else:
        chosen = devices.select("device").distinct()
    logs, written = _written_events(event_rows(events, devices, start, end), root)
    write_rows(session_rows(sessions, chosen, start, end), f"{root}/metadata/sessions")
    write_rows(status_rows(status, chosen), f"{root}/metadata/device_status")
    digests = logs.unionByName(digest_tree(spark, root, ["metadata"]))
    if stored is not None:
        digests = digests.unionByName(_written_snapshots(snapshot_rows(stored, start, end, chosen, **redaction_rules), root))
    digests = digests.checkpoint()
    # chosen devices without any event are listed with 0
    counts = chosen.join(written, "device", "left").select("device", F.coalesce("events", F.lit(0)).alias("events"))
    manifest(digests, counts, devices, start, end, stored is not None, created_at).write.mode("overwrite").text(
        f"{root}/manifest")
    return digests


def manifest(
    digests: DataFrame, counts: DataFrame, devices, start: str | None, end: str | None, with_configs: bool, created_at: str
) -> DataFrame:
    """JSON Lines: a header line, then one line per device and per file, so it grows with no limit."""
    header = {
        "format_version": fixed.EXPORT_FORMAT_VERSION, "created_at": created_at,
        "filters": {
            "devices": list(devices) if isinstance(devices, (list, tuple)) else None, "start": start, "end": end,
            "bounds": "[start, end)", "zone": "UTC", "include_configs": with_configs,
        },
        "logs": {"format": "jsonl", "columns": [*fixed.EXPORT_COLUMNS, "clean"]},
    }
    spark = digests.sparkSession
    head = spark.createDataFrame([(0, json.dumps(header))], "part int, value string")
    per_device = counts.select(F.lit(1).alias("part"), F.to_json(F.struct("device", "events")).alias("value"))
    per_file = digests.select(F.lit(2).alias("part"), F.to_json(F.struct("path", "size", "sha256", "records")).alias("value"))
    return head.unionByName(per_device).unionByName(per_file).orderBy("part", "value").select("value")
