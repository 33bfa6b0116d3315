"""Device-log tables derived from the given parquet tables.

The given ``events`` become a fleet's event log: users are devices, sign-ups start sessions,
errors are collector errors and the rest are log lines in the formats devices print.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograft import fixed
from lograft.functions import text
from lograft.operators.sessions import assign_sessions
from lograft.plans import ordered
from lograft.session import shared_dir
from lograft.sources import store

NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_line(kind: Column, k: Column, v: Column, ts: Column) -> Column:
    esc = F.lit(text.ESC)
    letter = F.substring(F.lit("VDCIWE"), (k % 6 + 1).cast("int"), F.lit(1))
    return (
        F.when(kind.isin("signup", "error"), F.concat(kind, F.lit(" code="), k))
        .when(k % 10 == 0, F.concat(F.lit("INFO reading "), kind, F.lit(" value="), v))
        .when(k % 10 == 1, F.concat(F.lit("free text "), esc, F.lit("[31m"), kind, esc, F.lit("[0m "), v))
        .otherwise(F.concat(
            F.lit("["), F.date_format(ts, "HH:mm:ss"), F.lit("]"), esc, F.lit("[0;32m["), letter, F.lit("]["),
            kind, F.lit(":"), k, F.lit("]: value="), v, esc, F.lit("[0m"),
        ))
    )


EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DOCUMENTS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def log_rows(source: DataFrame) -> DataFrame:
    """id, ts, device, address, event_type and raw from the given events, as a table or a stream."""
    source = source.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return source.select(
        F.col("event_id").alias("id"), "ts",
        F.concat(F.lit("dev-"), F.col("user_id")).alias("device"),
        F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 256), F.lit("."), F.col("user_id") % 256).alias("address"),
        F.when(F.col("event_type") == "signup", "session_start").when(F.col("event_type") == "error", "collector_error")
        .otherwise("log").alias("event_type"),
        raw_line(F.col("event_type"), F.col("k"), F.round(F.col("value") * 100).cast("long"), F.col("ts")).alias("raw"),
    )


def device_events(spark: SparkSession, sf_dir: str, sessions: bool = True, parsed: bool = True) -> DataFrame:
    """The event log of the fleet, with session ids and parsed fields unless they are not wanted."""
    log = log_rows(table(spark, sf_dir, "events"))
    if sessions:
        log = assign_sessions(log)
    return text.parse(log, only=F.col("event_type") == "log") if parsed else log


_STORED: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Path of a table that is written once per application to the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        write(path)
        _STORED[key] = path
    return _STORED[key]


def stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log as a stored event log, which is what queries over a real fleet read."""
    return store.read(spark, _stored(spark, sf_dir, "log", lambda path: store.append(device_events(spark, sf_dir), path)))


def all_kinds(log: DataFrame) -> DataFrame:
    """The same log in which the error rows are dealt to the other kinds of collector events, with their texts."""
    code = F.regexp_extract("raw", r"^error code=([0-9]+)$", 1).try_cast("long")
    error, n = F.col("event_type") == "collector_error", code % 8
    kind = (
        F.when(error & n.isin(0, 4), "disconnected").when(error & n.isin(1, 5), "retry_scheduled")
        .when(error & (n == 3), "connected").otherwise(F.col("event_type"))
    )
    said = (
        F.when(error & (n == 0), text.disconnected_text(F.lit(fixed.SHUTDOWN_REASON), code))
        .when(error & (n == 4), text.disconnected_text(F.lit("device gone"), code))
        .when(error & n.isin(1, 5), text.retry_text(code / 4, code, F.format_string("at-%d", F.col("id"))))
        .when(error & (n == 3), F.lit("device connected"))
        .when(F.col("event_type") == "session_start", text.session_start_text(F.when(F.col("id") % 2 == 0, "cli").otherwise("api")))
        .otherwise(F.col("message"))
    )
    return log.select(*[c for c in log.columns if c not in ("event_type", "message")], kind.alias("event_type"), said.alias("message"))


ARRIVALS = 5


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with all kinds of events as a stream of several micro-batches; some rows arrive about a hundredth of the log after their neighbours."""
    rows = all_kinds(stored_log(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(path: str) -> None:
        low, high = rows.agg(F.min("id"), F.max("id")).first()
        late = F.when(F.col("id") % 37 == 5, F.col("id") + (high - low) // 100).otherwise(F.col("id"))
        turn = F.least(F.lit(ARRIVALS - 1), ((late - low) * ARRIVALS / (high - low + 1)).cast("int"))
        for n in range(ARRIVALS):  # one after the other, as file streams go by the time of a file
            rows.filter(turn == n).repartition(parts).write.mode("append").parquet(path)

    path = _stored(spark, sf_dir, "arrivals", write)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", parts).parquet(path)


def stored_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session table of the stored log."""
    rows = device_sessions(stored_log(spark, sf_dir))
    return spark.read.parquet(_stored(spark, sf_dir, "sessions", lambda path: rows.write.parquet(path)))


def device_sessions(events: DataFrame) -> DataFrame:
    """One row per session; the last session of each device is still open."""
    per_session = events.groupBy("session_id", "device").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("_end"), F.min("id").alias("first_id"),
        F.count_if(F.col("event_type") == "log").alias("line_count"),
    )
    closed = ordered.scan(per_session, ["device"], "first_id", [ordered.next_seen("_later", F.lit(True))])
    return closed.select(
        "session_id", "device", "first_id", "started_at",
        F.when(F.col("_later"), F.col("_end")).alias("ended_at"),
        F.when(F.col("_later"), F.lit("device disconnected")).alias("end_reason"), "line_count",
    )


def status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of partial status updates; sticky fields are often left out."""
    source = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    k = F.col("k")
    given = lambda c: F.when(k % 3 == 0, c)
    return source.select(
        F.col("event_id").alias("seq"), "ts", F.concat(F.lit("dev-"), F.col("user_id")).alias("device"),
        F.when(F.col("event_type") == "signup", "connecting").when(F.col("event_type") == "error", "backoff")
        .otherwise("connected").alias("state"),
        given(F.concat(F.lit("10.1.0."), k)).alias("address"),
        given(F.when(k % 2 == 0, "cli").otherwise("api")).alias("backend"),
        given(F.lit("explicit")).alias("source"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("error code="), k)).alias("error"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("s-"), F.col("event_id"))).alias("session_id"),
        F.when(F.col("event_type") == "error", F.date_add(F.col("ts").cast("date"), 1).cast("timestamp_ntz"))
        .alias("next_retry_at"),
        F.when(k % 5 == 0, F.col("ts")).alias("last_line_at"),
        F.when(k % 7 == 0, k).alias("attempts"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration snapshots: every document is one, its source the device."""
    return snapshot_rows(table(spark, sf_dir, "documents"))


def snapshot_rows(docs: DataFrame) -> DataFrame:
    """Each document as a configuration with a credential section, captured twice in a row without a change."""
    content = F.concat(
        F.lit("name: "), F.col("source"), F.lit("\nlang: "), F.col("lang"), F.lit("\nwifi:\n  password: pw-"), F.col("doc_id") % 7,
        F.lit("\nkey: |\n  inner\nurl: http://u:p@h/\n"), F.coalesce("text", F.lit("")))
    again = docs.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"))
    return again.select(
        (F.col("doc_id") * 2 + F.col("again")).alias("id"), F.col("source").alias("device"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(mins=F.col("doc_id").cast("int"), secs=(F.col("again") * 20).cast("decimal(18,6)"))).alias("captured_at"),
        F.sha2(F.col("lang"), 256).alias("source_hash"), content.alias("content"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents, with credential-bearing lines mixed in by document number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "_text")).withColumn(
        "line_no", F.col("line_no").cast("long"))
    n = F.col("doc_id") % 7
    line = (
        F.when(n == 1, F.concat(F.lit("see mqtt://user:pw"), F.col("line_no"), F.lit("@host/x "), F.col("_text")))
        .when(n == 2, F.concat(F.lit("  - password: "), F.col("_text")))
        .when(n == 3, F.concat(F.lit("note legacy-token-"), F.col("line_no"), F.lit(" "), F.col("_text")))
        .when(n == 4, F.concat(F.lit("id s3cr3t-value "), F.col("_text")))
        .when((n == 0) & (F.col("line_no") % 11 == 4), F.concat(F.lit("ERROR Failed to read "), F.col("_text")))
        .when((n == 5) & (F.col("line_no") % 4 == 0), F.lit("  api_key: |"))
        .when(n == 5, F.concat(F.repeat(F.lit(" "), (F.col("line_no") % 4 * 2).cast("int")), F.col("_text")))
        .when((n == 6) & (F.col("line_no") % 9 == 1), F.lit("x -----BEGIN RSA PRIVATE KEY-----"))
        .when((n == 6) & (F.col("line_no") % 9 == 3), F.lit("-----END RSA PRIVATE KEY-----"))
        .otherwise(F.col("_text"))
    )
    # a unique long in document order; a document with more lines must not run into the next one
    fits = F.col("line_no") < 1 << 20
    position = F.when(fits, F.shiftleft("doc_id", 20) + F.col("line_no")).otherwise(
        F.raise_error(F.lit("a document has more than 2**20 lines")).cast("long"))
    return lines.select(position.alias("id"), "doc_id", "line_no", line.alias("line"))


def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as a stored table, which is what line operators over a real fleet read."""
    rows = document_lines(spark, sf_dir)
    write = lambda path: rows.repartitionByRange("id").sortWithinPartitions("id").write.parquet(path)
    return spark.read.parquet(_stored(spark, sf_dir, "lines", write))


def device_lines(spark: SparkSession, sf_dir: str, devices: int = 997) -> DataFrame:
    """The same lines as sent by many devices, which name their sessions alike: every device has a session 0."""
    return stored_lines(spark, sf_dir).select(
        "id", F.concat(F.lit("dev-"), F.col("doc_id") % devices).alias("device"),
        F.concat(F.lit("session-"), F.floor(F.col("doc_id") / devices)).alias("session_id"), "doc_id", "line_no", "line")


def device_secrets(spark: SparkSession, sf_dir: str, devices: int = 997) -> DataFrame:
    """(device, value): words of every fiftieth document, and one of two known values for every device."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    own = docs.filter("doc_id % 50 = 0").select(
        F.concat(F.lit("dev-"), F.floor(F.col("doc_id") / 50) % devices).alias("device"),
        F.explode(F.slice(F.regexp_extract_all("text", F.lit("[a-z]{4}"), F.lit(0)), 1, 5)).alias("value"))
    known = docs.select(
        F.concat(F.lit("dev-"), F.col("doc_id") % devices).alias("device"),
        F.when(F.col("doc_id") % devices % 2 == 0, "s3cr3t-value").otherwise("legacy-token").alias("value"))
    return own.unionByName(known).distinct()


def documents_with_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a credential section in front of every third one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    head = F.concat(
        F.lit("wifi:\n  ssid: net\n  password: pw-"), F.col("doc_id"), F.lit("\nkey: |\n  line\nurl: http://u:p@h/\n")
    )
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(head, "text")).otherwise(F.col("text")).alias("text"))
    return spark.read.parquet(_stored(spark, sf_dir, "secret-documents", lambda path: rows.repartitionByRange("doc_id").write.parquet(path)))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device settings as written by an operator, a good part of them wrong."""
    s = table(spark, sf_dir, "supplier")
    n = F.col("s_suppkey")
    pick = lambda cond, value: F.when(cond, value)
    return s.select(
        n.alias("pos"),
        F.when(n % 4 == 0, F.col("s_name")).when(n % 10 == 1, F.concat(F.lit("Node-"), F.floor(n / 20)))
        .otherwise(F.concat(F.lit("node-"), n % 40)).alias("name"),
        pick(n % 3 != 0, F.when(n % 11 == 0, F.lit("bad host!")).otherwise(F.concat(F.lit("10.2.0."), n % 256))).alias("address"),
        pick(n % 2 == 0, F.concat(F.lit("alias-"), n)).alias("alias"),
        pick(n % 5 == 0, F.concat(F.lit("/configs/"), n, F.lit(".yaml"))).alias("config_file"),
        pick(n % 6 == 1, F.when(n % 12 == 1, F.lit("cli")).otherwise(F.lit("serial"))).alias("backend"),
        pick(n % 7 == 0, (n % 5).cast("double")).alias("retry_initial_delay"),
        pick(n % 7 == 0, (n % 4).cast("double")).alias("retry_max_delay"),
        pick(n % 9 == 0, F.lit(0.5)).alias("retry_multiplier"),
        pick(n % 8 == 0, F.lit(1.5)).alias("retry_jitter"),
        pick(n % 13 == 0, F.lit(-1.0)).alias("retry_reset_after"),
        pick(n % 10 == 3, F.lit(45.0)).alias("idle_timeout"),
        pick(n % 10 == 7, F.lit(70000).cast("long")).alias("api_port"),
        pick(n % 15 == 0, F.lit(0.0)).alias("api_connect_timeout"),
    )


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices found on the network, with repeated names and addresses."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("pos"),
        F.when(key % 13 == 0, F.concat(F.lit("Sensor-"), key % 97)).when(key % 17 == 0, F.concat(F.lit("cam-"), key % 31))
        .otherwise(F.concat(F.lit("sensor-"), key % 97)).alias("name"),
        F.when(key % 19 != 0, F.concat(F.lit("10.1."), F.col("c_nationkey"), F.lit("."), key % 50)).alias("address"),
    )


def archive_listing(spark: SparkSession, sf_dir: str, prefix: str = "device-log-export-") -> DataFrame:
    """A folder listing with exports, temporary files and files of others."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    mtime = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(n * 43 % 43000).cast("int"))
    stamp = F.date_format(mtime, "yyyyMMdd'T'HHmmss'Z'")
    return d.select(
        F.when(n % 10 == 3, F.concat(F.lit("notes-"), n, F.lit(".txt")))
        .when(n % 10 == 7, F.concat(F.lit(".export-tmp-"), n))
        .when(n % 10 == 9, F.concat(F.lit(prefix), n, F.lit(".tar.gz")))
        .otherwise(F.concat(F.lit(prefix), stamp, F.lit("-"), F.lpad(F.lower(F.hex(n)), 8, "0"), F.lit(".tar.gz")))
        .alias("name"),
        F.col("n_chars").alias("length"), mtime.alias("mtime"), n.alias("seq"),
    )
