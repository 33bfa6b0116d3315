"""Every operator as a query over the given tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograft import fixed
from lograft.functions import redaction, text, times
from lograft.operators import export, filters, inventory, redact, retention, search, sessions, snapshots, status
from lograft.session import shared_dir
from lograft.sources import derived, ledger, messages, store
from lograft.streaming import changes, lifecycle, tail

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RANGE = ("2024-01-10T00:00:00Z", "2024-01-12T12:00:00Z")
PREFIX = "device-log-export-"
VALUE_PATTERNS = [r"legacy-token-\w+", r"token = \"[^\"]*\""]
SECRETS = ["s3cr3t-value", "abc", "s3cr3t"]
DEFAULTS = {"retry_initial_delay": 5.0, "idle_timeout": 30.0, "backend": None}
RULES = {"names": ["cam-1", "CAM-2"], "prefixes": ["sensor-", "cam-3"], "excluded": ["Sensor-5", "cam-30"]}
LIMITS = {"dev-1": retention.Limit(5, None), "dev-2": retention.Limit(None, 25), "dev-3": retention.Limit(7.5, 10),
          "dev-99999": retention.Limit(1, 1)}
INTERVAL = 8 * 3600


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return derived.stored_log(spark, sf)


def _status(spark: SparkSession, sf: str) -> DataFrame:
    """Status of every device."""
    return status.from_events(_events(spark, sf))


def _stamp(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, times.format_ts(F.col(c)))
    return df


# --- lines ---

@query
def event_rows(spark, sf):
    return _events(spark, sf).select("id", *retention.EVENT_FIELDS)


@query
def parse_lines(spark, sf):
    return derived.device_events(spark, sf, sessions=False).select(
        "id", "event_type", "clean", "level", "component", "device_time", "message")


@query
def strip_ansi(spark, sf):
    return derived.device_events(spark, sf, sessions=False, parsed=False).select(
        "id", text.strip_ansi(F.col("raw")).alias("clean"))


@query
def level_rank(spark, sf):
    e = derived.device_events(spark, sf, sessions=False)
    return e.groupBy("level").agg(F.count("*").alias("n")).withColumn("level_rank", text.level_rank(F.col("level")))


@query
def connected_lines(spark, sf):
    e = derived.device_events(spark, sf, sessions=False)
    return e.filter(text.looks_connected(F.col("device_time"), F.col("message"))).select("id", "device", "raw")


@query
def diagnostic_lines(spark, sf):
    lines = derived.stored_lines(spark, sf)
    return lines.filter(text.is_diagnostic(F.col("line"))).select("doc_id", "line_no")


@query
def message_parts(spark, sf):
    turns = derived.table(spark, sf, "conversations")
    return messages.message_lines(
        turns.withColumn("ts", F.lit("2024-03-01 10:00:00").cast("timestamp_ntz")
                         + F.make_dt_interval(secs=(F.col("conv_id") * 60 + F.col("turn")).cast("decimal(18,6)"))),
        "text",
    ).select("conv_id", "turn", "part", "raw")


@query
def short_texts(spark, sf):
    docs = derived.table(spark, sf, "documents")
    return docs.select(
        "doc_id", text.first_chars(F.col("text")).alias("first_400"), text.last_chars(F.col("text")).alias("last_500"),
        times.human_size(F.col("n_chars") * F.col("n_chars")).alias("size"), F.sha2("text", 256).alias("digest"),
    )


@query
def time_texts(spark, sf):
    e = derived.table(spark, sf, "events")
    return e.select(
        "event_id", times.format_ts(F.col("ts")).alias("stored"), times.short_utc(F.col("ts")).alias("short"),
        times.file_stamp(F.col("ts")).alias("stamp"),
    )


@query
def parse_time_texts(spark, sf):
    e = derived.table(spark, sf, "events")
    n = F.col("event_id")
    written = (
        F.when(n % 5 == 0, F.date_format("ts", "yyyy-MM-dd")).when(n % 5 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(n % 5 == 2, times.format_ts(F.col("ts"))).when(n % 5 == 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .otherwise(F.lit("yesterday"))
    )
    return e.select("event_id", F.date_format(times.parse_column(written), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"))


@query
def tail_lines(spark, sf):
    return search.tail_text(search.view(_events(spark, sf)), times.format_ts(F.col("ts")))


@query
def event_json(spark, sf):
    rows = search.view(_events(spark, sf))
    return rows.select("id", search.event_json(rows, times.format_ts(F.col("ts"))).alias("event"))


@query
def event_messages(spark, sf):
    u = derived.status_updates(spark, sf)
    retry = text.retry_text(F.col("seq") / F.lit(8.0), F.col("seq") % 9 + 1, times.format_ts(F.col("ts")))
    bye = text.disconnected_text(F.concat(F.lit("device "), F.col("state")), F.col("seq") % 70)
    return u.select("seq", retry.alias("retry"), bye.alias("bye")).select(
        "seq", "retry", "bye", text.retry_fields(F.col("retry"))["attempt"].alias("attempt"),
        text.retry_fields(F.col("retry"))["retry_at"].alias("retry_at"),
        text.disconnect_fields(F.col("bye"))["reason"].alias("reason"),
        text.disconnect_fields(F.col("bye"))["lines"].alias("lines"),
    )


# --- search and tail ---

@query
def search_level_min(spark, sf):
    return search.page(_events(spark, sf), 1, 50, level="WARNING")


@query
def search_text_literal(spark, sf):
    return search.page(_events(spark, sf), q="VALUE=1")


@query
def search_time_range(spark, sf):
    return search.page(_events(spark, sf), 1, 500, start=RANGE[0], end=RANGE[1])


@query
def search_combined(spark, sf):
    return search.page(_events(spark, sf), 1, 50, level="WARNING", q="value=", start=RANGE[0], end="2024-01-20T00:00:00Z")


@query
def search_device_type(spark, sf):
    return search.page(_events(spark, sf), 1, 500, device="dev-7", event_type="collector_error")


@query
def search_page2_has_next(spark, sf):
    return search.page(_events(spark, sf), 2, 30, event_type="log")


@query
def search_after_cursor(spark, sf):
    return search.page(_events(spark, sf), 1, 40, cursor=("2024-01-15 00:00:00", 0), level="ERROR")


@query
def tail_after_cursor(spark, sf):
    return search.tail(_events(spark, sf), 400, level="INFO")


@query
def tail_initial_view(spark, sf):
    return search.tail_view(_events(spark, sf), 100, event_type="log")


@query
def high_water_id(spark, sf):
    return search.high_water(_events(spark, sf))


# --- status ---

@query
def log_summary(spark, sf):
    return status.log_summary(_events(spark, sf))


@query
def last_event(spark, sf):
    return status.last_event(_events(spark, sf))


@query
def status_from_events(spark, sf):
    return _status(spark, sf)


@query
def status_rollup(spark, sf):
    return status.rollup(_status(spark, sf), _events(spark, sf)).orderBy("device")


@query
def status_update_fold(spark, sf):
    return status.fold_updates(derived.status_updates(spark, sf))


@query
def status_attempt_fold(spark, sf):
    """The fold with connection attempts counted."""
    u = derived.status_updates(spark, sf)
    kind = F.when((F.col("state") == "connecting") & (F.col("seq") >= 700), "attempt").otherwise("status")
    first = u.groupBy("device").agg(F.min("seq").alias("_first"))
    u = u.join(first, "device").withColumn("kind", F.when(F.col("seq") == F.col("_first"), "status").otherwise(kind)).drop("_first")
    u = u.withColumn("attempts", F.when(F.col("kind") != "attempt", F.col("attempts")))
    return status.fold_updates(status.count_attempts(u)).select("device", "state", "attempts", "next_retry_at")


@query
def status_stopped(spark, sf):
    return status.stop_all(_status(spark, sf), F.lit(derived.NOW).cast("timestamp_ntz"))


@query
def device_attempts(spark, sf):
    return sessions.attempts(_events(spark, sf))


@query
def known_devices(spark, sf):
    extra = _status(spark, sf).select(F.concat(F.lit("x-"), "device").alias("device")).unionByName(_status(spark, sf).select("device"))
    return status.known_devices(_events(spark, sf), extra)


@query
def selected_devices(spark, sf):
    e = derived.table(spark, sf, "supplier").select(F.explode(F.array("s_name", F.concat(F.lit("n-"), "s_suppkey"))).alias("device"))
    return status.selected_devices(e)


@query
def log_span_text(spark, sf):
    e = _events(spark, sf)
    per = e.groupBy("session_id").agg(
        F.min(F.when(sessions.is_log(), F.col("ts"))).alias("first"), F.max(F.when(sessions.is_log(), F.col("ts"))).alias("last"))
    return per.select("session_id", times.log_span(F.col("first"), F.col("last")).alias("span"))


@query
def time_ago_text(spark, sf):
    e = derived.table(spark, sf, "events")
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return e.select("event_id", times.time_ago(F.when(F.col("event_id") % 11 != 0, F.col("ts")), now).alias("ago"))


# --- sessions ---

@query
def sessions_derived(spark, sf):
    e = _events(spark, sf)
    bye = F.concat(F.lit("device gone ("), F.col("id") % 7, F.lit(" lines this session)"))
    ends = F.col("event_type") == "collector_error"
    e = e.withColumn("message", F.when(ends, bye).otherwise(F.col("message"))).withColumn(
        "event_type", F.when(ends, "disconnected").otherwise(F.col("event_type")))
    return sessions.derive(e)


@query
def disconnect_audit(spark, sf):
    e = _events(spark, sf)
    bye = F.concat(F.lit("device gone ("), F.col("id") % 7, F.lit(" lines this session)"))
    ends = F.col("event_type") == "collector_error"
    e = e.withColumn("message", F.when(ends, bye)).withColumn(
        "event_type", F.when(ends, "disconnected").otherwise(F.col("event_type")))
    return sessions.disconnect_check(e)


@query
def session_line_counts(spark, sf):
    return sessions.line_counts(_events(spark, sf))


@query
def line_numbers(spark, sf):
    return sessions.line_numbers(_events(spark, sf)).select("session_id", "id", "line_no")


@query
def session_gaps(spark, sf):
    return sessions.gaps(_events(spark, sf))


@query
def first_connected(spark, sf):
    return sessions.first_connected(_events(spark, sf))


@query
def throttled_last_line(spark, sf):
    """With one session per device, so that sessions reach fifty lines."""
    e = derived.device_events(spark, sf, sessions=False).withColumn("session_id", F.concat("device", F.lit("-all")))
    return sessions.last_lines(e)


@query
def crash_closed_sessions(spark, sf):
    s = derived.stored_sessions(spark, sf)
    crashed = F.col("line_count") % 3 == 1
    s = s.withColumn("ended_at", F.when(~crashed, F.col("ended_at"))).withColumn(
        "end_reason", F.when(F.col("line_count") % 2 == 0, F.col("end_reason")))
    return sessions.close_crashed(s)


@query
def idle_breaks(spark, sf):
    return sessions.idle_breaks(_events(spark, sf), 36_000)


@query
def sessions_overlapping(spark, sf):
    s = derived.stored_sessions(spark, sf)
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-10 00:00:00", "2024-01-12 12:00:00"))
    return s.filter(filters.session_overlap(start, end))


@query
def failure_excerpt(spark, sf):
    """Lines of a document are one session; documents whose lines hold a diagnostic failed."""
    lines = derived.stored_lines(spark, sf).select(
        "id", F.col("doc_id").cast("string").alias("session_id"), F.lit("log").alias("event_type"), F.col("line").alias("raw"))
    failed = lines.filter(text.is_diagnostic(F.col("raw"))).select("session_id").distinct()
    return sessions.failure_excerpt(lines, failed)


@query
def backoff_audit(spark, sf):
    s = derived.stored_sessions(spark, sf)
    return sessions.backoff_audit(s, reset_after=4 * 86400.0)


@query
def backoff_audit_slow(spark, sf):
    """A multiplier close to one, so that the delay grows over many sessions."""
    s = derived.stored_sessions(spark, sf)
    return sessions.backoff_audit(s, multiplier=1.001, reset_after=4 * 86400.0).select(
        "device", "session_id", "attempt", F.round("base_delay", 6).alias("base_delay"))


# --- retention ---

def plan(spark, sf, policy: retention.Policy) -> retention.Plan:
    return retention.Plan(derived.stored_log(spark, sf), policy, derived.NOW)


def batch_size(spark, sf) -> int:
    """A twentieth of the log."""
    return max(1, derived.table(spark, sf, "events").count() // 20)


def size_cap(spark, sf, share: float) -> int:
    return int(retention.stored_bytes(derived.stored_log(spark, sf)).first()[0] * share)


@query
def stored_bytes(spark, sf):
    return retention.stored_bytes(_events(spark, sf))


@query
def stored_log_rows(spark, sf):
    """One day and a bit read back from the stored log; only the days concerned are opened."""
    log = derived.stored_log(spark, sf)
    return log.filter(filters.log_filter(log, start=RANGE[0], end=RANGE[1], level="INFO")).select("id", "level", "row_bytes", "event_date")


@query
def retention_age(spark, sf):
    return plan(spark, sf, retention.Policy(max_age_days=20)).survivors().select("id")


@query
def retention_device_age(spark, sf):
    policy = retention.Policy(per_device={"dev-1": retention.Limit(5, None), "dev-3": retention.Limit(7.5, None)})
    return plan(spark, sf, policy).survivors().select("id")


@query
def retention_device_count(spark, sf):
    policy = retention.Policy(per_device={"dev-2": retention.Limit(None, 25), "dev-3": retention.Limit(None, 10)})
    return plan(spark, sf, policy).survivors().select("id")


@query
def retention_size_cap(spark, sf):
    b = batch_size(spark, sf)
    return plan(spark, sf, retention.Policy(max_total_bytes=size_cap(spark, sf, 0.6), batch_size=b)).survivors().select("id")


@query
def retention_budget(spark, sf):
    """Age alone would take about seven batches; five are allowed."""
    b = batch_size(spark, sf)
    return plan(spark, sf, retention.Policy(20, None, LIMITS, b, 5)).deleted().select("id", "policy")


def full_plan(spark, sf) -> retention.Plan:
    b = batch_size(spark, sf)
    return plan(spark, sf, retention.Policy(20, size_cap(spark, sf, 0.4), LIMITS, b, 14))


@query
def retention_full_run(spark, sf):
    return full_plan(spark, sf).deleted().select("id", "policy")


@query
def retention_applied(spark, sf):
    """The log after a whole run with limits, a size cap and a budget, applied to stored days."""
    path, journal = _folder(spark), _folder(spark)
    store.append(_events(spark, sf), path)
    store.apply_retention(spark, path, journal, full_plan(spark, sf).policy, derived.NOW)
    return store.read(spark, path).select("id", "device", "row_bytes", F.col("event_date").cast("string").alias("event_date"))


@query
def append_twice(spark, sf):
    """Snapshots that arrive in five files: a batch of two files, the same one again, then all files under another batch."""
    path = _folder(spark)
    rows = derived.snapshots(spark, sf).withColumn("file", F.concat(F.lit("part-"), F.col("id") % 5))
    first = rows.filter("file IN ('part-1', 'part-3')")
    for part, batch in ((first, "b0"), (first, "b0"), (rows, "b1")):
        ledger.append(part, path, batch, "file")
    return _stamp(ledger.read(spark, path), "captured_at").select("id", "device", "captured_at", "file", F.sha2("content", 256).alias("content_hash"))


@query
def retention_steps(spark, sf):
    return full_plan(spark, sf).step_table().select("step", "policy", "rule", "device", "matching", "demand", "batches", "deleted")


@query
def retention_run_stats(spark, sf):
    run = full_plan(spark, sf)
    snaps = derived.snapshots(spark, sf)
    return retention.run_statistics(
        run, derived.stored_sessions(spark, sf), snaps, snapshots.prune(snaps, derived.NOW, 29.5, 4),
        retention.archive_plan(derived.archive_listing(spark, sf), derived.NOW, PREFIX, 14, 300_000),
    )


@query
def orphan_sessions(spark, sf):
    e = _events(spark, sf)
    left = e.filter(~filters.older_than("ts", 20, derived.NOW, e))
    return retention.orphan_sessions(derived.stored_sessions(spark, sf), left)


@query
def deleted_line_total(spark, sf):
    """The counter over one run per event day, each deleting that day's rows."""
    e = _events(spark, sf)
    runs = e.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(sessions.is_log()).alias("deleted_log_lines"))
    return retention.cumulative_deleted(runs)


@query
def snapshots_keep_last(spark, sf):
    return snapshots.keep_last(derived.snapshots(spark, sf), 4).select("id", "device")


@query
def snapshots_prune(spark, sf):
    return snapshots.prune(derived.snapshots(spark, sf), derived.NOW, 29.5, 10).select("id", "device")


@query
def archive_prune(spark, sf):
    return retention.archive_plan(derived.archive_listing(spark, sf), derived.NOW, PREFIX, 14, 300_000).select("name", "length", "action")


@query
def archive_listed(spark, sf):
    return derived.archive_listing(spark, sf).filter(filters.listed_export(F.col("name"), PREFIX)).select("name", "length")


# --- snapshots ---

@query
def snapshots_dedupe(spark, sf):
    return snapshots.changed(derived.snapshots(spark, sf)).select("id", "device", "content_hash")


@query
def snapshot_latest(spark, sf):
    return snapshots.latest(derived.snapshots(spark, sf))


@query
def snapshot_in_effect(spark, sf):
    return snapshots.in_effect(derived.snapshots(spark, sf), "2024-01-01T02:00:00Z", "2024-01-01T03:00:00Z")


def _polls(spark, sf) -> DataFrame:
    return _events(spark, sf).select(
        "device", F.col("id").alias("seq"), "ts", F.sha2("event_type", 256).alias("source_hash"))


@query
def capture_triggers_change(spark, sf):
    return snapshots.capture_triggers(_polls(spark, sf), on_change=True).select("device", "seq", "reason")


@query
def capture_triggers(spark, sf):
    return snapshots.capture_triggers(_polls(spark, sf), INTERVAL, on_startup=True, on_change=True).select("device", "seq", "reason")


# --- redaction ---

@query
def redact_urls(spark, sf):
    return derived.stored_lines(spark, sf).select("doc_id", "line_no", redaction.redact_urls(F.col("line")).alias("line"))


@query
def redact_patterns(spark, sf):
    return derived.stored_lines(spark, sf).select(
        "doc_id", "line_no", redaction.redact_patterns(F.col("line"), VALUE_PATTERNS).alias("line"))


@query
def redact_known(spark, sf):
    return derived.stored_lines(spark, sf).select("doc_id", "line_no", redaction.redact_known(F.col("line"), SECRETS).alias("line"))


@query
def redact_known_per_row(spark, sf):
    """Each line has its own list: the language and the source of its document, and a common value."""
    lines = derived.stored_lines(spark, sf)
    own = F.array(F.concat(F.lit("value "), F.col("doc_id") % 5), F.lit("s3cr3t-value"), F.lit("the"), F.lit("ation"))
    return lines.select("doc_id", "line_no", redaction.redact_known_of_row(F.col("line"), own).alias("line"))


@query
def redact_key_lines(spark, sf):
    line = F.col("line")
    cut = F.when(redaction.is_sensitive(redaction.line_key(line)), redaction.redact_key_line(line)).otherwise(line)
    return derived.stored_lines(spark, sf).select("doc_id", "line_no", cut.alias("line"))


@query
def redact_single_lines(spark, sf):
    return derived.stored_lines(spark, sf).select(
        "doc_id", "line_no", redaction.redact_line(F.col("line"), ["^note$"], VALUE_PATTERNS, SECRETS).alias("line"))


@query
def redact_sessions(spark, sf):
    """Every document is a session whose lines arrive one by one."""
    shown, _ = redact.redact_lines(
        derived.stored_lines(spark, sf), ["doc_id"], "id", "line", ["^note$"], VALUE_PATTERNS, SECRETS)
    return shown.select("doc_id", "line_no", "line")


@query
def redact_device_secrets(spark, sf):
    """Lines of many devices that name their sessions alike, each with the secrets of its own device."""
    shown, _ = redact.redact_lines(
        derived.device_lines(spark, sf), ["device", "session_id"], "id", "line", ["^note$"], VALUE_PATTERNS, ["value"],
        device_secrets=derived.device_secrets(spark, sf))
    return shown.select("device", "session_id", "doc_id", "line_no", "line")


@query
def redact_documents(spark, sf):
    docs = derived.documents_with_secrets(spark, sf)
    return docs.select("doc_id", redaction.redact_document(F.col("text"), [], VALUE_PATTERNS, SECRETS).alias("text"))


@query
def known_secret_list(spark, sf):
    words = derived.table(spark, sf, "documents").select(F.explode(F.split(F.col("text"), "[ .,\n]+")).alias("value"))
    return inventory.secret_list(words)


# --- fleet inventory ---

def _settings(spark, sf) -> DataFrame:
    return inventory.effective_settings(derived.registry(spark, sf), DEFAULTS)


@query
def effective_settings(spark, sf):
    return _settings(spark, sf)


NESTED = {"retry": {"initial_delay": 5.0, "jitter": 0.2}, "api": {"port": 6053, "noise_psk": {"file": "/run/psk"}, "password": None},
          "idle_timeout": 30.0, "backend": "auto"}


@query
def effective_settings_nested(spark, sf):
    """Settings documents of devices, with objects that are empty, nested or only refer to a value, over default objects."""
    r = derived.registry(spark, sf)
    n = F.col("pos")
    settings = F.struct(
        F.struct(F.col("retry_initial_delay").alias("initial_delay"), F.col("retry_max_delay").alias("max_delay")).alias("retry"),
        F.struct(F.col("api_port").alias("port"), F.when(n % 6 == 0, F.struct(F.format_string("PSK_%d", n).alias("env"))).alias("noise_psk")).alias("api"),
        F.when(n % 8 == 0, F.struct(n.alias("seconds"))).alias("idle_timeout"), "backend")
    return inventory.nested_settings(r.select("pos", F.to_json(settings).alias("settings")), NESTED)


@query
def backend_target(spark, sf):
    return inventory.resolve_backend(derived.registry(spark, sf)).select("pos", "name", "backend", "target")


@query
def registry_violations(spark, sf):
    r = _settings(spark, sf)
    return inventory.violations(r.withColumn("backend", F.coalesce("backend", F.lit("auto"))))


@query
def duplicate_names(spark, sf):
    return inventory.duplicate_names(derived.registry(spark, sf))


@query
def retention_targets(spark, sf):
    limits = derived.table(spark, sf, "supplier").select(F.concat(F.lit("NODE-"), F.col("s_suppkey") % 60).alias("device")).distinct()
    return inventory.unknown_limits(limits, derived.registry(spark, sf))


@query
def address_check(spark, sf):
    c = derived.table(spark, sf, "customer")
    k = F.col("c_custkey")
    value = (
        F.when(k % 6 == 0, F.concat(F.lit("10.0.0."), k)).when(k % 6 == 1, F.concat(F.lit("host-"), k, F.lit(".lan")))
        .when(k % 6 == 2, F.concat(F.lit("bad host "), k)).when(k % 6 == 3, F.concat(F.lit("fe80::"), F.hex(k)))
        .when(k % 6 == 4, F.concat(F.lit("-"), k)).otherwise(F.concat(F.lit("[2001:db8::"), F.hex(k % 4096), F.lit("]")))
    )
    return c.select("c_custkey", inventory.is_address(value).alias("valid"))


@query
def discovery_filter(spark, sf):
    return derived.discovered(spark, sf).filter(
        filters.discovery_match(F.col("name"), RULES["names"], RULES["prefixes"], RULES["excluded"]))


def _existing(spark, sf) -> DataFrame:
    s = derived.table(spark, sf, "supplier")
    n = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("Sensor-"), n % 9).alias("name"), F.when(n % 2 == 0, F.concat(F.lit("CAM-"), n % 5)).alias("alias"),
        F.when(n % 3 == 0, F.concat(F.lit("10.1."), n % 25, F.lit("."), n % 50)).alias("address"))


@query
def discovery_known_anti(spark, sf):
    return inventory.drop_known(derived.discovered(spark, sf), _existing(spark, sf))


@query
def discovery_admit(spark, sf):
    return inventory.admit(derived.discovered(spark, sf), _existing(spark, sf), **RULES)


# --- export ---

@query
def export_rows(spark, sf):
    return _stamp(export.event_rows(_events(spark, sf), start=RANGE[0], end=RANGE[1]), "timestamp")


@query
def export_sessions(spark, sf):
    s = derived.stored_sessions(spark, sf)
    return export.session_rows(s, ["dev-1", "dev-2", "dev-7"], RANGE[0], RANGE[1])


@query
def export_status(spark, sf):
    return export.status_rows(_status(spark, sf), ["dev-2", "dev-4", "dev-5"])


@query
def export_snapshots(spark, sf):
    rows = export.snapshot_rows(derived.snapshots(spark, sf), "2024-01-01T02:00:00Z", "2024-01-01T03:00:00Z")
    return rows.select("id", "device", "path", "content")


@query
def export_digests(spark, sf):
    """Records by device in the files of a whole export, as the digests of its files count them."""
    root = _folder(spark)
    log = _events(spark, sf)
    states = status.from_events(log)
    digests = export.export(root, log, sessions.derive(log), states, derived.snapshots(spark, sf), start=RANGE[0], end=RANGE[1])
    logs = digests.filter(F.startswith("path", F.lit("logs/of_device=")))
    device = F.regexp_extract("path", "of_device=([^/]+)/", 1)
    return logs.groupBy(device.alias("device")).agg(F.sum("records").alias("records"), (F.sum("size") > F.sum("records") * 100).alias("filled"))


@query
def export_manifest_counts(spark, sf):
    return export.event_counts(_events(spark, sf), start=RANGE[0], end=RANGE[1])


# --- streams, run until the given tables are read ---

def _folder(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark, sf, name: str, schema: str) -> DataFrame:
    # a pattern, because a plain path would have to be a folder and the table may be a single file
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _event_stream(spark, sf) -> DataFrame:
    return derived.log_rows(_stream(spark, sf, "events", derived.EVENTS_SCHEMA))


@query
def stream_tail(spark, sf):
    log = text.parse(_event_stream(spark, sf), only=sessions.is_log()).withColumn("session_id", F.concat("device", F.lit("-all")))
    out = _folder(spark)
    rows = search.view(log.filter(filters.log_filter(log, level="WARNING", after=400)))
    tail.start(rows, f"{out}/rows", f"{out}/at", once=True).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("id", "ts", "device", "level", "clean")


# about a hundredth of the given 30 days: how late rows of ``derived.arrivals`` are at most
LATE = 10 * 3600


@query
def status_all_kinds(spark, sf):
    return status.from_events(derived.all_kinds(_events(spark, sf)))


@query
def stream_lifecycle(spark, sf):
    out = _folder(spark)
    log = derived.arrivals(spark, sf)
    lifecycle.start(log, out, f"{out}/at", once=True, late=LATE).awaitTermination()
    stored = lifecycle.current(spark, out)
    return _stamp(stored, "started_at", "ended_at", "connected_at", "last_line_at", "exact_last_line_at").select(
        "session_id", "device", "started_at", "ended_at", "end_reason", "lines", "connected_id", "connected_at", "last_line_at", "exact_last_line_at")


@query
def stream_status(spark, sf):
    out = _folder(spark)
    lifecycle.start_status(derived.arrivals(spark, sf), f"{out}/rows", f"{out}/at", once=True, late=LATE).awaitTermination()
    stored = lifecycle.latest(spark, f"{out}/rows", "device")
    return _stamp(stored, "updated_at", "last_error_at", "newest_line_at")


@query
def stream_gaps(spark, sf):
    """Gaps that are settled when the given events end."""
    out = _folder(spark)
    writer = lifecycle.gap_rows(derived.arrivals(spark, sf), late=LATE).writeStream.format("parquet").option("path", f"{out}/rows")
    writer.option("checkpointLocation", f"{out}/at").trigger(availableNow=True).start().awaitTermination()
    return _stamp(spark.read.parquet(f"{out}/rows"), "previous", "ts").select(
        "device", "session_id", "id", "previous", "ts", "gap_seconds", "message")


@query
def stream_retry_audit(spark, sf):
    """Ended sessions arrive in the order of their first ids, in several micro-batches."""
    out, parts = _folder(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    ended = derived.stored_sessions(spark, sf).filter("ended_at IS NOT NULL")
    cuts = ended.approxQuantile("first_id", [i / 5 for i in range(1, 5)], 0.01) if ended.limit(1).count() else []
    bounds = [float("-inf"), *cuts, float("inf")]
    for low, high in zip(bounds, bounds[1:]):
        ended.filter((F.col("first_id") > low) & (F.col("first_id") <= high)).repartition(parts).write.mode("append").parquet(f"{out}/in")
    stream = spark.readStream.schema(ended.schema).option("maxFilesPerTrigger", parts).parquet(f"{out}/in")
    lifecycle.audit_retries(stream, out, f"{out}/at", once=True, reset_after=4 * 86400.0).awaitTermination()
    return spark.read.parquet(f"{out}/audit").drop("batch")


@query
def stream_snapshot_changes(spark, sf):
    docs = _stream(spark, sf, "documents", derived.DOCUMENTS_SCHEMA)
    out = _folder(spark)
    changes.snapshot_changes(derived.snapshot_rows(docs), out, f"{out}/at", once=True).awaitTermination()
    return spark.read.parquet(f"{out}/changes").select("id", "device", "content_hash")


@query
def stream_idle(spark, sf):
    log = _event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("session_id", F.concat("device", F.lit("-all")))
    out = _folder(spark)
    writer = changes.idle_sessions(log, 36_000).writeStream.format("parquet").option("path", f"{out}/rows")
    writer.option("checkpointLocation", f"{out}/at").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return _stamp(rows, "active_from", "silent_since").select("session_id", "device", "active_from", "silent_since", "rows")
