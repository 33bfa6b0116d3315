"""The same results in DuckDB SQL, written independently of the Spark expressions."""

from __future__ import annotations

from lograft import fixed

SQL: dict[str, str] = {}

ANSI = fixed.ANSI
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
KEY_LINE = rf"""^([{SPACE}]*)((?:-[{SPACE}]+)*)("[^"]*"|'[^']*'|[^{SPACE}:#'"][^:#]*?)[{SPACE}]*:(?:[{SPACE}]+|$)(.*)$"""
STORED = "%Y-%m-%dT%H:%M:%S.%fZ"
TYPED = "CASE c WHEN 'signup' THEN 'session_start' WHEN 'error' THEN 'collector_error' ELSE 'log' END"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


EVENTS = rf"""
src AS (
  SELECT event_id AS id, ts, user_id, event_type AS c, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         CAST(round(value * 100) AS BIGINT) AS v FROM events),
base AS (
  SELECT id, ts, 'dev-' || user_id AS device, '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS address,
         {TYPED} AS event_type,
         CASE WHEN c IN ('signup', 'error') THEN c || ' code=' || k
              WHEN k % 10 = 0 THEN 'INFO reading ' || c || ' value=' || v
              WHEN k % 10 = 1 THEN 'free text ' || chr(27) || '[31m' || c || chr(27) || '[0m ' || v
              ELSE '[' || strftime(ts, '%H:%M:%S') || ']' || chr(27) || '[0;32m['
                   || substr('VDCIWE', CAST(k % 6 AS INTEGER) + 1, 1) || '][' || c || ':' || k || ']: value=' || v
                   || chr(27) || '[0m' END AS raw
  FROM src),
numbered AS (
  SELECT *, device || '-' || count(*) FILTER (WHERE event_type = 'session_start')
            OVER (PARTITION BY device ORDER BY id ROWS UNBOUNDED PRECEDING) AS session_id FROM base),
cleaned AS (SELECT *, regexp_replace(raw, '{ANSI}', '', 'g') AS clean FROM numbered),
matched AS (
  SELECT *, event_type = 'log' AND regexp_matches(clean, '(?s)^\[\d{{1,2}}:\d{{2}}:\d{{2}}(\.\d+)?\]\[[VDCIWE]\]\[[^\]:]*(:\d+)?\]') AS dev,
         event_type = 'log' AND regexp_matches(clean, '(?s)^(DEBUG|INFO|WARNING|ERROR|CRITICAL) ') AS tool FROM cleaned),
ev AS (
  SELECT id, ts, device, address, session_id, event_type, raw, clean,
    CASE WHEN dev THEN CASE regexp_extract(clean, '^\[[^\]]*\]\[(.)\]', 1) WHEN 'V' THEN 'VERY_VERBOSE' WHEN 'D' THEN 'DEBUG'
           WHEN 'C' THEN 'CONFIG' WHEN 'I' THEN 'INFO' WHEN 'W' THEN 'WARNING' WHEN 'E' THEN 'ERROR' END
         WHEN tool THEN split_part(clean, ' ', 1) END AS level,
    CASE WHEN dev THEN nullif(regexp_extract(clean, '^\[[^\]]*\]\[.\]\[([^\]:]*)', 1), '') END AS component,
    CASE WHEN dev THEN regexp_extract(clean, '^\[([^\]]*)\]', 1) END AS device_time,
    CASE WHEN dev THEN regexp_extract(clean, '(?s)^\[[^\]]*\]\[.\]\[[^\]]*\]:? ?(.*)$', 1)
         WHEN tool THEN regexp_extract(clean, '(?s)^[A-Z]+ (.*)$', 1)
         WHEN event_type = 'log' THEN clean ELSE raw END AS message
  FROM matched)"""

SESSIONS = """
per_session AS (
  SELECT session_id, device, min(id) AS first_id, min(ts) AS started_at, max(ts) AS last_at,
         count(*) FILTER (WHERE event_type = 'log') AS line_count FROM ev GROUP BY ALL),
sess AS (
  SELECT session_id, device, first_id, started_at,
         CASE WHEN lead(first_id) OVER w IS NOT NULL THEN last_at END AS ended_at,
         CASE WHEN lead(first_id) OVER w IS NOT NULL THEN 'device disconnected' END AS end_reason, line_count
  FROM per_session WINDOW w AS (PARTITION BY device ORDER BY first_id))"""

STATUS = """
faults AS (SELECT device, max_by(raw, id) AS last_error, max_by(ts, id) AS last_error_at FROM ev WHERE event_type = 'collector_error' GROUP BY 1),
starts AS (SELECT device, max_by(session_id, id) AS session_id, max_by(ts, id) AS updated_at, count(*) AS attempts
           FROM ev WHERE event_type = 'session_start' GROUP BY 1),
st AS (
  SELECT d.device, d.address, CASE WHEN s.device IS NULL THEN 'starting' ELSE 'connecting' END AS state, s.session_id,
         s.updated_at, f.last_error, f.last_error_at, coalesce(s.attempts, 0) AS attempts, CAST(NULL AS VARCHAR) AS next_retry_at
  FROM (SELECT device, max_by(address, id) AS address FROM ev GROUP BY 1) d
  LEFT JOIN starts s USING (device) LEFT JOIN faults f USING (device))"""

LINES = """
split_docs AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
exploded AS (SELECT doc_id, CAST(unnest(range(len(parts))) AS BIGINT) AS line_no, unnest(parts) AS t FROM split_docs),
dl AS (
  SELECT doc_id * 1048576 + line_no AS id, doc_id, line_no,
    CASE WHEN doc_id % 7 = 1 THEN 'see mqtt://user:pw' || line_no || '@host/x ' || t
         WHEN doc_id % 7 = 2 THEN '  - password: ' || t
         WHEN doc_id % 7 = 3 THEN 'note legacy-token-' || line_no || ' ' || t
         WHEN doc_id % 7 = 4 THEN 'id s3cr3t-value ' || t
         WHEN doc_id % 7 = 0 AND line_no % 11 = 4 THEN 'ERROR Failed to read ' || t
         WHEN doc_id % 7 = 5 AND line_no % 4 = 0 THEN '  api_key: |'
         WHEN doc_id % 7 = 5 THEN repeat(' ', line_no % 4 * 2) || t
         WHEN doc_id % 7 = 6 AND line_no % 9 = 1 THEN 'x -----BEGIN RSA PRIVATE KEY-----'
         WHEN doc_id % 7 = 6 AND line_no % 9 = 3 THEN '-----END RSA PRIVATE KEY-----'
         ELSE t END AS line
  FROM exploded)"""

SNAPS = """
snap AS (
  SELECT doc_id * 2 + again AS id, source AS device,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS BIGINT)) + to_seconds(again * 20) AS captured_at, sha256(lang) AS source_hash,
    'name: ' || source || chr(10) || 'lang: ' || lang || chr(10) || 'wifi:' || chr(10) || '  password: pw-' || (doc_id % 7) || chr(10)
      || 'key: |' || chr(10) || '  inner' || chr(10) || 'url: http://u:p@h/' || chr(10) || coalesce(text, '') AS content
  FROM (SELECT *, unnest([0, 1]) AS again FROM documents) d)"""

UPDATES = """
su AS (
  SELECT event_id AS seq, ts, 'dev-' || user_id AS device,
    CASE event_type WHEN 'signup' THEN 'connecting' WHEN 'error' THEN 'backoff' ELSE 'connected' END AS state,
    CASE WHEN k % 3 = 0 THEN '10.1.0.' || k END AS address,
    CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'cli' ELSE 'api' END END AS backend,
    CASE WHEN k % 3 = 0 THEN 'explicit' END AS source,
    CASE WHEN event_type = 'error' THEN 'error code=' || k END AS error,
    CASE WHEN event_type <> 'error' THEN 's-' || event_id END AS session_id,
    CASE WHEN event_type = 'error' THEN CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) END AS next_retry_at,
    CASE WHEN k % 5 = 0 THEN ts END AS last_line_at, CASE WHEN k % 7 = 0 THEN k END AS attempts
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))"""

REGISTRY = """
reg AS (
  SELECT s_suppkey AS pos,
    CASE WHEN n % 4 = 0 THEN s_name WHEN n % 10 = 1 THEN 'Node-' || (n // 20) ELSE 'node-' || (n % 40) END AS name,
    CASE WHEN n % 3 <> 0 THEN CASE WHEN n % 11 = 0 THEN 'bad host!' ELSE '10.2.0.' || (n % 256) END END AS address,
    CASE WHEN n % 2 = 0 THEN 'alias-' || n END AS alias,
    CASE WHEN n % 5 = 0 THEN '/configs/' || n || '.yaml' END AS config_file,
    CASE WHEN n % 6 = 1 THEN CASE WHEN n % 12 = 1 THEN 'cli' ELSE 'serial' END END AS backend,
    CASE WHEN n % 7 = 0 THEN CAST(n % 5 AS DOUBLE) END AS retry_initial_delay,
    CASE WHEN n % 7 = 0 THEN CAST(n % 4 AS DOUBLE) END AS retry_max_delay,
    CASE WHEN n % 9 = 0 THEN 0.5::DOUBLE END AS retry_multiplier,
    CASE WHEN n % 8 = 0 THEN 1.5::DOUBLE END AS retry_jitter,
    CASE WHEN n % 13 = 0 THEN (-1.0)::DOUBLE END AS retry_reset_after,
    CASE WHEN n % 10 = 3 THEN 45.0::DOUBLE END AS idle_timeout,
    CASE WHEN n % 10 = 7 THEN 70000::BIGINT END AS api_port,
    CASE WHEN n % 15 = 0 THEN 0.0::DOUBLE END AS api_connect_timeout
  FROM (SELECT *, s_suppkey AS n FROM supplier)),
eff AS (
  SELECT pos, name, address, alias, config_file, backend, coalesce(retry_initial_delay, 5.0) AS retry_initial_delay,
    coalesce(retry_max_delay, 300.0) AS retry_max_delay, coalesce(retry_multiplier, 2.0) AS retry_multiplier,
    coalesce(retry_jitter, 0.2) AS retry_jitter, coalesce(retry_reset_after, 60.0) AS retry_reset_after,
    coalesce(idle_timeout, 30.0) AS idle_timeout, coalesce(api_port, 6053) AS api_port,
    coalesce(api_connect_timeout, 30.0) AS api_connect_timeout FROM reg)"""

FOUND = """
found AS (
  SELECT c_custkey AS pos,
    CASE WHEN c_custkey % 13 = 0 THEN 'Sensor-' || (c_custkey % 97) WHEN c_custkey % 17 = 0 THEN 'cam-' || (c_custkey % 31)
         ELSE 'sensor-' || (c_custkey % 97) END AS name,
    CASE WHEN c_custkey % 19 <> 0 THEN '10.1.' || c_nationkey || '.' || (c_custkey % 50) END AS address FROM customer),
existing AS (
  SELECT 'Sensor-' || (s_suppkey % 9) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'CAM-' || (s_suppkey % 5) END AS alias,
    CASE WHEN s_suppkey % 3 = 0 THEN '10.1.' || (s_suppkey % 25) || '.' || (s_suppkey % 50) END AS address FROM supplier)"""

LISTING = """
listing AS (
  SELECT CASE WHEN n % 10 = 3 THEN 'notes-' || n || '.txt' WHEN n % 10 = 7 THEN '.export-tmp-' || n
              WHEN n % 10 = 9 THEN 'device-log-export-' || n || '.tar.gz'
              ELSE 'device-log-export-' || strftime(mtime, '%Y%m%dT%H%M%SZ') || '-' || lpad(lower(to_hex(n)), 8, '0') || '.tar.gz' END AS name,
         n_chars AS length, mtime
  FROM (SELECT doc_id AS n, n_chars, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id * 43 % 43000 AS BIGINT)) AS mtime FROM documents))"""

SIZES = """
sized AS (
  SELECT *, 35 + strlen(device) + coalesce(strlen(address), 0) + strlen(session_id) + strlen(event_type) + coalesce(strlen(level), 0)
    + coalesce(strlen(component), 0) + coalesce(strlen(device_time), 0) + coalesce(strlen(message), 0) + strlen(raw) AS bytes FROM ev)"""

SEARCH = "id, ts, device, session_id, event_type, level, component, message, raw, clean"


def define(name: str, body: str, *ctes: str) -> None:
    SQL[name] = ("WITH " + ",".join(ctes) + "\n" if ctes else "") + body


def page(name: str, where: str, size: int, offset: int = 0) -> None:
    define(name, f"""
SELECT {SEARCH}, n > {size} AS has_next FROM (
  SELECT *, row_number() OVER (ORDER BY ts DESC, id DESC) AS rn, count(*) OVER () AS n FROM (
    SELECT * FROM ev WHERE {where} ORDER BY ts DESC, id DESC LIMIT {size + 1} OFFSET {offset}))
WHERE rn <= {size}""", EVENTS)


def minimum(level: str) -> str:
    names = fixed.LEVELS[fixed.LEVELS.index(level):]
    return "level IN (" + ", ".join(lit(n) for n in names) + ")"


# --- lines ---
define("event_rows", "SELECT id, ts, device, address, session_id, event_type, level, component, device_time, message, raw FROM ev", EVENTS)
define("parse_lines", "SELECT id, event_type, clean, level, component, device_time, message FROM ev", EVENTS)
define("strip_ansi", "SELECT id, clean FROM ev", EVENTS)
define("level_rank", "SELECT level, count(*) AS n, CASE level " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(fixed.LEVELS))
       + " END AS level_rank FROM ev GROUP BY 1", EVENTS)
define("connected_lines", "SELECT id, device, raw FROM ev WHERE device_time IS NOT NULL OR starts_with(message, 'Successfully connected')", EVENTS)
DIAGNOSTIC = "(?i)" + "|".join(fixed.DIAGNOSTIC_PHRASES)
define("diagnostic_lines", f"SELECT doc_id, line_no FROM dl WHERE regexp_matches(line, '{DIAGNOSTIC}')", LINES)
define("message_parts", """
SELECT conv_id, turn, CAST(unnest(range(len(p))) AS BIGINT) AS part,
  '[' || strftime(TIMESTAMP '2024-03-01 10:00:00' + to_seconds(conv_id * 60 + turn), '%H:%M:%S') || ']' || rtrim(unnest(p), chr(13)) AS raw
FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS p FROM conversations)""")
define("short_texts", """
SELECT doc_id, substr(text, 1, 400) AS first_400, right(text, 500) AS last_500,
  CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.1f KiB', s / 1024.0)
       WHEN s < 1073741824 THEN printf('%.1f MiB', s / 1048576.0) WHEN s < 1099511627776 THEN printf('%.1f GiB', s / 1073741824.0)
       ELSE printf('%.1f TiB', s / 1099511627776.0) END AS size, sha256(text) AS digest
FROM (SELECT *, n_chars * n_chars AS s FROM documents)""")
define("time_texts", f"""SELECT event_id, strftime(ts, '{STORED}') AS stored, strftime(ts, '%Y-%m-%d %H:%M:%S') AS short,
  strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM events""")
define("parse_time_texts", """
SELECT event_id, strftime(CASE event_id % 5 WHEN 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) WHEN 1 THEN date_trunc('second', ts)
  WHEN 2 THEN ts WHEN 3 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END, '%Y-%m-%d %H:%M:%S.%f') AS parsed FROM events""")
define("tail_lines", f"""SELECT id, strftime(ts, '{STORED}') || ' [' || device || '] [' || coalesce(level, '') || '] [' || coalesce(component, '')
  || '] ' || CASE WHEN event_type = 'log' THEN '' ELSE '[' || event_type || ']' END || ' ' || clean AS line FROM ev""", EVENTS)
_FIELDS = " || ',' || ".join(
    f"""'"{c}":' || coalesce('"' || replace({"strftime(ts, '" + STORED + "')" if c == 'ts' else c}, chr(27), '\\u001B') || '"', 'null')"""
    for c in ("ts", "device", "session_id", "event_type", "level", "component", "message", "raw", "clean"))
define("event_json", f"""SELECT id, '{{"id":' || id || ',' || {_FIELDS} || '}}' AS event FROM ev""", EVENTS)
define("event_messages", f"""
SELECT seq, printf('retry in %.1fs (attempt %d) at ', seq / 8.0, seq % 9 + 1) || strftime(ts, '{STORED}') AS retry,
  printf('device %s (%d lines this session)', state, seq % 70) AS bye, seq % 9 + 1 AS attempt, strftime(ts, '{STORED}') AS retry_at,
  'device ' || state AS reason, seq % 70 AS lines FROM su""", UPDATES)

# --- search and tail ---
page("search_level_min", minimum("WARNING"), 50)
page("search_text_literal", "contains(lower(raw), 'value=1')", 100)
page("search_time_range", "ts >= '2024-01-10' AND ts < '2024-01-12 12:00:00'", 500)
page("search_combined", minimum("WARNING") + " AND contains(raw, 'value=') AND ts >= '2024-01-10' AND ts < '2024-01-20'", 50)
page("search_device_type", "device = 'dev-7' AND event_type = 'collector_error'", 500)
page("search_page2_has_next", "event_type = 'log'", 30, 30)
page("search_after_cursor", minimum("ERROR") + " AND ts < '2024-01-15 00:00:00'", 40)
define("tail_after_cursor", f"SELECT {SEARCH} FROM ev WHERE id > 400 AND {minimum('INFO')} ORDER BY id LIMIT 200", EVENTS)
define("tail_initial_view", f"""SELECT {SEARCH}, (SELECT max(id) FROM ev) AS cursor
FROM ev WHERE event_type = 'log' ORDER BY ts DESC, id DESC LIMIT 100""", EVENTS)
define("high_water_id", "SELECT coalesce(max(event_id), 0) AS high_water_id FROM events")

# --- status ---
define("log_summary", """SELECT device, count(*) AS log_count, min(ts) AS first_log_at, max(ts) AS last_log_at
FROM ev WHERE event_type = 'log' GROUP BY 1""", EVENTS)
define("last_event", "SELECT device, max(ts) AS last_event_at FROM ev GROUP BY 1", EVENTS)
define("status_from_events", "SELECT * FROM st", EVENTS, STATUS)
SPAN = """CASE WHEN {a} IS NULL OR {b} IS NULL THEN '-'
  WHEN {m} >= 1440 THEN ({m} // 1440) || 'd' || CASE WHEN {m} % 1440 // 60 > 0 THEN ' ' || ({m} % 1440 // 60) || 'h' ELSE '' END
  WHEN {m} >= 60 THEN ({m} // 60) || 'h' || CASE WHEN {m} % 60 > 0 THEN ' ' || ({m} % 60) || 'm' ELSE '' END
  WHEN {m} > 0 THEN {m} || ' min' ELSE '<1 min' END"""


def span(a: str, b: str) -> str:
    return SPAN.format(a=a, b=b, m=f"((epoch_us({b}) - epoch_us({a})) // 60000000)")


define("status_rollup", f"""
SELECT st.*, coalesce(l.n, 0) AS log_count, l.a AS first_log_at, l.b AS last_log_at, {span('l.a', 'l.b')} AS log_span,
  coalesce(last_error, 'none') AS shown_error
FROM st LEFT JOIN (SELECT device, count(*) AS n, min(ts) AS a, max(ts) AS b FROM ev WHERE event_type = 'log' GROUP BY 1) l USING (device)
""", EVENTS, STATUS)
define("status_update_fold", """
SELECT device, last(address ORDER BY seq) FILTER (WHERE address IS NOT NULL) AS address,
  last(backend ORDER BY seq) FILTER (WHERE backend IS NOT NULL) AS backend, last(source ORDER BY seq) FILTER (WHERE source IS NOT NULL) AS source,
  last(state ORDER BY seq) AS state, last(session_id ORDER BY seq) AS session_id, last(ts ORDER BY seq) AS updated_at,
  last(last_line_at ORDER BY seq) FILTER (WHERE last_line_at IS NOT NULL) AS last_line_at,
  last(error ORDER BY seq) FILTER (WHERE error IS NOT NULL) AS last_error, last(ts ORDER BY seq) FILTER (WHERE error IS NOT NULL) AS last_error_at,
  coalesce(last(attempts ORDER BY seq) FILTER (WHERE attempts IS NOT NULL), 0) AS attempts, last(next_retry_at ORDER BY seq) AS next_retry_at
FROM su GROUP BY 1""", UPDATES)
define("status_attempt_fold", """
, k AS (SELECT *, state = 'connecting' AND seq >= 700 AND seq > min(seq) OVER (PARTITION BY device) AS attempt FROM su),
s AS (SELECT device, max(seq) AS set_at, max_by(attempts, seq) AS base FROM k WHERE attempts IS NOT NULL AND NOT attempt GROUP BY 1)
SELECT k.device, last(state ORDER BY seq) AS state,
  coalesce(any_value(base), 0) + count(*) FILTER (WHERE attempt AND seq > coalesce(set_at, -1)) AS attempts,
  last(CASE WHEN NOT attempt THEN next_retry_at END ORDER BY seq) AS next_retry_at
FROM k LEFT JOIN s USING (device) GROUP BY 1""", UPDATES)
define("status_stopped", """SELECT device, address, 'stopped' AS state, CAST(NULL AS VARCHAR) AS session_id, TIMESTAMP '2024-01-31 00:00:00' AS updated_at,
  last_error, last_error_at, attempts, next_retry_at FROM st""", EVENTS, STATUS)
define("device_attempts", "SELECT device, count(*) FILTER (WHERE event_type = 'session_start') AS attempts FROM ev GROUP BY 1", EVENTS)
define("known_devices", "SELECT DISTINCT device FROM ev UNION SELECT 'x-' || device FROM st", EVENTS, STATUS)
define("selected_devices", "SELECT 'n-' || s_suppkey AS device FROM supplier")
define("log_span_text", f"SELECT session_id, {span('a', 'b')} AS span FROM (SELECT session_id, min(ts) FILTER (WHERE event_type = 'log') AS a, "
       "max(ts) FILTER (WHERE event_type = 'log') AS b FROM ev GROUP BY 1)", EVENTS)
define("time_ago_text", """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '-' WHEN s < 60 THEN s || ' sec ago' WHEN s < 3600 THEN (s // 60) || ' min ago'
  WHEN s < 86400 THEN (s // 3600) || ' hr ago' ELSE (s // 86400) || ' days ago' END AS ago
FROM (SELECT event_id, greatest(0, CAST(floor((epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(ts)) / 1000000.0) AS BIGINT)) AS s FROM events)""")

# --- sessions ---
define("sessions_derived", """
SELECT session_id, device, max_by(address, id) AS address, min(id) AS first_id,
  coalesce(min(ts) FILTER (WHERE event_type = 'session_start'), min(ts)) AS started_at,
  max(ts) FILTER (WHERE event_type = 'collector_error') AS ended_at, count(*) FILTER (WHERE event_type = 'log') AS line_count,
  CASE WHEN count(*) FILTER (WHERE event_type = 'collector_error') > 0 THEN 'device gone' END AS end_reason FROM ev GROUP BY ALL""", EVENTS)
define("disconnect_audit", """
SELECT session_id, count(*) FILTER (WHERE event_type = 'log') AS stored_lines,
  (max(id) FILTER (WHERE event_type = 'collector_error')) % 7 AS said_lines FROM ev GROUP BY 1""", EVENTS)
define("session_line_counts", "SELECT session_id, count(*) FILTER (WHERE event_type = 'log') AS line_count FROM ev GROUP BY 1", EVENTS)
define("line_numbers", "SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY id) AS line_no FROM ev WHERE event_type = 'log'", EVENTS)
define("session_gaps", f"""
SELECT device, session_id, id, previous, ts, (epoch_us(ts) - epoch_us(previous)) / 1000000.0 AS gap_seconds,
  'no events stored between ' || strftime(previous, '{STORED}') || ' and ' || strftime(ts, '{STORED}') AS message
FROM (SELECT *, max(ts) OVER (PARTITION BY device ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM ev)
WHERE event_type = 'session_start' AND previous IS NOT NULL""", EVENTS)
define("first_connected", """SELECT session_id, device, min(id) AS id, min_by(ts, id) AS connected_at FROM ev
WHERE event_type = 'log' AND (device_time IS NOT NULL OR starts_with(message, 'Successfully connected')) GROUP BY ALL""", EVENTS)
define("throttled_last_line", """
, n AS (SELECT device || '-all' AS session_id, device, id, ts, row_number() OVER (PARTITION BY device ORDER BY id) AS n,
  min(CASE WHEN device_time IS NOT NULL THEN id END) OVER (PARTITION BY device) AS c FROM ev WHERE event_type = 'log')
SELECT session_id, device, min(ts) FILTER (WHERE id = c) AS connected_at,
  max_by(ts, id) FILTER (WHERE id = c OR (id > c AND n % 50 = 0)) AS last_line_at, max_by(ts, id) AS exact_last_line_at, count(*) AS lines
FROM n GROUP BY ALL""", EVENTS)
define("crash_closed_sessions", """
, o AS (SELECT session_id, device, first_id, started_at, CASE WHEN line_count % 3 <> 1 THEN ended_at END AS ended_at,
  CASE WHEN line_count % 2 = 0 THEN end_reason END AS end_reason, line_count FROM sess)
SELECT session_id, device, first_id, started_at, line_count, coalesce(ended_at, lead(started_at) OVER w) AS ended_at,
  CASE WHEN ended_at IS NULL AND lead(started_at) OVER w IS NOT NULL THEN coalesce(end_reason, 'collector_crashed_or_killed') ELSE end_reason END AS end_reason
FROM o WINDOW w AS (PARTITION BY device ORDER BY first_id)""", EVENTS, SESSIONS)
define("idle_breaks", """
SELECT session_id, device, id, p AS silent_since, ts AS resumed_at, (epoch_us(ts) - epoch_us(p)) / 1000000.0 AS silent_seconds
FROM (SELECT *, lag(ts) OVER (PARTITION BY session_id ORDER BY id) AS p FROM ev) WHERE epoch_us(ts) - epoch_us(p) > 36000000000""", EVENTS)
define("sessions_overlapping", "SELECT * FROM sess WHERE (ended_at IS NULL OR ended_at >= '2024-01-10') AND started_at < '2024-01-12 12:00:00'", EVENTS, SESSIONS)
define("failure_excerpt", f"""
, d AS (SELECT *, regexp_matches(line, '{DIAGNOSTIC}') AS diag FROM dl),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY id DESC) AS back,
  row_number() OVER (PARTITION BY doc_id, diag ORDER BY id DESC) AS dback FROM d WHERE doc_id IN (SELECT doc_id FROM d WHERE diag)),
p AS (SELECT doc_id, n, substr(line, 1, 400) AS t FROM f WHERE (n <= 8 OR back <= 16 OR (diag AND dback <= 8)) AND line <> ''),
q AS (SELECT *, n - lag(n) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS gap FROM p)
SELECT CAST(doc_id AS VARCHAR) AS session_id, count(*) AS shown_lines,
  string_agg(CASE WHEN gap > 0 THEN '... ' || gap || ' lines omitted ...' || chr(10) ELSE '' END || t, chr(10) ORDER BY n) AS excerpt
FROM q GROUP BY doc_id""", LINES)
def backoff(multiplier: str) -> str:
    return f"""
, e AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY first_id) AS k, epoch_us(ended_at) - epoch_us(started_at) >= 345600000000 AS healthy
  FROM sess WHERE ended_at IS NOT NULL),
r AS (SELECT *, coalesce(max(CASE WHEN healthy THEN k END) OVER (PARTITION BY device ORDER BY first_id ROWS UNBOUNDED PRECEDING), 1) AS z FROM e),
b AS (SELECT device, session_id, first_id, k - z + 1 AS attempt, least(300.0::DOUBLE, 2.0::DOUBLE * pow({multiplier}::DOUBLE, k - z)) AS base_delay FROM r)
SELECT *, greatest(0.05::DOUBLE, base_delay * 0.8::DOUBLE) AS min_delay, greatest(0.05::DOUBLE, base_delay * 1.2::DOUBLE) AS max_delay FROM b"""


define("backoff_audit", backoff("2.0"), EVENTS, SESSIONS)
define("backoff_audit_slow", "SELECT device, session_id, attempt, round(base_delay, 6) AS base_delay FROM ("
       + backoff("1.001").replace(", e AS", "WITH e AS", 1) + ")", EVENTS, SESSIONS)

# --- retention ---
NOW = "TIMESTAMP '2024-01-31 00:00:00'"
AGED = "ts < TIMESTAMP '2024-01-11 00:00:00'"
define("stored_bytes", "SELECT CAST(sum(bytes) AS BIGINT) AS stored_bytes FROM sized", EVENTS, SIZES)
define("retention_age", f"SELECT id FROM ev WHERE NOT {AGED}", EVENTS)
define("retention_device_age", """SELECT id FROM ev WHERE NOT (device = 'dev-1' AND ts < TIMESTAMP '2024-01-26 00:00:00')
  AND NOT (device = 'dev-3' AND ts < TIMESTAMP '2024-01-23 12:00:00')""", EVENTS)
define("retention_device_count", """SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY id DESC) AS n FROM ev)
WHERE NOT (device = 'dev-2' AND n > 25) AND NOT (device = 'dev-3' AND n > 10)""", EVENTS)
BATCH = "(SELECT greatest(1, count(*) // 20) FROM events)"
define("retention_size_cap", f"""
, c AS (SELECT id, row_number() OVER (ORDER BY id) AS n, sum(bytes) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS gone, sum(bytes) OVER () AS total FROM sized),
k AS (SELECT coalesce(min(CAST(ceil(n / CAST({BATCH} AS DOUBLE)) AS BIGINT)), 0) AS batches FROM c WHERE total - CAST(floor(total * 0.6::DOUBLE) AS BIGINT) > 0 AND gone >= total - CAST(floor(total * 0.6::DOUBLE) AS BIGINT))
SELECT id FROM c, k WHERE n > batches * {BATCH}""", EVENTS, SIZES)
define("retention_budget", f"""
SELECT id, 'events_age' AS policy FROM (SELECT id, row_number() OVER (ORDER BY ts, id) AS n FROM ev WHERE {AGED}) WHERE n <= 5 * {BATCH}""", EVENTS)
# Device rules in configuration order: dev-1 age, dev-2 count, dev-3 age, dev-3 count, dev-99999 age.
FULL = f"""
s0 AS (SELECT * FROM sized),
d1 AS (SELECT id, row_number() OVER (ORDER BY ts, id) AS n FROM s0 WHERE {AGED}),
r1 AS (SELECT * FROM s0 WHERE NOT {AGED}),
d2 AS (SELECT id FROM r1 WHERE device = 'dev-1' AND ts < TIMESTAMP '2024-01-26 00:00:00'),
d3 AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id DESC) AS n FROM r1 WHERE device = 'dev-2') WHERE n > 25),
d4 AS (SELECT id FROM r1 WHERE device = 'dev-3' AND ts < TIMESTAMP '2024-01-23 12:00:00'),
d5 AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id DESC) AS n FROM r1 WHERE device = 'dev-3' AND ts >= TIMESTAMP '2024-01-23 12:00:00') WHERE n > 10),
dd AS (SELECT id FROM d2 UNION ALL SELECT id FROM d3 UNION ALL SELECT id FROM d4 UNION ALL SELECT id FROM d5),
r5 AS (SELECT id, bytes, row_number() OVER (ORDER BY id) AS n, sum(bytes) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS gone
       FROM r1 WHERE id NOT IN (SELECT id FROM dd)),
cap AS (SELECT CAST(floor(sum(bytes) * 0.4::DOUBLE) AS BIGINT) AS cap, {BATCH} AS b FROM s0),
need AS (SELECT coalesce((SELECT sum(bytes) FROM r5), 0) - cap AS excess, b FROM cap),
k6 AS (SELECT CASE WHEN any_value(excess) <= 0 THEN 0 ELSE (min(n) FILTER (WHERE gone >= excess) + any_value(b) - 1) // any_value(b) END AS demand FROM r5, need),
steps0 AS (
  SELECT 1 AS step, 'events_age' AS policy, 'age' AS rule, CAST(NULL AS VARCHAR) AS device, (SELECT count(*) FROM d1) AS matching, TRUE AS runs
  UNION ALL SELECT 2, 'events_device', 'device age', 'dev-1', (SELECT count(*) FROM d2), TRUE
  UNION ALL SELECT 3, 'events_device', 'device count', 'dev-2', (SELECT count(*) FROM d3), (SELECT count(*) > 0 FROM d3)
  UNION ALL SELECT 4, 'events_device', 'device age', 'dev-3', (SELECT count(*) FROM d4), TRUE
  UNION ALL SELECT 5, 'events_device', 'device count', 'dev-3', (SELECT count(*) FROM d5), (SELECT count(*) > 0 FROM d5)
  UNION ALL SELECT 6, 'events_device', 'device age', 'dev-99999', 0, TRUE),
steps1 AS (SELECT step, policy, rule, device, matching, matching // {BATCH} + 1 AS demand FROM steps0 WHERE runs
  UNION ALL SELECT 7, 'events_size', 'size', NULL, least((SELECT count(*) FROM r5), demand * {BATCH}), demand FROM k6 WHERE demand > 0),
steps2 AS (SELECT *, 14 - coalesce(sum(demand) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM steps1),
steps AS (SELECT row_number() OVER (ORDER BY step) AS step, policy, rule, device, CAST(matching AS BIGINT) AS matching, CAST(demand AS BIGINT) AS demand,
  CAST(least(demand, rest) AS BIGINT) AS batches, CAST(least(matching, least(demand, rest) * {BATCH}) AS BIGINT) AS deleted FROM steps2 WHERE rest > 0),
full_run AS (
  SELECT id, 'events_age' AS policy FROM d1 WHERE n <= (SELECT deleted FROM steps WHERE rule = 'age')
  UNION ALL SELECT id, 'events_device' FROM dd
  UNION ALL SELECT id, 'events_size' FROM r5 WHERE n <= coalesce((SELECT deleted FROM steps WHERE rule = 'size'), 0))"""
define("retention_full_run", "SELECT id, policy FROM full_run", EVENTS, SIZES, FULL)
define("retention_applied", """SELECT id, device, bytes AS row_bytes, strftime(ts, '%Y-%m-%d') AS event_date FROM sized
WHERE id NOT IN (SELECT id FROM full_run)""", EVENTS, SIZES, FULL)
define("append_twice", f"""SELECT id, device, strftime(captured_at, '{STORED}') AS captured_at, 'part-' || (id % 5) AS file,
  sha256(content) AS content_hash FROM snap""", SNAPS)
define("retention_steps", "SELECT step, policy, rule, device, matching, demand, batches, deleted FROM steps", EVENTS, SIZES, FULL)
ARCHIVE = f"""
a0 AS (SELECT *, starts_with(name, '.export-tmp-') AS tmp, starts_with(name, 'device-log-export-') AND ends_with(name, '.tar.gz') AS ours,
  epoch_us({NOW}) - epoch_us(mtime) AS age FROM listing),
a1 AS (SELECT *, CASE WHEN tmp AND age > 86400000000 THEN 'tmp' WHEN ours AND age > 14 * 86400000000 THEN 'exports_age' END AS act FROM a0),
a2 AS (SELECT *, sum(CASE WHEN ours AND act IS NULL THEN length ELSE 0 END) OVER (ORDER BY mtime DESC, name ROWS UNBOUNDED PRECEDING) AS newer FROM a1),
arch AS (SELECT name, length, coalesce(act, CASE WHEN ours AND newer > 300000 THEN 'exports_size' END) AS action FROM a2)"""
PRUNED = """
kept AS (SELECT id, device, row_number() OVER (PARTITION BY device ORDER BY id DESC) AS n FROM snap WHERE captured_at >= TIMESTAMP '2024-01-01 12:00:00')"""
define("retention_run_stats", """
SELECT count(*) FILTER (WHERE policy = 'events_age') AS events_age, count(*) FILTER (WHERE policy = 'events_device') AS events_device,
  count(*) FILTER (WHERE policy = 'events_size') AS events_size,
  (SELECT count(*) FROM sess WHERE ended_at IS NOT NULL AND session_id NOT IN (SELECT session_id FROM ev WHERE id NOT IN (SELECT id FROM full_run))) AS sessions,
  (SELECT count(*) FROM snap WHERE id NOT IN (SELECT id FROM kept WHERE n <= 4)) AS config_snapshots,
  (SELECT count(*) FROM arch WHERE action IN ('exports_age', 'exports_size')) AS exports,
  (SELECT count(*) FROM arch WHERE action = 'tmp') AS tmp,
  (SELECT count(*) FROM ev WHERE event_type = 'log' AND id IN (SELECT id FROM full_run)) AS deleted_log_lines
FROM full_run""", EVENTS, SIZES, FULL, SESSIONS, SNAPS, PRUNED, LISTING, ARCHIVE)
define("orphan_sessions", f"""SELECT * FROM sess WHERE ended_at IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.session_id = sess.session_id AND NOT {AGED})""", EVENTS, SESSIONS)
define("deleted_line_total", "SELECT count(*) AS retention_deleted_log_lines FROM events WHERE event_type NOT IN ('signup', 'error')")
define("snapshots_keep_last", "SELECT id, device FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY id DESC) AS n FROM snap) WHERE n <= 4", SNAPS)
define("snapshots_prune", "SELECT id, device FROM kept WHERE n <= 10", SNAPS, PRUNED)
define("archive_prune", "SELECT name, length, action FROM arch WHERE action IS NOT NULL", LISTING, ARCHIVE)
define("archive_listed", "SELECT name, length FROM listing WHERE regexp_matches(name, '^device-log-export-[0-9]{8}T[0-9]{6}Z-[0-9a-f]{8}\\.tar\\.gz$')", LISTING)

# --- snapshots ---
DEDUPED = """SELECT id, device, h AS content_hash FROM (SELECT *, sha256(content) AS h, lag(sha256(content)) OVER (PARTITION BY device ORDER BY id) AS p FROM snap)
WHERE h IS DISTINCT FROM p"""
define("snapshots_dedupe", DEDUPED, SNAPS)
define("snapshot_latest", "SELECT id, device, captured_at, source_hash, content FROM snap WHERE (device, id) IN (SELECT device, max(id) FROM snap GROUP BY 1)", SNAPS)
IN_EFFECT = """
eff_snap AS (SELECT * FROM snap WHERE captured_at >= TIMESTAMP '2024-01-01 02:00:00' AND captured_at < TIMESTAMP '2024-01-01 03:00:00'
  OR id IN (SELECT max(id) FROM snap WHERE captured_at < TIMESTAMP '2024-01-01 02:00:00' GROUP BY device))"""
define("snapshot_in_effect", "SELECT id, device, captured_at, source_hash, content FROM eff_snap", SNAPS, IN_EFFECT)
define("capture_triggers_change", """
SELECT device, seq, CASE WHEN p IS NULL THEN 'startup' ELSE 'source changed' END AS reason
FROM (SELECT device, id AS seq, event_type AS h, lag(event_type) OVER (PARTITION BY device ORDER BY id) AS p FROM ev) WHERE h IS DISTINCT FROM p""", EVENTS)
define("capture_triggers", """
, polls AS (SELECT device, id AS seq, epoch_us(ts) AS t, event_type AS h, row_number() OVER (PARTITION BY device ORDER BY id) AS n FROM ev),
walk(device, n, seq, h, last, reason) AS (
  SELECT device, n, seq, h, t, 'startup' FROM polls WHERE n = 1
  UNION ALL
  SELECT p.device, p.n, p.seq, p.h, CASE WHEN p.h <> w.h OR p.t - w.last >= 28800000000 THEN p.t ELSE w.last END,
    CASE WHEN p.h <> w.h THEN 'source changed' WHEN p.t - w.last >= 28800000000 THEN 'scheduled' END
  FROM walk w JOIN polls p ON p.device = w.device AND p.n = w.n + 1)
SELECT device, seq, reason FROM walk WHERE reason IS NOT NULL""", EVENTS)
SQL["capture_triggers"] = SQL["capture_triggers"].replace("WITH ", "WITH RECURSIVE ", 1)

# --- redaction ---
URL = rf"([a-zA-Z][a-zA-Z0-9+.-]*://)[^/{SPACE}:@]+:[^/{SPACE}@]*@"


def url(x: str) -> str:
    return f"regexp_replace({x}, {lit(URL)}, '\\1[REDACTED]@', 'g')"


def patterns(x: str) -> str:
    for p in (r"legacy-token-\w+", r'token = "[^"]*"'):
        x = f"regexp_replace({x}, {lit(p)}, '[REDACTED]', 'g')"
    return x


def known(x: str) -> str:
    return f"replace(replace({x}, 's3cr3t-value', '[REDACTED]'), 's3cr3t', '[REDACTED]')"


KEY = f"trim(regexp_extract(line, {lit(KEY_LINE)}, 3), '\"''')"
CUT = f"regexp_replace(line, {lit(KEY_LINE)}, '\\1\\2\\3: [REDACTED]')"


def sensitive(extra: str = "") -> str:
    return f"(regexp_matches(line, {lit(KEY_LINE)}) AND regexp_matches({KEY}, '(?i){fixed.SENSITIVE_KEY}{extra}'))"


def single(extra: str, scrubbed: str | None = None) -> str:
    return f"""CASE WHEN regexp_matches(line, '{fixed.PEM_BEGIN}') THEN regexp_extract(line, '(?s)^(.*?){fixed.PEM_BEGIN}', 1) || '[REDACTED]'
  WHEN {sensitive(extra)} THEN {CUT} ELSE {scrubbed or known(patterns(url('line')))} END"""


define("redact_urls", f"SELECT doc_id, line_no, {url('line')} AS line FROM dl", LINES)
define("redact_patterns", f"SELECT doc_id, line_no, {patterns('line')} AS line FROM dl", LINES)
define("redact_known", f"SELECT doc_id, line_no, {known('line')} AS line FROM dl", LINES)
define("redact_known_per_row", """SELECT doc_id, line_no,
  replace(replace(replace(line, 's3cr3t-value', '[REDACTED]'), 'value ' || (doc_id % 5), '[REDACTED]'), 'ation', '[REDACTED]') AS line FROM dl""", LINES)
define("redact_key_lines", f"SELECT doc_id, line_no, CASE WHEN {sensitive()} THEN {CUT} ELSE line END AS line FROM dl", LINES)
define("redact_single_lines", f"SELECT doc_id, line_no, {single('|^note$')} AS line FROM dl", LINES)
define("known_secret_list", """SELECT value, CAST(length(value) AS BIGINT) AS length FROM (
  SELECT DISTINCT unnest(regexp_split_to_array(text, '[ .,\n]+')) AS value FROM documents) WHERE length(value) >= 4""")

# --- fleet inventory ---
define("effective_settings", "SELECT * FROM eff", REGISTRY)
define("effective_settings_nested", """
SELECT pos, unnest(['retry.initial_delay', 'retry.max_delay', 'retry.jitter', 'api.port', CASE WHEN pos % 6 = 0 THEN 'api.noise_psk' ELSE 'api.noise_psk.file' END,
    'api.password', CASE WHEN pos % 8 = 0 THEN 'idle_timeout.seconds' ELSE 'idle_timeout' END, 'backend']) AS path,
  unnest([CASE WHEN retry_initial_delay IS NULL THEN '5.0' ELSE CAST(CAST(retry_initial_delay AS BIGINT) AS VARCHAR) END, CAST(CAST(retry_max_delay AS BIGINT) AS VARCHAR),
    '0.2', coalesce(CAST(api_port AS VARCHAR), '6053'), CASE WHEN pos % 6 = 0 THEN '{"env":"PSK_' || pos || '"}' ELSE '"/run/psk"' END, 'null',
    CASE WHEN pos % 8 = 0 THEN CAST(pos AS VARCHAR) ELSE '30.0' END, coalesce('"' || backend || '"', '"auto"')]) AS value FROM reg
""", REGISTRY)
SQL["effective_settings_nested"] = "SELECT pos, path, value FROM (" + SQL["effective_settings_nested"] + ") WHERE value IS NOT NULL"
define("backend_target", """SELECT pos, name, CASE WHEN backend IN ('cli', 'api') THEN backend WHEN config_file IS NOT NULL THEN 'cli' ELSE 'api' END AS backend,
  coalesce(address, alias || '.local') AS target FROM reg""", REGISTRY)
VALID = "regexp_matches(name, '^[A-Za-z0-9][A-Za-z0-9_.-]{0,63}$')"
_RULES = [
    ("name", "invalid device name", f"NOT {VALID}"),
    ("name", "duplicate device name", f"{VALID} AND pos > first_pos"),
    ("address", "invalid host name or address", "address = 'bad host!'"),
    ("config_file", "required by the cli backend", "backend = 'cli' AND config_file IS NULL"),
    ("backend", "must be one of auto, cli, api", "backend = 'serial'"),
    ("device", "address or alias is required", "address IS NULL AND alias IS NULL"),
    ("retry_initial_delay", "out of range", "retry_initial_delay < 0.1"),
    ("retry_max_delay", "out of range", "retry_max_delay < 0.1"),
    ("retry_multiplier", "out of range", "retry_multiplier < 1"),
    ("retry_jitter", "out of range", "retry_jitter > 1"),
    ("retry_reset_after", "out of range", "retry_reset_after < 0"),
    ("api_port", "out of range", "api_port > 65535"),
    ("api_connect_timeout", "out of range", "api_connect_timeout <= 0"),
    ("retry_max_delay", "must be >= initial delay",
     "CASE WHEN retry_max_delay < 0.1 THEN 300 ELSE retry_max_delay END < CASE WHEN retry_initial_delay < 0.1 THEN 2 ELSE retry_initial_delay END"),
]
define("registry_violations", " UNION ALL ".join(f"SELECT pos, name, '{f}' AS field, '{p}' AS problem FROM n WHERE {c}" for f, p, c in _RULES), REGISTRY,
       f"\nn AS (SELECT *, min(CASE WHEN {VALID} THEN pos END) OVER (PARTITION BY lower(name)) AS first_pos FROM eff)")
define("duplicate_names", "SELECT pos, name, first_pos FROM n WHERE pos > first_pos", REGISTRY,
       f"\nn AS (SELECT *, min(pos) OVER (PARTITION BY lower(name)) AS first_pos FROM reg WHERE {VALID})")
define("retention_targets", """SELECT device FROM (SELECT DISTINCT 'NODE-' || (s_suppkey % 60) AS device FROM supplier)
WHERE lower(device) NOT IN (SELECT lower(name) FROM reg)""", REGISTRY)
define("address_check", """SELECT c_custkey, CASE c_custkey % 6 WHEN 2 THEN FALSE WHEN 4 THEN FALSE WHEN 3 THEN length(to_hex(c_custkey)) <= 4 ELSE TRUE END AS valid FROM customer""")
WANTED = "lower(name) NOT IN ('sensor-5', 'cam-30') AND (lower(name) IN ('cam-1', 'cam-2') OR lower(name) LIKE 'sensor-%' OR lower(name) LIKE 'cam-3%')"
UNKNOWN = """lower(name) NOT IN (SELECT lower(name) FROM existing UNION SELECT lower(alias) FROM existing WHERE alias IS NOT NULL)
  AND (address IS NULL OR lower(address) NOT IN (SELECT lower(address) FROM existing WHERE address IS NOT NULL))"""
define("discovery_filter", f"SELECT pos, name, address FROM found WHERE {WANTED}", FOUND)
define("discovery_known_anti", f"SELECT pos, name, address FROM found WHERE {UNKNOWN}", FOUND)

# --- export ---
define("export_rows", f"""SELECT id, strftime(ts, '{STORED}') AS timestamp, device, address, session_id, event_type, level, component, device_time, message, raw, clean
FROM ev WHERE ts >= '2024-01-10' AND ts < '2024-01-12 12:00:00'""", EVENTS)
define("export_sessions", """SELECT * FROM sess WHERE device IN ('dev-1', 'dev-2', 'dev-7')
  AND (ended_at IS NULL OR ended_at >= '2024-01-10') AND started_at < '2024-01-12 12:00:00'""", EVENTS, SESSIONS)
define("export_status", "SELECT * FROM st WHERE device IN ('dev-2', 'dev-4', 'dev-5')", EVENTS, STATUS)
define("export_digests", "SELECT device, count(*) AS records, true AS filled FROM ev WHERE ts >= '2024-01-10' AND ts < '2024-01-12 12:00:00' GROUP BY 1", EVENTS)
define("export_manifest_counts", "SELECT device, count(*) AS events FROM ev WHERE ts >= '2024-01-10' AND ts < '2024-01-12 12:00:00' GROUP BY 1", EVENTS)

# --- stored log and streams ---
define("stored_log_rows", f"""SELECT id, level, bytes AS row_bytes, CAST(ts AS DATE) AS event_date FROM sized
WHERE ts >= '2024-01-10' AND ts < '2024-01-12 12:00:00' AND {minimum('INFO')}""", EVENTS, SIZES)
define("stream_tail", f"SELECT id, ts, device, level, clean FROM ev WHERE id > 400 AND {minimum('WARNING')}", EVENTS)
ALL_KINDS = f"""
code AS (SELECT *, CASE WHEN event_type = 'collector_error' THEN CAST(regexp_extract(raw, '([0-9]+)$', 1) AS BIGINT) END AS e FROM ev),
ak AS (
  SELECT * REPLACE (
    CASE WHEN e % 8 IN (0, 4) THEN 'disconnected' WHEN e % 8 IN (1, 5) THEN 'retry_scheduled' WHEN e % 8 = 3 THEN 'connected' ELSE event_type END AS event_type),
    CASE e % 8 WHEN 0 THEN '{fixed.SHUTDOWN_REASON}' WHEN 4 THEN 'device gone' END AS reason FROM code)"""
TOLD = """
steps AS (SELECT device, max_by({'k': event_type, 's': session_id, 't': ts, 'r': reason, 'a': 'at-' || id}, id) AS step
  FROM ak WHERE event_type IN ('session_start', 'connected', 'disconnected', 'retry_scheduled') GROUP BY 1),
errs AS (SELECT device, max_by({'i': id, 's': session_id, 't': ts, 'm': message}, id) AS err FROM ak WHERE event_type = 'collector_error' GROUP BY 1),
byes AS (SELECT device, max_by({'i': id, 's': session_id, 't': ts, 'r': reason}, id) AS bye FROM ak WHERE event_type = 'disconnected' GROUP BY 1),
seen AS (SELECT device, max_by(address, id) AS address, count(*) FILTER (WHERE event_type = 'session_start') AS attempts,
  max(ts) FILTER (WHERE event_type = 'log') AS newest_line_at FROM ak GROUP BY 1),
fold AS (
  SELECT device, address, CASE WHEN step.k = 'session_start' THEN 'connecting' WHEN step.k = 'connected' THEN 'connected'
    WHEN step.k = 'disconnected' AND step.r LIKE 'collector%' THEN 'stopped' WHEN step.k IS NULL THEN 'starting' ELSE 'backoff' END AS state,
    CASE WHEN step.k IN ('session_start', 'connected') THEN step.s END AS session_id, step.t AS updated_at,
    bye IS NOT NULL AND (err IS NULL OR (bye.s <> err.s AND bye.i > err.i)) AS gone, bye, err, attempts,
    CASE WHEN step.k = 'retry_scheduled' THEN step.a END AS next_retry_at, newest_line_at
  FROM seen LEFT JOIN steps USING (device) LEFT JOIN errs USING (device) LEFT JOIN byes USING (device)),
told AS (
  SELECT device, address, state, session_id, updated_at, CASE WHEN gone THEN bye.r ELSE err.m END AS last_error,
    CASE WHEN gone THEN bye.t ELSE err.t END AS last_error_at, attempts, next_retry_at, newest_line_at FROM fold)"""
define("status_all_kinds", "SELECT * EXCLUDE (newest_line_at) FROM told", EVENTS, ALL_KINDS, TOLD)
define("stream_status", f"""SELECT * REPLACE (strftime(updated_at, '{STORED}') AS updated_at, strftime(last_error_at, '{STORED}') AS last_error_at,
  strftime(newest_line_at, '{STORED}') AS newest_line_at) FROM told""", EVENTS, ALL_KINDS, TOLD)
define("stream_lifecycle", f"""
, n AS (SELECT session_id, device, id, ts, event_type, reason,
  CASE WHEN event_type = 'log' THEN row_number() OVER (PARTITION BY session_id, event_type = 'log' ORDER BY id) END AS n,
  min(CASE WHEN device_time IS NOT NULL THEN id END) OVER (PARTITION BY session_id) AS c FROM ak)
SELECT session_id, device, strftime(coalesce(min(ts) FILTER (WHERE event_type = 'session_start'), min(ts)), '{STORED}') AS started_at,
  strftime(max(ts) FILTER (WHERE event_type = 'disconnected'), '{STORED}') AS ended_at,
  max_by(reason, id) FILTER (WHERE event_type = 'disconnected') AS end_reason,
  count(n) AS lines, min(c) AS connected_id, strftime(min(ts) FILTER (WHERE id = c), '{STORED}') AS connected_at,
  strftime(max_by(ts, id) FILTER (WHERE id = c OR (id > c AND n % 50 = 0)), '{STORED}') AS last_line_at,
  strftime(max_by(ts, id) FILTER (WHERE event_type = 'log'), '{STORED}') AS exact_last_line_at
FROM n GROUP BY ALL""", EVENTS, ALL_KINDS)
define("stream_gaps", f"SELECT * REPLACE (strftime(previous, '{STORED}') AS previous, strftime(ts, '{STORED}') AS ts) FROM ("
       + SQL["session_gaps"].split(EVENTS, 1)[1] + ") WHERE epoch_us(ts) // 1000 < (SELECT max(epoch_us(ts)) // 1000 - 36000000 FROM ev)", EVENTS)
define("stream_retry_audit", backoff("2.0"), EVENTS, SESSIONS)
define("stream_snapshot_changes", DEDUPED, SNAPS)
define("stream_idle", f"""
, g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY device ORDER BY ts)) >= 36000000000 AS fresh FROM base),
h AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY device ORDER BY ts ROWS UNBOUNDED PRECEDING) AS stretch FROM g),
i AS (SELECT device || '-all' AS session_id, device, min(ts) AS a, max(ts) AS b, count(*) AS rows FROM h GROUP BY device, stretch)
SELECT session_id, device, strftime(a, '{STORED}') AS active_from, strftime(b, '{STORED}') AS silent_since, rows
FROM i WHERE epoch_us(b) + 36000000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM base) - 60000000""", EVENTS)

# --- line-by-line results, as recursive queries ---
BLOCKS = """
coded AS (
  SELECT *, CASE WHEN regexp_matches(line, '{begin}') THEN CASE WHEN regexp_matches(line, '(?s){begin}.*{end}') THEN 1 ELSE 3 END ELSE 0 END AS pem,
    regexp_matches(line, '{end}') AS ends, CASE WHEN regexp_matches(line, '^[{space}]*$') THEN -1 ELSE length(line) - length(ltrim(line, ' ')) END AS indent,
    CASE WHEN {sensitive} AND regexp_matches(regexp_extract(line, {key}, 4), '^[{space}]*(?:[|>][+-]?[0-9]*)?[{space}]*$')
      THEN length(regexp_extract(line, {key}, 1)) + length(regexp_extract(line, {key}, 2)) ELSE 2147483647 END AS opens,
    row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n
  FROM {lines}),
walk(doc_id, n, in_pem, block, hidden) AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT), FALSE, CAST(2147483647 AS BIGINT), FALSE FROM coded
  UNION ALL
  SELECT c.doc_id, c.n,
    CASE WHEN w.in_pem THEN NOT c.ends WHEN c.pem > 0 THEN c.pem = 3 ELSE FALSE END,
    CASE WHEN w.in_pem OR c.pem > 0 OR c.indent < 0 OR c.indent > w.block THEN w.block ELSE c.opens END,
    CASE WHEN w.in_pem THEN TRUE WHEN c.pem > 0 THEN FALSE WHEN c.indent < 0 THEN w.block <> 2147483647 ELSE c.indent > w.block END
  FROM walk w JOIN coded c ON c.doc_id = w.doc_id AND c.n = w.n + 1),
shown AS (SELECT c.doc_id, c.line_no, CASE WHEN w.hidden THEN '' ELSE {single} END AS line FROM coded c JOIN walk w ON c.doc_id = w.doc_id AND c.n = w.n)"""


def blocks(lines: str, extra: str, scrubbed: str | None = None) -> str:
    return BLOCKS.format(begin=fixed.PEM_BEGIN, end=fixed.PEM_END, space=SPACE, key=lit(KEY_LINE), sensitive=sensitive(extra),
                         single=single(extra, scrubbed), lines=lines)


define("redact_sessions", "SELECT doc_id, line_no, line FROM shown", LINES, blocks("dl", "|^note$"))
DEVICE_SECRETS = r"""
own_words AS (SELECT doc_id // 50 % 997 AS d, unnest(regexp_extract_all(text, '[a-z]{4}')[1:5]) AS value FROM documents WHERE doc_id % 50 = 0),
all_secrets AS (
  SELECT d, value FROM own_words UNION SELECT doc_id % 997, CASE WHEN doc_id % 997 % 2 = 0 THEN 's3cr3t-value' ELSE 'legacy-token' END FROM documents
  UNION SELECT doc_id % 997, 'value' FROM documents),
secret_lists AS (SELECT d, list(value ORDER BY length(value) DESC, value) AS secrets FROM all_secrets GROUP BY d),
told AS (SELECT dl.*, secrets FROM dl JOIN secret_lists ON d = doc_id % 997)"""
define("redact_device_secrets", """SELECT 'dev-' || (doc_id % 997) AS device, 'session-' || (doc_id // 997) AS session_id, doc_id, line_no, line FROM shown""",
       LINES, DEVICE_SECRETS, blocks("told", "|^note$", f"""list_reduce(list_concat([{patterns(url('line'))}], secrets),
  lambda acc, s: replace(acc, s, '[REDACTED]'))"""))
SECRET_DOCS = r"""
secret_docs AS (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'wifi:' || chr(10) || '  ssid: net' || chr(10) || '  password: pw-' || doc_id || chr(10) || 'key: |' || chr(10)
    || '  line' || chr(10) || 'url: http://u:p@h/' || chr(10) ELSE '' END || text AS text FROM documents),
cut AS (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS parts, text LIKE '%' || chr(10) AS ended FROM secret_docs),
split_lines AS (
  SELECT doc_id, CAST(unnest(range(len(p))) AS BIGINT) AS line_no, unnest(p) AS line
  FROM (SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS p FROM cut))"""
define("redact_documents", """
SELECT doc_id, coalesce(t, '') || CASE WHEN ended THEN chr(10) ELSE '' END AS text
FROM cut LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS t FROM shown GROUP BY 1) USING (doc_id)""",
       SECRET_DOCS, blocks("split_lines", ""))
SNAP_LINES = SECRET_DOCS.split("cut AS", 1)[1]
define("export_snapshots", """
SELECT id, device, 'configs/' || device || '/' || strftime(captured_at, '%Y%m%dT%H%M%SZ') || '-' || id || '.yaml' AS path,
  coalesce(t, '') || CASE WHEN ended THEN chr(10) ELSE '' END AS content
FROM eff_snap JOIN cut ON cut.doc_id = id LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS t FROM shown GROUP BY 1) s ON s.doc_id = id""",
       SNAPS, IN_EFFECT, "secret_docs AS (SELECT id AS doc_id, content AS text FROM eff_snap),cut AS" + SNAP_LINES, blocks("split_lines", "", url("line")))
define("discovery_admit", f"""
, pool AS (SELECT *, lower(name) AS low, row_number() OVER (ORDER BY lower(name), pos) AS n FROM found
  WHERE {WANTED} AND {UNKNOWN} AND address IS NOT NULL),
pick(n, names, addresses, pos) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT p.n, CASE WHEN ok THEN list_append(names, low) ELSE names END, CASE WHEN ok THEN list_append(addresses, address) ELSE addresses END, CASE WHEN ok THEN p.pos END
  FROM pick k JOIN pool p ON p.n = k.n + 1, LATERAL (SELECT NOT list_contains(names, low) AND NOT list_contains(addresses, address) AS ok))
SELECT pos, name, address FROM found WHERE pos IN (SELECT pos FROM pick WHERE pos IS NOT NULL)""", FOUND)
for _name in ("redact_sessions", "export_snapshots", "redact_device_secrets", "redact_documents", "discovery_admit"):
    SQL[_name] = SQL[_name].replace("WITH ", "WITH RECURSIVE ", 1)
