"""They decide results, so they are stated here once, as plain text."""

# --- event types, in declaration order ---
EVENT_TYPES = (
    "log", "session_start", "session_end", "connected", "disconnected",
    "retry_scheduled", "gap", "collector_error",
)

# --- log levels, lowest first, and the one-letter codes devices print ---
LEVELS = ("VERY_VERBOSE", "DEBUG", "CONFIG", "INFO", "WARNING", "ERROR", "CRITICAL")
LEVEL_LETTERS = {
    "V": "VERY_VERBOSE", "D": "DEBUG", "C": "CONFIG", "I": "INFO", "W": "WARNING", "E": "ERROR",
}
TOOL_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")

# --- device states ---
STATES = ("starting", "connecting", "connected", "backoff", "stopped")

# --- columns of exported events ---
EXPORT_COLUMNS = (
    "id", "timestamp", "device", "address", "session_id", "event_type", "level", "component", "device_time", "message", "raw",
)

# --- reserved texts ---
SHUTDOWN_REASON = "collector shutting down"
CRASH_REASON = "collector_crashed_or_killed"
CAPTURE_SESSION = "config-capture"
REDACTED = "[REDACTED]"
CONNECTED_PREFIX = "Successfully connected"
RAW_COPY_MARK = "# collector "

# --- patterns shared by every engine (Java, Python and RE2 read them alike) ---
ANSI = r"\x1b(?:\[[0-?]*[ -/]*[@-~]|\][^\x07\x1b]*(?:\x07|\x1b\\)|[@-Z\\-_])"
DEVICE_NAME = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,63}$"
HOST_NAME = r"^[A-Za-z0-9]([A-Za-z0-9._-]{0,251}[A-Za-z0-9])?$"
PEM_BEGIN = r"-----BEGIN [A-Z ]*(?:PRIVATE KEY|CERTIFICATE)-----"
PEM_END = r"-----END [A-Z ]*(?:PRIVATE KEY|CERTIFICATE)-----"
SENSITIVE_KEY = (
    "pass(word|wd|phrase)|psk|secret|token|key|credential|auth|bearer|"
    "private|cert|signature|pairing"
)
DIAGNOSTIC_PHRASES = (
    "failed config", "failed to", "error", "exception", "invalid", "not found",
    "no such file", "could not", "unable to", "traceback",
)

# --- numeric limits and defaults ---
MAX_LINE_BYTES = 1024 * 1024
PAGE_SIZE_DEFAULT = 100
TAIL_LIMIT = 200
LAST_LINE_STRIDE = 50
EXCERPT_FIRST, EXCERPT_LAST, EXCERPT_DIAGNOSTIC, EXCERPT_CHARS = 8, 16, 8, 400
ERROR_TEXT_CHARS = 500
MIN_SECRET_LENGTH = 4
STALE_TEMP_SECONDS = 24 * 3600
EXPORT_FORMAT_VERSION = 1
BUILTIN_SETTINGS = {
    "retry_initial_delay": 2.0, "retry_max_delay": 300.0, "retry_multiplier": 2.0,
    "retry_jitter": 0.2, "retry_reset_after": 60.0, "idle_timeout": 0.0,
    "api_port": 6053, "api_connect_timeout": 30.0,
}
