"""Line-level expressions: escape removal, parsing, predicates and message texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograft import fixed

ESC = "\x1b"

# Every line matches: "[12:34:56.789][I][wifi:123]: message", or "INFO message", or plain text.
# \p{Nd} because any Unicode digit counts as a digit.
_LINE = (
    r"(?s)^(?:\[(\p{Nd}{1,2}:\p{Nd}{2}:\p{Nd}{2}(?:\.\p{Nd}+)?)\]\[([VDCIWE])\]\[([^\]:]*)(?::\p{Nd}+)?\]:? ?"
    r"|(" + "|".join(fixed.TOOL_LEVELS) + r") )?(.*)$"
)


def strip_ansi(raw: Column) -> Column:
    return F.regexp_replace(raw, fixed.ANSI, "")


def level_name(code: Column) -> Column:
    """A printed letter or level word as level name; NULL for anything else."""
    names = {**fixed.LEVEL_LETTERS, **{w: w for w in fixed.TOOL_LEVELS}}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), code)


def level_rank(level: Column) -> Column:
    rank = F.lit(None).cast("int")
    for position, name in enumerate(fixed.LEVELS):
        rank = F.when(level == name, F.lit(position)).otherwise(rank)
    return rank


def parse(df: DataFrame, raw: str = "raw", only: Column | None = None) -> DataFrame:
    """Add clean, level, component, device_time and message.

    One regex pass rewrites any line to ``time]level]component]message`` with missing fields empty;
    the first three cannot hold ``]``, so a split in four is exact. Each result names the raw column
    once or twice, which keeps filters on it small when they are pushed below the projection. Rows
    outside ``only`` keep message = raw and have no parsed fields.
    """
    kept = [c for c in df.columns if c not in ("clean", "level", "component", "device_time", "message")]
    clean = strip_ansi(F.col(raw))
    fields = F.split(F.regexp_replace(clean, _LINE, "$1]$2$4]$3]$5"), r"\]", 4)
    rows = df.select(*kept, clean.alias("clean"), (fields if only is None else F.when(only, fields)).alias("_f"))
    part = lambda i: F.get("_f", F.lit(i))
    return rows.select(
        *kept, "clean", level_name(part(1)).alias("level"), F.nullif(part(2), F.lit("")).alias("component"),
        F.nullif(part(0), F.lit("")).alias("device_time"), F.coalesce(part(3), F.col(raw)).alias("message"),
    )


def looks_connected(device_time: Column, message: Column) -> Column:
    return device_time.isNotNull() | F.coalesce(F.startswith(message, F.lit(fixed.CONNECTED_PREFIX)), F.lit(False))


def is_diagnostic(line: Column) -> Column:
    """Any diagnostic phrase, in any case; four letters outside ASCII fold to i, s and k as well.

    One alternation over the lowered line folds it once; a chain of substring tests would fold it for each phrase.
    """
    for letter, plain in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k")):
        line = F.replace(line, F.lit(letter), F.lit(plain))
    return F.rlike(F.lower(line), F.lit("|".join(fixed.DIAGNOSTIC_PHRASES)))


def contains_ascii_folded(text: Column, needle: str) -> Column:
    """Literal substring, case-insensitive for ASCII letters only (É and é stay different)."""
    literal = r"\Q" + needle.replace(r"\E", r"\E\\E\Q") + r"\E"
    return F.rlike(text, F.lit("(?i)" + literal))


def first_chars(text: Column, n: int = fixed.EXCERPT_CHARS) -> Column:
    return F.substring(text, 1, n)


def last_chars(text: Column, n: int = fixed.ERROR_TEXT_CHARS) -> Column:
    return F.right(text, F.lit(n))


def valid_device_name(name: Column) -> Column:
    return F.rlike(name, F.lit(fixed.DEVICE_NAME))


def stamped_parts(message: Column, ts: Column) -> Column:
    """Lines of one received message, each prefixed with the receipt time of day."""
    prefix = F.concat(F.lit("["), F.date_format(ts, "HH:mm:ss"), F.lit("]"))
    return F.transform(F.split(message, "\n"), lambda p: F.concat(prefix, F.regexp_replace(p, r"\r+\z", "")))


def tail_line(ts: Column, device: Column, level: Column, component: Column, event_type: Column, clean: Column) -> Column:
    """One display line; collector events carry their type, missing fields are empty."""
    def box(c: Column) -> Column:
        return F.concat(F.lit("["), F.coalesce(c, F.lit("")), F.lit("] "))

    kind = F.when(event_type == "log", F.lit("")).otherwise(F.concat(F.lit("["), event_type, F.lit("]")))
    return F.concat(ts, F.lit(" "), box(device), box(level), box(component), kind, F.lit(" "), clean)


# --- texts of collector events, and the fields read back from them ---

def session_start_text(backend: Column) -> Column:
    return F.format_string("collection session started (backend=%s)", backend)


def gap_text(previous: Column, now: Column) -> Column:
    return F.format_string("no events stored between %s and %s", previous, now)


def disconnected_text(reason: Column, lines: Column) -> Column:
    return F.format_string("%s (%d lines this session)", reason, lines)


def one_decimal(value: Column) -> Column:
    """One decimal of the exact binary value, ties to even (``%.1f`` in Java rounds ties up)."""
    return F.translate(F.format_number(value, 1), ",", "")


def retry_text(delay: Column, attempt: Column, at: Column) -> Column:
    return F.format_string("retry in %ss (attempt %d) at %s", one_decimal(delay), attempt, at)


def retry_fields(message: Column) -> Column:
    pattern = r"^retry in ([0-9.]+)s \(attempt ([0-9]+)\) at (\S+)$"
    field = lambda i: F.nullif(F.regexp_extract(message, pattern, i), F.lit(""))
    return F.struct(
        field(1).try_cast("double").alias("delay"), field(2).try_cast("long").alias("attempt"), field(3).alias("retry_at")
    )


def disconnect_fields(message: Column) -> Column:
    pattern = r"(?s)^(.*) \(([0-9]+) lines this session\)$"
    field = lambda i: F.nullif(F.regexp_extract(message, pattern, i), F.lit(""))
    return F.struct(field(1).alias("reason"), field(2).try_cast("long").alias("lines"))
