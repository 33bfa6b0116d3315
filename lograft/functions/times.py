"""Timestamps: stored text form, user arguments and display texts."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lograft.functions.text import one_decimal

STORED = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def format_ts(ts: Column) -> Column:
    """Fixed-width UTC text, so that text order is time order (session zone UTC)."""
    return F.date_format(ts, STORED)


def file_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def short_utc(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("-"))


def parse_argument(text: str) -> datetime:
    """A time given by a caller, in any ISO-8601 form and zone, as UTC without a zone."""
    try:
        moment = datetime.fromisoformat(text.strip().upper())
    except ValueError:
        raise ValueError(f"{text!r} is no ISO-8601 time") from None
    return moment.astimezone(timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment


def parse_column(text: Column) -> Column:
    """A column of ISO-8601 texts as timestamps, NULL where the text is not one.

    Bare years and months, which Spark would accept, are refused; the compact and the week form,
    which it does not know, are rewritten first.
    """
    value = F.trim(text)
    value = F.regexp_replace(value, "[zZ]$", "+00:00")
    value = F.regexp_replace(value, r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3")
    value = F.regexp_replace(value, r"(?<=[T ])(\d{2})(\d{2})(\d{2})(?=$|[.+-])", "$1:$2:$3")
    week = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?$"
    year, number, day = (F.regexp_extract(value, week, i).try_cast("int") for i in (1, 2, 3))
    # ISO week 1 holds 4 January; weekday() is 0 for Monday
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    week_day = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (number - 1) * 7 + F.coalesce(day, F.lit(1)) - 1)
    last_week = F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))
    return (
        F.when(F.rlike(value, F.lit(week)), F.when(number.between(1, last_week), week_day.cast("timestamp")))
        .when(F.rlike(value, F.lit(r"^\d{4}-\d{2}-\d{2}($|[T ]\d{2}($|:\d{2}|[+-]))")), value.try_cast("timestamp"))
    )


def instant(value: datetime | str, like: T.DataType) -> Column:
    """A literal of the column's own timestamp type, so the comparison reaches the scan."""
    if isinstance(value, str):
        value = parse_argument(value)
    return F.lit(literal_text(value)).cast(like)


def literal_text(moment: datetime) -> str:
    return moment.isoformat(sep=" ")


def seconds_between(earlier: Column, later: Column) -> Column:
    """Whole seconds, floored at zero."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.greatest(F.lit(0).cast("long"), F.floor(micros / 1_000_000).cast("long"))


def exact_seconds(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1_000_000.0)


def time_ago(ts: Column, now: Column) -> Column:
    s = seconds_between(ts, now)
    div = lambda n: F.floor(s / n).cast("string")
    return (
        F.when(ts.isNull(), F.lit("-"))
        .when(s < 60, F.concat(s.cast("string"), F.lit(" sec ago")))
        .when(s < 3600, F.concat(div(60), F.lit(" min ago")))
        .when(s < 86400, F.concat(div(3600), F.lit(" hr ago")))
        .otherwise(F.concat(div(86400), F.lit(" days ago")))
    )


def log_span(first: Column, last: Column) -> Column:
    minutes = F.floor(seconds_between(first, last) / 60)
    days, hours, rest = F.floor(minutes / 1440), F.floor(minutes % 1440 / 60), minutes % 60
    part = lambda n, unit, lead: F.when(n > 0, F.concat(F.lit(lead), n.cast("string"), F.lit(unit))).otherwise(F.lit(""))
    return (
        F.when(first.isNull() | last.isNull(), F.lit("-"))
        .when(days > 0, F.concat(days.cast("string"), F.lit("d"), part(hours, "h", " ")))
        .when(hours > 0, F.concat(hours.cast("string"), F.lit("h"), part(rest, "m", " ")))
        .when(minutes > 0, F.concat(minutes.cast("string"), F.lit(" min")))
        .otherwise(F.lit("<1 min"))
    )


def human_size(size: Column) -> Column:
    scaled = lambda power, unit: F.concat(one_decimal(size / F.lit(float(1024**power))), F.lit(f" {unit}"))
    text = scaled(4, "TiB")
    for power, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB")):
        text = F.when(size < 1024 ** (power + 1), scaled(power, unit)).otherwise(text)
    return F.when(size < 1024, F.concat(size.cast("long").cast("string"), F.lit(" B"))).otherwise(text)
