"""Times: entry and item time, message stamps, accounting periods, parameters."""

from __future__ import annotations

import re
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def iso(c: Column) -> Column:
    """RFC 3339 UTC text with second precision."""
    return F.date_format(c, ISO)


def entry_date() -> Column:
    return F.coalesce("source_created_at", "ingested_at")


def activity_at() -> Column:
    return F.coalesce("source_updated_at", "source_created_at", "ingested_at")


def item_at() -> Column:
    return F.coalesce("occurred_at", "source_updated_at", "source_created_at", "ingested_at")


def message_time(ts: Column) -> Column:
    """``sec.micros`` text as a timestamp; missing digits count as zeros on the right."""
    sec = F.coalesce(F.split_part(ts, F.lit("."), F.lit(1)).try_cast("long"), F.lit(0))
    frac = F.rpad(F.split_part(F.concat(ts, F.lit(".")), F.lit("."), F.lit(2)), 6, "0")
    micros = F.coalesce(F.substring(frac, 1, 6).try_cast("long"), F.lit(0))
    return F.timestamp_micros(sec * 1_000_000 + micros)


def local_date(c: Column, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(c, tz))


def local_midnight(day: Column, tz: str) -> Column:
    """UTC instant of local midnight; a midnight inside a clock gap moves to the next valid time."""
    return F.to_utc_timestamp(day.cast("timestamp"), tz)


def period_start(kind: str, c: Column, tz: str) -> Column:
    """First local date of the accounting period: a Monday, or the 1st of the month."""
    return F.to_date(F.date_trunc(kind, F.from_utc_timestamp(c, tz)))


def next_start(kind: str, start: Column) -> Column:
    return F.date_add(start, 7) if kind == "week" else F.add_months(start, 1)


def previous_start(kind: str, start: Column) -> Column:
    return F.date_add(start, -7) if kind == "week" else F.add_months(start, -1)


def period(kind: str, c: Column, tz: str) -> Column:
    """``struct(kind, period_start, starts_at, ends_at)`` of the period that contains an instant."""
    start = period_start(kind, c, tz)
    return F.struct(
        F.lit(kind).alias("kind"),
        start.alias("period_start"),
        local_midnight(start, tz).alias("starts_at"),
        local_midnight(next_start(kind, start), tz).alias("ends_at"),
    )


def safe_time(c: Column) -> Column:
    """RFC 3339, date-time or a leading date; null when nothing fits."""
    t = F.trim(c)
    rfc = F.when(
        t.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"),
        F.try_to_timestamp(F.upper(t)),
    )
    local = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?$"), F.try_to_timestamp(t))
    return F.coalesce(rfc, local, safe_date(F.substring(t, 1, 10)).cast("timestamp"))


def safe_date(c: Column) -> Column:
    """Exact ``YYYY-MM-DD``; null otherwise."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")).cast("date"))


def parse_date(s: str, end_of_day: bool = False) -> datetime:
    """Parameter: RFC 3339, or a date; with ``end_of_day`` a bare date means the next midnight."""
    try:
        t = datetime.fromisoformat(s)
        if t.tzinfo is not None:
            return t.astimezone(UTC)
    except ValueError:
        pass
    d = date.fromisoformat(s) + timedelta(days=1 if end_of_day else 0)
    return datetime(d.year, d.month, d.day, tzinfo=UTC)


def parse_when(s: str, now: datetime, tz: str = "UTC") -> datetime:
    """Parameter: ``today``, an age such as ``90d`` or ``12w``, a date or an RFC 3339 time."""
    t = s.strip()
    if t.lower() == "today":
        local = now.astimezone(ZoneInfo(tz))
        return local.replace(hour=0, minute=0, second=0, microsecond=0).astimezone(UTC)
    m = re.fullmatch(r"(\d+)([dw])", t)
    if m:
        return now - timedelta(days=int(m[1]) * (7 if m[2] == "w" else 1))
    return parse_date(t)
