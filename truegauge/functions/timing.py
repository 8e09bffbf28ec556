"""Dates, date keys and tolerant timestamp parsing (UTC sessions)."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_utc(value: Column) -> Column:
    """Timestamp, or null where the text does not parse."""
    return value.try_cast("timestamp")


def date_key(value: Column) -> Column:
    """``YYYYMMDD`` as an int; 0 where the date is missing."""
    key = F.year(value) * F.lit(10000) + F.month(value) * F.lit(100) + F.dayofmonth(value)
    return F.coalesce(key, F.lit(0)).cast("int")


def key_of(day: date) -> int:
    return day.year * 10000 + day.month * 100 + day.day


def strict_day(text: str) -> date:
    """``YYYY-MM-DD`` only; anything else is refused."""
    try:
        return datetime.strptime(text, "%Y-%m-%d").date()
    except ValueError:
        raise ValueError(f"Invalid date format for '{text}'. Expected YYYY-MM-DD.") from None


def days_back(days: int, as_of: date, floor: date | None = None) -> date:
    """Start of a rolling range, never before ``floor``."""
    start = as_of - timedelta(days=days)
    return max(start, floor) if floor else start


def parse_watermark(text: str | None) -> datetime | None:
    """ISO text to an aware datetime; bad text is no watermark, naive means UTC."""
    if not text:
        return None
    try:
        moment = datetime.fromisoformat(text)
    except (TypeError, ValueError):
        return None
    return moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
