"""Calendar buckets and relative ranges."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..refusal import Refusal


def bucket(column: Column, grain: str) -> Column:
    """The first day of the period, as a date; weeks begin on Monday."""
    return F.date_trunc(grain, column).cast("date")


def within(column: Column, start: date, end: date) -> Column:
    return (column >= F.lit(start)) & (column < F.lit(end))


def relative_range(today: date, count: int, unit: str, include_current: bool = False) -> tuple[date, date]:
    """The last `count` units: days and weeks are blocks of days that end at `today`; months, quarters and years are whole
    periods before the present one, which counts as one of them, up to today, if it is included."""
    if count < 1:
        raise Refusal("invalid_definition", "last: count")
    tomorrow = today + timedelta(days=1)
    if unit in ("day", "week"):
        end = tomorrow if include_current else today
        return end - timedelta(days=count * (7 if unit == "week" else 1)), end
    months = {"month": 1, "quarter": 3, "year": 12}.get(unit)
    if not months:
        raise Refusal("invalid_definition", f"last: unit {unit!r}")
    now = (today.year * 12 + today.month - 1) // months * months
    first = lambda m: date(m // 12, m % 12 + 1, 1)
    return first(now - months * (count - bool(include_current))), tomorrow if include_current else first(now)
