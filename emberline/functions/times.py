"""Instants, trailing windows and calendar parts. All times are UTC wall-clock values."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, functions as F

from .numbers import as_column

Moment = datetime | date | str


def parse_moment(as_of: Moment) -> datetime:
    if isinstance(as_of, str):
        return datetime.fromisoformat(as_of)
    if isinstance(as_of, datetime):
        return as_of
    return datetime(as_of.year, as_of.month, as_of.day)


def instant(as_of: Moment) -> Column:
    """A timestamp literal that does not depend on the session time zone."""
    return F.lit(parse_moment(as_of).isoformat(sep=" ")).cast("timestamp_ntz")


def day(as_of: Moment) -> Column:
    return F.lit(parse_moment(as_of).date().isoformat()).cast("date")


def since(
    column: Column | str,
    as_of: Moment,
    days: int,
    year: str | None = None,
    month: str | None = None,
) -> Column:
    """``as_of - days <= column <= as_of``, plus the same bounds on the year/month partition columns.

    A plain time predicate cannot prune a table laid out by integer year and month; the
    second conjunct lets the scan skip whole partitions.
    """
    end = parse_moment(as_of)
    start = end - timedelta(days=days)
    keep = as_column(column).between(instant(start), instant(end))
    if year and month:
        keep = keep & (F.col(year) * 12 + F.col(month)).between(start.year * 12 + start.month, end.year * 12 + end.month)
    return keep


def days_upto(column: Column | str, as_of: Moment, days: int) -> Column:
    """A date column from ``days`` before the day of ``as_of`` up to that day."""
    return as_column(column).between(F.date_sub(day(as_of), days), day(as_of))


def hour_of(column: Column | str) -> Column:
    return F.date_trunc("hour", as_column(column)).cast("timestamp_ntz")


def monday_of(column: Column | str) -> Column:
    return F.date_trunc("week", as_column(column)).cast("date")


def month_of(column: Column | str) -> Column:
    return F.trunc(as_column(column).cast("date"), "month")


def iso_weekday(column: Column | str) -> Column:
    """Monday is 1, Sunday is 7."""
    return F.weekday(as_column(column)) + 1


def iso_text(column: Column | str) -> Column:
    return F.date_format(as_column(column), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def previous_months(as_of: Moment, count: int) -> tuple[date, date]:
    """First and last month start of the ``count`` full months before ``as_of``."""
    at = parse_moment(as_of)
    index = at.year * 12 + at.month - 1
    first, last = index - count, index - 1
    return date(first // 12, first % 12 + 1, 1), date(last // 12, last % 12 + 1, 1)


def month_starts(first: date, last: date) -> Column:
    """An array of month starts; explode it for a dense month axis."""
    return F.sequence(F.lit(first), F.lit(last), F.expr("INTERVAL 1 MONTH"))


def calendar(column: Column | str, prefix: str) -> list[Column]:
    """Year, month, day, ISO weekday and quarter of a date."""
    c = as_column(column)
    return [
        F.year(c).alias(f"{prefix}_year"),
        F.month(c).alias(f"{prefix}_month"),
        F.dayofmonth(c).alias(f"{prefix}_day"),
        iso_weekday(c).alias(f"{prefix}_day_of_week"),
        F.quarter(c).alias(f"{prefix}_quarter"),
    ]
