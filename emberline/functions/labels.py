"""Closed vocabularies, priorities and banded labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import as_column

# The vocabularies of the data model.
DEVICE_STATUSES = ("online", "offline", "degraded", "maintenance")
SEVERITIES = ("critical", "high", "medium", "low")
ANOMALY_STATUSES = ("normal", "anomalous", "unknown")
PAYMENT_STATUS = {
    "delivered": "captured",
    "shipped": "captured",
    "processing": "captured",
    "pending": "authorized",
    "returned": "refunded",
    "cancelled": "failed",
}
DEBIT_TYPES = ("purchase", "withdrawal", "payment")


def severity_rank(severity: Column | str, other: int | None = None) -> Column:
    """1 for critical … 4 for low; ``other`` for any other label."""
    c = as_column(severity)
    rank = F.lit(other).cast("int")
    for position, label in reversed(list(enumerate(SEVERITIES, start=1))):
        rank = F.when(c == label, position).otherwise(rank)
    return rank


def triage_rank(severity: Column | str) -> Column:
    """The sort key of the triage lists: everything below medium shares one place."""
    return F.coalesce(F.least(severity_rank(severity), F.lit(4)), F.lit(4))


def severity_name(rank: Column) -> Column:
    name = F.lit(None).cast("string")
    for position, label in reversed(list(enumerate(SEVERITIES, start=1))):
        name = F.when(rank == position, label).otherwise(name)
    return name


def lookup(column: Column | str, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), as_column(column))


def bands(column: Column, *steps: tuple[float, str], otherwise: str, strict: bool = True) -> Column:
    """The label of the first step the value lies above (or, not strict, reaches)."""
    label = F.lit(otherwise)
    for limit, name in reversed(steps):
        label = F.when(column > limit if strict else column >= limit, name).otherwise(label)
    return label


def risk_tier(score: Column | str) -> Column:
    c = as_column(score)
    return F.when(c < 40, "low").when(c < 70, "medium").when(c < 88, "high").otherwise("restricted")


def campaign_label(channel: Column, when: Column) -> Column:
    return F.concat(channel, F.lit("_"), F.year(when), F.lit("Q"), F.quarter(when))


def table_of_batch(file_stem: Column) -> Column:
    """'orders_03' and 'orders_04' are batches of 'orders'."""
    return F.regexp_replace(file_stem, r"_\d+$", "")


def blank_to_null(column: Column | str) -> Column:
    return F.nullif(as_column(column), F.lit(""))


def text_is_true(column: Column | str) -> Column:
    return F.lower(F.trim(as_column(column))) == "true"


def is_uuid(column: Column | str) -> Column:
    return as_column(column).rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
