"""Rounding, ratios and means with one result in every engine and every row order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F



def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed(c: Column | str, places: int = 4) -> Column:
    """Half-up rounding decided in DECIMAL, returned as DOUBLE.

    Rounding a DOUBLE at a tie depends on its binary form; eight decimal places first make
    12.34125 mean exactly that.
    """
    return F.round(as_column(c).cast("decimal(38,8)"), places).cast("double")


def half_even(c: Column | str, places: int = 2) -> Column:
    """Banker's rounding of a DECIMAL value."""
    return F.bround(as_column(c), places)


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as DOUBLE; null when the bottom is zero or null."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def mean(c: Column | str, precision: str = "decimal(28,6)") -> Column:
    """Average of a decimal-like value whose result does not depend on the row order."""
    value = as_column(c)
    return ratio(F.sum(value.cast(precision)), F.count(value))


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def fahrenheit(celsius: Column) -> Column:
    return celsius * 9.0 / 5.0 + 32


def lenient_integer(text: Column) -> Column:
    """'10.0' reads as 10, text that is no number as null."""
    return text.try_cast("decimal(38,6)").cast("long")
