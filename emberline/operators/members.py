"""Distinct counts that can be rolled up: who was there is kept as bitmaps, so a week is the union of its days.

A distinct count can't be added up over days, a set can. Members have dense numbers; those of 32,768 neighbouring numbers share a
bitmap of 4 KB. A table has at most one bitmap per group and neighbourhood, and never more bitmaps than rows. It suits groups that hold
many members; where most groups hold a few, plain rows of (group, member) take less room.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import ROWS_PER_BUCKET, surrogate_keys

NEIGHBOURHOOD, BITMAP = "members_from", "members"


def member_numbers(members: DataFrame, column: str, name: str = "member_number", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The distinct non-null values of ``column`` with numbers 1, 2, …; keep the table, as bitmaps mean nothing without it."""
    known = members.filter(F.col(column).isNotNull()).select(column).distinct()
    return surrogate_keys(known, name, [F.asc(column)], column, rows_per_bucket)


def member_bitmaps(rows: DataFrame, groups: Sequence[str | Column], number: str = "member_number") -> DataFrame:
    """One bitmap per group and neighbourhood of numbers. Repeated members set the same bit; a null number sets none."""
    n = F.col(number)
    return rows.filter(n.isNotNull()).groupBy(*groups, F.bitmap_bucket_number(n).alias(NEIGHBOURHOOD)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias(BITMAP)
    )


def rolled_up(bitmaps: DataFrame, groups: Sequence[str | Column]) -> DataFrame:
    """Bitmaps of coarser groups, to be kept, rolled up again or counted."""
    return bitmaps.groupBy(*groups, NEIGHBOURHOOD).agg(F.bitmap_or_agg(BITMAP).alias(BITMAP))


def member_counts(bitmaps: DataFrame, groups: Sequence[str | Column], name: str) -> DataFrame:
    """How many distinct members each group has; the bitmaps may be finer than the groups."""
    united = rolled_up(bitmaps, groups)
    return united.groupBy(*[c for c in united.columns if c not in (NEIGHBOURHOOD, BITMAP)]).agg(F.sum(F.bitmap_count(BITMAP)).alias(name))
