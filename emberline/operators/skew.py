"""Joins that survive a key holding a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

ROWS_PER_SLICE = 2_000_000


def hot_keys(
    facts: DataFrame,
    on: Sequence[str],
    rows_per_slice: int = ROWS_PER_SLICE,
    key_counts: DataFrame | None = None,
    count_column: str = "count",
) -> DataFrame:
    """The keys with more rows than one task should take, and the slices to cut each into.

    Every such key is listed. There are fewer of them than ``rows / rows_per_slice``, half a million
    short rows for 10^12 rows, so the result may always be broadcast. The list only routes rows, it
    never selects them.
    """
    counts = facts.groupBy(*on).count() if key_counts is None else key_counts
    rows = F.col(count_column)
    return (
        counts.filter(rows > rows_per_slice)
        .select(*[F.col(k).alias(f"_hot_{k}") for k in on], F.ceil(rows / rows_per_slice).cast("int").alias("_slices"))
    )


def join_spread(
    facts: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    rows_per_slice: int = ROWS_PER_SLICE,
    key_counts: DataFrame | None = None,
    count_column: str = "count",
    null_safe: bool = False,
) -> DataFrame:
    """Equi join of a fact side with a side that is (nearly) unique per key.

    Hot keys are cut into slices on the fact side, by a hash of the row so that a retried
    task sends each row to the same place, and the few matching rows of the other side are
    repeated once per slice. All other keys pass through unchanged. ``how`` may be inner,
    left, left_semi or left_anti; with ``null_safe`` null keys match each other.

    Counting the keys is a pass over the key columns of ``facts``. Where ``facts`` is itself a
    join, hand in ``key_counts`` of the rows it started from: the counts only have to be upper
    bounds.
    """
    keys = [on] if isinstance(on, str) else list(on)
    hot = F.broadcast(hot_keys(facts, keys, rows_per_slice, key_counts, count_column))

    def with_slices(df: DataFrame) -> DataFrame:
        # Null keys may be hot too (a left join keeps them), hence the null-safe match.
        match = reduce(and_, [df[k].eqNullSafe(hot[f"_hot_{k}"]) for k in keys])
        return df.join(hot, match, "left").drop(*[f"_hot_{k}" for k in keys])

    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in facts.columns])
    left = with_slices(facts).withColumn(
        "_slice", F.when(F.col("_slices").isNull(), F.lit(0)).otherwise(F.pmod(row_hash, F.col("_slices")).cast("int"))
    ).drop("_slices")
    right = with_slices(dim).withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1))
    ).drop("_slices")
    if not null_safe:
        return left.join(right, [*keys, "_slice"], how).drop("_slice")
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in [*keys, "_slice"]})
    match = reduce(and_, [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys]) & (left["_slice"] == right["_r__slice"])
    return left.join(right, match, how).drop("_slice", "_r__slice", *[f"_r_{k}" for k in keys])
