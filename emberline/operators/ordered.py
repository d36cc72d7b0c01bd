"""Ordered folds over groups of any size, as a prefix scan in two levels.

A window function handles one group in one task. Here a task handles one bucket of a group: a range of the first order column. Each bucket
of a large group is summed up in one row, an ordinary window over these rows gives what comes before a bucket, and that one
carried row is put in front of the bucket's own rows. So a window over (group, bucket) yields the fold over the whole group.

Which groups have buckets, and where these begin, comes from the group's own count, least and greatest order value, an aggregate
inside the same plan. A group of few rows is one bucket without a carried row, so it costs a plain window. Nothing is
written, and building a query starts no job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ByteType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, TimestampNTZType, TimestampType

BUCKET, CARRIED, ALL = "_bucket", "_own", "_all"
#: Rows that a bucket has in the mean. Groups with more have several; their list, under rows / ROWS_PER_BUCKET short rows, may always be broadcast.
ROWS_PER_BUCKET = 1_000_000
#: Ranges are equally wide, so more are cut than a uniform column needs, but never more than one task can order.
SPARE, MOST_BUCKETS = 4, 1 << 20
#: With smaller buckets than this, the list of groups is left to Spark's size check.
BROADCAST_FROM = 100_000


def _image(column: str, kind, prefix: str = "0") -> str:
    """SQL for a double that never falls when the column grows. Of a string it is the bytes behind its first ``prefix`` characters."""
    if isinstance(kind, StringType):
        return f"double(conv(rpad(hex(substring(CAST(substring({column}, {prefix} + 1) AS BINARY), 1, 6)), 12, '0'), 16, 10))"
    if isinstance(kind, DateType):
        return f"double(unix_date({column}))"
    if isinstance(kind, TimestampType):
        return f"double(unix_micros({column}))"
    if isinstance(kind, TimestampNTZType):
        return f"double(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column}))"
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, DecimalType)):
        return f"double({column})"
    raise ValueError(f"rows can't be cut into ranges of a {kind.simpleString()}")


def in_buckets(df: DataFrame, keys: Sequence[str], by: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Rows with their bucket: null in groups of at most ``rows_per_bucket`` rows, else the number of the range of ``by`` they fall into."""
    kind, c = df.schema[by].dataType, f"`{by}`"
    rows = df if keys else df.withColumn(ALL, F.lit(0))
    group = list(keys) or [ALL]
    # The least and greatest strings share a prefix, and so do all between them.
    shared = "size(filter(sequence(1, greatest(1, least(length(_least), length(_greatest)))), i -> left(_least, i) = left(_greatest, i)))"
    shared = f"coalesce({shared}, 0)" if isinstance(kind, StringType) else "0"
    large = (
        rows.groupBy(*group).agg(F.expr("count(1) AS _n"), F.expr(f"min({c}) AS _least"), F.expr(f"max({c}) AS _greatest")).filter(F.col("_n") > rows_per_bucket)
        .selectExpr(f"struct({', '.join(f'`{k}`' for k in group)}) AS _g", "_n", "_least", "_greatest", f"{shared} AS _shared")
        .selectExpr("_g", f"least(ceil(_n / {rows_per_bucket}) * {SPARE}, {MOST_BUCKETS}) AS _parts", f"{_image('_least', kind, '_shared')} AS _from", f"{_image('_greatest', kind, '_shared')} AS _to", "_shared")
    )
    at = f"CASE WHEN _parts IS NULL THEN NULL WHEN {c} IS NULL OR _to <= _from THEN 0L ELSE bigint(width_bucket({_image(c, kind, '_shared')}, _from, _to, _parts)) END"
    if isinstance(kind, (FloatType, DoubleType)):  # NaN and infinities have no range
        at = f"CASE WHEN _parts IS NOT NULL AND (isnan(_to) OR abs(_to) = double('Infinity') OR abs(_from) = double('Infinity')) THEN 0L ELSE {at} END"
    found = rows.withColumn("_g", F.struct(*group)).join(F.broadcast(large) if rows_per_bucket >= BROADCAST_FROM else large, "_g", "left")
    return found.withColumn(BUCKET, F.expr(at)).select(*df.columns, BUCKET)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    *,
    by: str,
    sums: Mapping[str, Column] | None = None,
    highest: Mapping[str, Column] | None = None,
    lowest: Mapping[str, Column] | None = None,
    last_known: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    number: str | None = None,
    before: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    chained: bool = False,
) -> DataFrame:
    """Running values up to and including each row, per ``keys`` in ``order``; without keys all rows are one group.

    ``order`` must be total, and its first term must sort the plain column ``by``. ``sums``, ``highest`` and ``lowest`` fold the value;
    ``last_known`` is the newest non-null value so far; ``previous`` the value of the row before (null for the first row);
    ``number`` counts rows from 1. With ``before`` the folds leave the row itself out.

    With ``chained`` a second fold over the same keys and order takes over the buckets found here; end the chain with a call
    without it. Rows of one group that share the value of ``by`` are in one bucket.
    """
    sums = dict(sums or {})
    if number:
        sums[number] = F.lit(1).cast("long")
    highest, lowest = dict(highest or {}), dict(lowest or {})
    last_known, previous = dict(last_known or {}), dict(previous or {})
    folds = {**sums, **highest, **lowest, **last_known, **previous}
    columns = [c for c in df.columns if c != BUCKET]
    placed = df if BUCKET in df.columns else in_buckets(df, keys, by, rows_per_bucket)
    kinds = df.select(*[F.sum(c).alias(n) for n, c in sums.items()]).schema if sums else None
    rows = placed.withColumns({f"_v_{n}": F.struct(c.alias("v")) if n in previous else c for n, c in folds.items()} | {CARRIED: F.lit(1)})

    # What each bucket of a large group hands on, and what the buckets before it have handed on together.
    group = [*keys, BUCKET]
    cut = rows.filter(F.col(BUCKET).isNotNull())
    if last_known or previous:
        whole = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        cut = cut.withColumns({f"_v_{n}": F.last(f"_v_{n}", ignorenulls=True).over(whole) for n in [*last_known, *previous]})
    parts = [F.sum(f"_v_{n}").alias(f"_v_{n}") for n in sums]
    parts += [F.max(f"_v_{n}").alias(f"_v_{n}") for n in highest]
    parts += [F.min(f"_v_{n}").alias(f"_v_{n}") for n in lowest]
    parts += [F.first(f"_v_{n}").alias(f"_v_{n}") for n in [*last_known, *previous]]
    # Buckets are ranges of ``by``, so any value of it ranks its bucket, in either direction.
    handed = cut.groupBy(*group).agg(F.min(by).alias("_by" if by in group else by), *parts)
    earlier = Window.partitionBy(*keys).orderBy(order[0], BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"_v_{n}").over(earlier).alias(f"_v_{n}") for n in sums]
    carried += [F.max(f"_v_{n}").over(earlier).alias(f"_v_{n}") for n in highest]
    carried += [F.min(f"_v_{n}").over(earlier).alias(f"_v_{n}") for n in lowest]
    carried += [F.last(f"_v_{n}", ignorenulls=True).over(earlier).alias(f"_v_{n}") for n in [*last_known, *previous]]
    both = rows.unionByName(handed.select(*group, F.lit(0).alias(CARRIED), *carried), allowMissingColumns=True)

    each = Window.partitionBy(*group).orderBy(CARRIED, *order)
    so_far = each.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = {n: F.coalesce(F.sum(f"_v_{n}").over(so_far), F.lit(0)).cast(kinds[n].dataType) for n in sums}
    out |= {n: F.max(f"_v_{n}").over(so_far) for n in highest}
    out |= {n: F.min(f"_v_{n}").over(so_far) for n in lowest}
    out |= {n: F.last(f"_v_{n}", ignorenulls=True).over(so_far) for n in last_known}
    out |= {n: F.lag(f"_v_{n}").over(each)["v"] for n in previous}
    kept = [*columns, *([BUCKET] if chained else [])]
    folded = both.select(*kept, CARRIED, *[c.alias(f"_o_{n}") for n, c in out.items()]).filter(F.col(CARRIED) == 1)
    return folded.select(*kept, *[F.col(f"_o_{n}").alias(n) for n in folds])


def floored(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], *, by: str, name: str, change: Column, start: Column,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """A running sum from ``start`` that never falls below zero; ``start`` is the same for all rows of a group.

    What a bucket does to the level before it is x -> max(least, x + total), and such functions compose: the level is the plain sum less the
    deepest shortfall so far. So a bucket hands on two numbers, its total and its lowest point, and one pass over the rows does.
    A null change is none.
    """
    placed = in_buckets(df.withColumns({"_change": F.coalesce(change.cast("long"), F.lit(0).cast("long")), "_start": start}), keys, by, rows_per_bucket)
    group = [*keys, BUCKET]
    so_far = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_sum", F.sum("_change").over(so_far)).withColumn("_low", F.min("_sum").over(so_far))

    handed = local.filter(F.col(BUCKET).isNotNull()).groupBy(*group).agg(F.min(by).alias(by), F.sum("_change").alias("_total"), F.min("_low").alias("_lowest"))
    # Buckets are ranges of ``by``, so any value of it ranks its bucket, in either direction.
    ranked = Window.partitionBy(*keys).orderBy(order[0], BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        handed.withColumn("_before", F.coalesce(F.sum("_total").over(ranked), F.lit(0)))
        .withColumn("_deepest", F.min(F.col("_before") + F.col("_lowest")).over(ranked))
        .select(F.struct(*group).alias("_g"), "_before", "_deepest")
    )
    found = local.withColumn("_g", F.struct(*group)).join(carried, "_g", "left")
    level = F.col("_start") + F.coalesce("_before", F.lit(0)) + F.col("_sum")
    # least() passes over nulls, so the first bucket of a group, and groups of one bucket, need no case of their own.
    deepest = F.col("_start") + F.least(F.col("_deepest"), F.coalesce("_before", F.lit(0)) + F.col("_low"))
    return found.select(*df.columns, (level - F.least(deepest, F.lit(0))).cast("long").alias(name))


def surrogate_keys(df: DataFrame, name: str, order: Sequence[Column], by: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Gap-free numbers 1, 2, … in ``order``, whose first term sorts ``by``, without sending all rows to one task."""
    return running(df, [], order, by=by, number=name, rows_per_bucket=rows_per_bucket)
