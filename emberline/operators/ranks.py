"""Exact value at a rank by distributed selection, one way for groups of any size.

Nothing is sorted. The values of a group are counted in bins that keep their order, each with its least and greatest value, and
Spark combines the counts before they are shuffled. The bin that holds the rank is the answer if its values are all alike, or
if the rank is its first or its last. Otherwise the rows of that one bin are counted again in finer bins, and the bin they leave value
by value. A group of a few rows is settled by the first count; a group with a third of all rows costs one row a bin and task.

A task never holds more than the bins of one group: at most ``2 * 1455 * LOG_STEPS`` at first, for a group that spans all
magnitudes of a double, then ``ZOOM``, and at last the values that are closer than a ``ZOOM``-th of a first bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DecimalType

#: First bins a unit of the natural logarithm: values in one differ by under 0.4 %.
LOG_STEPS = 256
#: Equal bins that the range of a first bin is cut into.
ZOOM = 1 << 22
#: No double's logarithm is lower than minus this.
_LOWEST_LOG = 746


# Expressions are SQL text: the queries are built from Python, where every part of a column is a call into the JVM.


def first_bin(x: str) -> str:
    """A whole number that never falls when the double ``x`` grows: by sign and logarithm. NaN comes last, as in Spark's order."""
    beyond = (_LOWEST_LOG + 711) * LOG_STEPS
    return f"""CASE WHEN isnan({x}) THEN {beyond + 1}L
        WHEN abs({x}) = double('Infinity') THEN bigint(signum({x})) * {beyond}L
        WHEN {x} = 0 THEN 0L
        ELSE bigint(signum({x})) * (bigint(floor((ln(abs({x})) + {_LOWEST_LOG}) * {LOG_STEPS})) + 1) END"""


def _counted(rows: DataFrame, group: Sequence[str], bin_: str) -> DataFrame:
    """Per group its bins in order: how many values, the least and the greatest of each."""
    bins = rows.groupBy(*group, F.expr(bin_).alias("_at")).agg(F.expr("count(1) AS _n"), F.expr("min(_v) AS _low"), F.expr("max(_v) AS _high"))
    return bins.groupBy(*group).agg(F.expr("array_sort(collect_list(struct(_at, _n, _low, _high))) AS _bins"))


def _picked(counted: DataFrame, group: Sequence[str], rank: str) -> DataFrame:
    """Per group the bin that holds the rank, the rank within it, and the answer if the bin alone gives it."""
    found = """aggregate(_bins, struct(0L AS upto, CAST(NULL AS INT) AS found, 0 AS k),
        (s, b) -> struct(
            IF(s.found IS NULL AND s.upto + b._n < _rank, s.upto + b._n, s.upto) AS upto,
            IF(s.found IS NULL AND s.upto + b._n >= _rank, s.k, s.found) AS found,
            s.k + 1 AS k),
        s -> struct(_rank - s.upto AS inside, get(_bins, s.found) AS b))"""
    # A generated row, so that later filters don't evaluate the fold again for each of their terms.
    one = counted.selectExpr(*group, f"inline(array(struct(_bins, {rank} AS _rank)))").selectExpr(*group, f"inline(array({found})) AS (_inside, _bin)")
    answer = "CASE WHEN _bin._low = _bin._high OR _inside = 1 THEN _bin._low WHEN _inside = _bin._n THEN _bin._high END"
    return one.selectExpr(*group, "_bin._at AS _at", "_bin._low AS _low", "_bin._high AS _high", "_inside AS _rank", f"{answer} AS _answer")


def value_at_rank(df: DataFrame, keys: Sequence[str], value: str, fraction: float = 0.95, name: str = "p95", extra: Sequence[Column] = ()) -> DataFrame:
    """The ``max(floor(fraction * n), 1)``-th smallest non-null value per group, and ``extra`` aggregates.

    ``value`` is numeric; decimals have at most 18 digits, so that few share a double. A group without values has null. Null keys form
    groups of their own. Building the query starts no job.
    """
    kind = df.schema[value].dataType
    if isinstance(kind, DecimalType) and kind.precision > 18:
        raise ValueError("a decimal of over 18 digits: cast it first")
    keys = list(keys)
    # One column for the whole key: null keys are equal inside a struct, so plain equi joins do.
    keyed = df.withColumn("_g", F.struct(*keys))
    rows = keyed.filter(F.col(value).isNotNull()).select("_g", F.col(value).alias("_v"), F.expr(first_bin(f"double(`{value}`)")).alias("_b"))
    rank = f"greatest(bigint(floor(aggregate(_bins, 0L, (s, b) -> s + b._n) * CAST('{fraction}' AS DECIMAL(6,4)))), 1L)"
    first = _picked(_counted(rows, ["_g"], "_b"), ["_g"], rank)

    # The rows of the one bin; both counts below read the same shuffled rows.
    def rows_in(bins: DataFrame, at: str) -> DataFrame:
        asked = bins.filter("_answer IS NULL").selectExpr("_g", f"{at} AS _b", "_low", "_high", "_rank")
        return rows.join(asked, ["_g", "_b"]).filter("_v BETWEEN _low AND _high")

    finer = f"coalesce(bigint(floor(try_divide(double(_v) - double(_low), double(_high) - double(_low)) * {ZOOM})), 0L)"
    group = ["_g", "_b", "_rank"]
    second = _picked(_counted(rows_in(first, "_at"), group, finer), ["_g", "_b"], "_rank")
    third = _picked(_counted(rows_in(second, "_b"), group, "_v"), ["_g", "_b"], "_rank")
    later = second.filter("_answer IS NOT NULL").select("_g", F.col("_answer").alias("_later")).unionByName(third.select("_g", F.col("_answer").alias("_later")))
    found = first.select("_g", "_answer").join(later, "_g", "left").select("_g", F.coalesce("_answer", "_later").alias(name))
    aggregates = list(extra) or [F.expr("count(1) AS _rows")]
    groups = keyed.groupBy("_g").agg(*aggregates)
    out = [F.col(f"_g.`{k}`").alias(k) for k in keys] + [F.col(f"`{c}`") for c in groups.columns if c != "_g" and (extra or c != "_rows")]
    return groups.join(found, "_g", "left").select(*out, name)
