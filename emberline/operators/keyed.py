"""Small keyed building blocks: newest row per key, paging, dense month axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_WORD, _BITS = "_word", "_bits"


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One whole row per key: the one with the greatest ``order`` values.

    Last write wins, an upsert. Spark turns ``row_number() = 1`` into a group limit before and
    after the shuffle, so a key with very many versions ships one row per task, not all of them.
    """
    ranked = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_version", F.row_number().over(ranked)).filter(F.col("_version") == 1).drop("_version")


def only_for(history: DataFrame, live: DataFrame, keys: Sequence[str]) -> DataFrame:
    """History rows whose keys occur among the live rows, before anything is aggregated or sorted.

    A semi join: where the live keys are few Spark sends them to the history, which is then not shuffled at all.
    """
    return history.join(live.select(*keys).distinct(), list(keys), "left_semi")


def key_bits(df: DataFrame, column: str) -> DataFrame:
    """The whole numbers in ``column``, 64 neighbours to a row: a 64th of the keys where they are dense, never more rows than keys."""
    n = F.col(column)
    known = df.filter(n.isNotNull()).select(n.cast("long").alias("_n"))
    return known.groupBy(F.shiftright("_n", 6).alias(_WORD)).agg(F.bit_or(F.expr("shiftleft(1L, int(_n & 63))")).alias(_BITS))


def only_known(rows: DataFrame, bits: DataFrame, column: str) -> DataFrame:
    """Rows whose number is in ``key_bits``: a semi join by a table that is mostly small enough to be sent to the rows, which then stay where they are."""
    n = F.col(column).cast("long")
    met = rows.withColumn(_WORD, F.shiftright(n, 6)).join(bits, _WORD)
    return met.filter(F.expr(f"getbit({_BITS}, int(bigint(`{column}`) & 63)) = 1")).select(*rows.columns)


def page_of(df: DataFrame, order: Sequence[Column], page: int = 1, page_size: int = 25) -> DataFrame:
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size must be positive")
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def page_totals(df: DataFrame, page_size: int = 25) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_items")).select(
        "total_items", F.ceil(F.col("total_items") / page_size).cast("long").alias("total_pages")
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values in locale order."""
    c = F.col(column)
    return df.filter(c.isNotNull() & (c != "")).select(column).distinct().orderBy(F.collate(c, "UNICODE"), c)
