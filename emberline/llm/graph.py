"""Connected components of links between integer ids, as Spark joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import settled
from .common import discard, release

#: Up to so many links are followed in one task, without shuffles.
ALONE = 20_000


def _shape(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """(v, component) for every id in ``links`` (a, b): the smallest id that can be reached.

    Large-star and small-star turns, each of which hangs neighbours on the smallest one near them, until nothing moves. A
    turn is one aggregate with map-side combining and one join whose skew Spark can split; ids are never gathered in lists.
    Every turn's edges are a written table, the first one written by at most ``tasks`` tasks. Null and equal ends are dropped.
    """
    # ``b`` is always the smaller end.
    edges = settled(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tasks)
    before = _shape(edges)
    # The number of edges never grows, so what is small once stays small: one partition needs no shuffle.
    dealt = (lambda df: df.coalesce(1)) if before[0] <= ALONE else (lambda df: df)
    edges = dealt(edges)
    while True:
        both = dealt(edges.select(F.col("a").alias("u"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("w"))))
        nearest = both.groupBy("u").agg(F.min(F.least("u", "w")).alias("m"))
        # Large star: every larger neighbour of u hangs on the smallest id around u.
        large = edges.withColumnRenamed("b", "u").join(nearest, "u").select("a", F.col("m").alias("b")).filter("a <> b")
        own = nearest.filter("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))
        large = dealt(settled(dealt(large.unionByName(own)).distinct()))
        # Small star: u and its smaller neighbours hang on the smallest of them.
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(lowest.select("a", F.col("m").alias("b")))
        last, edges = edges, dealt(settled(dealt(small).distinct()))
        discard(last)
        discard(large)
        release(edges.sparkSession)
        now = _shape(edges)
        if now == before:
            break
        before = now
    found = edges.groupBy("a").agg(F.min("b").alias("component"))
    roots = found.select(F.col("component").alias("v")).distinct().select("v", F.col("v").alias("component"))
    return found.select(F.col("a").alias("v"), "component").unionByName(roots)
