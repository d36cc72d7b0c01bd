"""Distinct counts from bitmaps."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from emberline.operators import members, rollups


def test_counts_roll_up_across_neighbourhoods(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), rng.randrange(30), rng.choice([1, 7, 32_768, 32_769, 100_000, rng.randrange(200_000), None])) for _ in range(3_000)]
    rows = spark.createDataFrame(data, "kind string, day int, member_number long").repartition(6)
    daily = members.member_bitmaps(rows, ["kind", "day"])
    assert daily.count() <= len(data)

    def want(key):
        out = {}
        for kind, day, n in data:
            if n is not None:
                out.setdefault(key(kind, day), set()).add(n)
        return {k: len(v) for k, v in out.items()}

    assert {(r.kind, r.day): r.n for r in members.member_counts(daily, ["kind", "day"], "n").collect()} == want(lambda k, d: (k, d))
    weekly = members.rolled_up(daily, ["kind", F.expr("day div 7").alias("week")])
    assert {(r.kind, r.week): r.n for r in members.member_counts(weekly, ["kind", "week"], "n").collect()} == want(lambda k, d: (k, d // 7))
    assert members.member_counts(weekly, [], "n").first().n == want(lambda k, d: 0)[0]  # rolled up twice


def test_numbers_are_dense_and_leave_nulls_out(spark):
    df = spark.createDataFrame([(f"c{k % 40}",) for k in range(100)] + [(None,)], "c string")
    got = members.member_numbers(df, "c", rows_per_bucket=7).collect()
    assert sorted(r.member_number for r in got) == list(range(1, 41)) and len({r.c for r in got}) == 40


def test_buyers_by_period(spark):
    rng = random.Random(2)
    day = date(2024, 1, 29)
    orders = [(i, f"c{rng.randrange(12)}", day + timedelta(days=rng.randrange(60))) for i in range(200)]
    items = [(rng.randrange(210), rng.choice("xyz")) for _ in range(500)]
    o = spark.createDataFrame(orders, "order_id int, customer_id string, order_date date")
    numbers = members.member_numbers(o, "customer_id")
    daily = rollups.daily_buyers(o, spark.createDataFrame(items, "order_id int, product_category string"), numbers)
    want = {}
    for i, category in items:
        for _, c, d in (x for x in orders if x[0] == i):
            for p, start in (("day", d), ("week", d - timedelta(days=d.weekday())), ("month", d.replace(day=1))):
                want.setdefault((p, start, category), set()).add(c)
    assert {tuple(r)[:3]: r[3] for r in rollups.buyers_by_period(daily).collect()} == {k: len(v) for k, v in want.items()}
    with pytest.raises(ValueError):
        rollups.buyers_by_period(daily, ["decade"])
    assert rollups.buyers_by_period(rollups.daily_buyers(o.limit(0), spark.createDataFrame(items, "order_id int, product_category string"), numbers)).collect() == []
