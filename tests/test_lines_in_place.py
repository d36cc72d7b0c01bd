"""Questions over order lines that move only the columns they need: no written table of lines stands before them."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from emberline.operators import federated, keyed, rollups, signals
from emberline.plans import registry
from emberline.sources import views

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def no_items(monkeypatch):
    def fail(*_):
        raise AssertionError("the written lines are read")

    monkeypatch.setattr(views.DomainTables, "order_items", fail)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_archive_lines_are_the_clean_lines_of_archived_orders(spark):
    t = views.DomainTables(spark, FOLDER)
    lines = t.archive_lines()
    want = t.clean_lines().join(t.given("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select(lines.columns)
    assert lines.count() == want.count() > 0 and lines.exceptAll(want).isEmpty()
    joined = lines.select("l_orderkey", "l_partkey").join(t.archive_keys(), "l_orderkey")
    # Lines and orders once each for the choice of the orders, the orders once more for their columns; nothing for versions.
    assert plan_of(joined).count("Exchange hashpartitioning") == 3


def test_demand_index_reads_no_written_lines(spark, no_items):
    assert registry.queries()["demand_index"](spark, FOLDER).count() > 0


def test_demand_index_is_the_same_from_sales(spark):
    rng = random.Random(3)
    orders = spark.createDataFrame([(k, date(2024, 1, 1) + timedelta(days=rng.randrange(300))) for k in range(80)], "order_id int, order_date date")
    items = spark.createDataFrame([(rng.randrange(90), rng.choice("xyz"), rng.randrange(9)) for _ in range(400)], "order_id int, product_category string, quantity int")
    whole = signals.demand_index(orders, items, [47]).collect()
    assert sorted(map(str, whole)) == sorted(map(str, signals.demand_index_of_sales(items.join(orders, "order_id"), [47]).collect())) and whole


def test_numbers_are_known_by_their_bits(spark):
    known = [0, 1, 63, 64, 65, -1, -64, -65, 2**40, -(2**63), 2**63 - 1]
    bits = keyed.key_bits(spark.createDataFrame([(k,) for k in known + known[:3]] + [(None,)], "k long"), "k")
    assert bits.count() == len({k >> 6 for k in known})
    asked = sorted({k + d for k in known for d in (-64, -2, -1, 0, 1, 2, 64) if -(2**63) <= k + d < 2**63})
    rows = spark.createDataFrame([(k, "a") for k in asked] + [(None, "b"), (1, "c")], "k long, x string")
    got = [tuple(r) for r in keyed.only_known(rows, bits, "k").collect()]
    assert sorted(got) == sorted([(k, "a") for k in known] + [(1, "c")])
    assert keyed.only_known(rows, bits.limit(0), "k").count() == 0


@pytest.mark.parametrize("name", ["line_amounts", "order_totals"])
def test_amounts_read_no_written_lines(spark, no_items, name):
    rows = registry.queries()[name](spark, FOLDER)
    assert rows.count() > 0


def test_buyers_of_purchases(spark):
    rng = random.Random(4)
    first = date(2023, 12, 28)
    data = [(rng.choice([None, *range(9)]), rng.choice([None, *(first + timedelta(days=k) for k in range(50))]), rng.choice(["x", "y", None])) for _ in range(300)]
    want = {}
    for c, d, category in data:
        if c is not None:
            for p, start in (("day", d), ("week", d and d - timedelta(days=d.weekday())), ("month", d and d.replace(day=1))):
                want.setdefault((p, start, category), set()).add(c)
    rows = spark.createDataFrame(data, "customer_id long, order_date date, product_category string").repartition(5)
    assert {tuple(r)[:3]: r[3] for r in rollups.buyers_of_purchases(rows).collect()} == {k: len(v) for k, v in want.items()}
    with pytest.raises(ValueError):
        rollups.buyers_of_purchases(rows, ["decade"])
    assert rollups.buyers_of_purchases(rows.limit(0)).collect() == []


def test_buyers_by_period_builds_no_sparse_bitmaps(spark, no_items):
    rows = registry.queries()["buyers_by_period"](spark, FOLDER)
    assert rows.count() > 0 and "bitmap" not in plan_of(rows)


def test_buyers_of_all_categories_hold_no_bitmaps(spark, no_items):
    rows = registry.queries()["buyers_of_all_categories"](spark, FOLDER)
    assert rows.count() > 0 and "bitmap" not in plan_of(rows)
    year = {r.period_start.year: r.unique_customers for r in rows.filter("period = 'year'").collect()}
    t = views.DomainTables(spark, FOLDER)
    orders = t.archive_lines().select("l_orderkey").distinct().join(t.archive_keys(), "l_orderkey")
    assert year == {r.y: r.n for r in orders.groupBy(F.year("order_date").alias("y")).agg(F.count_distinct("o_custkey").alias("n")).collect()}


def test_purchase_lines_read_no_written_lines(spark, no_items):
    assert registry.queries()["purchase_lines"](spark, FOLDER).count() > 0


def test_purchases_are_the_same_in_place(spark):
    rng = random.Random(5)
    customers = spark.createDataFrame([(f"c{k}", f"f{k}", f"l{k}") for k in range(5)], "customer_id string, first_name string, last_name string")
    orders = spark.createDataFrame([(f"o{k}", f"c{rng.randrange(6)}") for k in range(40)], "order_id string, customer_id string")
    items = spark.createDataFrame([(f"o{rng.randrange(45)}", k, f"p{rng.randrange(7)}") for k in range(200)], "order_id string, item_sequence int, product_id string")
    products = spark.createDataFrame([(f"p{k}", f"n{k}", k / 2) for k in range(6)], "product_id string, name string, price double")
    both = [f(customers, orders, items, products).collect() for f in (federated.purchases, federated.purchases_in_place)]
    assert sorted(both[0]) == sorted(both[1]) and both[0]


def test_price_audit_reads_no_written_lines(spark, no_items):
    assert registry.queries()["price_audit"](spark, FOLDER).columns[0] == "product_id"
