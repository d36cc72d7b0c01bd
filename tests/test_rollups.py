"""Rollups against step-by-step arithmetic, and invariants on the given tables."""

import random
from datetime import date
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from emberline.functions import labels, numbers, times
from emberline.operators import rollups, signals
from emberline.sources.views import BUSINESS_TODAY, DomainTables

SMALL = "/root/testdata/sf0.001"
CENT = Decimal("0.01")


def test_statements_fold_month_by_month(spark):
    rng = random.Random(1)
    accounts = [(f"a{i}", f"c{i}", "savings" if i % 2 else "checking", Decimal(rng.randrange(-500000, 500000)) / 100) for i in range(12)]
    kinds = ["purchase", "withdrawal", "payment", "deposit", "refund"]
    txns = [(f"a{rng.randrange(14)}", date(2026, rng.randrange(1, 8), rng.randrange(1, 28)), rng.choice(kinds), Decimal(rng.randrange(1, 99999)) / 100) for _ in range(200)]
    got = rollups.monthly_statements(
        spark.createDataFrame(accounts, "account_id string, customer_id string, account_type string, start_balance decimal(14,2)"),
        spark.createDataFrame(txns, "account_id string, txn_date date, transaction_type string, amount decimal(14,2)"), "2026-07-15",
    )
    want = {}
    for a, _, kind, balance in accounts:
        for month in range(1, 7):
            mine = [t for t in txns if t[0] == a and t[1].month == month]
            debits = sum((t[3] for t in mine if t[2] in labels.DEBIT_TYPES), Decimal(0))
            credits = sum((t[3] for t in mine if t[2] not in labels.DEBIT_TYPES), Decimal(0))
            fees = (debits * Decimal("0.005")).quantize(CENT, ROUND_HALF_EVEN)
            interest = (balance * Decimal("0.0015")).quantize(CENT, ROUND_HALF_EVEN) if kind == "savings" else Decimal(0)
            closing = balance + credits - debits - fees + interest
            want[a, month] = (balance, closing, credits, debits, len(mine), fees, interest)
            balance = closing
    rows = {(x.account_id, x.statement_month): (x.opening_balance, x.closing_balance, x.total_credits, x.total_debits, x.transaction_count,
                                                x.fees_charged, x.interest_earned) for x in got.collect()}
    assert rows == want


def test_line_and_order_amounts(spark):
    lines = [("o1", Decimal("10.05"), 3, Decimal("0.40")), ("o1", Decimal("0.25"), 1, Decimal("0.00")), ("o2", Decimal("99.99"), 2, Decimal("20.00"))]
    items = rollups.line_amounts(spark.createDataFrame(lines, "order_id string, unit_price decimal(14,2), quantity int, discount_amount decimal(14,2)"))
    for x, (_, unit, n, off) in zip(items.collect(), lines):
        tax = (unit * n - off) * Decimal("0.08")
        assert x.tax_amount == tax.quantize(CENT, ROUND_HALF_EVEN)
        assert x.line_total == (unit * n - off + tax).quantize(CENT, ROUND_HALF_EVEN)
    shipping = spark.createDataFrame([("o1", Decimal("5.00")), ("o2", Decimal("0.00"))], "order_id string, shipping_cost decimal(14,2)")
    totals = {x.order_id: x.total_amount for x in rollups.order_totals(items, shipping).collect()}
    assert totals == {"o1": Decimal("37.40"), "o2": Decimal("194.38")}


def test_half_even_and_half_up(spark):
    row = spark.range(1).select(
        numbers.half_even(F.lit("2.345").cast("decimal(10,3)")).alias("even"),
        numbers.fixed(F.lit(2.345), 2).alias("up"),
        numbers.ratio(F.lit(1), F.lit(0)).alias("none"),
        numbers.lenient_integer(F.lit("10.0")).alias("ten"),
        numbers.lenient_integer(F.lit("x")).alias("no"),
        numbers.clamp(F.lit(7), 0, 5).alias("five"),
    ).first()
    assert (float(row.even), row.up, row.none, row.ten, row.no, row.five) == (2.34, 2.35, None, 10, None, 5)


def test_labels(spark):
    row = spark.range(1).select(
        labels.lookup(F.lit("returned"), labels.PAYMENT_STATUS).alias("paid"),
        labels.lookup(F.lit("odd"), labels.PAYMENT_STATUS).alias("none"),
        labels.is_uuid(F.lit("0b9d5d0e-8f2f-4d3a-9b1c-aaaaaaaaaaaa")).alias("yes"),
        labels.is_uuid(F.lit("0b9d5d0e")).alias("no"),
        labels.campaign_label(F.lit("email"), F.lit("2026-05-03").cast("date")).alias("label"),
        labels.table_of_batch(F.lit("orders_12")).alias("table"),
        times.iso_weekday(F.lit("2026-04-26").cast("date")).alias("sunday"),
    ).first()
    assert tuple(row) == ("refunded", None, True, False, "email_2026Q2", "orders", 7)


def test_previous_months():
    assert times.previous_months("2026-01-15", 3) == (date(2025, 10, 1), date(2025, 12, 1))


@pytest.fixture(scope="module")
def tables(spark):
    return DomainTables(spark, SMALL)


def test_ltv_ends_at_the_total_of_its_months(tables):
    ltv = rollups.monthly_ltv(tables.commerce_customers(), tables.orders_archive(), BUSINESS_TODAY)
    last = {x.customer_id: x.ltv for x in ltv.filter("snapshot_date = '2001-07-31'").collect()}
    orders = tables.orders_archive().filter("order_status = 'delivered' AND order_date BETWEEN '2000-08-01' AND '2001-07-31'")
    total = {x.customer_id: x.t for x in orders.groupBy("customer_id").agg(F.sum("total_amount").alias("t")).collect()}
    assert last == {c: total.get(c, 0) for c in last} and ltv.count() == 12 * len(last)


def test_cohort_cells_fit_their_cohort(tables):
    cells = rollups.cohort_retention(tables.commerce_customers(), tables.orders_archive(), BUSINESS_TODAY)
    assert cells.filter("active_customers > cohort_size OR retention_rate > 1").count() == 0
    assert cells.groupBy("cohort_year", "cohort_month").count().filter("count <> 12").count() == 0


def test_tiers_are_disjoint_and_complete(tables):
    rows = tables.readings()
    hot, cold = signals.tiered(rows, "reading_timestamp", times.instant("2024-01-30"))
    assert hot.count() + cold.count() == rows.count() and hot.intersect(cold).count() == 0


def test_compounding_equals_last_over_first(tables):
    daily = rollups.portfolio_daily(tables.portfolio_metrics().select("account_id", "metric_date", "portfolio_value"))
    ends = daily.groupBy("account_id").agg(
        (F.max_by("portfolio_value", "metric_date") / F.min_by("portfolio_value", "metric_date") - 1).cast("double").alias("a"),
        (F.max_by("cumulative_return_pct", "metric_date") / 100).alias("b"),
    )
    assert all(x.a == pytest.approx(x.b, rel=1e-4, abs=1e-5) for x in ends.collect())


def test_velocity_ranks_have_no_gaps(tables):
    weekly = rollups.weekly_products(tables.orders_archive(), tables.order_items(), tables.products(), rows_per_bucket=4)
    per = weekly.groupBy("product_category", "week_start_date").agg(
        F.count("*").alias("n"), F.max("velocity_rank").alias("top"), F.count_distinct("velocity_rank").alias("d")
    )
    assert per.filter("n <> top OR n <> d").count() == 0
