"""Derived tables: hourly statistics, sales, lifetime value, cohorts, statements, portfolios."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import labels
from ..functions.numbers import fixed, half_even, mean, ratio
from ..functions.times import Moment, day, monday_of, month_of, month_starts, previous_months
from .members import member_bitmaps, member_counts
from .ordered import ROWS_PER_BUCKET, running
from .ranks import value_at_rank
from .skew import join_spread

def _money_sum(c: Column | str) -> Column:
    return F.sum(F.col(c) if isinstance(c, str) else c).cast("decimal(28,2)")


def hourly_rollup(readings: DataFrame, fraction: float = 0.95, exact_rank: bool = True) -> DataFrame:
    """Per device, metric and hour: count, minimum, maximum, mean, p95 and population deviation.

    p95 is the ``max(floor(0.95 n), 1)``-th smallest value. ``exact_rank=False`` takes it from
    the sketch instead, in a single pass.
    """
    keys = ["device_id", "metric_name", "hour_start"]
    rows = readings.withColumn("hour_start", F.col("reading_bucket_hour")).withColumn(
        "_v", F.col("metric_value").cast("double")
    )
    stats = [
        F.count(F.lit(1)).alias("sample_count"),
        F.min("metric_value").cast("decimal(12,4)").alias("min_value"),
        F.max("metric_value").cast("decimal(12,4)").alias("max_value"),
        fixed(mean("metric_value")).cast("decimal(12,4)").alias("avg_value"),
        fixed(F.stddev_pop("_v")).cast("decimal(12,4)").alias("stddev_value"),
    ]
    if exact_rank:
        out = value_at_rank(rows, keys, "metric_value", fraction, "p95_value", stats)
    else:
        out = rows.groupBy(*keys).agg(*stats, F.percentile_approx("metric_value", fraction, 10_000).alias("p95_value"))
    return out.select(
        *keys,
        F.year("hour_start").alias("hour_year"),
        F.month("hour_start").alias("hour_month"),
        "sample_count", "min_value", "max_value", "avg_value",
        F.col("p95_value").cast("decimal(12,4)").alias("p95_value"),
        "stddev_value",
    )


def daily_sales(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Sales by order date, category and destination.

    Lines are combined per (order, category) before they meet the orders, so an order with very
    many lines arrives as a few rows, and the distinct order count becomes a plain count.
    """
    per_order = items.groupBy("order_id", "product_category").agg(
        F.sum("quantity").alias("_units"),
        _money_sum(F.col("unit_price") * F.col("quantity")).alias("_gross"),
        _money_sum("discount_amount").alias("_discount"),
        _money_sum("line_total").alias("_net"),
        F.count(F.lit(1)).alias("_lines"),
    )
    facts = orders.select("order_id", "customer_id", "order_date", "order_status", "shipping_country", "shipping_state")
    returned = F.col("order_status") == "returned"
    return (
        per_order.join(facts, "order_id")
        .groupBy(F.col("order_date").alias("summary_date"), "product_category", "shipping_country", "shipping_state")
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            F.sum("_units").alias("unit_count"),
            _money_sum("_gross").alias("gross_revenue"),
            _money_sum("_discount").alias("discount_total"),
            _money_sum("_net").alias("net_revenue"),
            F.sum(F.when(returned, F.col("_lines")).otherwise(0)).alias("return_count"),
            _money_sum(F.when(returned, F.col("_net")).otherwise(0)).alias("return_amount"),
            F.count_distinct("customer_id").alias("unique_customers"),
        )
        .withColumn("summary_year", F.year("summary_date"))
        .withColumn("summary_month", F.month("summary_date"))
    )


def daily_buyers(orders: DataFrame, items: DataFrame, numbers: DataFrame) -> DataFrame:
    """Who bought, per day and category, as bitmaps of customer numbers; customers without a number are left out."""
    per_order = items.select("order_id", "product_category").distinct()
    bought = per_order.join(orders.select("order_id", "customer_id", "order_date"), "order_id").select("customer_id", "order_date", "product_category").distinct()
    placed = join_spread(bought, numbers, "customer_id")
    return member_bitmaps(placed, [F.col("order_date").alias("summary_date"), "product_category"])


def buyers_by_period(daily: DataFrame, periods: Sequence[str] = ("day", "week", "month"), by: Sequence[str] = ("product_category",)) -> DataFrame:
    """Distinct customers per day, week, month, quarter or year and ``by``, all from the daily bitmaps."""
    _known_periods(periods)
    each = [
        member_counts(daily, [F.date_trunc(p, "summary_date").cast("date").alias("period_start"), *by], "unique_customers").select(
            F.lit(p).alias("period"), "period_start", *by, "unique_customers"
        )
        for p in periods
    ]
    return reduce(DataFrame.unionByName, each)


def _known_periods(periods: Sequence[str]) -> None:
    absent = sorted(set(periods) - {"day", "week", "month", "quarter", "year"})
    if absent or not periods:
        raise ValueError(f"no such period: {', '.join(absent)}")


def buyers_of_purchases(purchases: DataFrame, periods: Sequence[str] = ("day", "week", "month"), by: Sequence[str] = ("product_category",)) -> DataFrame:
    """``buyers_by_period`` from rows of customer_id, order_date and ``by``, where most groups hold few customers.

    Rows are laid out by customer and ``by`` once. There each customer becomes one row a period, and only counts leave.
    """
    _known_periods(periods)
    placed = purchases.filter(F.col("customer_id").isNotNull()).select("customer_id", "order_date", *by).repartition("customer_id", *by)
    starts = F.array(*[F.struct(F.lit(p).alias("period"), F.date_trunc(p, "order_date").cast("date").alias("period_start")) for p in periods])
    once = placed.select("customer_id", *by, F.inline(starts)).distinct()
    return once.groupBy("period", "period_start", *by).agg(F.count(F.lit(1)).alias("unique_customers"))


def weekly_products(orders: DataFrame, items: DataFrame, products: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Weekly units, revenue, mean price and return rate per product, ranked in its category.

    The rank runs over all products of a category, a group without a bound, so it is taken with
    the sliced ordered fold.
    """
    per_order = items.groupBy("order_id", "product_id").agg(
        F.sum("quantity").alias("_units"),
        _money_sum(F.col("unit_price") * F.col("quantity")).alias("_gross"),
    )
    weekly = (
        join_spread(
            per_order, orders.select("order_id", "order_date", "order_status"), "order_id",
            key_counts=items.groupBy("order_id").count(),
        )
        .groupBy("product_id", monday_of("order_date").alias("week_start_date"))
        .agg(
            F.sum("_units").alias("units_sold"),
            _money_sum("_gross").alias("gross_revenue"),
            F.sum(F.when(F.col("order_status") == "returned", F.col("_units")).otherwise(0)).alias("_returned"),
        )
    )
    sold = F.nullif(F.col("units_sold"), F.lit(0))
    # A product has one row per week by now, so no key is hot.
    rows = weekly.join(products.select("product_id", F.col("category").alias("product_category")), "product_id").select(
        "product_id", "product_category", "week_start_date",
        F.year("week_start_date").alias("week_year"),
        F.weekofyear("week_start_date").alias("week_of_year"),
        "units_sold", "gross_revenue",
        F.coalesce(half_even((F.col("gross_revenue") / sold).cast("decimal(28,6)"), 2), F.lit(0)).alias("average_selling_price"),
        F.coalesce(fixed(ratio(F.col("_returned"), sold)), F.lit(0.0)).alias("return_rate"),
    )
    return running(
        rows, ["product_category", "week_start_date"], [F.desc("units_sold"), F.desc("product_id")],
        by="units_sold", number="velocity_rank", rows_per_bucket=rows_per_bucket,
    )


def _delivered_per_month(orders: DataFrame) -> DataFrame:
    return (
        orders.filter(F.col("order_status") == "delivered")
        .groupBy("customer_id", month_of("order_date").alias("month_start"))
        .agg(
            F.count(F.lit(1)).alias("orders_this_month"),
            _money_sum("total_amount").alias("spend_this_month"),
            F.max("order_date").alias("_last_order"),
        )
    )


def monthly_ltv(
    customers: DataFrame, orders: DataFrame, as_of: Moment, months: int = 12, active_days: int = 90,
    ignore_later_orders: bool = False,
) -> DataFrame:
    """Month-end lifetime value per customer over the last full months, without gaps.

    A customer counts as active when any order lies within ``active_days`` before the snapshot
    *or after it*; ``ignore_later_orders`` drops the second half. The running sums see at most
    ``months`` rows per customer.
    """
    first, last = previous_months(as_of, months)
    monthly = _delivered_per_month(orders)
    latest = monthly.groupBy("customer_id").agg(F.max("_last_order").alias("_latest_order"))
    in_range = monthly.filter(F.col("month_start").between(F.lit(first), F.lit(last)))
    spine = (
        customers.select("customer_id", "loyalty_tier")
        .join(latest, "customer_id", "left")
        .withColumn("month_start", F.explode(month_starts(first, last)))
    )
    upto = Window.partitionBy("customer_id").orderBy("month_start").rowsBetween(Window.unboundedPreceding, 0)
    rows = spine.join(in_range, ["customer_id", "month_start"], "left")
    snapshot = F.last_day("month_start")
    if ignore_later_orders:
        # The newest order up to the snapshot: months before the range count through their maximum.
        earlier = monthly.filter(F.col("month_start") < F.lit(first)).groupBy("customer_id").agg(
            F.max("_last_order").alias("_earlier_order")
        )
        rows = rows.join(earlier, "customer_id", "left")
        newest = F.greatest(F.max("_last_order").over(upto), F.col("_earlier_order"))
    else:
        newest = F.col("_latest_order")
    return rows.select(
        "customer_id",
        F.year("month_start").alias("snapshot_year"),
        F.month("month_start").alias("snapshot_month"),
        snapshot.alias("snapshot_date"),
        F.coalesce(F.sum("spend_this_month").over(upto), F.lit(0)).cast("decimal(28,2)").alias("ltv"),
        F.coalesce(F.sum("orders_this_month").over(upto), F.lit(0)).alias("cumulative_orders"),
        F.coalesce("orders_this_month", F.lit(0)).alias("orders_this_month"),
        F.coalesce("spend_this_month", F.lit(0)).cast("decimal(28,2)").alias("spend_this_month"),
        "loyalty_tier",
        F.coalesce(F.datediff(snapshot, newest) <= active_days, F.lit(False)).alias("is_active"),
    )


def cohort_retention(customers: DataFrame, orders: DataFrame, as_of: Moment, offsets: int = 12) -> DataFrame:
    """Active share and revenue of each acquisition month, for the months after it, zeros included."""
    cohort = month_of("created_at")
    sizes = customers.groupBy(cohort.alias("cohort_start")).agg(F.count(F.lit(1)).alias("cohort_size"))
    this_month = F.trunc(day(as_of), "month")
    cells = (
        sizes.withColumn("months_since_acquisition", F.explode(F.sequence(F.lit(0), F.lit(offsets - 1))))
        .withColumn("month_start", F.add_months("cohort_start", F.col("months_since_acquisition")))
        .filter(F.col("month_start") <= this_month)
    )
    # One row per customer and month on the left, one per customer on the right.
    active = (
        _delivered_per_month(orders)
        .join(customers.select("customer_id", cohort.alias("cohort_start")), "customer_id")
        .groupBy("cohort_start", "month_start")
        .agg(F.count(F.lit(1)).alias("active_customers"), _money_sum("spend_this_month").alias("revenue_in_period"))
    )
    n = F.coalesce("active_customers", F.lit(0))
    revenue = F.coalesce("revenue_in_period", F.lit(0)).cast("decimal(28,2)")
    per_active = (F.col("revenue_in_period") / F.nullif(F.col("active_customers"), F.lit(0))).cast("decimal(28,6)")
    return cells.join(active, ["cohort_start", "month_start"], "left").select(
        F.year("cohort_start").alias("cohort_year"),
        F.month("cohort_start").alias("cohort_month"),
        "months_since_acquisition",
        "cohort_size",
        n.alias("active_customers"),
        fixed(ratio(n, F.col("cohort_size"))).alias("retention_rate"),
        revenue.alias("revenue_in_period"),
        F.coalesce(half_even(per_active, 2), F.lit(0)).cast("decimal(28,2)").alias("avg_revenue_per_active"),
    )


def current_ltv(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Delivered orders and their value per customer, zero where there is none."""
    stats = (
        orders.filter(F.col("order_status") == "delivered")
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("total_orders"), _money_sum("total_amount").alias("current_ltv"))
    )
    keep = [c for c in customers.columns if c not in ("total_orders", "current_ltv")]
    return customers.select(*keep).join(stats, "customer_id", "left").select(
        *keep,
        F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
        F.coalesce("current_ltv", F.lit(0)).cast("decimal(28,2)").alias("current_ltv"),
    )


def enriched_orders(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders with year, month, number of lines and the payment status their state implies."""
    counts = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("item_count"))
    return (
        orders.join(counts, "order_id", "left")
        .withColumn("item_count", F.coalesce("item_count", F.lit(0)))
        .withColumn("order_year", F.year("order_date"))
        .withColumn("order_month", F.month("order_date"))
        .withColumn("payment_status", labels.lookup("order_status", labels.PAYMENT_STATUS))
    )


def flat_items(items: DataFrame, nested: str = "product") -> DataFrame:
    """Order lines with the fields of a nested product as plain columns."""
    plain = [c for c in items.columns if c != nested]
    fields = items.schema[nested].dataType.fieldNames()
    return items.select(
        *plain, *[F.col(f"{nested}.{f}").alias(f if f.startswith("product_") else f"product_{f}") for f in fields]
    )


def line_amounts(items: DataFrame, tax_rate: str = "0.08") -> DataFrame:
    """Tax and total of each line from unit price, quantity and discount; cents, half to even."""
    base = F.col("unit_price").cast("decimal(14,2)") * F.col("quantity") - F.col("discount_amount").cast("decimal(14,2)")
    tax = base * F.lit(tax_rate).cast("decimal(6,4)")
    return items.withColumns({
        "tax_amount": half_even(tax, 2).cast("decimal(14,2)"),
        "line_total": half_even(base + tax, 2).cast("decimal(14,2)"),
    })


def order_totals(lines: DataFrame, shipping: DataFrame) -> DataFrame:
    """Order amounts from their lines and a shipping cost per order."""
    sums = lines.groupBy("order_id").agg(
        _money_sum(F.col("unit_price").cast("decimal(14,2)") * F.col("quantity")).alias("subtotal"),
        _money_sum("tax_amount").alias("tax_amount"),
        _money_sum("discount_amount").alias("discount_amount"),
    )
    total = F.col("subtotal") - F.col("discount_amount") + F.col("tax_amount") + F.col("shipping_cost")
    return sums.join(shipping.select("order_id", "shipping_cost"), "order_id").withColumn(
        "total_amount", half_even(total, 2).cast("decimal(28,2)")
    )


def attribution(conversions: DataFrame) -> DataFrame:
    """Campaign label and attributed revenue; a single touch takes the whole value."""
    shared = half_even(F.col("conversion_value") * F.col("attributed_share").cast("decimal(6,4)"), 2)
    return conversions.withColumns({
        "campaign_name": labels.campaign_label(F.col("channel"), F.col("conversion_timestamp")),
        "conversion_year": F.year("conversion_timestamp"),
        "conversion_month": F.month("conversion_timestamp"),
        "attributed_revenue": F.when(F.col("touch_count") > 1, shared)
        .otherwise(F.col("conversion_value")).cast("decimal(28,2)"),
    })


def monthly_statements(
    accounts: DataFrame, transactions: DataFrame, as_of: Moment, months: int = 6,
    fee_rate: str = "0.005", savings_rate: str = "0.0015",
) -> DataFrame:
    """Statements of the last full months for every account, closing balance carried forward.

    Rounding each month makes the balance non-linear, so it is folded in order. The fold runs
    over exactly ``months`` rows per account, already summed by month; its first opening balance
    is ``start_balance`` of the account.
    """
    first, last = previous_months(as_of, months)
    debit = F.col("transaction_type").isin(*labels.DEBIT_TYPES)
    monthly = (
        transactions.filter(F.col("txn_date").between(F.lit(first), F.last_day(F.lit(last))))
        .groupBy("account_id", month_of("txn_date").alias("month_start"))
        .agg(
            _money_sum(F.when(debit, F.col("amount")).otherwise(0)).alias("debits"),
            _money_sum(F.when(debit, F.lit(0)).otherwise(F.col("amount"))).alias("credits"),
            F.count(F.lit(1)).alias("txns"),
        )
    )
    cash = "decimal(28,2)"
    zero = F.lit(0).cast(cash)
    per_account = (
        accounts.select("account_id", "customer_id", "account_type", "start_balance")
        .withColumn("month_start", F.explode(month_starts(first, last)))
        .join(monthly, ["account_id", "month_start"], "left")
        .groupBy("account_id", "customer_id", "account_type", "start_balance")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "month_start",
                        F.coalesce("credits", zero).alias("credits"),
                        F.coalesce("debits", zero).alias("debits"),
                        F.coalesce("txns", F.lit(0)).cast("long").alias("txns"),
                    )
                )
            ).alias("_months")
        )
    )
    savings = F.col("account_type") == "savings"
    statement = (
        "struct<month_start:date,opening:decimal(28,2),closing:decimal(28,2),credits:decimal(28,2),"
        "debits:decimal(28,2),txns:bigint,fees:decimal(28,2),interest:decimal(28,2)>"
    )

    def next_month(done: Column, m: Column) -> Column:
        opening = F.when(F.size(done) == 0, F.col("start_balance").cast(cash)).otherwise(
            F.try_element_at(done, F.lit(-1))["closing"]
        )
        fees = half_even(m["debits"] * F.lit(fee_rate).cast("decimal(6,4)"), 2).cast(cash)
        interest = F.when(savings, half_even(opening * F.lit(savings_rate).cast("decimal(6,4)"), 2)).otherwise(0).cast(cash)
        closing = (opening + m["credits"] - m["debits"] - fees + interest).cast(cash)
        row = F.struct(
            m["month_start"].alias("month_start"), opening.alias("opening"), closing.alias("closing"),
            m["credits"].alias("credits"), m["debits"].alias("debits"), m["txns"].alias("txns"),
            fees.alias("fees"), interest.alias("interest"),
        ).cast(statement)
        return F.concat(done, F.array(row))

    folded = F.aggregate("_months", F.expr("array()").cast(f"array<{statement}>"), next_month)
    return per_account.select("account_id", "customer_id", F.explode(folded).alias("s")).select(
        "account_id", "customer_id",
        F.year("s.month_start").alias("statement_year"),
        F.month("s.month_start").alias("statement_month"),
        F.col("s.month_start").alias("period_start"),
        F.last_day("s.month_start").alias("period_end"),
        F.col("s.opening").alias("opening_balance"),
        F.col("s.closing").alias("closing_balance"),
        F.col("s.credits").alias("total_credits"),
        F.col("s.debits").alias("total_debits"),
        F.col("s.txns").alias("transaction_count"),
        F.col("s.fees").alias("fees_charged"),
        F.col("s.interest").alias("interest_earned"),
    )


def portfolio_daily(values: DataFrame) -> DataFrame:
    """Daily profit, return and compounded return from one portfolio value per account and day.

    A group is one account's calendar, one row per day, so a window holds it easily.
    """
    by_day = Window.partitionBy("account_id").orderBy("metric_date")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, 0)
    value = F.col("portfolio_value").cast("double")
    before = F.lag(value).over(by_day)
    daily = F.try_divide(value - before, before)
    rows = values.withColumn("_return", daily).withColumn("_pnl", value - before)
    compounded = F.exp(F.sum(F.log1p(F.coalesce("_return", F.lit(0.0)))).over(so_far)) - 1
    return rows.select(
        *values.columns,
        F.coalesce("_pnl", F.lit(0.0)).alias("daily_pnl"),
        (F.coalesce("_return", F.lit(0.0)) * 100).alias("daily_return_pct"),
        (compounded * 100).alias("cumulative_return_pct"),
    )


def compounded_returns(returns: DataFrame) -> DataFrame:
    """Compounded return per account from daily returns in percent (each above -100)."""
    so_far = Window.partitionBy("account_id").orderBy("metric_date").rowsBetween(Window.unboundedPreceding, 0)
    growth = F.log1p(F.col("daily_return_pct").cast("double") / 100.0)
    return returns.withColumn("cumulative_return_pct", (F.exp(F.sum(growth).over(so_far)) - 1) * 100)


def risk_scored(scores: DataFrame) -> DataFrame:
    return scores.withColumn("risk_tier", labels.risk_tier("risk_score"))


def days_in_service(devices: DataFrame, at: Column) -> DataFrame:
    return devices.withColumn("days_since_install", F.datediff(at.cast("date"), F.col("installed_at").cast("date")))


def window_minutes(windows: DataFrame) -> DataFrame:
    return windows.withColumn(
        "downtime_minutes", F.timestamp_diff("MINUTE", F.col("window_start"), F.col("window_end"))
    )


def available_balances(accounts: DataFrame, holds: DataFrame) -> DataFrame:
    """Balance minus the sum of the account's holds."""
    held = holds.groupBy("account_id").agg(_money_sum("amount").alias("held"))
    return accounts.join(held, "account_id", "left").withColumn(
        "available_balance", (F.col("current_balance") - F.coalesce("held", F.lit(0))).cast("decimal(28,2)")
    )
