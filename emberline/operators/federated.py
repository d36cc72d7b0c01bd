"""Questions answered over live state and history in one plan.

The history side of every question is aggregated to one row per key first. Live rows, which may
crowd on one key, then meet it through ``join_spread``. Thresholds are arguments; their defaults
are the usual values. Every top-k ends in a unique key, so its rows are determined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import bands, triage_rank
from ..functions.numbers import fixed, mean, ratio
from ..functions.times import day, days_upto, instant, Moment, since
from .keyed import newest_per_key, only_for
from .ordered import ROWS_PER_BUCKET
from .signals import alerts_with_weather
from .skew import join_spread


def _top(df: DataFrame, order: list[Column], k: int | None) -> DataFrame:
    """The first ``k`` rows in order; all rows, unordered, when ``k`` is None."""
    return df if k is None else df.orderBy(*order).limit(k)


def _hour_parts(hourly: DataFrame) -> tuple:
    return ("hour_year", "hour_month") if "hour_year" in hourly.columns else (None, None)


# --- sensors ----------------------------------------------------------------------------------


def alert_triage(
    alerts: DataFrame, devices: DataFrame, hourly: DataFrame, weather: DataFrame, as_of: Moment,
    baseline_days: int = 14, top: int | None = 25, weather_at: str = "latest", rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Unacknowledged alerts against the metric's own p95 and the weather at the site.

    ``weather_at='latest'`` shows the site's newest observation, ``'raised'`` the one in force
    when the alert was raised.
    """
    if weather_at not in ("latest", "raised"):
        raise ValueError("weather_at must be 'latest' or 'raised'")
    opened = alerts.filter(~F.col("acknowledged"))
    past = hourly.filter(since("hour_start", as_of, baseline_days, *_hour_parts(hourly)))
    baseline = only_for(past, opened, ["device_id", "metric_name"]).groupBy("device_id", "metric_name").agg(
        F.max("p95_value").cast("double").alias("_p95"), mean("avg_value").alias("_avg")
    )
    place = devices.select("device_id", "device_class", "model", "zone")
    # Hot keys are counted on the alerts alone, before the first join.
    rows = join_spread(opened, place, "device_id")
    rows = join_spread(
        rows, baseline, ["device_id", "metric_name"], "left", key_counts=opened.groupBy("device_id", "metric_name").count()
    )
    if weather_at == "raised":
        rows = alerts_with_weather(rows, weather, rows_per_bucket)
    else:
        latest = newest_per_key(weather.filter(F.col("observation_time") <= instant(as_of)), ["site_id"], ["observation_time"]).select(
            "site_id", "temperature_c", "humidity_pct", "conditions"
        )
        rows = join_spread(rows, latest, "site_id", "left", key_counts=opened.groupBy("site_id").count())
    value = F.col("metric_value").cast("double")
    out = rows.select(
        "alert_id", "severity", "alert_type", "device_class", "model", "site_id", "zone", "metric_name",
        value.alias("alert_value"),
        fixed("_p95", 2).alias("baseline_p95"),
        fixed("_avg", 2).alias("baseline_avg"),
        fixed(F.try_divide(value - F.col("_p95"), F.col("_p95")), 3).alias("pct_over_baseline"),
        F.col("temperature_c").alias("site_temp_c"),
        F.col("humidity_pct").alias("site_humidity"),
        F.col("conditions").alias("site_weather"),
    )
    return _top(out, [triage_rank("severity"), F.desc_nulls_last("pct_over_baseline"), F.asc("alert_id")], top)


def deteriorating_devices(
    devices: DataFrame, hourly: DataFrame, as_of: Moment, short_days: int = 3, long_days: int = 14,
    change: float = 0.10, top: int | None = 30,
) -> DataFrame:
    """Degraded or maintained devices whose recent mean left their longer mean by more than ``change``.

    Both means come from one scan with a conditional aggregate.
    """
    recent = since("hour_start", as_of, short_days)
    v = F.col("avg_value")
    trend = hourly.filter(since("hour_start", as_of, long_days, *_hour_parts(hourly))).groupBy("device_id", "metric_name").agg(
        mean(F.when(recent, v)).alias("_short"), mean(v).alias("_long"), F.count_if(recent).alias("_hours")
    ).filter(F.col("_hours") > 0)
    watched = devices.filter(F.col("status").isin("degraded", "maintenance"))
    delta = F.try_divide(F.col("_short") - F.col("_long"), F.col("_long"))
    rows = trend.join(watched, "device_id").filter(F.abs(delta) > change)
    out = rows.select(
        "device_id", "site_id", "zone", "device_class", "status", "battery_percent", "metric_name",
        fixed("_short", 2).alias("avg_3d"), fixed("_long", 2).alias("avg_14d"), fixed(delta, 3).alias("delta_pct"),
    )
    return _top(out, [F.abs("delta_pct").desc(), F.asc("device_id"), F.asc("metric_name")], top)


def site_health(devices: DataFrame, daily: DataFrame, as_of: Moment, days: int = 30, top: int | None = 20) -> DataFrame:
    """Online share of every site now against its uptime over the last days."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    live = devices.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("live_device_count"),
        is_("online").alias("online_count"), is_("degraded").alias("degraded_count"), is_("offline").alias("offline_count"),
    )
    history = daily.filter(days_upto("summary_date", as_of, days)).groupBy("site_id").agg(
        mean("uptime_pct").alias("_uptime"), mean("avg_battery_pct").alias("_battery"),
        F.sum("alerts_critical").cast("long").alias("critical_alerts_30d"),
    )
    online = ratio(F.col("online_count") * 100, F.col("live_device_count"))
    rows = live.join(history, "site_id", "left").withColumn("_gap", fixed(F.col("_uptime") - online, 6))
    cols = [
        "site_id", "live_device_count", "online_count", "degraded_count", "offline_count",
        fixed(online, 2).alias("current_online_pct"),
        fixed("_uptime", 2).alias("historical_uptime_30d"),
        fixed("_battery", 2).alias("historical_battery_30d"),
        "critical_alerts_30d",
    ]
    return _top(rows, [F.desc_nulls_last("_gap"), F.asc("site_id")], top).select(*cols)


# --- commerce ---------------------------------------------------------------------------------


def top_categories(orders: DataFrame, items: DataFrame, per_order: bool = True) -> DataFrame:
    """Preferred category per customer: of the best single order, or overall.

    Lines shrink to (order, category) before they meet the orders; the winner is an aggregate.
    """
    spent = items.groupBy("order_id", "product_category").agg(F.sum("line_total").alias("_spent"))
    rows = spent.join(orders.select("order_id", "customer_id"), "order_id")
    if not per_order:
        rows = rows.groupBy("customer_id", "product_category").agg(F.sum("_spent").alias("_spent"), F.lit("").alias("order_id"))
    rank = F.struct(F.col("_spent"), F.col("order_id"), F.col("product_category"))
    return rows.groupBy("customer_id").agg(F.max(rank)["product_category"].alias("top_preferred_category"))


def cart_personalization(
    carts: DataFrame, customers: DataFrame, ltv: DataFrame, orders: DataFrame, items: DataFrame,
    per_order: bool = True, top: int | None = 25, as_of: Moment | None = None,
) -> DataFrame:
    """Customers filling a cart, with their lifetime value and preferred category.

    Of the archive only these customers' orders, and of the lines only those of such orders, are aggregated. With ``as_of`` the
    lifetime value is the newest by that day.
    """
    filled = carts.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("items_in_cart"),
        F.sum(F.col("quantity") * F.col("unit_price")).cast("decimal(28,2)").alias("cart_value"),
    )
    known = ltv if as_of is None else ltv.filter(F.col("snapshot_date") <= day(as_of))
    latest = newest_per_key(
        only_for(known, carts, ["customer_id"]).select("customer_id", "ltv", "loyalty_tier", "cumulative_orders", "snapshot_date"), ["customer_id"], ["snapshot_date"]
    )
    theirs = only_for(orders.select("customer_id", "order_id"), carts, ["customer_id"])
    lines = only_for(items, theirs, ["order_id"])
    out = (
        filled.join(customers.select("customer_id"), "customer_id")
        .join(latest, "customer_id", "left")
        .join(top_categories(theirs, lines, per_order), "customer_id", "left")
        .select(
            "customer_id", "items_in_cart", "cart_value", F.col("ltv").alias("historical_ltv"),
            "loyalty_tier", "cumulative_orders", "top_preferred_category",
        )
    )
    return _top(out, [F.desc("cart_value"), F.asc("customer_id")], top)


def price_audit(
    products: DataFrame, quotes: DataFrame, above: float = 0.10, top: int | None = 30, as_of: Moment | None = None
) -> DataFrame:
    """Active products priced well above the mean competitor price of the newest week; with ``as_of``, the newest begun by that day."""
    if as_of is not None:
        quotes = quotes.filter(F.col("week_start_date") <= day(as_of))
    newest = quotes.agg(F.max("week_start_date").alias("w"))
    market = quotes.filter(F.col("week_start_date") == newest.scalar()).groupBy(F.col("our_product_id").alias("product_id")).agg(
        mean("competitor_price").alias("_market"), F.count(F.lit(1)).alias("competitor_quotes")
    )
    price = F.col("price").cast("double")
    rows = products.filter("is_active").join(market, "product_id").filter(price > F.col("_market") * (1 + above))
    out = rows.select(
        "product_id", F.col("name").alias("product"), "category", "brand", price.alias("our_price"),
        fixed("_market").alias("avg_competitor_price"),
        fixed(ratio((price - F.col("_market")) * 100, F.col("_market")), 2).alias("pct_above_market"),
        "competitor_quotes", "stock_quantity",
    )
    return _top(out, [F.desc("pct_above_market"), F.asc("product_id")], top)


def return_rates(orders: DataFrame) -> DataFrame:
    returned = F.count_if(F.col("order_status") == "returned")
    return orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("lifetime_orders"), returned.alias("lifetime_returns"),
        ratio(returned, F.count(F.lit(1))).alias("_rate"),
    )


def order_risk(
    inflight: DataFrame, archive: DataFrame, high: float = 0.15, medium: float = 0.08, top: int | None = 30
) -> DataFrame:
    """Orders in fulfilment with the return rate of their customer. No history reads as LOW."""
    live = inflight.filter(F.col("order_status").isin("processing", "shipped"))
    rows = join_spread(live, return_rates(only_for(archive, live, ["customer_id"])), "customer_id", "left")
    flag = bands(F.col("_rate"), (high, "HIGH"), (medium, "MEDIUM"), otherwise="LOW", strict=False)
    out = rows.select(
        "order_id", "customer_id", "order_date", "order_status", "total_amount", "lifetime_orders", "lifetime_returns",
        fixed("_rate", 3).alias("return_rate"), flag.alias("risk_flag"), "_rate",
    )
    order = [F.desc_nulls_last("_rate"), F.desc("total_amount"), F.asc("order_id")]
    return _top(out, order, top).drop("_rate")


def session_potential(
    sessions: DataFrame, customers: DataFrame, retention: DataFrame, min_retention: float = 0.25, min_views: int = 5,
    top: int | None = 25,
) -> DataFrame:
    """Busy sessions of customers from well-retained acquisition months."""
    mature = retention.groupBy("cohort_year", "cohort_month").agg(
        F.max_by("retention_rate", "months_since_acquisition").alias("_rate")
    ).filter(F.col("_rate") > min_retention)
    cohort = customers.select(
        "customer_id", F.year("created_at").alias("cohort_year"), F.month("created_at").alias("cohort_month")
    )
    # Customers crowd on few cohorts; the cohort side has one row per calendar month.
    of_customer = join_spread(cohort, mature, ["cohort_year", "cohort_month"])
    rows = join_spread(sessions.filter(F.col("page_views") > min_views), of_customer, "customer_id")
    out = rows.select(
        "customer_id", "session_number", "session_start", "page_views", "cart_additions", "cohort_year", "cohort_month",
        fixed("_rate", 4).alias("cohort_retention"),
    )
    order = [F.desc("cohort_retention"), F.desc("page_views"), F.asc("customer_id"), F.asc("session_number")]
    return _top(out, order, top)


# --- financial --------------------------------------------------------------------------------


def authorization_context(
    authorizing: DataFrame, accounts: DataFrame, archive: DataFrame, risk: DataFrame, as_of: Moment,
    baseline_days: int = 180, times_average: float = 5, min_history: int = 3, top: int | None = 30,
) -> DataFrame:
    """Transactions asking for authorization against the customer's spending and risk tier."""
    asking = authorizing.filter(F.col("auth_status") == "requesting")
    asked = asking.groupBy("account_id", "merchant_category").count()
    of_account = only_for(accounts.select("account_id", "customer_id"), asking, ["account_id"])
    pairs = asked.drop("count").join(of_account, "account_id")
    spent = archive.filter(days_upto("txn_date", as_of, baseline_days) & (F.col("status") == "posted"))
    usual = only_for(spent, pairs, ["customer_id", "merchant_category"]).groupBy("customer_id", "merchant_category").agg(
        mean("amount").alias("_avg"), F.max("amount").cast("double").alias("_max"), F.count(F.lit(1)).alias("baseline_n")
    )
    known = risk.filter(F.col("snapshot_date") <= day(as_of))
    latest = newest_per_key(
        only_for(known, of_account, ["customer_id"]).select("customer_id", "risk_score", "risk_tier", "snapshot_date"), ["customer_id"], ["snapshot_date"]
    )
    # History moves to the (account, category) pairs that are asking, so that the live rows meet it
    # on their own columns and no pair is formed that nobody asked for.
    context = join_spread(pairs, usual, ["customer_id", "merchant_category"], "left").drop("customer_id")
    owner = join_spread(of_account, latest.drop("snapshot_date"), "customer_id", "left")
    rows = join_spread(asking, owner, "account_id")
    rows = join_spread(rows, context, ["account_id", "merchant_category"], "left", key_counts=asked)
    amount = F.col("amount").cast("double")
    advice = (
        F.when(F.col("risk_tier").isin("high", "restricted"), "REVIEW")
        .when((amount > F.col("_avg") * times_average) & (F.col("baseline_n") > min_history), "REVIEW")
        .when(amount > F.col("_max"), "WATCH")
        .otherwise("OK")
    )
    out = rows.select(
        "account_id", "transaction_id", "initiated_at", amount.alias("authorizing_amount"), "merchant_name",
        "merchant_category", "merchant_country", "channel",
        fixed("_avg", 2).alias("baseline_avg_amount"), fixed("_max", 2).alias("baseline_max_amount"), "baseline_n",
        fixed(F.try_divide(amount, F.col("_avg")), 2).alias("ratio_vs_avg"),
        "risk_score", "risk_tier", advice.alias("auth_recommendation"),
    )
    return _top(out, [F.desc("initiated_at"), F.asc("transaction_id")], top)


def fraud_triage(
    alerts: DataFrame, customers: DataFrame, fraud_labels: DataFrame, top: int | None = 25
) -> DataFrame:
    """Open fraud alerts with the confirmed fraud history of the customer."""
    prior = fraud_labels.filter("is_fraud").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("lifetime_fraud_count"),
        F.sum("loss_amount").alias("_loss"), F.sum("recovered_amount").alias("_recovered"),
    )
    who = customers.select(
        "customer_id", F.concat("first_name", F.lit(" "), "last_name").alias("customer_name"),
        F.col("risk_tier").alias("current_risk_tier"),
    ).join(prior, "customer_id", "left")
    out = join_spread(alerts, who, "customer_id").select(
        "alert_id", "severity", "alert_type", "raised_at", F.col("status").alias("case_status"), "assigned_to",
        fixed("risk_score", 2).alias("alert_risk_score"), "customer_name", "current_risk_tier", "lifetime_fraud_count",
        fixed("_loss", 2).alias("lifetime_loss"), fixed("_recovered", 2).alias("lifetime_recovered"),
    )
    order = [triage_rank("severity"), F.desc_nulls_last("lifetime_fraud_count"), F.asc("alert_id")]
    return _top(out, order, top)


def portfolio_exposure(
    accounts: DataFrame, metrics: DataFrame, market: DataFrame, as_of: Moment, ticker: str = "AAPL", days: int = 30,
    top: int | None = 25,
) -> DataFrame:
    """Investment accounts behind a benchmark: mean daily return minus the ticker's.

    The benchmark is one value; it enters as a scalar subquery, not as a join.
    """
    recent = metrics.filter(days_upto("metric_date", as_of, days)).groupBy("account_id").agg(
        mean("daily_return_pct").alias("_return"), mean("volatility_30d").alias("_vol"),
        F.max_by("portfolio_value", "metric_date").alias("_last"),
    )
    move = F.try_divide(
        F.col("close_price").cast("double") - F.col("open_price").cast("double"), F.col("open_price").cast("double")
    ) * 100.0
    bench = market.filter((F.col("ticker") == ticker) & days_upto("quote_date", as_of, days)).agg(mean(move, "decimal(28,12)").alias("b"))
    rows = (
        accounts.filter((F.col("account_type") == "investment") & (F.col("status") == "active"))
        .join(recent, "account_id")
        .withColumn("_bench", bench.scalar())
        .withColumn("_alpha", fixed(F.col("_return") - F.col("_bench"), 4))
    )
    out = rows.select(
        "customer_id", "account_id", F.col("current_balance").cast("double").alias("live_balance"),
        fixed("_last", 2).alias("last_closing_value"), fixed("_return").alias("portfolio_avg_daily_return"),
        fixed("_vol").alias("portfolio_volatility"), fixed("_bench").alias("benchmark_avg_daily_return"),
        F.col("_alpha").alias("alpha_30d"),
    )
    return _top(out, [F.asc_nulls_last("alpha_30d"), F.asc("account_id")], top)


def compliance_watchlist(
    transfers: DataFrame, accounts: DataFrame, customers: DataFrame, filings: DataFrame, as_of: Moment,
    min_amount: float = 10_000, days: int = 365, trigger: str = "greatest", top: int | None = 25,
) -> DataFrame:
    """Large pending transfers, those of customers with recent SAR filings first.

    ``trigger='greatest'`` shows the alphabetically last reason, ``'newest'`` that of the newest filing.
    """
    recent = filings.filter((F.col("filing_type") == "SAR") & since("filed_at", as_of, days))
    reason = F.max("trigger_reason") if trigger == "greatest" else F.max_by("trigger_reason", "filed_at")
    prior = recent.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("sar_count_12mo"), F.max("filed_at").alias("last_filing_at"), reason.alias("last_trigger")
    )
    who = customers.select("customer_id", F.concat("first_name", F.lit(" "), "last_name").alias("customer_name"), "risk_tier")
    owner = join_spread(
        accounts.select(F.col("account_id").alias("source_account_id"), "customer_id"),
        who.join(prior, "customer_id", "left"), "customer_id",
    )
    large = transfers.filter((F.col("amount") >= min_amount) & F.col("status").isin("pending", "processing", "flagged"))
    out = join_spread(large, owner, "source_account_id").select(
        "customer_id", "customer_name", "risk_tier", "transfer_id", F.col("amount").cast("double").alias("amount"),
        "transfer_type", "destination_bank", "status", "sar_count_12mo", "last_filing_at", "last_trigger",
    )
    flagged = F.when(F.col("sar_count_12mo") > 0, 0).otherwise(1)
    return _top(out, [flagged.asc(), F.desc("amount"), F.asc("transfer_id")], top)


# --- boards and short forms -------------------------------------------------------------------


def alert_triage_short(alerts: DataFrame, devices: DataFrame, hourly: DataFrame, weather: DataFrame, as_of: Moment, top: int | None = 25) -> DataFrame:
    """The short triage list: ordered by excess over the p95 alone, one weather row per site."""
    rows = alert_triage(alerts, devices, hourly, weather, as_of, top=None).select(
        "alert_id", "severity", "alert_type", "metric_name", "alert_value", "baseline_p95", "pct_over_baseline",
        "site_temp_c", "site_weather",
    )
    return _top(rows, [F.desc_nulls_last("pct_over_baseline"), F.asc("alert_id")], top)


def site_health_by_day(devices: DataFrame, daily: DataFrame) -> DataFrame:
    """Every site's live share beside each of its daily uptimes, one row per site and day."""
    live = devices.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("live_device_count"), F.count_if(F.col("status") == "online").alias("online_count")
    )
    online = ratio(F.col("online_count") * 100, F.col("live_device_count"))
    return daily.select("site_id", "summary_date", "uptime_pct").join(live, "site_id").select(
        "site_id", "summary_date", "live_device_count", "online_count",
        fixed(online, 2).alias("current_online_pct"), fixed("uptime_pct", 2).alias("uptime_pct"),
    )


def device_timeline(devices: DataFrame, readings: DataFrame, hourly: DataFrame, alerts: DataFrame) -> DataFrame:
    """Everything about the devices as one long table: readings, hourly statistics and alerts.

    Joining the three to the device would pair each reading with each hour and each alert; a union
    of sections keeps every row once.
    """
    state = devices.select("device_id", F.col("status").alias("device_status"), "battery_percent")
    null = lambda t: F.lit(None).cast(t)
    sections = [
        readings.select(
            "device_id", F.lit("reading").alias("section"), F.col("reading_timestamp").alias("at"), "metric_name",
            F.col("metric_value").cast("double").alias("value"), null("double").alias("baseline_p95"),
            F.col("quality_code").alias("label"),
        ),
        hourly.select(
            "device_id", F.lit("hourly").alias("section"), F.col("hour_start").alias("at"), "metric_name",
            F.col("avg_value").cast("double").alias("value"), F.col("p95_value").cast("double").alias("baseline_p95"),
            null("string").alias("label"),
        ),
        alerts.select(
            "device_id", F.lit("alert").alias("section"), F.col("raised_at").alias("at"), "metric_name",
            F.col("metric_value").cast("double").alias("value"), null("double").alias("baseline_p95"),
            F.col("severity").alias("label"),
        ),
    ]
    rows = sections[0].unionByName(sections[1]).unionByName(sections[2])
    return join_spread(rows, state, "device_id")


def page_counts(page: DataFrame, readings: DataFrame, alerts: DataFrame) -> DataFrame:
    """Distinct metrics, distinct alerts and alphabetically greatest severity of the listed devices.

    Each input is counted on its own; joining both to the page first would multiply them. The list
    may have any length: Spark sends its ids to the scans while they are few.
    """
    ids = page.select("device_id").distinct()
    readings, alerts = (x.join(ids, "device_id", "left_semi") for x in (readings, alerts))
    metrics = readings.groupBy("device_id").agg(F.count_distinct("metric_name").alias("metric_count"))
    raised = alerts.groupBy("device_id").agg(
        F.count_distinct("alert_id").alias("alert_count"), F.max("severity").alias("highest_severity")
    )
    return (
        page.select("device_id", "status", "battery_percent", "site_id")
        .join(metrics, "device_id", "left").join(raised, "device_id", "left").na.fill(0, ["metric_count", "alert_count"])
    )


def history_counts(left: DataFrame, right: DataFrame, key: str, counted: str, name: str, keep: list[str]) -> DataFrame:
    """Rows of ``left`` with the number of their ``right`` rows, zero when there are none."""
    counts = right.groupBy(key).agg(F.count(counted).alias(name))
    return left.select(key, *keep).join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def purchases(customers: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Who bought what at which price: one row per order line."""
    placed = join_spread(orders.select("order_id", "customer_id"), customers.select("customer_id", "first_name", "last_name"), "customer_id")
    lines = join_spread(items.select("order_id", "item_sequence", "product_id"), placed, "order_id", key_counts=items.groupBy("order_id").count())
    what = products.select("product_id", F.col("name").alias("product_name"), "price")
    return join_spread(lines, what, "product_id", key_counts=items.groupBy("product_id").count()).select(
        "order_id", "item_sequence", "first_name", "last_name", "product_name", F.col("price").cast("double").alias("price")
    )


def purchases_in_place(customers: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """``purchases`` of lines that lie by order already: customers meet the orders, as these are fewer, and only the products move the lines again.

    No keys are counted; a key with very many rows is left to the splitting of skewed joins.
    """
    placed = orders.select("order_id", "customer_id").join(customers.select("customer_id", "first_name", "last_name").hint("merge"), "customer_id")
    lines = items.select("order_id", "item_sequence", "product_id").join(placed.drop("customer_id").hint("merge"), "order_id")
    what = products.select("product_id", F.col("name").alias("product_name"), "price").hint("merge")
    return lines.join(what, "product_id").select(
        "order_id", "item_sequence", "first_name", "last_name", "product_name", F.col("price").cast("double").alias("price")
    )


def orders_board(today: DataFrame, daily: DataFrame, as_of: Moment, days: int = 30) -> DataFrame:
    """Orders and revenue of the day against the mean daily revenue before it."""
    now = today.filter(F.col("order_date") == day(as_of)).agg(
        F.count(F.lit(1)).alias("orders_today"), F.coalesce(F.sum("total_amount"), F.lit(0)).cast("double").alias("revenue_today")
    )
    past = daily.filter((F.col("summary_date") >= F.date_sub(day(as_of), days)) & (F.col("summary_date") < day(as_of)))
    per_day = past.groupBy("summary_date").agg(F.sum("net_revenue").alias("_net"))
    usual = per_day.agg(mean("_net", "decimal(30,2)").alias("m"))
    rows = now.withColumn("_usual", usual.scalar())
    return rows.select(
        "orders_today", "revenue_today", fixed("_usual", 2).alias("avg_daily_revenue"),
        fixed(F.try_divide(F.col("revenue_today"), F.col("_usual"))).alias("ratio_to_usual"),
    )


def spend_monitor(
    recent: DataFrame, archive: DataFrame, as_of: Moment, days: int = 30, recent_days: int = 7
) -> DataFrame:
    """Recent card spend of each customer per day against the mean daily spend of the weeks before."""
    now = recent.filter(days_upto("txn_date", as_of, recent_days)).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("recent_transactions"), F.sum("amount").alias("_recent")
    )
    cut = F.date_sub(day(as_of), recent_days)
    past = archive.filter((F.col("txn_date") >= F.date_sub(cut, days)) & (F.col("txn_date") < cut)).groupBy("customer_id").agg(
        F.sum("amount").alias("_past")
    )
    per_day, usual = F.col("_recent").cast("double") / recent_days, F.col("_past").cast("double") / days
    return now.join(past, "customer_id", "left").select(
        "customer_id", "recent_transactions", F.col("_recent").cast("double").alias("recent_spend"),
        fixed(usual).alias("usual_daily_spend"), fixed(F.try_divide(per_day, usual)).alias("spend_ratio"),
    )
