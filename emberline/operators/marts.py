"""Facts and dimensions loaded from the operational tables.

Every mart has all its columns. Source columns named in a ``_have`` call are optional: without them
the column is null. All others must be there, or building the mart fails. Facts keep every line; the dimension side of each join
is unique per key, and hot keys of the fact side are sliced by ``join_spread``. Dimension numbers
come from the sliced ordered count, not from one global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import bands
from ..functions.numbers import fahrenheit, ratio
from ..functions.times import Moment, calendar, day, hour_of, iso_weekday
from .ordered import surrogate_keys
from .skew import join_spread

OPEN_END = "9999-12-31"


def _have(df: DataFrame, names: str, kind: str = "string") -> list[Column]:
    return [F.col(n) if n in df.columns else F.lit(None).cast(kind).alias(n) for n in names.split()]


def _absent(names: str, kind: str = "string") -> list[Column]:
    """Columns that no source fills yet."""
    return [F.lit(None).cast(kind).alias(n) for n in names.split()]


def _fixed_values(**values) -> list[Column]:
    """Columns that carry a constant until a later job fills them."""
    return [F.lit(v).alias(n) for n, v in values.items()]


def _current_version(created: str) -> list[Column]:
    return [
        F.col(created).cast("date").alias("effective_date"),
        F.lit(OPEN_END).cast("date").alias("end_date"),
        F.lit(True).alias("is_current"),
    ]


def customer_value_segment(value: Column) -> Column:
    return bands(value, (5000, "high_value"), (1000, "regular"), otherwise="low_value")


def balance_segment(balance: Column) -> Column:
    return bands(balance, (100000, "high_value"), (10000, "medium_value"), otherwise="standard")


def sales_fact(orders: DataFrame, items: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Delivered and returned order lines with their order, customer and product."""
    sold = orders.filter(F.col("order_status").isin("delivered", "returned"))
    order_cols = sold.select(
        "order_id", "order_date", "order_timestamp", *calendar("order_date", "order"), "customer_id",
        F.col("total_amount").cast("double").alias("order_total"),
        "order_status", *_have(sold, "payment_method payment_status shipping_country shipping_state shipping_city"),
        *_have(sold, "order_shipping", "double"), *_have(sold, "created_at updated_at", "timestamp_ntz"),
    )
    # An order's own sums over its lines; one row an order, so no key of this join is hot.
    cash = lambda c: F.sum(c).cast("double")
    of_lines = items.groupBy("order_id").agg(
        cash(F.col("unit_price") * F.col("quantity")).alias("order_subtotal"), cash("tax_amount").alias("order_tax"),
        cash("discount_amount").alias("order_discount"),
    )
    order_cols = order_cols.join(of_lines, "order_id", "left")
    buyer = customers.select(
        "customer_id", F.col("email").alias("customer_email"),
        F.concat("first_name", F.lit(" "), "last_name").alias("customer_name"),
        F.col("loyalty_tier").alias("customer_loyalty_tier"),
        customer_value_segment(F.col("lifetime_value")).alias("customer_segment"),
        (F.col("total_orders") == 1).alias("is_first_purchase"),
    )
    placed = join_spread(order_cols, buyer, "customer_id", key_counts=sold.groupBy("customer_id").count())
    lines = items.select(
        "order_id", "item_sequence", "product_id", "product_sku", "product_name", "quantity",
        F.col("unit_price").cast("double").alias("unit_price"), F.col("discount_amount").cast("double").alias("discount_amount"),
        F.col("tax_amount").cast("double").alias("tax_amount"), F.col("line_total").cast("double").alias("line_total"),
    )
    what = products.select(
        "product_id", F.col("category").alias("product_category"), F.col("subcategory").alias("product_subcategory"),
        F.col("brand").alias("product_brand"),
    )
    rows = join_spread(lines, placed, "order_id", key_counts=items.groupBy("order_id").count())
    rows = join_spread(rows, what, "product_id", key_counts=items.groupBy("product_id").count())
    return rows.select(
        F.sha2(F.concat_ws("/", "order_id", "item_sequence"), 256).alias("sale_id"),
        *rows.columns,
        (F.col("order_status") == "returned").alias("is_returned"),
        (F.col("discount_amount") > 0).alias("is_discounted"),
    )


def commerce_customer_dim(customers: DataFrame) -> DataFrame:
    value, orders = F.col("lifetime_value").cast("double"), F.col("total_orders")
    segment = (
        F.when(F.col("lifetime_value") > 5000, "high_value").when(F.col("lifetime_value") > 1000, "regular")
        .when(orders == 0, "new").otherwise("low_value")
    )
    rows = customers.select(
        "customer_id", *_have(customers, "email first_name last_name"),
        F.concat("first_name", F.lit(" "), "last_name").alias("full_name"),
        *_have(customers, "phone age_group gender shipping_street shipping_city shipping_state shipping_zip shipping_country"),
        "total_orders", (orders * 3).alias("total_items_purchased"),
        value.alias("lifetime_value"),
        F.coalesce(ratio(value, F.when(orders > 0, orders)), F.lit(0.0)).alias("average_order_value"),
        "loyalty_tier", segment.alias("customer_segment"),
        *_absent("days_since_first_order days_since_last_order", "int"), *_absent("rfm_score preferred_category"),
        *_have(customers, "preferred_payment_method"), *_have(customers, "marketing_opt_in", "boolean"),
        *_current_version("created_at"), "created_at", *_have(customers, "updated_at", "timestamp_ntz"),
    )
    return surrogate_keys(rows, "customer_key", [F.asc("customer_id")], "customer_id")


def product_dim(products: DataFrame) -> DataFrame:
    price, cost = F.col("price").cast("double"), F.col("cost").cast("double")
    rows = products.select(
        "product_id", *_have(products, "sku name description category subcategory brand"),
        price.alias("current_price"), cost.alias("cost"),
        F.when(cost > 0, ratio(price - cost, price) * 100).otherwise(0.0).alias("margin_percent"),
        *_fixed_values(total_units_sold=0, total_revenue=0, return_rate=0, days_out_of_stock=0),
        *[c.alias("average_rating") for c in _have(products, "rating_avg", "double")],
        *[c.alias("review_count") for c in _have(products, "rating_count", "int")],
        *_have(products, "weight_kg", "double"), *_have(products, "dimensions_cm"), *_absent("discontinuation_date", "date"),
        F.col("stock_quantity").alias("current_stock"), *_have(products, "reorder_level", "int"),
        *_have(products, "is_active", "boolean"),
        *_current_version("created_at"), "created_at", *_have(products, "updated_at", "timestamp_ntz"),
    )
    return surrogate_keys(rows, "product_key", [F.asc("product_id")], "product_id")


MEASURES = "temperature humidity pressure energy_kwh co2_ppm pm25_ugm3 voc_ppb water_flow_lpm vibration_hz light_lux signal_strength battery_level"


PLACE = "location_name location_building location_floor location_room"


def metrics_fact(readings: DataFrame, devices: DataFrame, as_of: Moment) -> DataFrame:
    """Wide sensor rows from before today with their device and calendar parts."""
    at = F.col("reading_timestamp")
    old = readings.filter(at.cast("date") < day(as_of))
    place = devices.select("device_id", *_have(devices, f"device_name device_type manufacturer model {PLACE} site_id zone"), *_have(devices, "latitude longitude", "double"))
    rows = join_spread(old, place, "device_id")
    date = at.cast("date")
    return rows.select(
        "reading_id", "device_id", at, date.alias("reading_date"),
        F.year(date).alias("reading_year"), F.month(date).alias("reading_month"), F.dayofmonth(date).alias("reading_day"),
        F.hour(at).alias("reading_hour"), F.minute(at).alias("reading_minute"), iso_weekday(date).alias("day_of_week"),
        *[c for c in place.columns if c != "device_id"],
        *_have(rows, MEASURES, "double"), *_have(rows, "motion_detected", "boolean"),
        *_have(rows, "gps_latitude gps_longitude gps_altitude gps_speed", "double"), *_have(rows, "data_quality"),
        *_have(rows, "sequence_number", "long"), at.alias("created_at"),
        F.col("temperature").alias("temperature_celsius"),
        fahrenheit(F.col("temperature")).alias("temperature_fahrenheit"),
        *_fixed_values(is_anomaly=False, anomaly_score=0.0),
    )


def device_dim(devices: DataFrame, as_of: Moment) -> DataFrame:
    rows = devices.select(
        "device_id", *_have(devices, f"device_name device_type device_class manufacturer model firmware_version {PLACE} site_id zone"),
        *_have(devices, "latitude longitude", "double"),
        F.col("installed_at").alias("installation_date"), *_have(devices, "warranty_expiry_date", "date"),
        *_have(devices, "total_readings", "long"),
        *[c.alias("avg_uptime_percentage") for c in _have(devices, "uptime_percentage", "double")],
        *[c.alias("avg_signal_strength") for c in _have(devices, "signal_strength_dbm", "int")],
        F.col("battery_percent").alias("avg_battery_level"),
        *_fixed_values(total_downtime_hours=0, error_count=0, warning_count=0, alert_count=0, maintenance_count=0,
                       data_quality_score=85.0, anomaly_rate=0.02),
        F.col("status").alias("current_status"),
        F.col("last_heartbeat").alias("last_seen"),
        F.datediff(day(as_of), F.col("last_maintenance_date")).alias("days_since_last_maintenance"),
        *_current_version("installed_at"), F.col("installed_at").alias("created_at"), "updated_at",
    )
    return surrogate_keys(rows, "device_key", [F.asc("device_id")], "device_id")


def wide_hourly(readings: DataFrame, devices: DataFrame, as_of: Moment, expected: int = 4, minutes: int = 15) -> DataFrame:
    """One wide row of statistics per device and hour from before today.

    The statistics are complete before the device columns are joined: one row per device-hour
    crosses that shuffle, not one per reading.
    """
    at = F.col("reading_timestamp")
    v = lambda c: F.col(c).cast("double")
    moved = F.coalesce(F.col("motion_detected"), F.lit(False))
    stats = [F.count(F.lit(1)).alias("reading_count")]
    for c in ("temperature", "humidity", "pressure"):
        stats += [F.avg(v(c)).alias(f"avg_{c}"), F.min(v(c)).alias(f"min_{c}"), F.max(v(c)).alias(f"max_{c}")]
    stats += [
        F.stddev(v("temperature")).alias("stddev_temperature"),
        F.sum(v("energy_kwh")).alias("total_energy_kwh"), F.avg(v("energy_kwh")).alias("avg_power_kw"),
        F.max(v("energy_kwh")).alias("peak_power_kw"),
        F.avg(v("co2_ppm")).alias("avg_co2_ppm"), F.max(v("co2_ppm")).alias("max_co2_ppm"),
        F.avg(v("pm25_ugm3")).alias("avg_pm25_ugm3"), F.max(v("pm25_ugm3")).alias("max_pm25_ugm3"),
        F.avg(v("voc_ppb")).alias("avg_voc_ppb"),
        F.count_if(moved).alias("motion_events"), (F.count_if(moved) * minutes).alias("motion_duration_minutes"),
        F.sum(v("water_flow_lpm") * minutes).alias("total_water_flow_liters"), F.avg(v("water_flow_lpm")).alias("avg_flow_rate_lpm"),
        F.avg(v("signal_strength")).alias("avg_signal_strength"), F.min(v("signal_strength")).alias("min_signal_strength"),
        F.avg(v("battery_level")).alias("avg_battery_level"), F.min(v("battery_level")).alias("min_battery_level"),
        F.max(at).alias("created_at"),
    ]
    hourly = readings.filter(at.cast("date") < day(as_of)).groupBy("device_id", hour_of(at).alias("aggregate_timestamp")).agg(*stats)
    place = devices.select("device_id", *_have(devices, "device_type location_building location_floor"))
    hour = F.col("aggregate_timestamp")
    # A device has one row per hour by now, so no key is hot.
    return hourly.join(place, "device_id").select(
        "device_id", hour,
        F.year(hour).alias("aggregate_year"), F.month(hour).alias("aggregate_month"),
        F.dayofmonth(hour).alias("aggregate_day"), F.hour(hour).alias("aggregate_hour"),
        *[c for c in place.columns if c != "device_id"],
        *[c for c in hourly.columns if c not in ("device_id", "aggregate_timestamp")],
        F.lit(expected).alias("expected_reading_count"),
        F.greatest(F.lit(0), expected - F.col("reading_count")).alias("missing_reading_count"),
        *_fixed_values(anomaly_count=0, anomaly_rate=0.0),
    )


def transaction_fact(transactions: DataFrame, accounts: DataFrame, customers: DataFrame, as_of: Moment) -> DataFrame:
    """Transactions from before today with account, customer, segments and risk flags."""
    old = transactions.filter(F.col("txn_date") < day(as_of))
    holder = customers.select(
        "customer_id", *_have(customers, "customer_type"), F.col("risk_tier").alias("customer_risk_rating"),
        balance_segment(F.col("total_balance")).alias("customer_segment"),
    )
    owner = join_spread(
        accounts.select("account_id", "customer_id", "account_type", *_have(accounts, "account_subtype")), holder, "customer_id"
    )
    rows = join_spread(old.drop("customer_id"), owner, "account_id")
    date, at, score, amount = F.col("txn_date"), F.col("txn_timestamp"), F.col("fraud_score"), F.col("amount").cast("double")
    before, after = _have(rows, "balance_before balance_after", "double")
    return rows.select(
        "transaction_id", "account_id", "customer_id", at.alias("transaction_timestamp"), date.alias("transaction_date"),
        F.year(date).alias("transaction_year"), F.month(date).alias("transaction_month"),
        F.dayofmonth(date).alias("transaction_day"), F.hour(at).alias("transaction_hour"),
        iso_weekday(date).alias("day_of_week"), F.dayofmonth(date).alias("day_of_month"),
        F.weekofyear(date).alias("week_of_year"), F.quarter(date).alias("quarter"),
        "transaction_type", *_have(rows, "transaction_category"), amount.alias("amount"), *_have(rows, "currency"),
        before, after, (after - before).alias("balance_change"),
        "account_type", "account_subtype", "customer_type", "customer_risk_rating", "customer_segment",
        *_have(rows, "from_account_id to_account_id merchant_name merchant_category"), *_absent("merchant_category_code"),
        *_have(rows, "location_city location_state"), F.col("merchant_country").alias("location_country"),
        *_have(rows, "latitude longitude", "double"), *_have(rows, "channel device_id"),
        F.when(F.col("channel").isin("mobile", "online"), "digital").otherwise("physical").alias("device_type"),
        "status", (F.col("status") == "completed").alias("is_completed"), *_have(rows, "is_flagged", "boolean"),
        "fraud_score", (score > 0.7).alias("is_fraud"),
        bands(score, (0.8, "high_risk"), (0.5, "medium_risk"), otherwise="low_risk").alias("fraud_type"),
        (amount > 10000).alias("is_large_cash"), (score > 0.8).alias("requires_sar"),
        iso_weekday(date).isin(6, 7).alias("is_weekend"),
        F.hour(at).between(9, 17).alias("is_business_hours"),
        (F.col("merchant_country") != "USA").alias("is_cross_border"),
        *_fixed_values(is_reversed=False, is_structured=False, is_high_risk_merchant=False),
        *_have(rows, "created_at", "timestamp_ntz"),
    )


def account_dim(accounts: DataFrame, last_transactions: DataFrame, as_of: Moment) -> DataFrame:
    """Accounts with their age and the days since their last transaction."""
    rows = accounts.join(last_transactions, "account_id", "left").select(
        "account_id", "customer_id", *_have(accounts, "account_number"), "account_type", *_have(accounts, "account_subtype currency"),
        F.col("current_balance").cast("double").alias("current_balance"),
        *_have(accounts, "available_balance credit_limit", "double"),
        F.col("current_balance").cast("double").alias("monthly_avg_balance"),
        F.datediff(day(as_of), F.col("opened_date")).alias("days_since_opened"),
        F.datediff(day(as_of), F.col("last_transaction_date")).alias("days_since_last_transaction"),
        *_fixed_values(total_deposits=0, total_withdrawals=0, total_fees_paid=0, total_interest_earned=0, avg_transaction_amount=0,
                       nsf_count=0, lifetime_fees=0, lifetime_interest=0, estimated_profitability=0),
        *_fixed_values(transaction_count=0, balance_volatility=0.0, overdraft_count=0, fraud_alert_count=0, risk_score=0.1),
        "status", "opened_date", *_have(accounts, "closed_date", "date"), (F.col("status") == "active").alias("is_active"),
        *_current_version("opened_date"), F.col("opened_date").alias("created_at"), *_have(accounts, "updated_at", "timestamp_ntz"),
    )
    return surrogate_keys(rows, "account_key", [F.asc("account_id")], "account_id")


def financial_customer_dim(customers: DataFrame, as_of: Moment) -> DataFrame:
    balance = F.col("total_balance").cast("double")
    rows = customers.select(
        "customer_id", *_have(customers, "customer_type first_name last_name business_name age_group city state country"),
        *_have(customers, "credit_score", "int"), *_have(customers, "aml_risk_score", "double"),
        *_have(customers, "kyc_status"), *_have(customers, "pep_status", "boolean"), *_have(customers, "kyc_verified_date sanctions_check_date", "date"),
        *_absent("preferred_channel preferred_transaction_type"),
        "total_accounts", F.col("total_accounts").alias("active_accounts"), F.col("total_accounts").alias("products_held"),
        balance.alias("total_balance"),
        F.datediff(day(as_of), F.col("created_at").cast("date")).alias("relationship_length_days"),
        F.col("risk_tier").alias("risk_rating"), (F.col("risk_tier") == "high").alias("requires_enhanced_dd"),
        *_fixed_values(total_transactions=0, avg_transaction_amount=0, cross_sell_score=0.5, fraud_incidents=0),
        balance.alias("lifetime_value"), (balance * 0.02).alias("estimated_annual_revenue"),
        balance_segment(F.col("total_balance")).alias("customer_segment"),
        "status", F.col("created_at").cast("date").alias("customer_since"),
        F.col("last_login").cast("date").alias("last_contact_date"),
        *_current_version("created_at"), "created_at", *_have(customers, "updated_at", "timestamp_ntz"),
    )
    return surrogate_keys(rows, "customer_key", [F.asc("customer_id")], "customer_id")
