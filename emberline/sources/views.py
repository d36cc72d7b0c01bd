"""The domain tables, derived from the given TPC-H-like tables.

Each method returns one hot or cold table of the data model as a DataFrame over the Parquet
files of one folder. The cold tables that rollup jobs keep on storage (hourly statistics, daily
summaries, clean order lines, external feeds) are written once per application to the shared
folder by those same jobs and read back.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.numbers import fixed
from ..functions.times import day, hour_of, instant
from ..operators.keyed import key_bits, newest_per_key, only_for, only_known
from ..operators.rollups import cohort_retention, daily_sales, hourly_rollup, monthly_ltv
from ..operators.signals import daily_bars, sessions
from ..session import job_folder

IOT_NOW = "2024-01-31 00:00:00"
BUSINESS_TODAY = "2001-08-02"

_written: dict[tuple[str, str, str], str] = {}
_schemas: dict[tuple[str, str], StructType] = {}


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _choice(key: Column, options: dict[int, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for k, v in options.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def _cash(c: Column) -> Column:
    return c.cast("decimal(14,2)")


def _cents(c: Column) -> Column:
    return F.round(c.cast("decimal(30,8)"), 2).cast("decimal(14,2)")


def _price() -> Column:
    return F.col("l_extendedprice").cast("decimal(14,2)")


def _off() -> Column:
    return F.col("l_discount").cast("decimal(4,2)")


def _unit_price() -> Column:
    return _cents(F.col("l_extendedprice") / F.col("l_quantity"))


class DomainTables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def given(self, name: str) -> DataFrame:
        return self._read(os.path.join(self.folder, f"{name}.parquet"))

    def _read(self, path: str) -> DataFrame:
        """A Parquet table; its schema is read from the files once, not at every use."""
        key = (self.spark.sparkContext.applicationId, path)
        if key not in _schemas:
            _schemas[key] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_schemas[key]).parquet(path)

    def written(self, name: str, build: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Build a table once per application, keep it in the shared folder, read it from there."""
        return self._read(
            self.written_once(name, lambda path: build().write.mode("overwrite").partitionBy(*partition_by).parquet(path))
        )

    def written_once(self, name: str, write: Callable[[str], None]) -> str:
        """The shared folder ``write`` filled; it runs once per application, input folder and name."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _written:
            path = job_folder(self.spark, "tables", f"{zlib.crc32(self.folder.encode()):08x}", name)
            write(path)
            _written[key] = path
        return _written[key]

    # --- sensors --------------------------------------------------------------------------

    def readings(self) -> DataFrame:
        quality = _choice(F.col("event_id") % 10, {0: "bad", 1: "suspect"}, "good")
        return self.given("events").select(
            _text("user_id").alias("device_id"),
            hour_of("ts").alias("reading_bucket_hour"),
            F.col("ts").alias("reading_timestamp"),
            F.col("event_type").alias("metric_name"),
            F.col("value").cast("decimal(18,4)").alias("metric_value"),
            F.lit("u").alias("unit"),
            quality.alias("quality_code"),
        )

    def readings_dense(self) -> DataFrame:
        """Few devices with one metric, so that an hour holds several samples."""
        events = self.given("events")
        return events.select(
            (F.col("user_id") % 4).cast("string").alias("device_id"),
            hour_of("ts").alias("reading_bucket_hour"),
            F.col("ts").alias("reading_timestamp"),
            F.lit("value").alias("metric_name"),
            F.col("value").cast("decimal(18,4)").alias("metric_value"),
            F.lit("u").alias("unit"),
            F.lit("good").alias("quality_code"),
        )

    def device_state(self) -> DataFrame:
        k = F.col("c_custkey")
        seen = self.given("events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("_seen"))
        heartbeat = F.when(k % 11 != 0, F.col("_seen"))
        return self.given("customer").join(seen, "c_custkey").select(
            _text("c_custkey").alias("device_id"),
            F.lit("sensor").alias("device_type"),
            F.col("c_mktsegment").alias("device_class"),
            F.concat(F.lit("M"), k % 3).alias("model"),
            F.concat(F.lit("1."), k % 5).alias("firmware_version"),
            _choice(k % 7, {4: "offline", 5: "degraded", 6: "maintenance"}, "online").alias("status"),
            heartbeat.alias("last_heartbeat"),
            F.col("c_acctbal").cast("decimal(18,4)").alias("last_reading_value"),
            (5 + k % 95).cast("int").alias("battery_percent"),
            (-30 - k % 70).cast("int").alias("signal_strength_dbm"),
            F.concat(F.lit("SITE-"), F.col("c_nationkey")).alias("site_id"),
            F.concat(F.lit("Z"), k % 10).alias("zone"),
            (instant("2023-01-01") + F.make_dt_interval(days=(k % 300).cast("int"))).alias("installed_at"),
            heartbeat.alias("updated_at"),
        )

    def _sites(self) -> DataFrame:
        return self.given("customer").select(
            F.col("c_custkey").alias("user_id"), F.concat(F.lit("SITE-"), F.col("c_nationkey")).alias("site_id")
        )

    def alerts_open(self, hours: int = 24) -> DataFrame:
        e = F.col("event_id")
        return (
            self.given("events")
            .filter((F.col("event_type") == "error") & (F.col("ts") >= instant(IOT_NOW) - F.expr(f"INTERVAL {hours} HOURS")))
            .join(self._sites(), "user_id")
            .select(
                _text("user_id").alias("device_id"),
                _text("event_id").alias("alert_id"),
                F.col("ts").alias("raised_at"),
                _choice(e % 4, {0: "critical", 1: "high", 2: "medium"}, "low").alias("severity"),
                _choice(e % 5, {0: "anomaly", 1: "offline", 2: "battery_low"}, "threshold").alias("alert_type"),
                F.col("event_type").alias("metric_name"),
                F.col("value").cast("decimal(18,4)").alias("metric_value"),
                F.lit(50).cast("decimal(18,4)").alias("threshold_value"),
                "site_id",
                (e % 10 == 0).alias("acknowledged"),
            )
        )

    def hourly_aggregates(self) -> DataFrame:
        """Hourly statistics of everything older than the 24 hot hours, laid out by year and month."""

        def build() -> DataFrame:
            old = self.readings().filter(F.col("reading_timestamp") < instant(IOT_NOW) - F.expr("INTERVAL 24 HOURS"))
            return hourly_rollup(old)

        return self.written("hourly_aggregates", build, ("hour_year", "hour_month"))

    def weather_by_location(self) -> DataFrame:
        return self.written("weather_by_location", self._build_weather_by_location)

    def _build_weather_by_location(self) -> DataFrame:
        hour = hour_of("ts")
        observed = (
            self.given("events").join(self._sites(), "user_id")
            .groupBy("site_id", hour.alias("observation_time"))
            .agg(F.sum(F.col("value").cast("decimal(18,4)")).alias("_sum"), F.count(F.lit(1)).alias("_n"))
        )
        celsius = fixed((F.col("_sum").cast("double") / F.col("_n")) % 40, 2)
        return observed.select(
            "site_id",
            "observation_time",
            celsius.alias("temperature_c"),
            (F.col("_n") % 100).cast("double").alias("humidity_pct"),
            _choice(F.hour("observation_time") % 3, {0: "clear", 1: "cloudy"}, "rain").alias("conditions"),
        )

    def daily_site_summary(self) -> DataFrame:
        return self.written("daily_site_summary", self._build_daily_site_summary)

    def _build_daily_site_summary(self) -> DataFrame:
        error = F.col("event_type") == "error"
        battery = (5 + F.col("user_id") % 95)
        return (
            self.given("events").join(self._sites(), "user_id")
            .groupBy("site_id", F.col("ts").cast("date").alias("summary_date"))
            .agg(
                F.count(F.lit(1)).alias("readings_received"),
                F.count_if(error & (F.col("event_id") % 4 == 0)).alias("alerts_critical"),
                (F.count_if(~error) * 100.0 / F.count(F.lit(1))).alias("uptime_pct"),
                (F.sum(battery) / F.count(F.lit(1))).alias("avg_battery_pct"),
            )
        )

    def failure_history(self) -> DataFrame:
        rows = self.given("events").filter((F.col("event_type") == "error") & (F.col("event_id") % 20 == 0))
        return rows.select(
            _text("event_id").alias("failure_id"),
            _text("user_id").alias("device_id"),
            F.col("ts").alias("failure_timestamp"),
            F.concat(F.lit("1."), F.col("user_id") % 5).alias("firmware_version"),
        )

    def firmware_deployments(self) -> DataFrame:
        """Two deployments per device, the first retired when the second starts."""
        start = instant("2024-01-01")
        wave = F.explode(F.array(F.lit(0), F.lit(1)))
        rows = self.given("customer").select("c_custkey", wave.alias("k"))
        deployed = start + F.make_dt_interval(days=F.col("k") * 15)
        return rows.select(
            _text("c_custkey").alias("device_id"),
            F.concat(F.lit("1."), (F.col("c_custkey") + F.col("k")) % 5).alias("firmware_version"),
            deployed.alias("deployed_at"),
            F.when(F.col("k") == 0, instant("2024-01-16")).alias("retired_at"),
        )

    def maintenance_windows(self) -> DataFrame:
        rows = self.given("events").filter((F.col("event_type") == "signup") & (F.col("event_id") % 10 == 0))
        return rows.join(self._sites(), "user_id").select(
            _text("event_id").alias("window_id"),
            "site_id",
            F.col("ts").alias("window_start"),
            (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 600).cast("int"))).alias("window_end"),
        )

    # --- commerce -------------------------------------------------------------------------

    def commerce_customers(self) -> DataFrame:
        k = F.col("c_custkey")
        created = F.add_months(day("1995-01-01"), (k % 24).cast("int"))
        return self.given("customer").select(
            _text("c_custkey").alias("customer_id"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
            F.col("c_mktsegment").alias("first_name"),
            F.col("c_name").alias("last_name"),
            created.alias("created_at"),
            _choice(k % 4, {0: "bronze", 1: "silver", 2: "gold"}, "platinum").alias("loyalty_tier"),
            _cash(F.col("c_acctbal")).alias("lifetime_value"),
            (k % 5).cast("int").alias("total_orders"),
            (k % 2 == 0).alias("marketing_opt_in"),
        )

    def products(self) -> DataFrame:
        k, price = F.col("p_partkey"), _cash(F.col("p_retailprice"))
        return self.given("part").select(
            _text("p_partkey").alias("product_id"),
            F.concat(F.lit("SKU-"), k).alias("sku"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.concat(F.lit("size-"), F.col("p_size") % 5).alias("subcategory"),
            F.col("p_brand").alias("brand"),
            price.alias("price"),
            F.round(price * F.lit("0.6").cast("decimal(3,1)"), 2).cast("decimal(14,2)").alias("cost"),
            F.col("p_size").alias("stock_quantity"),
            F.lit(10).alias("reorder_level"),
            (k % 20 != 0).alias("is_active"),
            F.lit("1995-01-01").cast("date").alias("created_at"),
        )

    def _orders(self, statuses: tuple[str, ...], status: Column) -> DataFrame:
        c = F.col("o_custkey")
        return self.given("orders").filter(F.col("o_orderstatus").isin(*statuses)).select(
            _text("o_orderkey").alias("order_id"),
            _text("o_custkey").alias("customer_id"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            F.col("o_orderdate").alias("order_timestamp"),
            status.alias("order_status"),
            F.col("o_orderpriority").alias("payment_method"),
            _cash(F.col("o_totalprice")).alias("total_amount"),
            F.concat(F.lit("C"), c % 5).alias("shipping_country"),
            F.concat(F.lit("S"), c % 25).alias("shipping_state"),
        )

    def orders_archive(self) -> DataFrame:
        o = F.col("o_orderkey")
        return self._orders(("F",), F.when(o % 14 == 0, "returned").when(o % 20 == 1, "cancelled").otherwise("delivered"))

    def orders_inflight(self) -> DataFrame:
        status = (
            F.when(F.col("o_orderstatus") == "P", "pending")
            .when(F.col("o_orderkey") % 2 == 0, "processing").otherwise("shipped")
        )
        return self._orders(("O", "P"), status)

    def clean_lines(self, lines: DataFrame | None = None) -> DataFrame:
        """One line per (order, line number): the greatest of the versions."""
        return newest_per_key(
            self.given("lineitem") if lines is None else lines, ["l_orderkey", "l_linenumber"],
            ["l_extendedprice", "l_partkey", "l_suppkey", "l_shipdate"],
        )

    def archive_lines(self) -> DataFrame:
        """Clean lines of archived orders in the columns of the given table, whether or not their part is known.

        A plan, not a written table, so a question moves only the columns it names. Lines are laid out by order, once: that serves the choice of the
        orders, of a line's version, and a later join by ``l_orderkey``. The merge join makes it one plan for tables of any size.
        """
        archive = self.given("orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"))
        return self.clean_lines(only_for(self.given("lineitem").hint("merge"), archive, ["l_orderkey"]))

    def archive_keys(self) -> DataFrame:
        """Archived orders by the keys of the given tables, for ``archive_lines``."""
        return self.given("orders").filter(F.col("o_orderstatus") == "F").select(
            F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderdate").cast("date").alias("order_date")
        ).hint("merge")

    def key_bits(self, name: str, column: str) -> DataFrame:
        return self.written(f"{name}_bits", lambda: key_bits(self.given(name), column))

    def item_amounts(self) -> DataFrame:
        """The amounts of ``order_items`` as a plan, without the products' columns, which only decide that a line counts."""
        lines = only_known(self.clean_lines(), self.key_bits("part", "p_partkey"), "l_partkey")
        return lines.select(
            _text("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("item_sequence"), _unit_price().alias("unit_price"),
            F.col("l_quantity").cast("int").alias("quantity"), _cents(_price() * _off()).alias("discount_amount"),
        )

    def order_items(self) -> DataFrame:
        """Lines with their product. What is written are the given columns; those computed from them are computed where they are read."""

        def build() -> DataFrame:
            lines = self.clean_lines().select(
                "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                F.col("l_shipdate").cast("date").alias("ship_date"),
            )
            part = self.given("part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_name", "p_brand")
            return lines.join(part, "l_partkey")

        off, tax = _off(), F.col("l_tax").cast("decimal(4,2)")
        return self.written("order_items", build).select(
            _text("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("item_sequence"),
            _text("l_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.concat(F.lit("SKU-"), F.col("l_partkey")).alias("product_sku"),
            F.col("p_type").alias("product_category"),
            F.col("p_brand").alias("product_brand"),
            F.col("l_quantity").cast("int").alias("quantity"),
            _unit_price().alias("unit_price"),
            _cents(_price() * off).alias("discount_amount"),
            _cents(_price() * (1 - off) * tax).alias("tax_amount"),
            _cents(_price() * (1 - off) * (1 + tax)).alias("line_total"),
            "ship_date",
            F.col("l_suppkey").alias("supplier_id"),
        )

    def active_carts(self, days: int = 30) -> DataFrame:
        fresh = self.given("orders").filter(
            (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") >= instant(BUSINESS_TODAY) - F.expr(f"INTERVAL {days} DAYS"))
        )
        orders = fresh.select(_text("o_orderkey").alias("order_id"), _text("o_custkey").alias("customer_id"))
        return self.order_items().join(orders, "order_id").select("customer_id", "product_id", "quantity", "unit_price")

    def competitor_prices(self) -> DataFrame:
        """Per product, week and supplier: 95 % of the mean unit price of the lines."""

        def build() -> DataFrame:
            lines = only_known(self.clean_lines(), self.key_bits("part", "p_partkey"), "l_partkey")
            week = F.date_trunc("week", F.col("l_shipdate").cast("date")).cast("date").alias("week_start_date")
            return lines.select("l_partkey", "l_suppkey", week, _unit_price().alias("unit_price"))

        lines = self.written("quoted_lines", build).withColumns({"product_id": _text("l_partkey"), "supplier_id": F.col("l_suppkey")})
        per = lines.groupBy(F.col("product_id").alias("our_product_id"), "week_start_date", "supplier_id").agg(
            F.sum("unit_price").alias("_sum"), F.count(F.lit(1)).alias("_n")
        )
        price = fixed(F.col("_sum").cast("double") / F.col("_n") * 0.95, 2)
        return per.select(
            "our_product_id", "week_start_date",
            F.concat(F.lit("supplier-"), F.col("supplier_id")).alias("competitor_name"),
            price.cast("decimal(14,2)").alias("competitor_price"),
        )

    def clicks(self) -> DataFrame:
        return self.given("events").select(
            _text("user_id").alias("customer_id"), F.col("ts").alias("event_time"), "event_type", "event_id"
        )

    def live_sessions(self) -> DataFrame:
        return self.written("live_sessions", lambda: sessions(self.clicks(), "INTERVAL 2 DAYS"))

    def customer_ltv(self) -> DataFrame:
        return self.written("customer_ltv", lambda: monthly_ltv(self.commerce_customers(), self.orders_archive(), BUSINESS_TODAY))

    def cohort_retention(self) -> DataFrame:
        return self.written(
            "cohort_retention", lambda: cohort_retention(self.commerce_customers(), self.orders_archive(), BUSINESS_TODAY)
        )

    def daily_sales(self) -> DataFrame:
        return self.written(
            "daily_sales", lambda: daily_sales(self.orders_archive(), self.order_items()), ("summary_year", "summary_month")
        )

    # --- financial ------------------------------------------------------------------------

    def financial_customers(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.given("customer").select(
            _text("c_custkey").alias("customer_id"),
            F.col("c_mktsegment").alias("first_name"),
            F.col("c_name").alias("last_name"),
            _choice(k % 4, {0: "low", 1: "medium", 2: "high"}, "restricted").alias("risk_tier"),
            _choice(k % 3, {0: "business"}, "individual").alias("customer_type"),
            _cash(F.col("c_acctbal") * 20).alias("total_balance"),
            F.add_months(day("1995-01-01"), (k % 24).cast("int")).alias("created_at"),
            F.date_add(day("2001-01-01"), (k % 200).cast("int")).alias("last_login"),
            F.lit("active").alias("status"),
            (k % 3 + 1).cast("int").alias("total_accounts"),
        )

    def accounts(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.given("customer").select(
            F.concat(F.lit("A-"), k).alias("account_id"),
            _text("c_custkey").alias("customer_id"),
            _choice(k % 4, {0: "checking", 1: "savings", 2: "credit"}, "investment").alias("account_type"),
            F.when(k % 20 == 0, "frozen").otherwise("active").alias("status"),
            _cash(F.col("c_acctbal")).alias("current_balance"),
            _cash(F.col("c_acctbal")).alias("start_balance"),
            F.date_add(day("1994-01-01"), (k % 700).cast("int")).alias("opened_date"),
        )

    def _transactions(self) -> DataFrame:
        o, at = F.col("o_orderkey"), F.col("o_orderdate")
        return self.given("orders").select(
            _text("o_orderkey").alias("transaction_id"),
            F.concat(F.lit("A-"), F.col("o_custkey")).alias("account_id"),
            _text("o_custkey").alias("customer_id"),
            at.cast("date").alias("txn_date"),
            (at + F.make_dt_interval(hours=(o % 24).cast("int"))).alias("txn_timestamp"),
            _choice(o % 4, {0: "purchase", 1: "withdrawal", 2: "payment"}, "deposit").alias("transaction_type"),
            _cash(F.col("o_totalprice")).alias("amount"),
            F.concat(F.lit("merchant-"), o % 50).alias("merchant_name"),
            F.col("o_orderpriority").alias("merchant_category"),
            F.when(o % 3 == 0, "CAN").otherwise("USA").alias("merchant_country"),
            _choice(o % 4, {0: "card", 1: "online", 2: "atm"}, "mobile").alias("channel"),
            (o % 100).cast("double").alias("_score"),
            F.col("o_orderstatus"),
            o.alias("o_orderkey"),
        )

    def transactions_archive(self) -> DataFrame:
        rows = self._transactions().filter(F.col("o_orderstatus").isin("F", "P"))
        return rows.withColumn("status", F.when(F.col("o_orderstatus") == "F", "posted").otherwise("reversed")).withColumn(
            "fraud_score", F.col("_score") / 100.0
        ).drop("_score", "o_orderstatus", "o_orderkey")

    def transactions_authorizing(self, days: int = 30) -> DataFrame:
        rows = self._transactions().filter(
            (F.col("o_orderstatus") == "O") & (F.col("txn_date") >= F.date_sub(day(BUSINESS_TODAY), days))
        )
        return rows.select(
            "account_id", "transaction_id", F.col("txn_timestamp").alias("initiated_at"), "amount",
            "merchant_name", "merchant_category", "merchant_country", "channel",
            F.when(F.col("o_orderkey") % 2 == 0, "requesting").otherwise("approved").alias("auth_status"),
        )

    def card_transactions(self, days: int = 30) -> DataFrame:
        return self._transactions().filter(F.col("txn_date") >= F.date_sub(day(BUSINESS_TODAY), days)).select(
            "transaction_id", "account_id", "customer_id", "txn_date", "amount", "merchant_category"
        )

    def transfers_pending(self) -> DataFrame:
        o = F.col("o_orderkey")
        return self.given("orders").filter(F.col("o_orderstatus") == "P").select(
            F.concat(F.lit("A-"), F.col("o_custkey")).alias("source_account_id"),
            _text("o_orderkey").alias("transfer_id"),
            _choice(o % 3, {0: "wire", 1: "ach"}, "internal").alias("transfer_type"),
            F.concat(F.lit("bank-"), o % 7).alias("destination_bank"),
            _cash(F.col("o_totalprice")).alias("amount"),
            _choice(o % 4, {0: "pending", 1: "processing", 2: "flagged"}, "settled").alias("status"),
        )

    def risk_history(self) -> DataFrame:
        """Quarter-end scores of the four quarters before mid 2001."""
        ends = ["2000-09-30", "2000-12-31", "2001-03-31", "2001-06-30"]
        quarter = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.lit(e).cast("date").alias("d")) for q, e in enumerate(ends)]))
        return self.given("customer").select("c_custkey", quarter.alias("s")).select(
            _text("c_custkey").alias("customer_id"),
            F.col("s.d").alias("snapshot_date"),
            ((F.col("c_custkey") * 37 + F.col("s.q") * 13) % 100).cast("double").alias("risk_score"),
        )

    def fraud_labels(self) -> DataFrame:
        price = _cash(F.col("o_totalprice"))
        share = lambda s: F.round(price * F.lit(s).cast("decimal(2,1)"), 2).cast("decimal(14,2)")
        return self.given("orders").filter(F.col("o_orderkey") % 60 == 0).select(
            _text("o_orderkey").alias("label_id"),
            _text("o_custkey").alias("customer_id"),
            (F.col("o_orderkey") % 120 == 0).alias("is_fraud"),
            share("0.5").alias("loss_amount"),
            share("0.1").alias("recovered_amount"),
        )

    def fraud_alerts(self, days: int = 90) -> DataFrame:
        o = F.col("o_orderkey")
        rows = self.given("orders").filter(
            (o % 40 == 0) & (F.col("o_orderdate") >= instant(BUSINESS_TODAY) - F.expr(f"INTERVAL {days} DAYS"))
        )
        return rows.select(
            _text("o_custkey").alias("customer_id"),
            _text("o_orderkey").alias("alert_id"),
            F.col("o_orderdate").alias("raised_at"),
            _choice(F.expr("(o_orderkey div 40) % 4"), {0: "critical", 1: "high", 2: "medium"}, "low").alias("severity"),
            _choice(o % 3, {0: "velocity", 1: "geo_anomaly"}, "amount_anomaly").alias("alert_type"),
            (o % 100).cast("double").alias("risk_score"),
            F.lit("open").alias("status"),
            F.concat(F.lit("analyst-"), o % 3).alias("assigned_to"),
        )

    def filings(self) -> DataFrame:
        kind = F.expr("(o_orderkey div 50) % 5")
        return self.given("orders").filter(F.col("o_orderkey") % 50 == 0).select(
            _text("o_orderkey").alias("filing_id"),
            _text("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("filed_at"),
            _choice(kind, {0: "SAR", 1: "CTR", 2: "OFAC", 3: "314a"}, "FBAR").alias("filing_type"),
            F.col("o_orderpriority").alias("trigger_reason"),
        )

    def portfolio_metrics(self) -> DataFrame:
        return self.written("portfolio_metrics", self._build_portfolio_metrics)

    def _build_portfolio_metrics(self) -> DataFrame:
        k = F.col("o_custkey")
        daily = self.given("orders").groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("metric_date")).agg(
            F.sum(_cash(F.col("o_totalprice"))).alias("portfolio_value"), F.min("o_orderkey").alias("_first")
        )
        return daily.select(
            F.concat(F.lit("A-"), k).alias("account_id"),
            "metric_date",
            "portfolio_value",
            ((F.col("_first") % 200 - 100) / 50.0).cast("double").alias("daily_return_pct"),
            ((k % 35) / 10.0).cast("double").alias("volatility_30d"),
        )

    def ticks(self) -> DataFrame:
        return self.order_items().select(
            F.col("product_brand").alias("ticker"),
            F.col("ship_date").alias("quote_date"),
            F.col("order_id").cast("long").alias("order_key"),
            "item_sequence",
            F.col("unit_price").alias("price"),
            F.col("quantity").alias("volume"),
        )

    def stock_changes(self) -> DataFrame:
        """Sales, restocks and returns per product, from the order lines."""
        n = F.col("order_id").cast("long") % 4
        signed = F.when(n == 3, F.col("quantity") * 2).when(n == 2, F.col("quantity")).otherwise(-F.col("quantity"))
        return self.order_items().select(
            "product_id",
            F.col("ship_date").alias("transaction_date"),
            F.concat(F.col("order_id"), F.lit("/"), F.col("item_sequence")).alias("transaction_id"),
            signed.cast("long").alias("quantity_change"),
        )

    def market_data(self) -> DataFrame:
        return self.written("market_data", lambda: daily_bars(self.ticks(), ["order_key", "item_sequence"]))
