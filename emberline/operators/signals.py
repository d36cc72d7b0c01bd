"""Time-aware analyses: as-of joins, windows before failures, sessions, bars, stock, seasonality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import mean, ratio
from ..functions.times import monday_of
from .keyed import only_for
from .ordered import BUCKET, ROWS_PER_BUCKET, floored, running
from .skew import join_spread


def as_of_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
    values: Sequence[str], tie_break: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Every left row with the values of the newest right row at or before its time.

    Both sides form one ordered sequence per key and the newest right row is carried forward,
    so no (left, right) pairs are formed and a large key spreads over many tasks.
    """
    keys = list(keys)
    picked = F.struct(F.col(right_time), *values)
    row = F.struct(*left.columns)
    a = left.select(*keys, F.col(left_time).alias("_at"), F.lit(1).alias("_side"), row.alias("_row"),
                    F.lit(None).cast(right.select(picked.alias("s")).schema["s"].dataType).alias("_known"),
                    *[F.col(c).cast("string").alias(f"_t{i}") for i, c in enumerate(tie_break)])
    b = right.select(*keys, F.col(right_time).alias("_at"), F.lit(0).alias("_side"),
                     F.lit(None).cast(left.select(row.alias("s")).schema["s"].dataType).alias("_row"),
                     picked.alias("_known"), *[F.lit(None).cast("string").alias(f"_t{i}") for i in range(len(tie_break))])
    order = [F.asc("_at"), F.asc("_side"), *[F.asc(f"_t{i}") for i in range(len(tie_break))]]
    both = running(a.unionByName(b), keys, order, by="_at", last_known={"_match": F.col("_known")}, rows_per_bucket=rows_per_bucket)
    return both.filter(F.col("_side") == 1).select(
        "_row.*", F.col(f"_match.{right_time}").alias(right_time), *[F.col(f"_match.{v}").alias(v) for v in values]
    )


def alerts_with_weather(
    alerts: DataFrame, weather: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Alerts with the site's weather at the time they were raised."""
    return as_of_join(
        alerts, weather, ["site_id"], "raised_at", "observation_time",
        ["temperature_c", "humidity_pct", "conditions"], ["alert_id"], rows_per_bucket,
    )


def firmware_in_force(rows: DataFrame, deployments: DataFrame, at: str, tie_break: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Rows with the firmware in force at their time; null after it was retired."""
    found = as_of_join(rows, deployments, ["device_id"], at, "deployed_at", ["firmware_version", "retired_at"], tie_break, rows_per_bucket)
    in_force = F.col("deployed_at").isNotNull() & (F.col("retired_at").isNull() | (F.col(at) < F.col("retired_at")))
    return found.select(
        *rows.columns,
        F.when(in_force, F.col("firmware_version")).alias("firmware_version"),
        F.when(in_force, F.col("deployed_at")).alias("deployed_at"),
    )


def before_failures(
    failures: DataFrame, readings: DataFrame, hours: Sequence[int] = (72, 12), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Count and mean of the device's readings in the last hours before each failure.

    A reading lies in the window when ``failure - h <= t < failure``. First only readings stay that lie in an hour some failure's
    longest window covers, a semi join by device and hour. Of these, running count and sum per device are read at the
    window's two ends and subtracted: one ordered pass, no pairs of readings and failures. Values are decimals, so the
    subtraction is exact.
    """
    first, last = (F.date_trunc("hour", t) for t in (F.col("failure_timestamp") - F.expr(f"INTERVAL {max(hours)} HOURS"), F.col("failure_timestamp")))
    covered = failures.select("device_id", F.explode(F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))).alias("_hour"))
    readings = only_for(readings.withColumn("_hour", F.date_trunc("hour", "reading_timestamp")), covered, ["device_id", "_hour"])
    empty = F.lit(0).cast("decimal(28,6)")
    points = readings.select(
        "device_id", F.col("reading_timestamp").alias("_at"), F.lit(1).alias("_side"),
        F.lit(None).cast("string").alias("failure_id"), F.lit(None).cast("int").alias("_mark"),
        F.lit(1).cast("long").alias("_n"), F.col("metric_value").cast("decimal(28,6)").alias("_v"),
        F.col("metric_name").alias("_tie"),
    )
    failed = F.col("failure_timestamp")
    marks = failures.select(
        "device_id", "failure_id",
        F.explode(F.array(*[
            F.struct((failed - F.expr(f"INTERVAL {h} HOURS")).alias("at"), F.lit(h).alias("mark")) for h in (0, *hours)
        ])).alias("m"),
    ).select(
        "device_id", F.col("m.at").alias("_at"), F.lit(0).alias("_side"), "failure_id", F.col("m.mark").alias("_mark"),
        F.lit(0).cast("long").alias("_n"), empty.alias("_v"), F.col("failure_id").alias("_tie"),
    )
    order = [F.asc("_at"), F.asc("_side"), F.asc("_tie"), F.asc_nulls_first("_mark"), F.asc("_v")]
    # Null values count neither as readings nor in the sum, as in count(value) and avg(value).
    value = F.coalesce("_v", empty)
    counted = F.when(F.col("_v").isNull(), 0).otherwise(F.col("_n"))
    summed = running(points.unionByName(marks), ["device_id"], order, by="_at", sums={"_cn": counted, "_cv": value}, rows_per_bucket=rows_per_bucket)
    at_marks = summed.filter(F.col("_side") == 0).groupBy("device_id", "failure_id").agg(
        *[F.max(F.when(F.col("_mark") == h, F.col(c))).alias(f"{c}_{h}") for h in (0, *hours) for c in ("_cn", "_cv")]
    )
    out = at_marks
    for h in hours:
        n = F.col("_cn_0") - F.col(f"_cn_{h}")
        out = out.withColumn(f"readings_{h}h", n).withColumn(
            f"mean_{h}h", ratio(F.col("_cv_0") - F.col(f"_cv_{h}"), F.nullif(n, F.lit(0)))
        )
    return failures.join(out.select("device_id", "failure_id", *[f"{p}_{h}h" for h in hours for p in ("readings", "mean")]),
                         ["device_id", "failure_id"])


def failure_drift(failures: DataFrame, readings: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Means before each failure against the device's overall mean."""
    overall = only_for(readings, failures, ["device_id"]).groupBy("device_id").agg(mean("metric_value").alias("device_mean"))
    rows = join_spread(
        before_failures(failures, readings, rows_per_bucket=rows_per_bucket), overall, "device_id", "left", key_counts=failures.groupBy("device_id").count()
    )
    return rows.withColumn("drift_12h", ratio(F.col("mean_12h") - F.col("device_mean"), F.col("device_mean")))


def failure_rate_by_firmware(devices: DataFrame, failures: DataFrame) -> DataFrame:
    """Failures per device of each firmware and its ratio to the whole fleet."""
    fleet = devices.groupBy("firmware_version").agg(F.count(F.lit(1)).alias("devices"))
    failed = failures.groupBy("firmware_version").agg(F.count(F.lit(1)).alias("failures"))
    rows = fleet.join(failed, "firmware_version", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    whole = rows.agg(ratio(F.sum("failures"), F.sum("devices")).alias("r"))
    rate = ratio(F.col("failures"), F.col("devices"))
    return rows.select(
        "firmware_version", "devices", "failures",
        rate.alias("failure_rate"),
        F.try_divide(rate, whole.scalar()).alias("ratio_to_fleet"),
    )


def site_daily(devices: DataFrame, readings: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per site and day: devices heard, readings, alerts, share of usable readings, battery."""
    place = devices.select("device_id", "site_id", "battery_percent")
    per_device = readings.groupBy("device_id", F.col("reading_timestamp").cast("date").alias("summary_date")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("quality_code").eqNullSafe("bad")).alias("_bad")
    )
    heard = per_device.join(place, "device_id").groupBy("site_id", "summary_date").agg(
        F.count(F.lit(1)).alias("device_count"),
        F.sum("_n").alias("readings_received"),
        ratio(F.sum(F.col("_n") - F.col("_bad")) * 100, F.sum("_n")).alias("uptime_pct"),
        ratio(F.sum("battery_percent"), F.count("battery_percent")).alias("avg_battery_pct"),
    )
    raised = alerts.groupBy("site_id", F.col("raised_at").cast("date").alias("summary_date")).agg(
        F.count(F.lit(1)).alias("alerts_raised"),
        F.count_if(F.col("severity") == "critical").alias("alerts_critical"),
    )
    return heard.join(raised, ["site_id", "summary_date"], "left").na.fill(0, ["alerts_raised", "alerts_critical"])


def merged_windows(windows: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Maintenance windows of a site with overlapping and touching ones merged.

    Each range of start times merges its own windows into pieces, knowing only how far the ranges before it reach. Pieces that
    continue across a border are then joined, a fold over pieces instead of windows.
    """
    per_start = windows.groupBy("site_id", "window_start").agg(F.max("window_end").alias("window_end"), F.count(F.lit(1)).alias("_n"))
    order = [F.asc("window_start")]
    covered = running(
        per_start, ["site_id"], order, by="window_start", highest={"_covered": F.col("window_end")}, before=True,
        rows_per_bucket=rows_per_bucket, chained=True,
    )
    opens = (F.col("_covered").isNull() | (F.col("window_start") > F.col("_covered"))).cast("long")
    within = Window.partitionBy("site_id", BUCKET).orderBy(*order)
    pieces = covered.withColumn("_opens", opens).withColumn("_piece", F.sum("_opens").over(within)).groupBy("site_id", BUCKET, "_piece").agg(
        F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end"), F.sum("_n").alias("_n"), F.max("_opens").alias("_opens")
    ).drop("_piece")
    numbered = running(pieces, ["site_id"], order, by="window_start", sums={"_island": F.col("_opens")})
    return numbered.groupBy("site_id", "_island").agg(
        F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end"), F.sum("_n").alias("windows_merged")
    ).drop("_island")


def site_downtime(windows: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    merged = merged_windows(windows, rows_per_bucket)
    seconds = F.timestamp_diff("SECOND", F.col("window_start"), F.col("window_end"))
    return merged.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("outages"),
        F.sum("windows_merged").alias("windows"),
        F.sum(seconds).alias("downtime_seconds"),
        F.max(seconds).alias("longest_seconds"),
    )


def sessions(clicks: DataFrame, gap: str = "INTERVAL 30 MINUTES", user: str = "customer_id", time: str = "event_time") -> DataFrame:
    """Sessions per user, closed by a pause longer than ``gap``; views and cart additions counted.

    Events of one user in one span of ``gap`` length are never a longer pause apart, so they are one session and combine into one
    row before the shuffle, however many they are. Sessions are then runs of these rows, of which a user has no more than the
    calendar has spans: no event is ordered. Events without a time are a session of their own, the first.
    """
    epoch = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
    width = f"greatest(1L, timestampdiff(MICROSECOND, {epoch}, {epoch} + {gap}))"
    since_epoch = f"timestampdiff(MICROSECOND, {epoch}, CAST(`{time}` AS TIMESTAMP_NTZ))"
    spans = clicks.withColumn("_span", F.expr(f"floor({since_epoch} / {width})")).groupBy(user, "_span").agg(
        F.min(time).alias("session_start"),
        F.max(time).alias("session_end"),
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.col("event_type") == "view").alias("page_views"),
        F.count_if(F.col("event_type") == "click").alias("cart_additions"),
    )
    ordered = Window.partitionBy(user).orderBy(F.asc_nulls_first("_span"))
    before = F.lag("session_end").over(ordered)
    opens = before.isNull() | (F.col("session_start") > before + F.expr(gap))
    numbered = spans.withColumn("_opens", opens.cast("long")).withColumn("session_number", F.sum("_opens").over(ordered))
    return numbered.groupBy(user, "session_number").agg(
        F.min("session_start").alias("session_start"),
        F.max("session_end").alias("session_end"),
        *[F.sum(c).alias(c) for c in ("event_count", "page_views", "cart_additions")],
    )


def daily_bars(ticks: DataFrame, order: Sequence[str]) -> DataFrame:
    """Open, high, low, close and volume per ticker and day. ``min_by``/``max_by`` combine early."""
    at = F.struct(*order)
    return ticks.groupBy("ticker", "quote_date").agg(
        F.min_by("price", at).alias("open_price"),
        F.max("price").alias("high_price"),
        F.min("price").alias("low_price"),
        F.max_by("price", at).alias("close_price"),
        F.sum("volume").cast("long").alias("volume"),
    )


def running_stock(
    changes: DataFrame, opening: DataFrame | None = None, order: Sequence[str] = ("transaction_date", "transaction_id"),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Stock after each change, never below zero; without an opening stock it starts at zero."""
    rows = changes
    if opening is not None:
        rows = rows.join(opening.select("product_id", "stock_quantity"), "product_id", "left")
    start = F.coalesce(F.col("stock_quantity"), F.lit(0)).cast("long") if opening is not None else F.lit(0).cast("long")
    by = [F.asc(c) for c in order]
    stock = floored(rows, ["product_id"], by, by=order[0], name="quantity_after", change=F.col("quantity_change"), start=start, rows_per_bucket=rows_per_bucket)
    return stock.select(*changes.columns, "quantity_after")


def demand_index(
    orders: DataFrame, items: DataFrame, promo_weeks: Sequence[int] = (), trailing: int = 8
) -> DataFrame:
    """Weekly units per category against the mean and slope of the weeks before, and its seasonal index."""
    per_order = items.groupBy("order_id", "product_category").agg(F.sum("quantity").alias("quantity"))
    return demand_index_of_sales(per_order.join(orders.select("order_id", "order_date"), "order_id"), promo_weeks, trailing)


def demand_index_of_sales(sales: DataFrame, promo_weeks: Sequence[int] = (), trailing: int = 8) -> DataFrame:
    """``demand_index`` from rows of product_category, order_date and quantity.

    One row per category and week before any window, so a window sees a calendar, not sales.
    """
    weekly = (
        sales.groupBy("product_category", monday_of("order_date").alias("week_start_date"))
        .agg(F.sum("quantity").alias("units"))
        .withColumn("week_of_year", F.weekofyear("week_start_date"))
        .withColumn("_t", F.datediff("week_start_date", F.lit("1990-01-01").cast("date")) / 7)
    )
    past = Window.partitionBy("product_category").orderBy("week_start_date").rowsBetween(-trailing, -1)
    same_week = Window.partitionBy("product_category", "week_of_year")
    category = Window.partitionBy("product_category")
    y, t = F.col("units").cast("double"), F.col("_t").cast("double")
    n, st, sy = F.count(y).over(past), F.sum(t).over(past), F.sum(y).over(past)
    slope = F.try_divide(n * F.sum(t * y).over(past) - st * sy, n * F.sum(t * t).over(past) - st * st)
    promo = F.col("week_of_year").isin(list(promo_weeks)) if promo_weeks else F.lit(False)
    off_promo = F.avg(F.when(~promo, y)).over(category)
    return weekly.select(
        "product_category", "week_start_date", "week_of_year", "units",
        F.try_divide(y, F.avg(y).over(past)).alias("trend_ratio"),
        slope.alias("trend_slope"),
        F.try_divide(F.avg(y).over(same_week), F.avg(y).over(category)).alias("season_index"),
        F.when(promo, F.try_divide(y, off_promo)).alias("promo_lift"),
    )


def market_regimes(market: DataFrame, starts: Sequence[str]) -> DataFrame:
    """Mean and deviation of the market's daily return in each period between the dates."""
    regime = F.lit(0)
    for i, start in enumerate(starts, start=1):
        regime = F.when(F.col("quote_date") >= F.lit(start).cast("date"), i).otherwise(regime)
    daily = _market_return(market)
    return daily.groupBy(regime.alias("regime")).agg(
        F.count(F.lit(1)).alias("days"), F.avg("market_return").alias("mean_return"), F.stddev_samp("market_return").alias("return_stddev")
    )


def _market_return(market: DataFrame) -> DataFrame:
    move = ratio(F.col("close_price") - F.col("open_price"), F.col("open_price")) * 100
    return market.groupBy("quote_date").agg(F.avg(move).alias("market_return"))


def account_beta(returns: DataFrame, market: DataFrame) -> DataFrame:
    """Beta of each account against the mean market return of the day."""
    both = join_spread(returns, _market_return(market).withColumnRenamed("quote_date", "metric_date"), "metric_date")
    r, m = F.col("daily_return_pct").cast("double"), F.col("market_return")
    return both.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("days"),
        F.try_divide(F.covar_samp(r, m), F.var_samp(m)).alias("beta"),
    )


def spend_seasonality(transactions: DataFrame) -> DataFrame:
    """Mean spend of each calendar month against the mean over all months."""
    monthly = transactions.groupBy(F.year("txn_date").alias("y"), F.month("txn_date").alias("calendar_month")).agg(
        F.sum("amount").alias("spend")
    )
    whole = monthly.agg(mean("spend", "decimal(30,2)").alias("m"))
    per = monthly.groupBy("calendar_month").agg(
        F.count(F.lit(1)).alias("months"), mean("spend", "decimal(30,2)").alias("mean_spend")
    )
    return per.withColumn("season_index", F.try_divide(F.col("mean_spend"), whole.scalar()))


def tiered(rows: DataFrame, time: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Rows to keep hot and rows to archive. Each row is in exactly one; no time means hot."""
    old = F.coalesce(F.col(time) < cutoff, F.lit(False))
    return rows.filter(~old), rows.filter(old)
