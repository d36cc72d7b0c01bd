"""Device health: baselines, anomaly tests, roll-ups to devices and to the fleet.

Every function answers for all devices in one job. Readings are reduced to one row per
(device, metric) before any join, so a device that sends a third of all readings costs one
row per metric beyond the scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import timedelta
from typing import NamedTuple
from uuid import UUID

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import labels
from ..functions.numbers import mean
from ..functions.times import Moment, instant, iso_text, parse_moment, since
from .keyed import distinct_values, page_of, page_totals

MAX_READING_MINUTES = 60
MAX_BASELINE_DAYS = 30
MAX_PAGE_SIZE = 100
LOW_BATTERY = 20

BASELINE_FIELDS = (
    "baseline_avg", "baseline_p95", "baseline_min", "baseline_max", "baseline_stddev",
    "sample_count", "baseline_hours",
)


def _check(name: str, value: int, most: int | None = None) -> None:
    if not isinstance(value, int) or isinstance(value, bool) or value < 1:
        raise ValueError(f"{name} must be a positive integer")
    if most is not None and value > most:
        raise ValueError(f"{name} must be at most {most}")


def _one_of(name: str, value: str | None, allowed: Iterable[str]) -> None:
    if value is not None and value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")


# --- inputs -----------------------------------------------------------------------------------


def device_baseline(
    hourly: DataFrame, as_of: Moment, window_days: int = 7, device_ids: list[str] | None = None
) -> DataFrame:
    """Per device and metric: unweighted statistics of the hourly rows of the last days."""
    _check("window_days", window_days, MAX_BASELINE_DAYS)
    parts = ("hour_year", "hour_month") if "hour_year" in hourly.columns else (None, None)
    rows = hourly.filter(since("hour_start", as_of, window_days, *parts))
    if device_ids is not None:
        rows = rows.filter(F.col("device_id").isin(device_ids))
    return rows.groupBy("device_id", "metric_name").agg(
        mean("avg_value").alias("baseline_avg"),
        F.max("p95_value").cast("double").alias("baseline_p95"),
        F.min("min_value").cast("double").alias("baseline_min"),
        F.max("max_value").cast("double").alias("baseline_max"),
        mean("stddev_value").alias("baseline_stddev"),
        F.sum("sample_count").cast("long").alias("sample_count"),
        F.count(F.lit(1)).alias("baseline_hours"),
    )


def recent_readings(
    readings: DataFrame,
    as_of: Moment,
    window_minutes: int = 60,
    device_ids: list[str] | None = None,
    newest_first: bool = True,
) -> DataFrame:
    """Readings from the current and the previous hour bucket within the window.

    The bucket list is a plain ``IN`` on the layout column, so only two buckets are read.
    """
    _check("window_minutes", window_minutes, MAX_READING_MINUTES)
    at = parse_moment(as_of)
    bucket = at.replace(minute=0, second=0, microsecond=0)
    rows = readings.filter(
        F.col("reading_bucket_hour").isin([instant(bucket), instant(bucket - timedelta(hours=1))])
        & F.col("reading_timestamp").between(instant(at - timedelta(minutes=window_minutes)), instant(at))
    )
    if device_ids is not None:
        rows = rows.filter(F.col("device_id").isin(device_ids))
    return rows.orderBy(F.desc("reading_timestamp"), "device_id", "metric_name") if newest_first else rows


def readings_within(readings: DataFrame, as_of: Moment, hours: int) -> DataFrame:
    """Readings of a longer trailing window, for fleet-wide jobs over more than two buckets."""
    start = parse_moment(as_of) - timedelta(hours=hours)
    return readings.filter(
        (F.col("reading_bucket_hour") >= F.date_trunc("hour", instant(start)).cast("timestamp_ntz"))
        & (F.col("reading_timestamp") >= instant(start))
        & (F.col("reading_timestamp") <= instant(as_of))
    )


def alerts_of(alerts: DataFrame, device_ids: list[str]) -> DataFrame:
    """All alerts of the devices, acknowledged or not."""
    return alerts.filter(F.col("device_id").isin(device_ids))


# --- rules ------------------------------------------------------------------------------------


def usable(quality: str = "quality_code") -> Column:
    """Everything but 'bad'; an unknown quality counts as usable."""
    return ~F.col(quality).eqNullSafe(F.lit("bad"))


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def anomaly_columns(value: Column) -> dict[str, Column]:
    """Status and reason code of a value against the baseline columns of the same row.

    A number that is missing switches its rule off. The deviation rule needs average and
    standard deviation both: ``greatest`` alone would skip a null and use the other term.
    """
    deviation = F.abs(value - F.col("baseline_avg"))
    needed = F.col("baseline_stddev").isNotNull() & F.col("baseline_avg").isNotNull()
    allowed = F.greatest(2 * F.col("baseline_stddev"), 0.1 * F.col("baseline_avg"))
    above = _true(value > F.col("baseline_p95"))
    far = _true(needed & (deviation > allowed))
    no_baseline = F.col("baseline_hours").isNull()
    reason = (
        F.when(no_baseline, "no_baseline")
        .when(value.isNull() & ~F.col("_has_usable"), "no_usable_reading")
        .when(above, "above_p95")
        .when(far, "deviation")
    )
    status = (
        F.when(reason.isin("no_baseline", "no_usable_reading"), "unknown")
        .when(reason.isNotNull(), "anomalous")
        .otherwise("normal")
    )
    return {"anomaly_status": status, "reason_code": reason}


def reason_text() -> Column:
    """A sentence for the reason code of a metric-health row."""
    v, avg, p95, sd = (F.col(c) for c in ("metric_value", "baseline_avg", "baseline_p95", "baseline_stddev"))
    return (
        F.when(F.col("reason_code") == "no_baseline", "There is no baseline to compare with")
        .when(F.col("reason_code") == "no_usable_reading", "There is no reading of usable quality")
        .when(F.col("reason_code") == "above_p95", F.format_string("%.2f is above the baseline p95 of %.2f", v, p95))
        .when(
            F.col("reason_code") == "deviation",
            F.format_string(
                "%.2f is %.2f away from the baseline mean of %.2f; %.2f is allowed",
                v, F.abs(v - avg), avg, F.greatest(2 * sd, 0.1 * avg),
            ),
        )
    )


def _tested_metrics(readings: DataFrame, baseline: DataFrame, how: str) -> DataFrame:
    """Newest reading of any and of usable quality per device and metric, beside the baseline.

    ``max`` of a struct combines on the map side, a window over the readings would not.
    """
    reading = F.struct("reading_timestamp", "metric_value", "unit", "quality_code")
    newest = readings.groupBy("device_id", "metric_name").agg(
        F.max(reading).alias("_any"),
        F.max(F.when(usable(), reading)).alias("_usable"),
        F.count(F.lit(1)).alias("recent_count"),
    )
    rows = newest.join(baseline.select("device_id", "metric_name", *BASELINE_FIELDS), ["device_id", "metric_name"], how)
    rows = rows.withColumn("_has_usable", F.col("_usable").isNotNull())
    return rows.withColumns(anomaly_columns(F.col("_usable.metric_value").try_cast("double")))


def metric_health(readings: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row per device and metric seen in the readings: newest value, status and reason.

    The newest usable reading is tested; where there is none, or no baseline, the newest reading
    of any quality is shown.
    """
    rows = _tested_metrics(readings, baseline, "left")
    shown = F.when(F.col("baseline_hours").isNotNull() & F.col("_has_usable"), F.col("_usable")).otherwise(F.col("_any"))
    return rows.select(
        "device_id",
        "metric_name",
        "anomaly_status",
        "reason_code",
        shown["metric_value"].try_cast("double").alias("metric_value"),
        shown["unit"].alias("unit"),
        shown["quality_code"].alias("quality_code"),
        shown["reading_timestamp"].alias("reading_timestamp"),
        "recent_count",
        *BASELINE_FIELDS,
    )


def alert_summary(alerts: DataFrame, unknown_label: bool = False) -> DataFrame:
    """Per device: number of alerts, highest severity, whether one is critical or an anomaly.

    With ``unknown_label`` a device whose alerts all carry labels outside the vocabulary shows
    one of them instead of null.
    """
    best = labels.severity_name(F.min(labels.severity_rank("severity")))
    highest = F.coalesce(best, F.min("severity")) if unknown_label else best
    return alerts.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("open_alert_count"),
        highest.alias("highest_alert_severity"),
        F.bool_or(_true(F.col("severity") == "critical")).alias("has_critical_alert"),
        F.bool_or(_true(F.col("alert_type") == "anomaly")).alias("has_anomaly_alert"),
    )


def _metric_summary(health: DataFrame) -> DataFrame:
    return health.groupBy("device_id").agg(
        F.count_if(F.col("anomaly_status") == "anomalous").alias("anomaly_metric_count"),
        F.sum("recent_count").alias("recent_reading_count"),
    )


def _severity(low_battery: int) -> Column:
    return (
        F.when(F.col("has_critical_alert"), "critical")
        .when(F.col("anomaly_metric_count") > 0, "high")
        .when(F.col("status") == "degraded", "medium")
        .when(_true(F.col("battery_percent") < low_battery), "low")
        .otherwise("normal")
    )


def device_summary(
    devices: DataFrame, health: DataFrame, alerts: DataFrame, low_battery: int = LOW_BATTERY
) -> DataFrame:
    """Status, severity, freshness and alert counts of every device."""
    rows = (
        devices.join(_metric_summary(health), "device_id", "left")
        .join(alert_summary(alerts), "device_id", "left")
        .na.fill(0, ["anomaly_metric_count", "recent_reading_count", "open_alert_count"])
        .na.fill(False, ["has_critical_alert", "has_anomaly_alert"])
    )
    anomalous = (F.col("anomaly_metric_count") > 0) | F.col("has_anomaly_alert")
    return rows.select(
        *devices.columns,
        F.when(anomalous, "anomalous").otherwise("normal").alias("device_anomaly_status"),
        "anomaly_metric_count",
        _severity(low_battery).alias("severity"),
        F.when(F.col("recent_reading_count") > 0, "fresh").otherwise("stale").alias("data_freshness"),
        "highest_alert_severity",
        "open_alert_count",
    )


# --- documents and lists ----------------------------------------------------------------------

_EMPTY_READINGS = (
    "device_id string, reading_bucket_hour timestamp_ntz, reading_timestamp timestamp_ntz, "
    "metric_name string, metric_value decimal(18,4), unit string, quality_code string"
)
_EMPTY_ALERTS = "device_id string, alert_id string, severity string, alert_type string, acknowledged boolean"
_EMPTY_BASELINE = (
    "device_id string, metric_name string, baseline_avg double, baseline_p95 double, baseline_min double, "
    "baseline_max double, baseline_stddev double, sample_count long, baseline_hours long"
)


class DeviceHealth(NamedTuple):
    """One health document per device, and the rows it refers to.

    Readings and alerts stay rows: a device may have any number of them, so they are never
    gathered into one value.
    """

    document: DataFrame
    readings: DataFrame
    alerts: DataFrame


def device_health(
    devices: DataFrame,
    readings: DataFrame | None = None,
    alerts: DataFrame | None = None,
    baseline: DataFrame | None = None,
    low_battery: int = LOW_BATTERY,
) -> DeviceHealth:
    """State, summary and per-metric health of the devices; an input that is missing is empty.

    ``metric_health`` is an array in metric order. It holds one entry per metric name of the
    device, a closed vocabulary, not one per reading. Unknown devices give no document.
    """
    spark = devices.sparkSession
    readings = spark.createDataFrame([], _EMPTY_READINGS) if readings is None else readings
    alerts = spark.createDataFrame([], _EMPTY_ALERTS) if alerts is None else alerts
    baseline = spark.createDataFrame([], _EMPTY_BASELINE) if baseline is None else baseline
    health = metric_health(readings, baseline)
    entry = F.struct("metric_name", *[c for c in health.columns if c not in ("device_id", "metric_name")])
    nested = health.groupBy("device_id").agg(F.array_sort(F.collect_list(entry)).alias("metric_health"))
    document = (
        device_summary(devices, health, alerts, low_battery)
        .join(nested, "device_id", "left")
        .withColumn("metric_health", F.coalesce("metric_health", F.expr("array()")))
    )
    known = devices.select("device_id")
    return DeviceHealth(
        document, readings.join(known, "device_id", "left_semi"), alerts.join(known, "device_id", "left_semi")
    )


def fleet_health(
    devices: DataFrame,
    alerts: DataFrame | None = None,
    readings: DataFrame | None = None,
    baseline: DataFrame | None = None,
) -> DataFrame:
    """Devices with alert and anomaly columns; defaults are unknown, 0, null, 0.

    Without ``alerts`` neither counts nor the influence of anomaly alerts appear. Without
    ``readings`` and ``baseline`` the anomaly status stays unknown. A device gets a status as
    soon as it has any reading or any baseline.
    """
    rows = devices
    if alerts is not None:
        summary = alert_summary(alerts, unknown_label=True).drop("has_critical_alert")
        rows = rows.join(summary, "device_id", "left")
    else:
        rows = rows.withColumns({
            "open_alert_count": F.lit(0).cast("long"),
            "highest_alert_severity": F.lit(None).cast("string"),
            "has_anomaly_alert": F.lit(False),
        })
    if readings is not None and baseline is not None:
        # The full join keeps baselines without readings: they make the device known, no more.
        tested = _tested_metrics(readings, baseline, "full")
        seen = F.col("recent_count").isNotNull()
        per_device = tested.groupBy("device_id").agg(
            F.count_if(seen & (F.col("anomaly_status") == "anomalous")).alias("anomaly_metric_count"),
            F.count(F.lit(1)).alias("_known"),
        )
        rows = rows.join(per_device, "device_id", "left")
        known = F.col("_known").isNotNull()
    else:
        rows = rows.withColumn("anomaly_metric_count", F.lit(0).cast("long"))
        known = F.lit(False)
    count = F.coalesce("anomaly_metric_count", F.lit(0))
    anomalous = (count > 0) | _true(F.col("has_anomaly_alert"))
    return rows.select(
        *devices.columns,
        F.when(~known, "unknown").when(anomalous, "anomalous").otherwise("normal").alias("anomaly_status"),
        count.alias("anomaly_metric_count"),
        "highest_alert_severity",
        F.coalesce("open_alert_count", F.lit(0)).alias("open_alert_count"),
    )


def device_by_id(devices: DataFrame, device_id: str, check_form: bool = True) -> DataFrame:
    """The device with the id, or no row. Ids are UUIDs unless ``check_form`` is off."""
    if check_form:
        try:
            device_id = str(UUID(device_id))
        except ValueError:
            raise ValueError("device_id must be a UUID") from None
    return devices.filter(F.col("device_id") == device_id)


def matching_devices(devices: DataFrame, site_id: str | None = None, status: str | None = None) -> DataFrame:
    _one_of("status", status, labels.DEVICE_STATUSES)
    if site_id is not None:
        devices = devices.filter(F.col("site_id") == site_id)
    if status is not None:
        devices = devices.filter(F.col("status") == status)
    return devices


def _anomaly_place(status: Column) -> Column:
    return F.when(status == "anomalous", 0).when(status == "unknown", 1).otherwise(2)


# Each sort's column, whether it falls, and what of the value is sorted by. Nulls come last.
_SORTS = {
    "lastHeartbeat:desc": ("last_heartbeat", True, None),
    "batteryPercent:asc": ("battery_percent", False, None),
    "signalStrength:asc": ("signal_strength_dbm", False, None),
    "status:asc": ("status", False, None),
    "anomalyStatus:desc": ("anomaly_status", False, _anomaly_place),
    "openAlertCount:desc": ("open_alert_count", True, None),
}


def list_order(sort: str) -> list[Column]:
    """Sort keys of the device list; ties are settled by the device id."""
    _one_of("sort", sort, _SORTS)
    column, falls, place = _SORTS[sort]
    key = F.col(column) if place is None else place(F.col(column))
    return [F.desc_nulls_last(key) if falls else F.asc_nulls_last(key), F.asc("device_id")]


class DeviceList(NamedTuple):
    items: DataFrame
    totals: DataFrame


def list_devices(
    devices: DataFrame,
    alerts: DataFrame | None,
    readings: DataFrame | None,
    baseline: DataFrame | None,
    site_id: str | None = None,
    status: str | None = None,
    anomaly_status: str | None = None,
    page: int = 1,
    page_size: int = 25,
    sort: str = "lastHeartbeat:desc",
    filter_scope: str = "page",
) -> DeviceList:
    """A page of enriched devices and the totals of the listing.

    With ``filter_scope='page'`` the anomaly filter applies to the page already cut, and totals
    ignore it; ``'fleet'`` filters first. Only the page is enriched where the sort allows: its
    ids, at most ``MAX_PAGE_SIZE`` of them, are sent to the scans of the other inputs.
    """
    _check("page", page)
    _check("page_size", page_size, MAX_PAGE_SIZE)
    _one_of("anomaly_status", anomaly_status, labels.ANOMALY_STATUSES)
    _one_of("filter_scope", filter_scope, ("page", "fleet"))
    order = list_order(sort)
    matching = matching_devices(devices, site_id, status)
    needs_fleet = sort in ("anomalyStatus:desc", "openAlertCount:desc") or (filter_scope == "fleet" and anomaly_status)
    if needs_fleet:
        everything = fleet_health(matching, alerts, readings, baseline)
        if anomaly_status and filter_scope == "fleet":
            everything = everything.filter(F.col("anomaly_status") == anomaly_status)
        items, counted = page_of(everything, order, page, page_size), everything
    else:
        cut = page_of(matching, order, page, page_size)
        ids = F.broadcast(cut.select("device_id"))
        on_page = [None if x is None else x.join(ids, "device_id", "left_semi") for x in (alerts, readings, baseline)]
        items, counted = fleet_health(cut, *on_page), matching
    if anomaly_status and filter_scope == "page":
        items = items.filter(F.col("anomaly_status") == anomaly_status)
    return DeviceList(items, page_totals(counted, page_size))


def devices_after(devices: DataFrame, value, device_id: str, page_size: int = 25, sort: str = "lastHeartbeat:desc") -> DataFrame:
    """The next page after a known row, given its value in the sorted column (null too) and its id.

    The sort by anomaly status or open alerts needs the fleet's rows. What lies before the row is filtered out in the scan where
    the column is stored, so page 10,000 costs what page 1 costs: each task keeps a page, whatever came before. An offset would
    make it keep all pages up to then.
    """
    _check("page_size", page_size, MAX_PAGE_SIZE)
    _one_of("sort", sort, _SORTS)
    name, falls, place = _SORTS[sort]
    column, known = F.col(name), instant(value) if sort == "lastHeartbeat:desc" and value is not None else F.lit(value)
    if place is not None:
        column, known = place(column), place(known)
    if value is None and place is None:
        beyond = column.isNull() & (F.col("device_id") > device_id)
    else:
        later = column < known if falls else column > known
        beyond = later | column.isNull() | ((column == known) & (F.col("device_id") > device_id))
    return devices.filter(beyond).orderBy(*list_order(sort)).limit(page_size)


def site_ids(devices: DataFrame) -> DataFrame:
    return distinct_values(devices, "site_id")


def fleet_tiles(fleet: DataFrame) -> DataFrame:
    """The summary counts above a device list, in one pass."""
    status = F.lower("status")
    return fleet.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "online").alias("online_count"),
        F.count_if(status == "warning").alias("warning_count"),
        F.count_if(status == "offline").alias("offline_count"),
        F.count_if(F.col("anomaly_status") == "anomalous").alias("anomalous_count"),
        F.count_if(F.col("open_alert_count") > 0).alias("devices_with_alerts"),
    )


def device_state_shape(devices: DataFrame) -> DataFrame:
    """The outward form of a device row: camelCase names, ISO times, decimals as text."""
    return devices.select(
        F.col("device_id").alias("deviceId"),
        F.col("device_type").alias("deviceType"),
        F.col("device_class").alias("deviceClass"),
        F.col("model").alias("model"),
        F.col("firmware_version").alias("firmwareVersion"),
        F.col("status").alias("status"),
        iso_text("last_heartbeat").alias("lastHeartbeat"),
        F.col("last_reading_value").cast("string").alias("lastReadingValue"),
        F.col("battery_percent").alias("batteryPercent"),
        F.col("signal_strength_dbm").alias("signalStrengthDbm"),
        F.col("site_id").alias("siteId"),
        F.col("zone").alias("zone"),
        iso_text("installed_at").alias("installedAt"),
        iso_text("updated_at").alias("updatedAt"),
    )


def reading_shape(readings: DataFrame) -> DataFrame:
    return readings.select(
        F.col("device_id").alias("deviceId"),
        iso_text("reading_timestamp").alias("timestamp"),
        F.col("metric_name").alias("metricName"),
        F.col("metric_value").cast("string").alias("metricValue"),
        F.col("unit").alias("unit"),
        F.col("quality_code").alias("qualityCode"),
    )


def alert_shape(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        F.col("device_id").alias("deviceId"),
        F.col("alert_id").alias("alertId"),
        iso_text("raised_at").alias("raisedAt"),
        F.col("severity").alias("severity"),
        F.col("alert_type").alias("alertType"),
        F.col("metric_name").alias("metricName"),
        F.col("metric_value").cast("string").alias("metricValue"),
        F.col("threshold_value").cast("string").alias("thresholdValue"),
        F.col("site_id").alias("siteId"),
        F.col("acknowledged").alias("acknowledged"),
    )


def baseline_shape(baseline: DataFrame) -> DataFrame:
    """Baseline statistics as text with four decimals, the scale they are stored with."""
    text = lambda c: F.col(c).cast("decimal(18,4)").cast("string")
    return baseline.select(
        F.col("device_id").alias("deviceId"),
        F.col("metric_name").alias("metricName"),
        text("baseline_avg").alias("baselineAvg"),
        text("baseline_p95").alias("baselineP95"),
        text("baseline_min").alias("baselineMin"),
        text("baseline_max").alias("baselineMax"),
        text("baseline_stddev").alias("baselineStddev"),
        F.col("sample_count").alias("sampleCount"),
        F.col("baseline_hours").alias("baselineWindowHoursCovered"),
    )
