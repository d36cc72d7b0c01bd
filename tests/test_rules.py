"""The anomaly rules, one literal case each."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from emberline.operators import health

READINGS = "device_id string, metric_name string, reading_timestamp timestamp_ntz, metric_value decimal(18,4), unit string, quality_code string"
BASELINE = (
    "device_id string, metric_name string, baseline_avg double, baseline_p95 double, baseline_min double, "
    "baseline_max double, baseline_stddev double, sample_count long, baseline_hours long"
)
DEVICES = "device_id string, status string, battery_percent int"
ALERTS = "device_id string, alert_id string, severity string, alert_type string"
T0 = datetime(2026, 4, 23, 9, 0)
B0 = dict(avg=20.0, p95=24.0, low=18.0, high=26.0, sd=1.5)


def reading(value, quality="good", minutes_ago=0, metric="temperature", device="d"):
    v = None if value is None else Decimal(str(value))
    return (device, metric, T0 - timedelta(minutes=minutes_ago), v, "u", quality)


def baseline(metric="temperature", device="d", avg=20.0, p95=24.0, low=18.0, high=26.0, sd=1.5):
    return (device, metric, avg, p95, low, high, sd, 100, 100)


def evaluate(spark, readings, baselines):
    r = spark.createDataFrame(readings, READINGS)
    b = spark.createDataFrame(baselines, BASELINE)
    return {(x.device_id, x.metric_name): x for x in health.metric_health(r, b).collect()}


CASES = {
    "above p95": ([reading(25.0)], [baseline()], ("anomalous", "above_p95", 25.0)),
    "not above p95 but far": ([reading(24.0)], [baseline()], ("anomalous", "deviation", 24.0)),
    "ten percent of the mean is allowed": ([reading(112.0)], [baseline(avg=100.0, p95=120.0, sd=2.0)], ("anomalous", "deviation", 112.0)),
    "close to the mean": ([reading(20.5)], [baseline()], ("normal", None, 20.5)),
    "no baseline": ([reading(20.5)], [], ("unknown", "no_baseline", 20.5)),
    "bad readings only": ([reading(20.5, "bad")], [baseline()], ("unknown", "no_usable_reading", 20.5)),
    "newest is bad": ([reading(30.0, "bad"), reading(20.5, minutes_ago=5)], [baseline()], ("normal", None, 20.5)),
    "suspect counts": ([reading(25.0, "suspect")], [baseline()], ("anomalous", "above_p95", 25.0)),
    "unknown quality counts": ([reading(25.0, None)], [baseline()], ("anomalous", "above_p95", 25.0)),
    "newest decides": ([reading(20.5), reading(25.0, minutes_ago=5)], [baseline()], ("normal", None, 20.5)),
    "no baseline shows the newest of any quality": ([reading(30.0, "bad"), reading(20.5, minutes_ago=5)], [], ("unknown", "no_baseline", 30.0)),
    "missing deviation switches the second rule off": ([reading(23.9)], [baseline(sd=None)], ("normal", None, 23.9)),
    "missing mean switches the second rule off": ([reading(5.0)], [baseline(avg=None)], ("normal", None, 5.0)),
    "missing p95 leaves the second rule": ([reading(25.0)], [baseline(p95=None)], ("anomalous", "deviation", 25.0)),
    "missing value is normal": ([reading(None)], [baseline()], ("normal", None, None)),
    "a negative mean allows two deviations": ([reading(-23.5)], [baseline(avg=-20.0, p95=0.0, sd=1.5)], ("anomalous", "deviation", -23.5)),
    "equal to p95 is not above": ([reading(24.0)], [baseline(avg=22.0, sd=1.0)], ("normal", None, 24.0)),
    "equal to the allowed deviation": ([reading(23.0)], [baseline()], ("normal", None, 23.0)),
}


@pytest.mark.parametrize("name", CASES)
def test_metric_rule(spark, name):
    readings, baselines, (status, reason, value) = CASES[name]
    got = evaluate(spark, readings, baselines)[("d", "temperature")]
    assert (got.anomaly_status, got.reason_code, got.metric_value) == (status, reason, value)


def test_metrics_are_judged_one_by_one(spark):
    got = evaluate(
        spark,
        [reading(25.0), reading(45.0, metric="humidity"), reading(1.0, metric="pressure")],
        [baseline(), baseline("humidity", avg=50.0, p95=60.0, sd=3.0), baseline("vibration")],
    )
    assert {k[1]: v.anomaly_status for k, v in got.items()} == {"temperature": "anomalous", "humidity": "normal", "pressure": "unknown"}


def test_no_readings_give_no_rows(spark):
    assert evaluate(spark, [], [baseline()]) == {}


def test_reason_sentences(spark):
    r = spark.createDataFrame([reading(25.0), reading(24.0, device="e")], READINGS)
    b = spark.createDataFrame([baseline(), baseline(device="e")], BASELINE)
    got = {x.device_id: x.t for x in health.metric_health(r, b).select("device_id", health.reason_text().alias("t")).collect()}
    assert got == {"d": "25.00 is above the baseline p95 of 24.00", "e": "24.00 is 4.00 away from the baseline mean of 20.00; 3.00 is allowed"}


def summary(spark, readings=(), baselines=(), alerts=(), status="online", battery=90):
    devices = spark.createDataFrame([("d", status, battery)], DEVICES)
    h = health.metric_health(spark.createDataFrame(list(readings), READINGS), spark.createDataFrame(list(baselines), BASELINE))
    rows = spark.createDataFrame([("d", str(n), s, t) for n, (s, t) in enumerate(alerts)], ALERTS)
    return health.device_summary(devices, h, rows).first()


HIGH = dict(readings=[reading(25.0)], baselines=[baseline()])


@pytest.mark.parametrize(
    "given, expected",
    [
        (dict(**HIGH), ("anomalous", "high", 1)),
        (dict(alerts=[("low", "anomaly")]), ("anomalous", "normal", 0)),
        (dict(alerts=[("low", "threshold")]), ("normal", "normal", 0)),
        (dict(alerts=[("critical", "threshold")]), ("normal", "critical", 0)),
        (dict(status="degraded"), ("normal", "medium", 0)),
        (dict(battery=15), ("normal", "low", 0)),
        (dict(battery=20), ("normal", "normal", 0)),
        (dict(battery=None), ("normal", "normal", 0)),
        (dict(alerts=[("critical", "threshold")], **HIGH), ("anomalous", "critical", 1)),
        (dict(status="degraded", **HIGH), ("anomalous", "high", 1)),
    ],
)
def test_device_severity(spark, given, expected):
    got = summary(spark, **given)
    assert (got.device_anomaly_status, got.severity, got.anomaly_metric_count) == expected


def test_freshness_and_alerts(spark):
    assert summary(spark).data_freshness == "stale"
    got = summary(spark, alerts=[("low", "threshold"), ("high", "offline"), ("medium", "threshold")], **HIGH)
    assert (got.data_freshness, got.open_alert_count, got.highest_alert_severity) == ("fresh", 3, "high")
    got = summary(spark)
    assert (got.open_alert_count, got.highest_alert_severity) == (0, None)
    assert summary(spark, alerts=[("odd", "threshold")]).highest_alert_severity is None


def test_recent_readings_window(spark):
    now = datetime(2026, 4, 23, 23, 59)
    at = [now.replace(minute=55), now.replace(minute=10), datetime(2026, 4, 23, 22, 59), datetime(2026, 4, 23, 22, 40)]
    rows = spark.createDataFrame(
        [("d", t.replace(minute=0), t, "m", Decimal(n), "u", "good") for n, t in enumerate(at)],
        "device_id string, reading_bucket_hour timestamp_ntz, reading_timestamp timestamp_ntz, metric_name string, "
        "metric_value decimal(18,4), unit string, quality_code string",
    )
    assert [x.reading_timestamp for x in health.recent_readings(rows, now, 60).collect()] == at[:3]


FLEET = "device_id string, status string, site_id string, last_heartbeat timestamp_ntz, battery_percent int, signal_strength_dbm int"


def fleet(spark, *rows):
    return spark.createDataFrame([(d, s, site, T0 - timedelta(minutes=n), 50, -40) for n, (d, s, site) in enumerate(rows)], FLEET)


def test_site_ids(spark):
    devices = fleet(spark, ("1", "online", "b"), ("2", "online", "a"), ("3", "online", None), ("4", "online", "a"), ("5", "online", ""))
    assert [x.site_id for x in health.site_ids(devices).collect()] == ["a", "b"]


def test_device_by_id(spark):
    one = "0b9d5d0e-8f2f-4d3a-9b1c-aaaaaaaaaaaa"
    devices = fleet(spark, (one, "online", "a"))
    assert health.device_by_id(devices, one.upper()).count() == 1
    assert health.device_by_id(devices, one.replace("a", "b")).count() == 0
    with pytest.raises(ValueError):
        health.device_by_id(devices, "7")


def test_list_totals_follow_the_filters(spark):
    devices = fleet(spark, ("1", "online", "a"), ("2", "offline", "a"), ("3", "offline", "b"))
    listed = health.list_devices(devices, None, None, None, site_id="a", status="offline")
    assert [x.device_id for x in listed.items.collect()] == ["2"]
    assert tuple(listed.totals.first()) == (1, 1)
    empty = health.list_devices(devices, None, None, None, site_id="c")
    assert tuple(empty.totals.first()) == (0, 0)


def test_pages_follow_each_other(spark):
    devices = fleet(spark, *[(f"{n:02d}", "online", "a") for n in range(25)])
    pages = [[x.device_id for x in health.list_devices(devices, None, None, None, page=p, page_size=10).items.collect()] for p in (1, 2, 3)]
    assert pages == [[f"{n:02d}" for n in r] for r in (range(10), range(10, 20), range(20, 25))]
    last = devices.filter("device_id = '09'").first()
    after = health.devices_after(devices, last.last_heartbeat, last.device_id, 10)
    assert sorted(x.device_id for x in after.collect()) == pages[1]


def enrichment(spark):
    devices = fleet(spark, ("hot", "online", "a"), ("calm", "online", "a"), ("silent", "online", "a"), ("past", "online", "a"))
    readings = spark.createDataFrame([reading(95.0, device="hot"), reading(70.0, device="calm")], READINGS)
    baselines = spark.createDataFrame(
        [baseline(device=x, avg=70.0, p95=74.0, sd=2.0) for x in ("hot", "calm", "past")], BASELINE
    )
    alerts = spark.createDataFrame([("silent", "1", "odd", "anomaly"), ("calm", "2", "low", "threshold")], ALERTS)
    return devices, alerts, readings, baselines


def test_fleet_statuses(spark):
    devices, alerts, readings, baselines = enrichment(spark)
    got = {x.device_id: x for x in health.fleet_health(devices, alerts, readings, baselines).collect()}
    assert {d: x.anomaly_status for d, x in got.items()} == {"hot": "anomalous", "calm": "normal", "silent": "unknown", "past": "normal"}
    assert (got["silent"].open_alert_count, got["silent"].highest_alert_severity) == (1, "odd")
    none = {x.device_id: x for x in health.fleet_health(devices).collect()}
    assert {x.anomaly_status for x in none.values()} == {"unknown"} and {x.open_alert_count for x in none.values()} == {0}


@pytest.mark.parametrize("status, expected", [("anomalous", ["hot"]), ("normal", ["calm", "past"]), ("unknown", ["silent"])])
@pytest.mark.parametrize("scope", ["page", "fleet"])
def test_filter_by_anomaly(spark, status, expected, scope):
    devices, alerts, readings, baselines = enrichment(spark)
    got = health.list_devices(devices, alerts, readings, baselines, anomaly_status=status, filter_scope=scope)
    assert sorted(x.device_id for x in got.items.collect()) == expected
    assert got.totals.first().total_items == (4 if scope == "page" else len(expected))


def test_document_with_missing_inputs(spark):
    devices = spark.createDataFrame([("d", "online", 90)], DEVICES)
    got = health.device_health(devices)
    doc = got.document.first()
    assert (doc.data_freshness, doc.open_alert_count, doc.metric_health) == ("stale", 0, [])
    assert got.readings.count() == got.alerts.count() == 0


def test_document_metrics(spark):
    devices = spark.createDataFrame([("d", "online", 90)], DEVICES)
    readings = spark.createDataFrame([reading(20.5), reading(21, minutes_ago=1), reading(22, minutes_ago=2), reading(1, device="other")], READINGS)
    got = health.device_health(devices, readings, None, None)
    (metric,) = got.document.first().metric_health
    assert (metric.metric_name, metric.recent_count, metric.metric_value, metric.anomaly_status) == ("temperature", 3, 20.5, "unknown")
    assert got.readings.count() == 3


@pytest.mark.parametrize(
    "call",
    [
        lambda d: health.list_devices(d, None, None, None, page=0),
        lambda d: health.list_devices(d, None, None, None, page_size=101),
        lambda d: health.list_devices(d, None, None, None, status="sleeping"),
        lambda d: health.list_devices(d, None, None, None, anomaly_status="odd"),
        lambda d: health.list_devices(d, None, None, None, sort="name:asc"),
        lambda d: health.recent_readings(d, T0, 61),
        lambda d: health.device_baseline(d, T0, 31),
    ],
)
def test_arguments_are_checked(spark, call):
    with pytest.raises(ValueError):
        call(fleet(spark, ("1", "online", "a")))


def test_baseline_prunes_partitions(spark, tmp_path):
    rows = spark.createDataFrame(
        [("d", "m", datetime(2026, mo, 20), 2026, mo, 4, Decimal(mo), Decimal(mo), Decimal(mo), Decimal(mo), Decimal(1)) for mo in (1, 2, 3, 4)],
        "device_id string, metric_name string, hour_start timestamp_ntz, hour_year int, hour_month int, sample_count int, "
        "min_value decimal(12,4), max_value decimal(12,4), avg_value decimal(12,4), p95_value decimal(12,4), stddev_value decimal(12,4)",
    )
    rows.write.partitionBy("hour_year", "hour_month").parquet(str(tmp_path / "h"))
    stored = spark.read.parquet(str(tmp_path / "h"))
    got = health.device_baseline(stored, T0, 7)
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    (filters,) = [line for line in plan.splitlines() if line.startswith("PartitionFilters")]
    assert "hour_year" in filters and "* 12" in filters
    row = got.first()
    assert (row.baseline_avg, row.baseline_hours, row.sample_count) == (4.0, 1, 4)


@pytest.mark.parametrize("sort", list(health._SORTS))
def test_page_after_page_by_known_rows(spark, sort):
    start = datetime(2024, 1, 1)
    rows = [
        (f"d{k:03d}", start + timedelta(minutes=k % 7) if k % 5 else None, k % 4 if k % 6 else None, -(k % 3) if k % 8 else None,
         ["online", "offline", None][k % 3], ["normal", "anomalous", "unknown"][k % 3], k % 2)
        for k in range(83)
    ]
    df = spark.createDataFrame(rows, "device_id string, last_heartbeat timestamp_ntz, battery_percent int, signal_strength_dbm int, status string, anomaly_status string, open_alert_count long").repartition(4)
    column = health._SORTS[sort][0]
    whole = [r.device_id for r in df.orderBy(*health.list_order(sort)).collect()]
    page, seen = df.orderBy(*health.list_order(sort)).limit(20).collect(), []
    while page:
        seen += [r.device_id for r in page]
        page = health.devices_after(df, page[-1][column], page[-1].device_id, 20, sort).collect()
    assert seen == whole and len(set(seen)) == 83
    with pytest.raises(ValueError):
        health.devices_after(df, None, "d1", 10, "name:asc")
