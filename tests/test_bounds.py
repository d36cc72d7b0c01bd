"""No cap on listed devices or hot keys, no look past the instant a question is asked for, streams that go on."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from emberline.functions.times import days_upto, since
from emberline.operators import federated, health
from emberline.operators.skew import hot_keys, join_spread
from emberline.sources import ingest
from emberline.streaming import jobs


def test_counts_of_a_list_longer_than_a_page(spark):
    devices = spark.range(150).select(F.col("id").alias("device_id"), F.lit("online").alias("status"), F.lit(50).alias("battery_percent"), F.lit(1).alias("site_id"))
    readings = spark.range(300).select((F.col("id") % 150).alias("device_id"), F.concat(F.lit("m"), F.col("id") % 2).alias("metric_name"))
    alerts = spark.createDataFrame([(149, 1, "low"), (149, 2, "high")], "device_id long, alert_id long, severity string")
    rows = {r.device_id: r for r in federated.page_counts(devices, readings, alerts).collect()}
    assert len(rows) == 150 and all(r.metric_count == 1 for r in rows.values())
    assert (rows[149].alert_count, rows[149].highest_severity, rows[0].alert_count) == (2, "low", 0)


def test_three_thousand_hot_keys_are_all_split(spark):
    facts = spark.range(12_000).select((F.col("id") % 3_000).alias("k"), "id")
    assert hot_keys(facts, ["k"], rows_per_slice=2).filter("_slices = 2").count() == 3_000
    dim = spark.range(3_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    joined = join_spread(facts, dim, "k", rows_per_slice=2)
    assert joined.filter("twice = 2 * k").count() == 12_000


def test_windows_end_at_the_instant(spark):
    at = datetime(2024, 1, 15, 12, 10)
    times = [(at + timedelta(minutes=m),) for m in (-70, -20, 0, 1, 60)]
    rows = spark.createDataFrame(times, "t timestamp_ntz")
    assert rows.filter(since("t", at, 1)).count() == 3
    days = spark.createDataFrame([(date(2024, 1, d),) for d in (10, 14, 15, 16)], "d date")
    assert [r.d.day for r in days.filter(days_upto("d", at, 3)).orderBy("d").collect()] == [14, 15]
    readings = rows.select(F.lit("x").alias("device_id"), F.lit("m").alias("metric_name"), F.col("t").alias("reading_timestamp"), F.date_trunc("hour", "t").cast("timestamp_ntz").alias("reading_bucket_hour"))
    assert health.recent_readings(readings, at).count() == 2
    assert health.readings_within(readings, at, 24).count() == 3


def test_site_health_and_exposure_end_on_the_day(spark):
    devices = spark.createDataFrame([("a", "online")], "site_id string, status string")
    daily = spark.createDataFrame([("a", date(2024, 1, d), u, 50.0, 1) for d, u in ((10, 90.0), (15, 80.0), (16, 0.0))], "site_id string, summary_date date, uptime_pct double, avg_battery_pct double, alerts_critical int")
    (row,) = federated.site_health(devices, daily, "2024-01-15").collect()
    assert (row.historical_uptime_30d, row.critical_alerts_30d) == (85.0, 2)


def test_months_are_written_in_as_many_files_as_they_need(spark, tmp_path):
    rows = spark.range(1_000).select("id", F.lit(2024).alias("y"), (F.col("id") % 2 + 1).cast("int").alias("m"))
    ingest.append_conformed(rows, rows.schema, str(tmp_path / "t"), ["y", "m"], ["id"])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 1_000 and back.filter("m = 2").count() == 500


def test_a_stream_goes_on_in_its_folder(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "job")
    schema = "k int, v int, t timestamp"

    def add(rows):
        spark.createDataFrame([(k, v, datetime(2024, 1, 1)) for k, v in rows], schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        return {r.k: r.v for r in jobs.upsert_to_table(stream, "x", ["k"], ["v"], folder).collect()}

    add([(1, 1), (2, 2)])
    add([(1, 5)])
    assert run() == {1: 5, 2: 2}
    add([(2, 9), (3, 3)])
    assert run() == {1: 5, 2: 9, 3: 3}
    assert run() == {1: 5, 2: 9, 3: 3}  # nothing new
    assert len(jobs._versions(spark, folder)) == 2  # older versions are gone

    def rows():
        stream = spark.readStream.schema(schema).parquet(source)
        return jobs.run_to_table(stream, "y", folder=str(tmp_path / "rows")).count()

    assert rows() == 5
    add([(7, 7)])
    assert rows() == 6
