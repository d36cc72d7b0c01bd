"""Streams against their batch twins, late rows, restarts of state."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from emberline.operators import keyed, rollups
from emberline.streaming import jobs

SCHEMA = "device_id string, metric_name string, reading_timestamp timestamp_ntz, metric_value decimal(18,4), quality_code string"
T0 = datetime(2026, 4, 23)


def row(hours, value, device="d"):
    return (device, "m", T0 + timedelta(hours=hours), Decimal(value), "good")


def files(spark, folder, *batches):
    """One file per batch, older files first."""
    import os

    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.iterdir():
            if f.suffix == ".parquet" and not f.name.startswith("b"):
                target = folder / f"b{n}.parquet"
                os.rename(f, target)
                os.utime(target, (1_000_000 + n, 1_000_000 + n))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "b*.parquet").parquet(str(folder))


def test_rollup_equals_batch_and_drops_late_rows(spark, tmp_path):
    stream = files(
        spark, tmp_path, [row(0.1, 1), row(0.5, 3), row(1.2, 5)], [row(5, 7)], [row(9, 1)], [row(0.2, 100)], [row(20, 1)],
    )
    got = jobs.run_to_table(jobs.hourly_rollup_stream(jobs.with_event_time(stream, "reading_timestamp")), "t")
    rows = {x.hour_start: x for x in got.collect()}
    first = rows[T0]
    assert (first.sample_count, float(first.min_value), float(first.max_value), first.avg_value, first.stddev_value) == (2, 1.0, 3.0, 2.0, 1.0)
    assert sorted(rows) == [T0 + timedelta(hours=h) for h in (0, 1, 5, 9)]
    batch = spark.createDataFrame([row(0.1, 1), row(0.5, 3), row(1.2, 5), row(5, 7), row(9, 1)], SCHEMA).withColumn(
        "reading_bucket_hour", F.date_trunc("hour", "reading_timestamp").cast("timestamp_ntz")
    )
    twin = {x.hour_start: (x.sample_count, float(x.avg_value)) for x in rollups.hourly_rollup(batch).collect()}
    assert {h: (x.sample_count, x.avg_value) for h, x in rows.items()} == twin


def test_repeats_within_the_watermark(spark, tmp_path):
    stream = files(spark, tmp_path, [row(0, 1), row(0, 1), row(0.1, 2)], [row(0, 1), row(0.2, 3)])
    rows = jobs.with_event_time(stream, "reading_timestamp")
    got = jobs.run_to_table(jobs.first_per_key_stream(rows, ["device_id", "metric_value"], "reading_timestamp"), "t")
    assert sorted(float(x.metric_value) for x in got.collect()) == [1.0, 2.0, 3.0]


def test_upsert_over_batches(spark, tmp_path):
    batches = [[row(0, 1), row(2, 2), row(1, 9, "e")], [row(1, 3)], [row(3, 4), row(0, 7, "e")]]
    stream = files(spark, tmp_path, *batches)
    got = jobs.upsert_to_table(stream, "t", ["device_id"], ["reading_timestamp"])
    twin = keyed.newest_per_key(spark.createDataFrame(sum(batches, []), SCHEMA), ["device_id"], ["reading_timestamp"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, twin.collect()))


def add_file(spark, folder, n, rows):
    """One more file in the folder of a stream."""
    import os

    side = folder.parent / f"side{n}"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(side))
    (part,) = [f for f in side.iterdir() if f.suffix == ".parquet"]
    os.rename(part, folder / f"b{n}.parquet")
    os.utime(folder / f"b{n}.parquet", (1_000_000 + n, 1_000_000 + n))


def test_upsert_goes_on_after_a_stop_and_rewrites_touched_buckets_only(spark, tmp_path):
    inbox, base = tmp_path / "inbox", tmp_path / "table"
    inbox.mkdir()
    many = [row(0, k, f"d{k}") for k in range(200)]
    run = lambda stream, n=16: jobs.upsert_to_table(stream, "t", ["device_id"], ["reading_timestamp"], str(base), n)
    stream = files(spark, inbox, many)
    assert run(stream).count() == 200
    versions = lambda: {int(b): sorted(v) for b, v in jobs._written(spark, f"{base}/in_16_buckets").items()}
    assert versions() == {b: [0] for b in range(16)}
    late = [row(1, 1000, "d7"), row(-1, 1, "d7")]
    add_file(spark, inbox, 1, late)
    got = sorted(map(tuple, run(stream).collect()))
    twin = keyed.newest_per_key(spark.createDataFrame(many + late, SCHEMA), ["device_id"], ["reading_timestamp"])
    assert got == sorted(map(tuple, twin.collect()))
    (touched,) = [b for b, v in versions().items() if v == [0, 1]]
    assert all(v == [0] for b, v in versions().items() if b != touched)
    add_file(spark, inbox, 2, [row(2, 5, "d7")])
    assert {tuple(x) for x in run(stream).collect()} - set(got) == {row(2, 5, "d7")}
    assert versions()[touched] == [1, 2]  # what batch 2 would read again, and its own
    with pytest.raises(ValueError):
        run(stream, 8)


def test_upsert_of_no_rows(spark, tmp_path):
    got = jobs.upsert_to_table(files(spark, tmp_path, []), "t", ["device_id"], ["reading_timestamp"])
    assert got.count() == 0 and got.columns == spark.createDataFrame([], SCHEMA).columns


def test_flags_per_reading(spark, tmp_path):
    stream = jobs.with_event_time(files(spark, tmp_path, [row(0, 25), row(0.1, 20)], [row(0.2, 30, "unseen")]), "reading_timestamp")
    baseline = spark.createDataFrame(
        [("d", "m", 20.0, 24.0, 18.0, 26.0, 1.5, 10, 10)],
        "device_id string, metric_name string, baseline_avg double, baseline_p95 double, baseline_min double, baseline_max double, "
        "baseline_stddev double, sample_count long, baseline_hours long",
    )
    got = jobs.run_to_table(jobs.anomaly_stream(stream, baseline), "t")
    assert sorted((x.device_id, float(x.metric_value), x.anomaly_status) for x in got.collect()) == [
        ("d", 20.0, "normal"), ("d", 25.0, "anomalous"), ("unseen", 30.0, "unknown")
    ]
