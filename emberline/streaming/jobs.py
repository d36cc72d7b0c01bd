"""Streaming counterparts of the rollup, upsert, anomaly and session jobs.

Each takes a streaming DataFrame with a TIMESTAMP event time (watermarks do not accept the
zone-less type; ``with_event_time`` converts it) and returns one. ``run_to_table`` drives a
finite input to completion with its checkpoint in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numbers import mean
from ..operators.health import BASELINE_FIELDS, anomaly_columns, usable
from ..operators.keyed import newest_per_key
from ..session import job_folder


def with_event_time(stream: DataFrame, column: str) -> DataFrame:
    return stream.withColumn(column, F.col(column).cast("timestamp"))


def hourly_rollup_stream(readings: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Hourly statistics, emitted when the watermark has passed the hour; later rows are dropped.

    Spark judges lateness by the watermark of the batch before, so a row may still enter an hour
    in the very batch that closes it.

    p95 comes from a quantile sketch: an exact rank would have to keep every sample in state.
    """
    value = F.col("metric_value")
    return (
        readings.withWatermark("reading_timestamp", lateness)
        .groupBy("device_id", "metric_name", F.window("reading_timestamp", "1 hour"))
        .agg(
            F.count(F.lit(1)).alias("sample_count"),
            F.min(value).alias("min_value"), F.max(value).alias("max_value"), mean(value).alias("avg_value"),
            F.percentile_approx(value, 0.95, 10_000).alias("p95_value"),
            F.stddev_pop(value.cast("double")).alias("stddev_value"),
        )
        .withColumn("hour_start", F.col("window.start").cast("timestamp_ntz"))
        .drop("window")
    )


def first_per_key_stream(rows: DataFrame, keys: Sequence[str], time: str, lateness: str = "1 hour") -> DataFrame:
    """Drops repeats of a key that arrive within the watermark; state is bounded by it."""
    return rows.withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(keys))


def anomaly_stream(readings: DataFrame, baseline: DataFrame, slices: int | None = None) -> DataFrame:
    """Every usable reading tested against a static baseline as it arrives.

    The baseline has one row per device and metric and Spark sends it to the readings while it is
    small. Where it is not, a device that holds much of the stream can be cut into ``slices`` by a
    hash of the row, and the baseline is repeated for each.
    """
    keys = ["device_id", "metric_name"]
    known = baseline.select(*keys, *BASELINE_FIELDS)
    rows = readings.filter(usable())
    if slices:
        known = known.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        rows = rows.withColumn("_slice", F.pmod(F.xxhash64(*rows.columns), F.lit(slices)).cast("int"))
        keys = [*keys, "_slice"]
    rows = rows.join(known, keys, "left")
    rows = rows.withColumn("_has_usable", F.lit(True))
    checks = anomaly_columns(F.col("metric_value").try_cast("double"))
    return rows.select("device_id", "metric_name", "reading_timestamp", "metric_value", *[c.alias(n) for n, c in checks.items()])


def session_stream(clicks: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions emitted once the watermark has passed their end.

    With ``spark.sql.sessionWindow.merge.sessions.in.local.partition`` (set by ``build_session``)
    each task merges its own events first, so a busy customer ships sessions, not events.
    """
    return (
        clicks.withWatermark("event_time", lateness)
        .groupBy("customer_id", F.session_window("event_time", gap))
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.count_if(F.col("event_type") == "view").alias("page_views"),
            F.count_if(F.col("event_type") == "click").alias("cart_additions"),
            F.max("event_time").cast("timestamp_ntz").alias("session_end"),
        )
        .withColumn("session_start", F.col("session_window.start").cast("timestamp_ntz"))
        .drop("session_window")
    )


def run_to_table(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Process everything available, write Parquet, and return the written rows.

    A job that is to go on where it stopped names its ``folder``: the checkpoint in it says what was
    read, and the file sink beside it makes each row appear once. Without one the run stands alone.
    """
    spark = stream.sparkSession
    base = folder or job_folder(spark, "streams", f"{name}-{uuid.uuid4().hex}")
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


#: The column, and so the folder name, that says which bucket of an upserted table a row is in.
_BUCKET = "upsert_bucket"


def _written(spark: SparkSession, root: str) -> dict[int, dict[int, object]]:
    """Per bucket the versions of it below ``root`` that were written to their end, with their folders."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[int, dict[int, object]] = {}
    if not store.exists(top):
        return found
    for version in store.listStatus(top):
        path = version.getPath()
        if not store.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
            continue
        for part in store.listStatus(path):
            name = part.getPath().getName()
            if name.startswith(f"{_BUCKET}="):
                number = int(path.getName().removeprefix("version="))
                found.setdefault(int(name.removeprefix(f"{_BUCKET}=")), {})[number] = part.getPath()
    return found


def _versions(spark: SparkSession, base: str) -> list[list[str]]:
    """The folders of the table in ``base`` by age: the newest version of every bucket, the one before it where that is still kept, and so on."""
    above = spark._jvm.org.apache.hadoop.fs.Path(base)
    roots = [f.getPath() for f in above.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(above)]
    buckets = [b for r in roots if r.getName().startswith("in_") and r.getName().endswith("_buckets") for b in _written(spark, r.toString()).values()]
    aged = [[b[v].toString() for v in sorted(b, reverse=True)] for b in buckets]
    return [[b[k] for b in aged if k < len(b)] for k in range(max(map(len, aged), default=0))]


def _drop_superseded(spark: SparkSession, root: str, batch_id: int) -> None:
    """Delete what no batch can need again. Of each bucket stay the version of this batch, if it has one, and the newest before it,
    which this batch reads when it runs again. Versions without a bucket left go as a whole."""
    versions = _written(spark, root)
    gone, left = [], set()
    for of_bucket in versions.values():
        before = [v for v in of_bucket if v < batch_id]
        for v, path in of_bucket.items():
            if v < max(before, default=v):
                gone.append(path)
            else:
                left.add(v)
    gone += {path.getParent().toString(): path.getParent() for of_bucket in versions.values() for v, path in of_bucket.items() if v not in left}.values()
    for path in gone:
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def upsert_to_table(
    stream: DataFrame, name: str, keys: Sequence[str], order: Sequence[str], folder: str | None = None, buckets: int = 64
) -> DataFrame:
    """Keep the newest row per key across micro-batches and return the final table.

    The table lies in ``buckets`` by a hash of the key. A batch reads and writes only the buckets that
    its keys fall in, as a version named by the batch, so a batch that is run again replaces its own
    output only. A job that is to go on where it stopped names its ``folder`` and keeps its number of
    buckets; another number raises ValueError. At scale choose it so that a bucket is a few files.
    """
    if buckets < 1:
        raise ValueError("buckets must be positive")
    if _BUCKET in stream.columns:
        raise ValueError(f"the column {_BUCKET} is the table's own")
    spark = stream.sparkSession
    base = folder or job_folder(spark, "streams", f"{name}-{uuid.uuid4().hex}")
    schema = stream.schema
    root = f"{base}/in_{buckets}_buckets"
    above = spark._jvm.org.apache.hadoop.fs.Path(base)
    store = above.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    others = [f.getPath().getName() for f in store.listStatus(above)] if store.exists(above) else []
    if any(o.startswith("in_") and o.endswith("_buckets") and not root.endswith(f"/{o}") for o in others):
        raise ValueError(f"the table in {base} has another number of buckets")

    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int").alias(_BUCKET)
        touched = {r[0] for r in batch.select(bucket).distinct().collect()}  # at most ``buckets`` numbers
        current = []
        for number, versions in _written(session, root).items():
            before = [v for v in versions if v < batch_id]
            if number in touched and before:
                current.append(versions[max(before)].toString())
        rows = newest_per_key(batch, keys, order)
        if current:
            rows = newest_per_key(session.read.schema(schema).parquet(*current).unionByName(rows), keys, order)
        rows = rows.select("*", bucket).hint("rebalance", _BUCKET)
        rows.write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{root}/version={batch_id}")
        _drop_superseded(session, root, batch_id)

    query = (
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    versions = _versions(spark, base)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*versions[0])


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over a Parquet table, be it one file or a folder of part files.

    A plain path must be a folder, a pattern may be either; the last letter in brackets makes a
    pattern that matches this path only.
    """
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
