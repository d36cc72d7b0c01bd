"""Spark session settings and the shared folder for durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "emberline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    ``spark.sql.shuffle.partitions`` is only an initial count: adaptive execution coalesces
    it on small inputs, so a cluster should set it high (thousands) rather than tune it.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, for checkpoints and written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where driver and
    executors are one process, falls back to a temporary folder.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        # SparkContext.setCheckpointDir appends a UUID folder; reuse it when it is already set.
        folder = sc.getCheckpointDir()
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="emberline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def job_folder(spark: SparkSession, *parts: str) -> str:
    """A sub-folder of the shared folder that belongs to this application only."""
    return os.path.join(shared_folder(spark), spark.sparkContext.applicationId, *parts)


def settled(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """The rows as a written table in the shared folder, written by at most ``tasks`` tasks if that is given.

    Like a checkpoint it cuts the lineage and survives lost executors. Unlike one it is columnar,
    so a later step reads only its columns, and its size is known, so Spark can decide by it
    whether a join may broadcast it.
    """
    path = job_folder(df.sparkSession, "settled", uuid.uuid4().hex)
    (df.coalesce(tasks) if tasks else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
