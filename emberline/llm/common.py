"""What the operators share: reading tables, shipping the package, vectorised hashes of words and bytes."""

from __future__ import annotations

import os
import pickle
import shutil
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows that pass between the JVM and a Python worker at once. Whole texts may be long, so this is small.
BATCH_ROWS = 256

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors once and keep Arrow batches of whole texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_emberline_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "emberline"), "zip", os.path.dirname(package), os.path.basename(package))
    sc.addPyFile(archive)
    sc._emberline_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def batch_rows(spark: SparkSession, n: int):
    """Smaller Arrow batches for what runs inside, where single rows are large."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def discard(df: DataFrame) -> None:
    """Delete a table that ``settled`` wrote and no later step reads."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if "/settled/" in folder.toString():
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps: it does so when the driver collects its garbage."""
    spark.sparkContext._jvm.System.gc()


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """How many tasks write a table of ``rows`` rows: one for ``each`` of them, and not fewer than run at once. A small table in hundreds of
    files costs more to write and open than to compute; where that is as many as there are partitions, it changes nothing."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def map_arrow(df: DataFrame, columns: list[str], work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` over Arrow batches of just these columns; clashing or extra columns never reach it."""
    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(work, schema)


def in_one_task(rows: DataFrame, fit: Callable[[list[dict]], object]) -> object:
    """What ``fit`` makes of all ``rows``, a bounded sample, in one task: only what it makes comes to the driver, which holds neither the rows
    nor the fitting's memory."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [row for batch in batches for row in batch.to_pylist()]
        yield pa.RecordBatch.from_pydict({"made": pa.array([pickle.dumps(fit(found))], pa.binary())})

    made = rows.repartition(1).mapInArrow(work, "made binary").collect()
    # Without any row Spark may start no task.
    return pickle.loads(made[0].made) if made else fit([])


def held_out(doc_id) -> F.Column:
    """Rows whose label no model may see: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that similar inputs give unrelated outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def word_list(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z in lower case. Bytes split at just these characters."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def rows_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
