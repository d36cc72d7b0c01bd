"""Typed files in, conformed tables out, and an account of what was refused."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.labels import blank_to_null, table_of_batch, text_is_true
from ..functions.numbers import lenient_integer
from ..operators.keyed import newest_per_key
from ..operators.signals import tiered

# The types a staged file may carry; anything else is refused before a row is read.
STAGED_TYPES = (T.StringType, T.BooleanType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType,
                T.TimestampType, T.TimestampNTZType, T.DecimalType)


class Loaded(NamedTuple):
    good: DataFrame
    rejects: DataFrame


def _parsed(text: Column, kind: T.DataType) -> Column:
    """The typed value of a trimmed, non-empty text; null where it cannot be read."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BooleanType):
        return text_is_true(text)
    if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return lenient_integer(text).try_cast(kind)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        from_json = F.from_json(text, kind)
        if isinstance(kind, T.ArrayType):
            # A bracketed comma list is accepted where the cell is no JSON.
            inner = F.regexp_replace(text, r"^\[|\]$", "")
            cells = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", ""))
            typed = F.transform(F.filter(cells, lambda x: x != ""), lambda x: x.try_cast(kind.elementType))
            # One unreadable element makes the cell unreadable.
            return F.coalesce(from_json, F.when(~F.exists(typed, lambda x: x.isNull()), typed))
        return from_json
    return F.trim(text).try_cast(kind)


CORRUPT = "_corrupt_record"


def typed_rows(raw: DataFrame, schema: T.StructType) -> Loaded:
    """Convert text columns to the declared types; a row with an unreadable cell is a reject.

    Empty text is null, not an error. Rejects keep their text and name the columns at fault, so
    good and rejected rows together are all rows.
    """
    typed, faults = [], []
    for field in schema.fields:
        text = blank_to_null(field.name)
        value = _parsed(text, field.dataType)
        typed.append(value.alias(field.name))
        faults.append(F.when(text.isNotNull() & value.isNull(), F.lit(field.name)))
    if CORRUPT in raw.columns:
        faults.append(F.when(F.col(CORRUPT).isNotNull(), F.lit(CORRUPT)))
    checked = raw.withColumn("_faults", F.array_compact(F.array(*faults)))
    extra = [c for c in raw.columns if c not in schema.fieldNames() and c != CORRUPT]
    good = checked.filter(F.size("_faults") == 0).select(*typed, *extra)
    rejects = checked.filter(F.size("_faults") > 0).withColumnRenamed("_faults", "faulty_columns")
    return Loaded(good, rejects)


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, with_table: bool = False) -> Loaded:
    """CSV files with a header, typed by ``schema``. Several batch files form one input.

    Columns are found by header name; further columns are ignored, missing ones are an error,
    and all files must have the same header. The scan reads text and the types are applied in the
    plan, so a bad cell costs its row, not the file; a row with too few or too many cells is a
    reject as well. ``with_table`` adds the table name the file name stands for.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    header = spark.read.option("header", True).option("escape", '"').csv(paths).columns
    absent = sorted(set(schema.fieldNames()) - set(header))
    if absent:
        raise ValueError(f"the files lack {', '.join(absent)}")
    as_text = T.StructType([T.StructField(c, T.StringType()) for c in [*header, CORRUPT]])
    # Without pruning the parser sees every cell, so that a row of the wrong length is noticed
    # whatever columns are read later.
    reader = spark.read.schema(as_text).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
    reader = reader.option("escape", '"')
    raw = reader.option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(paths)
    columns = [*schema.fieldNames(), CORRUPT]
    if not with_table:
        return typed_rows(raw.select(*columns), schema)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.csv)?(/part-[^/]*)?$", 1)
    return typed_rows(raw.select(*columns, table_of_batch(stem).alias("table_name")), schema)


def read_csv_guessed(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """CSV files whose types Spark works out from the cells. Prefer ``read_csv``."""
    return spark.read.option("header", True).option("escape", '"').option("inferSchema", True).csv(paths)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes inside a cell are doubled, as spreadsheet tools and ``read_csv`` expect."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Snappy Parquet with empty text as null."""
    cols = [blank_to_null(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields]
    df.select(*cols).write.mode("overwrite").option("compression", "snappy").parquet(path)


def check_staged_types(df: DataFrame) -> dict[str, str]:
    """SQL type per column of a staged file; an unsupported type is an error."""
    for f in df.schema.fields:
        if not isinstance(f.dataType, STAGED_TYPES):
            raise ValueError(f"column {f.name} has the unsupported type {f.dataType.simpleString()}")
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def missing_columns(df: DataFrame, target: T.StructType) -> list[str]:
    return sorted(set(target.fieldNames()) - set(df.columns))


def conform(df: DataFrame, target: T.StructType) -> DataFrame:
    """The target's columns in its order and types. Extra columns go, missing ones are an error."""
    absent = missing_columns(df, target)
    if absent:
        raise ValueError(f"the source lacks {', '.join(absent)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.fields])


def append_conformed(
    df: DataFrame, target: T.StructType, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), mode: str = "append"
) -> None:
    """Write in the target's shape, partitioned and sorted within files.

    Rows are first brought together by partition value, in pieces of the size Spark is told to aim
    at: small months share a task, a month that holds most rows spreads over as many as it needs. With
    ``mode='overwrite'`` only the partitions present in the input are replaced, which makes a
    rerun safe; ``append`` would add the rows again.
    """
    check_staged_types(df)
    rows = conform(df, target)
    if partition_by:
        rows = rows.hint("rebalance", *[F.col(c) for c in partition_by])
    if sort_by:
        rows = rows.sortWithinPartitions(*partition_by, *sort_by)
    writer = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path) if partition_by else writer.parquet(path)


def archive_old(
    rows: DataFrame, time: str, cutoff: Column, target: T.StructType, path: str, partition_by: Sequence[str], mode: str = "append"
) -> DataFrame:
    """Move rows older than the cutoff to the archive at ``path``; returns the rows that stay hot.

    ``target`` holds the archive's columns, ``partition_by`` its year and month columns, which are
    derived from ``time`` and named in that order.
    """
    hot, old = tiered(rows, time, cutoff)
    year, month = partition_by
    dated = old.withColumns({year: F.year(time), month: F.month(time)})
    append_conformed(dated, target, path, partition_by, [time], mode)
    return hot


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The table after the changes: per key the newest row, also among the changes themselves."""
    return newest_per_key(current.unionByName(changes), keys, order)


READING_KEY = ("device_id", "reading_timestamp", "metric_name")
NARROW_READING_KEY = ("device_id", "reading_timestamp")


def newest_readings(readings: DataFrame, order: Sequence[str], narrow_key: bool = False) -> DataFrame:
    """Readings after last-write-wins. The narrow key lets two metrics of one instant collide."""
    return newest_per_key(readings, NARROW_READING_KEY if narrow_key else READING_KEY, order)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Name, row count and column count of every table, in one job."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).cast("long").alias("column_count")
        )
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reconciliation(source: dict[str, DataFrame], target: dict[str, DataFrame], rejects: dict[str, DataFrame]) -> DataFrame:
    """Per table: rows read, rows stored, rows refused, and whether they add up."""
    read = table_counts(source).select("table_name", F.col("row_count").alias("source_rows"))
    stored = table_counts(target).select("table_name", F.col("row_count").alias("target_rows"))
    out = read.join(stored, "table_name", "left")
    if rejects:
        out = out.join(table_counts(rejects).select("table_name", F.col("row_count").alias("rejected_rows")), "table_name", "left")
    else:
        out = out.withColumn("rejected_rows", F.lit(0).cast("long"))
    out = out.na.fill(0, ["target_rows", "rejected_rows"])
    return out.withColumn("balanced", F.col("source_rows") == F.col("target_rows") + F.col("rejected_rows"))
