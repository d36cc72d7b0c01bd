"""Typed load, rejects, conforming writes, upserts."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from emberline.sources import ingest

SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("price", T.DecimalType(10, 2)),
    T.StructField("seen", T.TimestampNTZType()), T.StructField("active", T.BooleanType()),
    T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("born", T.DateType()),
])
HEADER = "id,name,price,seen,active,tags,born,unused"


def write(path, *lines):
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


def test_cells_take_the_declared_type(spark, tmp_path):
    file = write(
        tmp_path / "things_01.csv",
        '10.0,Ann,1.5,2026-04-23T09:00:00,TRUE,"[""a"", ""b""]",2020-02-29,x',
        '2,,,,false,"[a, b]",,x',
    )
    loaded = ingest.read_csv(spark, file, SCHEMA, with_table=True)
    a, b = loaded.good.orderBy(F.desc("id")).collect()
    assert tuple(a) == (10, "Ann", Decimal("1.50"), datetime(2026, 4, 23, 9), True, ["a", "b"], date(2020, 2, 29), "things")
    assert tuple(b) == (2, None, None, None, False, ["a", "b"], None, "things")
    assert loaded.rejects.count() == 0


def test_bad_rows_do_not_stop_the_file(spark, tmp_path):
    first = write(tmp_path / "things_01.csv", "1,a,1,,,,,x", "two,b,cheap,,,,,x", "3,c,1", "4,d,1,,,,,x,too,many")
    second = write(tmp_path / "things_02.csv", "5,e,5,,,,2026-02-30,x", "6,f,6,,,,,x")
    loaded = ingest.read_csv(spark, [first, second], SCHEMA)
    assert sorted(x.id for x in loaded.good.collect()) == [1, 6]
    assert {x.id: x.faulty_columns for x in loaded.rejects.collect()} == {
        "two": ["id", "price"], "3": ["_corrupt_record"], "4": ["_corrupt_record"], "5": ["born"]
    }
    assert loaded.good.count() == 2 and loaded.rejects.count() == 4
    counts = ingest.reconciliation({"t": spark.range(6)}, {"t": loaded.good}, {"t": loaded.rejects}).first()
    assert counts.balanced and counts.rejected_rows == 4


def test_absent_header_column(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,name\n1,a\n")
    with pytest.raises(ValueError, match="price"):
        ingest.read_csv(spark, str(tmp_path / "x.csv"), SCHEMA)


def test_guessed_types(spark, tmp_path):
    file = write(tmp_path / "t.csv", "1,a,1.5,2026-04-23T09:00:00,true,x,2026-04-23,y")
    types = dict(ingest.read_csv_guessed(spark, file).dtypes)
    assert types["id"] == "int" and types["active"] == "boolean" and types["price"] == "double"


def test_conform_orders_casts_and_refuses(spark):
    df = spark.createDataFrame([("x", 1.005, 7)], "extra string, price double, id int")
    target = T.StructType.fromDDL("id long, price decimal(10,2)")
    assert tuple(ingest.conform(df, target).first()) == (7, Decimal("1.01"))
    with pytest.raises(ValueError, match="name"):
        ingest.conform(df, T.StructType.fromDDL("id long, name string"))
    with pytest.raises(ValueError, match="unsupported"):
        ingest.check_staged_types(spark.range(1).select(F.array(F.lit(1)).alias("a")))


def test_append_repeats_and_overwrite_does_not(spark, tmp_path):
    df = spark.createDataFrame([(1, 2026, 4), (2, 2026, 5)], "id int, yr int, mo int")
    target, path = T.StructType.fromDDL("id long, yr int, mo int"), str(tmp_path / "t")
    for mode, expected in (("append", 2), ("append", 4), ("overwrite", 2)):
        ingest.append_conformed(df, target, path, ["yr", "mo"], ["id"], mode=mode)
        assert spark.read.parquet(path).count() == expected
    ingest.append_conformed(df.filter("mo = 5"), target, path, ["yr", "mo"], mode="overwrite")
    assert spark.read.parquet(path).count() == 2


def test_written_text_blanks_are_null(spark, tmp_path):
    ingest.write_parquet(spark.createDataFrame([("",), ("a",)], "s string"), str(tmp_path / "p"))
    assert {x.s for x in spark.read.parquet(str(tmp_path / "p")).collect()} == {None, "a"}


def test_upsert_and_reading_keys(spark):
    schema = "device_id string, reading_timestamp int, metric_name string, metric_value int, seq int"
    rows = spark.createDataFrame([("d", 1, "a", 10, 0), ("d", 1, "b", 20, 1), ("d", 2, "a", 30, 2)], schema)
    late = spark.createDataFrame([("d", 1, "a", 11, 3)], schema)
    wide = ingest.upsert(rows, late, ingest.READING_KEY, ["seq"])
    assert sorted(x.metric_value for x in wide.collect()) == [11, 20, 30]
    narrow = ingest.newest_readings(rows, ["seq"], narrow_key=True)
    assert sorted(x.metric_value for x in narrow.collect()) == [20, 30]


def test_table_counts(spark):
    got = {x.table_name: (x.row_count, x.column_count) for x in ingest.table_counts({"a": spark.range(3), "b": spark.range(0)}).collect()}
    assert got == {"a": (3, 1), "b": (0, 1)}
