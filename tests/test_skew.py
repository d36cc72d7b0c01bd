"""Hot keys: slicing must never change a result."""

import random
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Window, functions as F

from emberline.operators import keyed, ordered, ranks, signals
from emberline.operators.skew import hot_keys, join_spread


def facts(spark, n=600):
    rng = random.Random(1)
    rows = [(None if i % 7 == 0 else "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.randrange(5), i) for i in range(n)]
    return spark.createDataFrame(rows, "k string, j int, v long")


def dims(spark):
    return spark.createDataFrame([("hot", 1, "H"), *[(f"k{i}", i % 5, f"d{i}") for i in range(30)], (None, 0, "N"), ("unused", 0, "U")], "k string, j int, d string")


def rows_of(df):
    return sorted(map(str, (tuple(x) for x in df.collect())))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("on", [["k"], ["k", "j"]])
def test_spread_join_equals_plain_join(spark, how, on):
    f, d = facts(spark), dims(spark).drop(*({"k", "j"} - set(on)))
    assert rows_of(join_spread(f, d, on, how, rows_per_slice=10)) == rows_of(f.join(d, on, how))


def test_hot_key_is_cut(spark):
    hot = {x._hot_k: x._slices for x in hot_keys(facts(spark), ["k"], rows_per_slice=50).collect()}
    assert hot["hot"] >= 3 and None in hot
    joined = join_spread(facts(spark), dims(spark).drop("j"), "k", rows_per_slice=10)
    assert joined.filter("k = 'hot'").count() == facts(spark).filter("k = 'hot'").count()


def sequence(spark, n=500):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("abc"), i, rng.choice([None, *range(-9, 10)]), i % 11 == 0) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t int, v int, mark boolean")


@pytest.mark.parametrize("per_bucket", [10**6, 100, 7])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("before", [False, True])
def test_running_folds(spark, per_bucket, descending, before):
    df = sequence(spark)
    got = ordered.running(
        df, ["k"], [F.desc("t") if descending else F.asc("t")], by="t",
        sums={"s": F.col("v")}, highest={"hi": F.col("v")}, lowest={"lo": F.col("v")}, last_known={"last": F.col("v")},
        previous={"prev": F.col("v")}, number="n", before=before, rows_per_bucket=per_bucket,
    )
    assert got.columns == ["k", "t", "v", "mark", "s", "n", "hi", "lo", "last", "prev"]
    groups = defaultdict(list)
    for x in sorted(df.collect(), key=lambda x: -x.t if descending else x.t):
        groups[x.k].append(x)
    want = set()
    for k, xs in groups.items():
        for i, x in enumerate(xs):
            seen = [y.v for y in (xs[:i] if before else xs[: i + 1])]
            known = [v for v in seen if v is not None]
            want.add((k, x.t, x.v, x.mark, sum(known), len(seen), max(known, default=None), min(known, default=None),
                      known[-1] if known else None, xs[i - 1].v if i else None))
    assert {tuple(x) for x in got.collect()} == want


def test_large_groups_alone_are_cut(spark):
    cut = ordered.in_buckets(sequence(spark), ["k"], "t", 100)
    assert cut.filter("k = 'hot'").select("_bucket").distinct().count() > 5
    assert cut.filter("k <> 'hot' AND _bucket IS NOT NULL").isEmpty()


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "double", "decimal(12,3)", "string"])
@pytest.mark.parametrize("descending", [False, True])
def test_buckets_follow_the_order_of_every_type(spark, kind, descending):
    """Numbers in buckets equal those of a plain window; nulls, ties and odd values among the order values."""
    rng = random.Random(11)
    texts = {"date": ["2024-02-29", "1969-12-31"], "timestamp": ["2024-02-29 10:00:00.5", "1950-01-01 00:00:00"], "timestamp_ntz": ["2024-03-31 02:30:00", "1950-01-01 00:00:00"],
             "double": ["-1.5", "0.0", "1e300"], "decimal(12,3)": ["-7.125", "0"], "string": ["", "order-9", "été", "Z", "order-10000000000"]}[kind]
    made = {"date": lambda n: f"20{n % 30:02d}-01-{n % 28 + 1:02d}", "timestamp": lambda n: f"2020-01-{n % 28 + 1:02d} 00:00:{n % 60:02d}",
            "timestamp_ntz": lambda n: f"2020-01-{n % 28 + 1:02d} 00:00:{n % 60:02d}", "double": lambda n: str(n / 7), "decimal(12,3)": lambda n: str(n), "string": lambda n: f"order-{n:05d}"}[kind]
    data = [(i % 2, rng.choice([None, *texts]) if i % 5 == 0 else made(rng.randrange(9999)), i) for i in range(400)]
    df = spark.createDataFrame(data, "g int, s string, i int").withColumn("t", F.col("s").cast(kind)).drop("s")
    order = [F.desc_nulls_first("t") if descending else F.asc_nulls_last("t"), F.asc("i")]
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("long"))
    assert rows_of(ordered.running(df, ["g"], order, by="t", number="n", rows_per_bucket=20)) == rows_of(want)


@pytest.mark.parametrize("values", [[float("nan"), 1.0, None], [float("inf"), -float("inf"), 2.0], [3.0], [None]])
def test_order_values_without_a_range(spark, values):
    df = spark.createDataFrame([(None, values[i % len(values)], i) for i in range(60)], "g string, t double, i int")
    order = [F.asc("t"), F.asc("i")]
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("long"))
    assert rows_of(ordered.running(df, ["g"], order, by="t", number="n", rows_per_bucket=10)) == rows_of(want)


@pytest.mark.parametrize("per_bucket", [10**6, 20])
def test_second_fold_takes_over_the_buckets(spark, per_bucket):
    df = sequence(spark)
    one = ordered.running(df, ["k"], [F.asc("t")], by="t", sums={"s": F.col("v")}, rows_per_bucket=per_bucket, chained=True)
    two = ordered.running(one, ["k"], [F.asc("t")], by="t", highest={"top": F.col("s")})
    assert two.columns == ["k", "t", "v", "mark", "s", "top"]
    best = {}
    for x in sorted(two.collect(), key=lambda x: x.t):
        best[x.k] = max(best.get(x.k, x.s), x.s)
        assert x.top == best[x.k]


def test_building_folds_and_ranks_starts_no_job(spark):
    df, jobs = sequence(spark), lambda: spark._jsc.sc().dagScheduler().nextJobId()
    before = jobs()
    ordered.running(df, ["k"], [F.asc("t")], by="t", number="n", chained=True)
    ordered.surrogate_keys(df.select("t"), "n", [F.asc("t")], "t")
    ranks.value_at_rank(df, ["k"], "v")
    assert jobs() == before


def test_surrogate_keys_have_no_gaps(spark):
    got = ordered.surrogate_keys(sequence(spark).select("t"), "n", [F.asc("t")], "t", rows_per_bucket=40)
    assert all(x.n == x.t + 1 for x in got.collect())


def test_spread_join_null_safe(spark):
    f, d = facts(spark).drop("j"), dims(spark).drop("j")
    plain = f.join(d.withColumnRenamed("k", "x"), F.col("k").eqNullSafe(F.col("x")), "left").drop("x")
    assert rows_of(join_spread(f, d, "k", "left", rows_per_slice=10, null_safe=True)) == rows_of(plain)
    assert join_spread(f, d, "k", "left_anti", rows_per_slice=10, null_safe=True).filter("k IS NULL").count() == 0


def at_rank(data, fraction=0.95):
    groups = defaultdict(list)
    for k, v in data:
        groups[k].append(v)
    found = {}
    for k, vs in groups.items():
        known = sorted((v for v in vs if v is not None), key=lambda v: (v != v, v))
        found[k] = known[max(int(len(known) * fraction), 1) - 1] if known else None
    return found


@pytest.mark.parametrize("fraction", [0.05, 0.5, 0.95, 1.0])
@pytest.mark.parametrize("steps, zoom", [(256, 1 << 22), (1, 4)])
def test_value_at_rank(spark, monkeypatch, fraction, steps, zoom):
    monkeypatch.setattr(ranks, "LOG_STEPS", steps)
    monkeypatch.setattr(ranks, "ZOOM", zoom)
    rng = random.Random(3)
    data = [("hot", rng.choice([rng.random(), 0.5])) for _ in range(6000)] + [(f"g{i}", float(j)) for i in range(1, 45) for j in range(i)]
    data += [("same", 1.0)] * 300 + [("hot", None), ("none", None)] + [(None, float(i % 777)) for i in range(5000)]
    data += [("wide", rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randrange(-300, 300)) for _ in range(500)] + [("wide", 0.0)]
    data += [("close", 1.0 + k * 2.0**-52) for k in range(300)] + [("odd", v) for v in (float("inf"), -float("inf"), 5e-324, -5e-324, 1.7e308, -1.7e308)]
    rng.shuffle(data)
    got = {x.k: x.p95 for x in ranks.value_at_rank(spark.createDataFrame(data, "k string, v double"), ["k"], "v", fraction).collect()}
    assert got == at_rank(data, fraction)


def test_value_at_rank_of_one_group_of_decimals_and_of_nan(spark):
    data = [(1, Decimal(k * k % 1009) / 100) for k in range(2000)]
    df = spark.createDataFrame(data, "k int, v decimal(18,2)")
    assert ranks.value_at_rank(df.drop("k"), [], "v").first()[0] == at_rank(data)[1]
    got = ranks.value_at_rank(df, ["k"], "v", 0.25, "q", [F.count(F.lit(1)).alias("n")])
    assert got.columns == ["k", "n", "q"] and tuple(got.first()) == (1, 2000, at_rank(data, 0.25)[1])
    assert ranks.value_at_rank(df.limit(0), ["k"], "v").collect() == []
    nan = spark.createDataFrame([(1, float("nan")), (1, 2.0), (1, float("inf"))], "k int, v double")
    assert [ranks.value_at_rank(nan, ["k"], "v", f).first().p95 for f in (0.4, 0.7)] == [2.0, float("inf")]
    assert ranks.value_at_rank(nan, ["k"], "v", 1.0).first().p95 != ranks.value_at_rank(nan, ["k"], "v", 1.0).first().p95
    with pytest.raises(ValueError):
        ranks.value_at_rank(df.withColumn("v", F.col("v").cast("decimal(30,2)")), ["k"], "v")


def test_a_constant_hot_group_is_one_row_a_bin(spark):
    data = [("hot", 7.0)] * 3000 + [("b", float(k)) for k in range(30)]
    df = spark.createDataFrame(data, "k string, v double").repartition(8)
    assert {x.k: x.p95 for x in ranks.value_at_rank(df, ["k"], "v").collect()} == at_rank(data)
    plan = df._sc._jvm.PythonSQLUtils.explainString(ranks.value_at_rank(df, ["k"], "v")._jdf.queryExecution(), "simple")
    assert "Window" not in plan


def test_newest_per_key(spark):
    rng = random.Random(4)
    data = [("hot" if i % 2 else f"k{i % 9}", rng.randrange(50), i) for i in range(400)]
    got = keyed.newest_per_key(spark.createDataFrame(data, "k string, t int, i int"), ["k"], ["t", "i"])
    want = {}
    for k, t, i in data:
        want[k] = max(want.get(k, (t, i)), (t, i))
    assert {x.k: (x.t, x.i) for x in got.collect()} == want
    assert "WindowGroupLimit" in got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")


START = datetime(2026, 4, 1)


def test_as_of_join(spark):
    rng = random.Random(5)
    left = [("s1" if i % 3 else f"s{i % 5}", START + timedelta(minutes=rng.randrange(600)), f"a{i}") for i in range(150)]
    right = [("s1" if i % 2 else f"s{i % 4}", START + timedelta(minutes=i * 7), i if i % 6 else None) for i in range(80)]
    got = signals.as_of_join(
        spark.createDataFrame(left, "site string, at timestamp_ntz, id string"),
        spark.createDataFrame(right, "site string, seen timestamp_ntz, temp int"),
        ["site"], "at", "seen", ["temp"], ["id"], rows_per_bucket=10,
    )
    newest = {}
    for site, at, i in left:
        found = [(seen, temp) for s, seen, temp in right if s == site and seen <= at]
        newest[i] = max(found, key=lambda x: x[0], default=(None, None))
    assert {x.id: (x.seen, x.temp) for x in got.collect()} == newest


def test_before_failures(spark):
    rng = random.Random(6)
    readings = [("d" if i % 2 else f"d{i % 3}", START + timedelta(hours=rng.randrange(400)), "m", None if i % 17 == 0 else rng.randrange(100)) for i in range(300)]
    failures = [("d" if i % 2 else f"d{i % 4}", f"f{i}", START + timedelta(hours=i * 17)) for i in range(20)]
    got = signals.before_failures(
        spark.createDataFrame(failures, "device_id string, failure_id string, failure_timestamp timestamp_ntz"),
        spark.createDataFrame(readings, "device_id string, reading_timestamp timestamp_ntz, metric_name string, metric_value int"),
        rows_per_bucket=20,
    )
    rows = got.collect()
    assert len(rows) == len(failures)
    for x in rows:
        for h in (72, 12):
            seen = [v for d, t, _, v in readings if d == x.device_id and v is not None
                    and x.failure_timestamp - timedelta(hours=h) <= t < x.failure_timestamp]
            assert x[f"readings_{h}h"] == len(seen)
            assert x[f"mean_{h}h"] == pytest.approx(sum(seen) / len(seen)) if seen else x[f"mean_{h}h"] is None


def test_merged_windows(spark):
    rng = random.Random(7)
    data = []
    for i in range(200):
        start = START + timedelta(minutes=rng.randrange(4000))
        data.append(("s" if i % 3 else "t", start, start + timedelta(minutes=rng.randrange(60))))
    got = signals.merged_windows(spark.createDataFrame(data, "site_id string, window_start timestamp_ntz, window_end timestamp_ntz"), rows_per_bucket=20)
    want = set()
    for site in "st":
        merged = []
        for _, a, b in sorted(x for x in data if x[0] == site):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
                merged[-1][2] += 1
            else:
                merged.append([a, b, 1])
        want |= {(site, *x) for x in merged}
    assert {(x.site_id, x.window_start, x.window_end, x.windows_merged) for x in got.collect()} == want


def test_sessions(spark):
    rng = random.Random(8)
    data = [("u" if i % 2 else f"u{i % 5}", START + timedelta(minutes=rng.randrange(5000)), rng.choice(["view", "click", "x"]), i) for i in range(300)]
    got = signals.sessions(spark.createDataFrame(data, "customer_id string, event_time timestamp_ntz, event_type string, event_id int"))
    want = set()
    for user in {x[0] for x in data}:
        found = []
        for _, t, kind, _ in sorted((x for x in data if x[0] == user), key=lambda x: (x[1], x[3])):
            if not found or t - found[-1][-1][0] > timedelta(minutes=30):
                found.append([])
            found[-1].append((t, kind))
        for n, s in enumerate(found, start=1):
            kinds = [k for _, k in s]
            want.add((user, n, s[0][0], s[-1][0], len(s), kinds.count("view"), kinds.count("click")))
    assert {tuple(x) for x in got.collect()} == want


def test_running_stock_never_falls_below_zero(spark):
    rng = random.Random(9)
    data = [("p" if i % 2 else f"p{i % 6}", i, f"{i:04d}", rng.choice([-5, -3, -1, 2, 8])) for i in range(300)]
    opening = {"p": 4, "p0": 1, "p2": 0}
    got = signals.running_stock(
        spark.createDataFrame(data, "product_id string, transaction_date int, transaction_id string, quantity_change long"),
        spark.createDataFrame(list(opening.items()), "product_id string, stock_quantity int"), rows_per_bucket=20,
    )
    level, want = dict(opening), set()
    for p, day, i, change in data:
        level[p] = max(0, level.get(p, 0) + change)
        want.add((i, level[p]))
    assert {(x.transaction_id, x.quantity_after) for x in got.collect()} == want


def test_sessions_order_no_event_and_a_busy_user_arrives_combined(spark):
    hot = [("hot", START + timedelta(seconds=k % 3000), "view", k) for k in range(4000)]
    data = hot + [("hot", START + timedelta(minutes=80), "click", 1), ("hot", None, "view", 2), ("hot", None, "x", 3), (None, START, "view", 4)]
    df = spark.createDataFrame(data, "customer_id string, event_time timestamp_ntz, event_type string, event_id int").repartition(4)
    got = signals.sessions(df)
    end = START + timedelta(seconds=2999)
    # The pause from the last view to the click is 30 minutes and a second.
    assert {tuple(x) for x in got.collect()} == {
        ("hot", 1, None, None, 2, 1, 0), ("hot", 2, START, end, 4000, 4000, 0),
        ("hot", 3, START + timedelta(minutes=80), START + timedelta(minutes=80), 1, 0, 1), (None, 1, START, START, 1, 1, 0),
    }
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert plan.index("partial_count") > plan.index("Window")  # counted before anything is ordered
    assert signals.sessions(df.limit(0)).collect() == []
    touching = spark.createDataFrame([("u", START + timedelta(minutes=30 * k), "view", k) for k in range(5)], df.schema)
    assert signals.sessions(touching).count() == 1 and signals.sessions(touching, "INTERVAL 0 SECONDS").count() == 5


@pytest.mark.parametrize("rows_per_bucket", [3, 25, 1_000_000])
def test_one_product_with_all_changes(spark, rows_per_bucket):
    rng = random.Random(rows_per_bucket)
    data = [("p", i // 2, f"{i:04d}", rng.choice([-9, -4, 3, 6, None])) for i in range(400)] + [(None, 1, "n", -3), (None, 2, "m", 5)]
    df = spark.createDataFrame(data, "product_id string, transaction_date int, transaction_id string, quantity_change int").repartition(5)
    got = {x.transaction_id: x.quantity_after for x in signals.running_stock(df, rows_per_bucket=rows_per_bucket).collect()}
    level, want = {}, {}
    for p, _, i, change in data:
        level[p] = max(0, level.get(p, 0) + (change or 0))
        want[i] = level[p]
    assert got == want
    back = ordered.floored(df, ["product_id"], [F.desc("transaction_date"), F.desc("transaction_id")], by="transaction_date", name="left",
                           change=F.col("quantity_change"), start=F.lit(7), rows_per_bucket=rows_per_bucket)
    level, want = {}, {}
    for p, _, i, change in sorted(data, key=lambda x: (x[1], x[2]), reverse=True):
        level[p] = max(0, level.get(p, 7) + (change or 0))
        want[i] = level[p]
    assert {x.transaction_id: x.left for x in back.collect()} == want


def test_windows_of_one_site_merge_across_borders(spark):
    one = [("s", START, START + timedelta(days=9))] + [("s", START + timedelta(hours=k), START + timedelta(hours=k, minutes=k % 90)) for k in range(300)]
    df = spark.createDataFrame(one + one[:5], "site_id string, window_start timestamp_ntz, window_end timestamp_ntz")
    for size in (4, 30, 1_000_000):
        assert {tuple(x) for x in signals.merged_windows(df, size).collect()} == {tuple(x) for x in signals.merged_windows(df, 10**6).collect()}
    assert signals.merged_windows(df, 4).agg(F.sum("windows_merged")).first()[0] == len(one) + 5
