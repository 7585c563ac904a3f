from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions.intervals import LIFETIME, from_seconds, parse_interval, seconds_of, slice_start
from millrace.operators.asof import asof_join
from millrace.operators.tiles import Feature, TileSpec, build_tiles, continuous_features, merge_tiles, rollup_tiles

#: Events and, in the tests below, results that the surveyed feature store is tested with.
EVENTS = [
    (1, "00:30", 10.0, "page_a", "cat1", "ad_a"), (1, "00:45", 20.0, "page_b", "cat2", "ad_b"), (1, "01:15", 30.0, "page_c", "cat1", "ad_a"), (1, "01:45", 40.0, "page_d", "cat3", "ad_c"), (1, "02:30", 50.0, "page_e", "cat2", "ad_b"),
    (2, "01:00", 100.0, "page_x", "cat1", "ad_a"), (2, "02:00", 200.0, "page_y", "cat2", "ad_a"), (2, "03:00", 300.0, "page_z", "cat1", "ad_b"),
]


def at(text, day="2024-01-01"):
    return datetime.fromisoformat(f"{day} {text}")


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame([(u, at(t), a, p, c, ad) for u, t, a, p, c, ad in EVENTS], "user_id int, ts timestamp_ntz, amount double, page_id string, category string, ad_id string").cache()


def spine(spark, *rows):
    return spark.createDataFrame([(u, t) for u, t in rows], "user_id int, at timestamp_ntz")


def merged(spark, events, features, rows, granularity="1h", **options):
    spec = TileSpec(("user_id",), "ts", granularity, tuple(features), options.pop("secondary", None))
    out = merge_tiles(spine(spark, *rows), build_tiles(events, spec), spec, "at", **options)
    return {(r["user_id"], r["at"]): r for r in out.collect()}


def test_intervals():
    assert [parse_interval(x) for x in ("90s", "2h", "3 days", "1 MIN")] == [90, 7200, 259200, 60]
    assert parse_interval("lifetime") == LIFETIME
    for bad in ("1 month", "h", "", "2w", "-1h"):
        with pytest.raises(ValueError):
            parse_interval(bad)


def test_slices_of_times_before_and_after_1970(spark):
    day, least = datetime(1970, 1, 1), timedelta(microseconds=1)
    times = [day + k * timedelta(hours=7) + j * least for k in (-9 * 10**5, -3, -1, 0, 1, 10**6) for j in (-1, 0, 1)] + [datetime(1, 1, 1), datetime(9999, 12, 31, 23, 59, 59, 999999), datetime(2300, 1, 1) - least]
    widths = (1, 7 * 3600, 86400)
    rows = spark.createDataFrame([(t,) for t in [*times, None]], "t timestamp_ntz").select("t", seconds_of(F.col("t")), *[slice_start(F.col("t"), w) for w in widths]).collect()
    for t, *got in rows:
        s = None if t is None else (t - day) // timedelta(seconds=1)
        assert got == [s] + [None if s is None else s // w * w for w in widths]
    # a slice names its time once, so slices of slices don't double what is computed for each row
    plan = spark.createDataFrame([], "time_column timestamp_ntz").select(slice_start(from_seconds(slice_start(F.col("time_column"), 86400)), 3600).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.splitlines()[0].count("time_column") == 1


def test_sum_over_two_hours(spark, events):
    r = merged(spark, events, [Feature.sum("amount", "2h").alias("s"), Feature.count("amount", "2h").alias("n"), Feature.avg("amount", "2h").alias("a")], [(1, at("03:00")), (1, at("12:00")), (9, at("03:00"))])
    assert r[1, at("03:00")][2:] == (120.0, 3, 40.0)
    assert r[1, at("12:00")][2:] == (0.0, 0, None)
    assert r[9, at("03:00")][2:] == (0.0, 0, None)


def test_offset(spark, events):
    r = merged(spark, events, [Feature.sum("amount", "2h").alias("now"), Feature.sum("amount", "2h", "1h").alias("before")], [(1, at("04:00"))])
    assert r[1, at("04:00")][2:] == (50.0, 120.0)


def test_incomplete_tile_does_not_count(spark, events):
    r = merged(spark, events, [Feature.count("amount", "1h").alias("n")], [(1, at("02:45"))])
    assert r[1, at("02:45")]["n"] == 2  # B = 02:00


def test_lists(spark, events):
    r = merged(spark, events, [Feature.last_n("page_id", "3h", n=5).alias("last"), Feature.first_n("page_id", "3h", n=2).alias("first"), Feature.last_distinct_n("category", "3h", n=3).alias("ld"), Feature.first_distinct_n("category", "3h", n=2).alias("fd")], [(1, at("03:00")), (2, at("03:00"))])
    assert r[1, at("03:00")][2:] == (["page_a", "page_b", "page_c", "page_d", "page_e"], ["page_a", "page_b"], ["cat1", "cat3", "cat2"], ["cat1", "cat2"])
    assert r[2, at("03:00")]["ld"] == ["cat1", "cat2"]


def test_lifetime(spark):
    rows = [(1, at("10:00", f"2024-01-0{d}"), 10.0 * d) for d in range(1, 6)]
    events = spark.createDataFrame(rows, "user_id int, ts timestamp_ntz, amount double")
    r = merged(spark, events, [Feature.sum("amount", "lifetime").alias("s"), Feature.stddev("amount", "lifetime").alias("sd")], [(1, at("00:00", f"2024-01-0{d}")) for d in (1, 2, 4, 6)], "1d")
    assert [r[1, at("00:00", f"2024-01-0{d}")]["s"] for d in (1, 2, 4, 6)] == [None, 10.0, 60.0, 150.0]


def test_secondary_keys(spark, events):
    r = merged(spark, events, [Feature.sum("amount", "2h").alias("s"), Feature.count("amount", "2h").alias("n")], [(1, at("03:00")), (2, at("04:00")), (3, at("04:00"))], secondary="ad_id")
    assert r[2, at("04:00")][2:] == (["ad_a", "ad_b"], [200.0, 300.0], [1, 1])
    assert r[3, at("04:00")][2:] == ([], [], [])
    nulls = events.withColumn("amount", F.when(F.col("ad_id") != "ad_a", F.col("amount")))
    r = merged(spark, nulls, [Feature.sum("amount", "4h").alias("s"), Feature.count("amount", "4h").alias("n")], [(1, at("04:00"))], secondary="ad_id")
    assert r[1, at("04:00")][2:] == (["ad_a", "ad_b", "ad_c"], [None, 70.0, 40.0], [0, 2, 1])


def test_sketches(spark, events):
    r = merged(spark, events, [Feature.approx_count_distinct("category", "3h").alias("n"), Feature.approx_percentile("amount", "3h", percentile=0.5).alias("p")], [(1, at("03:00")), (5, at("03:00"))])
    assert r[1, at("03:00")]["n"] == 3 and r[1, at("03:00")]["p"] == 30.0
    assert r[5, at("03:00")]["n"] == 0 and r[5, at("03:00")]["p"] is None


def test_rollup_order_and_validity(spark, events):
    spec = TileSpec(("user_id",), "ts", "1h", (Feature.last_n("amount", "3h", n=5), Feature.sum("amount", "3h")))
    mapping = spark.createDataFrame([(1, "s"), (2, "s"), (1, None)], "user_id int, sub string")
    rolled = rollup_tiles(build_tiles(events, spec), mapping, spec, ["sub"])
    out = merge_tiles(spark.createDataFrame([("s", at("03:00"))], "sub string, at timestamp_ntz"), rolled, TileSpec(("sub",), "ts", "1h", spec.features), "at").first()
    assert out[2] == [100.0, 30.0, 40.0, 200.0, 50.0] and out[3] == 450.0
    dated = spark.createDataFrame([(1, "x", at("00:00"), at("01:00")), (1, "y", at("01:00"), None)], "user_id int, sub string, f timestamp_ntz, t timestamp_ntz")
    sums = {r["sub"]: r["n"] for r in rollup_tiles(build_tiles(events, spec), dated, spec, ["sub"], "f", "t").groupBy("sub").agg(F.sum("_sum_amount").alias("n")).collect()}
    assert sums == {"x": 30.0, "y": 120.0}


def test_continuous(spark, events):
    spec = TileSpec(("user_id",), "ts", "1m", (Feature.sum("amount", "30m").alias("s"),), continuous=True)
    out = {r["at"]: r["s"] for r in continuous_features(events, spine(spark, (1, at("00:45")), (1, at("01:20")), (1, at("09:00"))), spec, "at").collect()}
    assert out == {at("00:45"): 30.0, at("01:20"): 30.0, at("09:00"): 0.0}


def test_validation():
    for bad in (lambda: Feature.last_n("a", "1h", n=101), lambda: Feature.last_n("a", "lifetime", n=1), lambda: Feature("median", "a", "1h"), lambda: TileSpec(("k",), "ts", "1h", (Feature.sum("a", "90m"),)), lambda: TileSpec(("k",), "ts", "30s", ()), lambda: TileSpec(("k",), "ts", "1h", (Feature.sum("a", "1h"), Feature.sum("a", "1h")))):
        with pytest.raises(ValueError):
            bad()


def test_asof(spark):
    left = spark.createDataFrame([("a", 5), ("a", 5), ("a", 1), ("b", 9), (None, 5), ("a", None)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x", 1), ("a", 5, None, 2), ("a", 7, "z", 3), (None, 1, "n", 4)], "k string, rt int, v string, w int")
    plain = sorted(asof_join(left, right, ["k"], "t", "rt", ["v", "w"]).collect(), key=str)
    assert plain == sorted([("a", 5, None, 2), ("a", 5, None, 2), ("a", 1, None, None), ("b", 9, None, None), (None, 5, None, None), ("a", None, None, None)], key=str)
    strict = {(r["k"], r["t"]): r["w"] for r in asof_join(left, right, ["k"], "t", "rt", ["w"], strict=True).collect()}
    assert strict["a", 5] == 1
    filled = {(r["k"], r["t"]): (r["v"], r["w"]) for r in asof_join(left, right, ["k"], "t", "rt", ["v", "w"], per_column=True).collect()}
    assert filled["a", 5] == ("x", 2)
    with pytest.raises(ValueError):
        asof_join(left.withColumn("v", F.lit(1)), right, ["k"], "t", "rt", ["v"])


@pytest.mark.parametrize("strict", [False, True])
def test_asof_spread_over_time(spark, strict):
    import random

    rng = random.Random(5)
    left = spark.createDataFrame([(i, rng.choice(["hot", "hot", "b", None]), rng.choice([None, *range(60)])) for i in range(300)], "id int, k string, t int")
    right = spark.createDataFrame([(rng.choice(["hot", "b", None]), rng.choice([None, *range(0, 60, 3)]), rng.choice([None, i])) for i in range(120)], "k string, rt int, v int")
    plain = asof_join(left, right, ["k"], "t", "rt", ["v"], prefix="p_", strict=strict)
    spread = asof_join(left, right, ["k"], "t", "rt", ["v"], prefix="p_", strict=strict, spread=7)
    assert spread.columns == plain.columns
    assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))
