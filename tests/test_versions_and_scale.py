"""Versions of views, pruned refreshes, many views in one sort, heavy keys, interval joins, moments, selection, matrices."""

import math
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import asof, metrics, prefix, sets, tiles
from millrace.operators.preprocess import OneHotEncoder, RobustScaler, SimpleImputer
from millrace.operators.tiles import Feature, TileSpec, build_tiles, tiled_features
from millrace.plans.models import Registry, estimator, grid, search, search_ridge
from millrace.plans.store import Entity, FeatureStore, FeatureView
from millrace.sources.catalog import ConcurrentChange, JsonCatalog
from millrace.sources.connector import DataConnector, key_filter
from millrace.streaming.stream import best_values, stream_lists

DAY = 86400


def rows_of(df):
    return sorted(map(str, df.collect()))


class Clock:
    def __init__(self):
        self.now = datetime(2024, 1, 10)

    def __call__(self):
        return self.now


@pytest.fixture
def clocked(spark, root):
    clock = Clock()
    return FeatureStore(spark, f"{root}/store", clock=clock, keep="2 days"), clock


# --- records and versions


def test_one_of_two_writers_loses(spark, root):
    catalog = JsonCatalog(spark, f"{root}/c")
    assert catalog.put("view", "A", {"x": 1}, expected=0) == 1
    _, seen = catalog.get_revision("view", "A")
    catalog.put("view", "A", {"x": 2}, expected=seen)
    with pytest.raises(ConcurrentChange):
        catalog.put("view", "A", {"x": 3}, expected=seen)
    assert not catalog._write("view", "A", 2, {"x": 4}) and catalog.get("view", "A") == {"x": 2}
    assert catalog.change("view", "A", lambda d: d | {"y": 1}) == {"x": 2, "y": 1} and catalog.names("view") == ["A"]
    for i in range(4):
        catalog.put("view", "A", {"x": i})
    assert len(catalog.children("view", "A")) <= 4 and catalog.get("view", "A") == {"x": 3}
    assert catalog.delete("view", "A") and catalog.get_revision("view", "A") == (None, 0) and catalog.names("view") == []


def test_readers_keep_their_version(spark, clocked):
    store, clock = clocked
    key, seen = store.register_entity(Entity("K", ("k",))), {"rows": spark.range(4).select(F.col("id").alias("k"), F.lit(0).alias("v"))}
    view = store.register_feature_view(FeatureView("A", [key], refresh_freq="1 day", compute=lambda s: seen["rows"]))
    first = store.read_feature_view(view)
    for v in (1, 2):
        seen["rows"] = spark.range(4 + v).select(F.col("id").alias("k"), F.lit(v).alias("v"))
        clock.now += timedelta(hours=1)
        store.refresh_feature_view(view)
    view = store.register_feature_view(FeatureView("A", [key], refresh_freq="1 day", compute=lambda s: spark.range(1).select(F.col("id").alias("k"), F.lit("new").alias("w"))), overwrite=True)
    assert first.count() == 4 and {r["v"] for r in first.collect()} == {0}
    assert store.read_feature_view(view, version=2).count() == 6 and store.read_feature_view(view).columns == ["k", "w"]
    assert [r["number"] for r in store.list_versions(view).orderBy("number").collect()] == [0, 1, 2, 3]
    clock.now += timedelta(days=3)
    store.refresh_feature_view(view)
    assert [r["number"] for r in store.list_versions(view).collect()] == [3, 4]
    with pytest.raises(ValueError, match="no version 0"):
        store.read_feature_view(view, version=0)
    clock.now += timedelta(hours=1)
    assert store.expire_versions(view, "1 minute") == [3] and store.read_feature_view(view).count() == 1
    assert len(store.catalog.children("..", "tables", "A$V1")) >= 1
    with pytest.raises(Exception):
        first.count()


def test_a_refresh_that_lost_leaves_nothing(spark, clocked):
    store, _ = clocked
    key = store.register_entity(Entity("K", ("k",)))
    once = {"change": True}

    def rows(s):
        if once.pop("change", None) is None:
            store.catalog.change("view", "A$V1", lambda d: d | {"desc": "meanwhile"})
        return s.range(3).select(F.col("id").alias("k"))

    view = store.register_feature_view(FeatureView("A", [key], refresh_freq="1 day", compute=lambda s: s.range(2).select(F.col("id").alias("k"))))
    before = store.catalog.children("..", "tables", "A$V1")
    view.compute = rows
    once.clear()
    with pytest.raises(ConcurrentChange):
        store.refresh_feature_view(view)
    assert store.catalog.children("..", "tables", "A$V1") == before and store.read_feature_view(view).count() == 2


def test_functions_are_kept_with_the_record(spark, root):
    store = FeatureStore(spark, f"{root}/s")
    key, n = store.register_entity(Entity("K", ("k",))), 5
    plain = spark.range(3).select(F.col("id").alias("k"))
    store.register_feature_view(FeatureView("P", [key], refresh_freq="1 day", compute=lambda s: s.range(n).selectExpr("id AS k")))
    store.register_feature_view(FeatureView("Q", [key], refresh_freq="1 day", compute=lambda s: plain))
    again = FeatureStore(spark, f"{root}/s")
    again.refresh_feature_view(again.get_feature_view("P", "V1"))
    assert again.read_feature_view(again.get_feature_view("P", "V1")).count() == 5
    with pytest.raises(ValueError, match="register the view again"):
        again.refresh_feature_view(again.get_feature_view("Q", "V1"))
    assert again.read_feature_view(again.get_feature_view("Q", "V1")).count() == 3


def test_current_values_without_a_time(spark, clocked):
    store, _ = clocked
    key = store.register_entity(Entity("K", ("k",)))
    rows = spark.createDataFrame([(1, datetime(2024, 1, d), d) for d in (1, 3, 2)] + [(2, datetime(2024, 1, 1), 9)], "k int, ts timestamp_ntz, v int")
    view = store.register_feature_view(FeatureView("A", [key], timestamp_col="ts", refresh_freq="1 day", compute=lambda s: rows))
    spine = spark.createDataFrame([(1,), (2,), (3,), (1,)], "k int")
    assert rows_of(store.retrieve_feature_values(spine, [view])) == rows_of(spark.createDataFrame([(1, 3), (2, 9), (3, None), (1, 3)], "k int, v int"))
    batches = store.register_feature_view(FeatureView("B", [key], timestamp_col="ts", refresh_freq="1 day", append_only=True, compute=lambda s: rows))
    with pytest.raises(ValueError, match="append-only"):
        store.retrieve_feature_values(spine, [batches])
    with pytest.raises(ValueError, match="both sides"):
        store.retrieve_feature_values(spine, [view, view])


# --- pruned refresh


def test_a_refresh_of_one_day_touches_that_day_only(spark, clocked, root):
    store, _ = clocked
    key = store.register_entity(Entity("K", ("k",)))
    rows = [(None if i % 7 == 0 else i % 5, datetime(2024, 1, 1) + timedelta(hours=i), i, float(i)) for i in range(24 * 6)] + [(1, None, 999, 1.0)]
    events = spark.createDataFrame(rows, "k int, ts timestamp_ntz, i int, v double").withColumn("day", F.to_date("ts"))
    late = (F.to_date("ts") == "2024-01-03") & (F.col("i") % 2 == 0)
    events.where(~late | F.col("ts").isNull()).write.partitionBy("day").parquet(f"{root}/src")
    read = lambda s: s.read.parquet(f"{root}/src")
    features = [Feature.sum("v", "24h").alias("s"), Feature.var("v", "24h").alias("w"), Feature.last_n("i", "24h", n=2).alias("l")]
    view = store.register_feature_view(FeatureView("A", [key], timestamp_col="ts", refresh_freq="1h", feature_granularity="1h", features=features, compute=read, cluster_by=["k"]))
    before, held = store.tables.snapshot("A$V1"), store.tiles(view)
    kept = rows_of(held)
    events.where(late).drop("day").write.mode("append").parquet(f"{root}/src/day=2024-01-03")
    changed = events.where(late)
    store.refresh_feature_view(view, changed=changed)
    after = store.tables.snapshot("A$V1")
    touched = str(int(datetime(2024, 1, 3).timestamp()) // DAY) if datetime(2024, 1, 3).astimezone().utcoffset() == timedelta(0) else str((datetime(2024, 1, 3) - datetime(1970, 1, 1)).days)
    assert set(before.parts) == set(after.parts) and {n for n in after.parts if after.parts[n] != before.parts[n]} == {touched}
    new = store.refreshed_tiles(view, before, changed, [int(touched)])
    assert {f.split("_range=")[1].split("/")[0] for f in new.inputFiles() if "_range=" in f} == {touched}
    assert re.search(r"ts#\d+ >= 2024-01-03 00:00:00\), \(ts#\d+ < 2024-01-04", new._jdf.queryExecution().executedPlan().toString())  # pushed to the files
    whole = build_tiles(read(spark), view.spec)
    pick = lambda t: t.select("k", "tile_start", F.round("_sum_v", 6), "_count_v", F.round("_spread_v", 6), F.sort_array("_last_n_i"))
    assert rows_of(pick(store.tiles(view))) == rows_of(pick(whole)) and rows_of(held) == kept
    nothing = changed.where("ts is null")
    store.refresh_feature_view(view, changed=nothing)
    assert store.tables.snapshot("A$V1").parts == after.parts
    one_day = store.tiles(view, int(touched) * DAY, (int(touched) + 1) * DAY)
    assert len({f.split("_range=")[1].split("/")[0] for f in one_day.inputFiles()}) == 1


def test_a_spine_reads_the_parts_it_needs(spark, clocked):
    store, _ = clocked
    key = store.register_entity(Entity("K", ("k",)))
    events = spark.createDataFrame([(i % 3, datetime(2024, 1, 1) + timedelta(hours=i), float(i)) for i in range(24 * 8)], "k int, ts timestamp_ntz, v double")
    view = store.register_feature_view(FeatureView("A", [key], timestamp_col="ts", refresh_freq="1h", feature_granularity="1h", features=[Feature.sum("v", "24h").alias("s")], compute=lambda s: events))
    spine = spark.createDataFrame([(k, datetime(2024, 1, 5, 12, 30)) for k in range(4)], "k int, at timestamp_ntz")
    out = store.retrieve_feature_values(spine, [view], "at")
    assert rows_of(out) == rows_of(tiled_features(events, spine, view.spec, "at"))
    assert len({f for f in out.inputFiles() if "_range=" in f}) and len({f.split("_range=")[1].split("/")[0] for f in out.inputFiles()}) == 2
    assert store.retrieve_feature_values(spine.limit(0), [view], "at").count() == 0


# --- as-of and interval joins


def random_sides(spark, seed):
    rng = np.random.default_rng(seed)
    stamp = lambda: datetime(2024, 1, 1) + timedelta(minutes=int(rng.integers(3000)))
    right = spark.createDataFrame([(1 if i % 3 else int(rng.integers(2, 6)), stamp(), float(i) if i % 9 else None) for i in range(300)] + [(None, stamp(), 0.0), (1, None, 5.0)], "k int, t timestamp_ntz, v double")
    left = spark.createDataFrame([(int(rng.integers(7)), stamp(), i) for i in range(200)] + [(None, stamp(), -1), (1, None, -2)], "k int, at timestamp_ntz, i int")
    return left.persist(), right.persist()


@pytest.mark.parametrize("strict", [False, True])
def test_heavy_keys_are_split_alone(spark, monkeypatch, strict):
    left, right = random_sides(spark, 3)
    want = rows_of(asof.asof_join(left, right, ["k"], "at", "t", ["v"], strict=strict))
    monkeypatch.setattr(asof, "PART_ROWS", 20)
    monkeypatch.setattr(asof, "COUNTED_BYTES", 0)
    out = asof.asof_join(left, right, ["k"], "at", "t", ["v"], strict=strict)
    assert rows_of(out) == want and "_part" in out._jdf.queryExecution().optimizedPlan().toString()
    t = right.where("t is not null").select("k", F.unix_micros(F.col("t").cast("timestamp")).alias("o"), "v").dropDuplicates(["k", "o"]).persist()
    columns = {"s": (F.sum, F.col("v").cast("decimal(20,2)")), "lo": (F.min, F.col("v")), "hi": (F.max, F.col("v"))}
    split = rows_of(asof.running_by_key(t, ["k"], "o", columns))
    monkeypatch.setattr(asof, "PART_ROWS", 1 << 20)
    assert split == rows_of(asof.running_by_key(t, ["k"], "o", columns))


def test_many_views_share_one_exchange(spark):
    left, right = random_sides(spark, 4)
    rights = [(right.where(F.col("v") % 10 == i), "t", ["v"], f"p{i}_") for i in range(10)]
    out = asof.asof_join_many(left, rights, ["k"], "at")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window [") == 1
    one = left
    for rows, ts, columns, p in rights[:2]:
        one = asof.asof_join(one, rows, ["k"], "at", ts, columns, p)
    assert rows_of(out.select(*one.columns)) == rows_of(one)


def test_interval_join(spark):
    rng = np.random.default_rng(9)
    stamp = lambda: datetime(2024, 1, 1) + timedelta(minutes=int(rng.integers(500)))
    for crossing in (False, True):
        rules = []
        for k in (1, 2, 3):
            ends = sorted({stamp() for _ in range(30)})
            rules += [(k, a, b, f"{k}{i}") for i, (a, b) in enumerate(zip(ends, [*ends[1:], None])) if i % 5]
        if crossing:
            rules += [(int(rng.integers(1, 4)), *sorted((stamp(), stamp())), f"x{i}") for i in range(60)] + [(2, stamp(), None, f"o{i}") for i in range(5)]
        rules += [(None, stamp(), None, "null"), (1, None, None, "never"), (2, datetime(2024, 1, 3), datetime(2024, 1, 2), "empty")]
        facts = [(int(rng.integers(1, 5)), stamp(), i) for i in range(200)] + [(1, rules[0][1], 900), (1, rules[0][2], 901), (None, stamp(), 902), (1, None, 903)]
        want = sorted((i, name) for k, at, i in facts for j, a, b, name in rules if k is not None and at is not None and k == j and a is not None and a <= at and (b is None or at < b))
        f = spark.createDataFrame(facts, "k int, at timestamp_ntz, i int")
        m = spark.createDataFrame(rules, "k int, a timestamp_ntz, b timestamp_ntz, name string")
        out = asof.validity_join(f, m, ["k"], "at", "a", "b")
        assert out.columns == ["k", "at", "i", "a", "b", "name"]
        assert sorted((r["i"], r["name"]) for r in out.collect()) == want
        assert ("Join" in out._jdf.queryExecution().optimizedPlan().toString()) == crossing


def test_interval_join_of_one_long_key(spark):
    n = 100_000
    facts = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 3 + 1).alias("at"))
    rules = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 3).alias("a"), (F.col("id") * 3 + 2).alias("b"), F.col("id").alias("name"))
    assert asof.validity_join(facts, rules, ["k"], "at", "a", "b").where("name * 3 + 1 = at").count() == n


# --- tiles


def test_variance_at_large_means(spark):
    rng = np.random.default_rng(1)
    values = [(1 + i % 2, datetime(2024, 1, 1) + timedelta(minutes=30 * i), 1e8 + float(rng.normal()) * 0.08, f"s{i % 3}") for i in range(300)]
    events = spark.createDataFrame(values, "k int, ts timestamp_ntz, v double, s string")
    spine = spark.createDataFrame([(1, datetime(2024, 1, 6, 12)), (2, datetime(2024, 1, 4))], "k int, at timestamp_ntz")
    for window, seconds in (("48h", 48 * 3600), ("lifetime", 10**9)):
        spec = TileSpec(("k",), "ts", "1h", (Feature.var("v", window).alias("w"), Feature.stddev("v", window).alias("d")))
        for r in tiled_features(events, spine, spec, "at").collect():
            inside = [v for k, t, v, _ in values if k == r["k"] and timedelta(0) < r["at"] - t <= timedelta(seconds=seconds)]
            assert r["w"] == pytest.approx(np.var(inside), rel=1e-9) and r["d"] == pytest.approx(np.std(inside), rel=1e-9)
    spec = TileSpec(("k",), "ts", "1h", (Feature.var("v", "48h").alias("w"),), "s")
    for r in tiled_features(events, spine, spec, "at").collect():
        for s, w in zip(r["secondary_keys"], r["w"]):
            assert w == pytest.approx(np.var([v for k, t, v, x in values if k == r["k"] and x == s and timedelta(0) < r["at"] - t <= timedelta(hours=48)]), rel=1e-9)
    spec = TileSpec(("k",), "ts", "1h", (Feature.var("v", "48h"),))
    rolled = tiles.rollup_tiles(build_tiles(events, spec), spark.createDataFrame([(1, "g"), (2, "g")], "k int, grp string"), spec, ["grp"])
    for r in rolled.collect():
        inside = [v for _, t, v, _ in values if (t - datetime(1970, 1, 1)).total_seconds() // 3600 * 3600 == r["tile_start"]]
        assert r["_spread_v"] == pytest.approx(np.var(inside) * len(inside), rel=1e-8, abs=1e-12)


@pytest.mark.parametrize("window", ["63h", "64h"])
def test_sums_near_the_largest_number(spark, window):
    big = 5 * 10**18
    events = spark.createDataFrame([(1, datetime(2024, 1, 1, h), big) for h in range(4)] + [(1, datetime(2024, 1, 20), 7)], "k int, ts timestamp_ntz, v long")
    spine = spark.createDataFrame([(1, datetime(2024, 1, 20, 5)), (1, datetime(2024, 1, 10))], "k int, at timestamp_ntz")
    spec = TileSpec(("k",), "ts", "1h", (Feature.sum("v", window).alias("s"), Feature.avg("v", window).alias("a")))
    assert rows_of(tiled_features(events, spine, spec, "at").select("s", "a")) == ["Row(s=0, a=None)", "Row(s=7, a=7.0)"]


def test_all_secondary_keys_through_the_store(spark, clocked):
    store, _ = clocked
    key = store.register_entity(Entity("K", ("k",)))
    events = spark.createDataFrame([(1, datetime(2024, 1, 9, 1), 1.0, i) for i in range(12)], "k int, ts timestamp_ntz, v double, s int")
    view = lambda most: FeatureView("A", [key], timestamp_col="ts", refresh_freq="1h", feature_granularity="1h", features=[Feature.sum("v", "240h").alias("x")], aggregation_secondary_key="s", most_secondary=most, version=f"V{most}", compute=lambda s: events)
    assert [len(store.read_feature_view(store.register_feature_view(view(n))).first()["x"]) for n in (5, None)] == [5, 12]
    assert store.get_feature_view("A", "VNone").spec.most_secondary is None


def test_best_values():
    items = [(3, "a"), (1, "b"), (3, "b"), (2, "a"), (3, "c")]
    assert best_values(items, True, False, 2) == [(3, "c"), (3, "b")] and best_values(items, False, False, 2) == [(1, "b"), (2, "a")]
    assert best_values(items, True, True, 5) == [(3, "c"), (3, "b"), (3, "a")] and best_values(items, False, True, 2) == [(1, "b"), (2, "a")]


def test_lists_on_a_stream_with_late_events(spark, root):
    start, spec = datetime(2024, 1, 1), TileSpec(("k",), "ts", "1h", (Feature.last_n("v", "2h", n=2), Feature.first_distinct_n("v", "2h", n=2)))
    batches = [[(1, 5, "a"), (1, 10, "b"), (2, 50, "c")], [(1, 7, "x"), (1, 70, "d"), (1, 3, "b"), (1, None, "n")], [(2, 400, "z"), (1, 8, None)], [(1, 9, "late")], [(2, 410, "y")]]
    frame = lambda rows: spark.createDataFrame([(k, None if m is None else start + timedelta(minutes=m), v) for k, m, v in rows], "k int, ts timestamp_ntz, v string")
    for rows in batches:
        frame(rows).coalesce(1).write.mode("append").parquet(f"{root}/in")
    found = {}
    stream = spark.readStream.schema(frame([]).schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    write = lambda df, n: [found.__setitem__((r["k"], r["tile_start"]), r) for r in df.collect()]
    stream_lists(stream, spec, "2 hours").writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    in_time = build_tiles(frame([r for i, rows in enumerate(batches) if i != 3 for r in rows]), spec).collect()  # the fourth batch comes after the watermark has passed
    key = lambda x: [(i["at"], i["value"]) for i in x or []]
    assert {(r["k"], r["tile_start"]): (sorted(key(r["_last_n_v"])), sorted(key(r["_first_distinct_n_v"]))) for r in in_time} == {k: (sorted(key(r["_last_n_v"])), sorted(key(r["_first_distinct_n_v"]))) for k, r in found.items()}


def test_lists_of_many_keys_take_few_calls(spark, root):
    from millrace.streaming import stream as module

    big, start = 2**53 + 1, datetime(2024, 1, 1)  # no float holds it
    rows = [(k if k else None, start + timedelta(seconds=k), None if k % 3 else big + k) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz, v long")
    df.write.parquet(f"{root}/in")
    spec, found = TileSpec(("k",), "ts", "1h", (Feature.last_n("v", "2h", n=2),)), {}
    stream = stream_lists(spark.readStream.schema(df.schema).parquet(f"{root}/in"), spec)
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(lambda b, n: [found.__setitem__((r["k"], r["tile_start"]), r["_last_n_v"]) for r in b.collect()]).start()
    query.awaitTermination()
    assert {(r["k"], r["tile_start"]): r["_last_n_v"] for r in build_tiles(df, spec).collect()} == found and len(found) == 500
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= module.BUCKETS


# --- selection, matrices, search, batches


def test_quantiles_of_many_columns(spark):
    rng = np.random.default_rng(2)
    columns = {"a": rng.normal(size=501), "b": np.round(rng.normal(size=501), 1), "c": np.full(501, -0.0), "d": rng.normal(size=501) * 10.0 ** rng.integers(-300, 300, 501), "e": np.where(np.arange(501) % 2, np.inf, -np.inf)}
    rows = [tuple(None if (i + j) % 11 == 0 else float(c[i]) for j, c in enumerate(columns.values())) + (None,) for i in range(501)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns) + ", f double")
    at = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = prefix.exact_quantiles_of(df, df.columns, at)
    for j, found in enumerate(got[:4]):
        values = [r[j] for r in rows if r[j] is not None]
        assert found == pytest.approx(list(np.quantile(values, at)), rel=1e-12, abs=1e-300)
    assert got[4][0] == -math.inf and got[4][-1] == math.inf and got[5] == [None] * 5
    assert prefix.exact_quantiles_of(df.limit(0), ["a"], [0.5]) == [[None]]
    assert math.isnan(prefix.exact_quantiles(spark.createDataFrame([(1.0,), (math.nan,)], "x double"), "x", [1.0])[0])
    assert prefix.modes(df.select(F.lit("x").alias("s"), "c", F.lit(None).cast("string").alias("n")), ["c", "s", "n"]) == [0.0, "x", None]


def test_fifty_columns_take_five_scans(spark):
    df = spark.range(200).select(*[(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(50)])
    tracker, before = spark.sparkContext.statusTracker(), set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    state = RobustScaler(df.columns).fit(df).state
    jobs = set(tracker.getJobIdsForGroup(None)) - before
    assert state["median"] == [99.5 * (i + 1) for i in range(50)] and len(jobs) <= 10  # two for each scan: its map side and its sums
    assert SimpleImputer(["c1", "c2"], strategy="median").fit(df).state["fill"] == [199.0, 298.5]


def test_correlation_of_many_columns(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 150)) + 1e7
    df = spark.createDataFrame(x.tolist(), ", ".join(f"c{i} double" for i in range(150))).repartition(5)
    assert np.allclose(metrics.correlation(df, df.columns), np.corrcoef(x.T), atol=1e-9)
    assert np.allclose(metrics.covariance(df, df.columns[:3], ddof=0), np.cov(x[:, :3].T, ddof=0), rtol=1e-8)
    monkeypatch.setattr(metrics, "BATCH_VALUES", 300)
    holes = df.select(F.when(F.rand(1) > 0.1, F.col("c0")).alias("c0"), "c1", F.when(F.col("c2") > 0, math.nan).alias("c2"), "c3")
    m = metrics.correlation(holes, ["c0", "c1", "c2", "c3"])
    assert np.isnan(m[[0, 2]]).all() and np.isnan(m[:, [0, 2]]).all() and m[1, 3] == pytest.approx(np.corrcoef(x[:, 1], x[:, 3])[0, 1])
    assert np.isnan(metrics.correlation(df.limit(0), ["c0", "c1"])).all()


def test_ridge_search_equals_fits(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, x), float(3 * x[0] - x[1] + rng.normal())) for i, x in enumerate(rng.normal(size=(200, 3)))]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, y double").persist()
    alphas = [0.1, 50.0, 1000.0]
    best, fast = search_ridge(df, ["a", "b", "c"], "y", alphas, folds=2, key=["i"])
    slow_best, slow = search(df, grid({"alpha": alphas}), lambda p: estimator("Ridge", ["a", "b", "c"], ["y"], **p), folds=2, key=["i"])
    assert best["index"] == slow_best["index"]
    assert [r["scores"] for r in fast] == [pytest.approx(r["scores"], abs=1e-6) for r in slow]
    with pytest.raises(ValueError, match="nulls"):
        search_ridge(df.withColumn("a", F.lit(None).cast("double")), ["a"], "y", alphas)


def test_epochs_by_partitions_and_buffer(spark, root):
    spark.range(1000).repartition(8).write.parquet(f"{root}/r")
    c = DataConnector(spark.read.parquet(f"{root}/r").select("id", (F.col("id") * 2).alias("x")))
    epoch = lambda **o: [i for b in c.to_batches(64, shuffle=True, buffer_rows=100, **o) for i in b.column(0).to_pylist()]
    one, two = epoch(), epoch()
    assert sorted(one) == sorted(two) == list(range(1000)) and one != two and epoch(seed=3) == epoch(seed=3)
    assert [b.num_rows for b in c.to_batches(64, shuffle=True, drop_last_batch=True)] == [64] * 15


def test_equal_rows_are_fitted_once_with_weights(spark, monkeypatch):
    from millrace.plans import models

    df = spark.range(4000).select((F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 4).cast("double").alias("b"), (F.pmod(F.xxhash64("id"), F.lit(10)) < F.col("id") % 5 + 3).cast("double").alias("y")).cache()
    fitted_on, assembled = [], models.Estimator._assembled
    monkeypatch.setattr(models.Estimator, "_assembled", lambda self, d: (fitted_on.append(d.count()), assembled(self, d))[1])
    families = {"LogisticRegression": {}, "DecisionTreeClassifier": {}, "GradientBoostingRegressor": {"maxIter": 2, "seed": 1}}
    guesses = lambda e: [r[0] for r in e.predict(df.select("a", "b").distinct()).orderBy("a", "b").select("guess").collect()]
    for name, params in families.items():
        made = lambda: estimator(name, ["a", "b"], ["y"], ["guess"], **params)  # noqa: B023, E731
        fitted_on.clear()
        fast = guesses(made().fit(df))
        assert fitted_on[0] <= 40, name
        with monkeypatch.context() as m:
            m.setattr(models, "REPEATED", 10**6)
            assert fast == pytest.approx(guesses(made().fit(df)), abs=1e-3), name
    for name in ("LinearSVC", "HuberRegressor", "RandomForestRegressor", "Ridge"):
        fitted_on.clear()
        estimator(name, ["a", "b"], ["y"]).fit(df)
        assert fitted_on[0] == 4000, name
    df.unpersist()


def test_batches_on_executors(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "ids": [b.column(0).to_pylist()]})

    c = DataConnector(spark.range(1003, numPartitions=7).select("id", (F.col("id") * 2).alias("x")))
    for shuffle in (False, True):
        got = c.over_batches(sizes, "n long, ids array<long>", 64, shuffle=shuffle).collect()
        assert sorted(r["n"] for r in got) == [1003 % 64] + [64] * 15
        assert sorted(i for r in got for i in r["ids"]) == list(range(1003))
    assert [r["n"] for r in c.over_batches(sizes, "n long, ids array<long>", 64, drop_last_batch=True).collect()] == [64] * 15
    assert [r["n"] for r in DataConnector(c.df.limit(0)).over_batches(sizes, "n long, ids array<long>", 64).collect()] == []
    assert [r["n"] for r in c.over_batches(sizes, "n long, ids array<long>", 5000).collect()] == [1003]


def test_small_answers(spark, root):
    df = spark.createDataFrame([("",), (None,), ("a",)], "c string")
    out = OneHotEncoder(["c"], ["o"], sparse=True).fit(df).transform(df).collect()
    assert sorted(str(dict(sorted(r["o"].items()))) for r in out) == ["{'0': 1, 'array_length': 3}", "{'1': 1, 'array_length': 3}", "{'2': 1, 'array_length': 3}"]
    names = spark.createDataFrame([("None", 1), (None, 2), ("x", 3)], "k string, v int")
    assert [r["v"] for r in key_filter(names, ["k"], [[None]]).collect()] == [2] and [r["v"] for r in key_filter(names, ["k"], [["None"]]).collect()] == [1]
    both = sets.distinct_union([(names, "k"), (df, "c")], "z")
    assert sorted(str(r["z"]) for r in both.collect()) == ["", "None", "None", "a", "x"]
    assert [r["k"] for r in sets.values_except(names, df, "k", "c").orderBy("k").collect()] == ["None", "x"]
    sets.check_known(df, both, "c", "z")
    with pytest.raises(ValueError, match="unknown"):
        sets.check_known(names, df, "k", "c")
    assert Registry(spark, f"{root}/m").models() == []


def test_schema_change_monitors_artifacts_ids(spark, clocked, root):
    from millrace.operators.windows import with_content_id
    from millrace.plans.models import Experiments, Monitors

    store, _ = clocked
    key = store.register_entity(Entity("K", ("k",)))
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1), 2.0)], "k int, ts timestamp_ntz, v double")
    store.register_feature_view(FeatureView("A", [key], timestamp_col="ts", refresh_freq="1 day", append_only=True, compute=lambda s: rows))
    with pytest.raises(ValueError, match="at the end"):
        store.update_feature_view("A", "V1", compute=lambda s: rows.drop("v"))
    assert store.read_feature_view(store.get_feature_view("A", "V1")).columns == ["k", "ts", "v"]
    view = store.update_feature_view("A", "V1", compute=lambda s: rows.withColumn("w", F.lit("x")))
    assert [r["w"] for r in store.read_feature_view(view).collect()] == [None]
    store.refresh_feature_view(view)
    assert sorted(str(r["w"]) for r in store.read_feature_view(view).collect()) == ["None", "x"]
    store.register_feature_view(FeatureView("B", [key], refresh_freq="1 day", compute=lambda s: rows))
    with pytest.raises(ValueError, match="append-only"):
        store.update_feature_view("B", "V1", query="SELECT 1")
    monitors, base = Monitors(spark, f"{root}/m"), spark.createDataFrame([(1, datetime(2024, 1, 1), 2.0, p) for p in (0.0, 1.0)], "k int, ts timestamp_ntz, v double, p double")
    monitors.register("m", base, "ts", ["k"], ["p"], ["v"])
    with pytest.raises(ConcurrentChange):
        monitors.register("m", base, "ts", ["k"], ["p"])
    assert monitors.names() == ["m"] and monitors.drift("m", base) == {"p": 0.0, "v": 0.0} and monitors.drift("m", base.where("p > 0"))["p"] > 0
    assert monitors.metrics("m", base, {"n": F.count("*")}).collect()[0]["n"] == 2
    monitors.delete("m")
    with pytest.raises(ValueError, match="no monitor"):
        monitors.drift("m", base)
    runs = Experiments(spark, f"{root}/runs")
    runs.log_artifact("r", "a", b"1")
    runs.log_artifact("r", "a", b"2")
    assert [bytes(r["content"]) for r in runs.artifacts("r").collect()] == [b"2"] and runs.artifacts("x").count() == 0
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "i int, s string")
    ids = [{r["row_id"] for r in with_content_id(d).collect()} for d in (df, df.repartition(3))]
    assert len(ids[0]) == 3 and ids[0] == ids[1]


def test_content_ids_of_many_equal_rows(spark):
    from millrace.operators import windows

    n = 3 * windows.STRETCH + 5
    df = spark.range(n, numPartitions=4).select(F.lit(1).alias("a"), F.lit(None).cast("int").alias("b"), F.lit(0.0).alias("x"))
    rare = spark.createDataFrame([(None, 1, 0.0), (1, None, -0.0), (None, None, None), (2, 3, math.nan)], "a int, b int, x double")  # the first two share a hash with the many
    out = windows.with_content_id(df.union(rare)).cache()
    assert out.agg(F.count("*"), F.count_distinct("row_id")).first() == (n + 4, n + 4)
    assert out.where("a = 1").count() == n + 1 and [str(r["x"]) for r in out.where("cast(x as string) = '-0.0'").collect()] == ["-0.0"]
    shares = [len(p) for p in out.where("x = 0").select("a").rdd.glom().collect()]
    assert max(shares) < n  # not all in one task
    again = windows.with_content_id(df.union(rare).repartition(3))
    assert out.select("row_id").exceptAll(again.select("row_id")).count() == 0
    out.unpersist()


def test_sinks_of_frameworks(spark, monkeypatch):
    """The sinks through stand-ins for the frameworks, which are not installed."""
    import sys
    import types

    torch, tf, datasets = (types.ModuleType(n) for n in ("torch", "tensorflow", "datasets"))
    torch.utils = types.SimpleNamespace(data=types.SimpleNamespace(IterableDataset=object))
    tf.TensorSpec, tf.as_dtype = lambda shape, dtype: (shape, dtype), lambda d: np.dtype(d).name
    tf.data = types.SimpleNamespace(Dataset=types.SimpleNamespace(from_generator=lambda make, output_signature: (list(make()), output_signature)))
    datasets.Dataset = types.SimpleNamespace(from_spark=lambda df: df.count())
    for m in (torch, tf, datasets):
        monkeypatch.setitem(sys.modules, m.__name__, m)
    c = DataConnector(spark.range(25).select("id", (F.col("id") * 0.5).alias("x")))
    batches = list(c.to_torch_dataset(10))
    assert [len(b["id"]) for b in batches] == [10, 10, 5] and batches[0]["x"][2] == 1.0
    assert sorted(i for b in c.to_torch_dataset(10, shuffle=True, drop_last_batch=True) for i in b["id"])[:1] != [] and len(list(c.to_torch_dataset(10, drop_last_batch=True))) == 2
    rows, signature = c.to_tf_dataset(10)
    assert [len(r["x"]) for r in rows] == [10, 10, 5] and signature == {"id": ((None,), "int64"), "x": ((None,), "float64")}
    assert c.to_huggingface_dataset() == 25 and c.to_huggingface_dataset(limit=3) == 3
