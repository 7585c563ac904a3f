"""Edges that the queries' tables do not reach: parts, nulls, ties, failures, empty tables."""

import math
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import metrics, prefix, preprocess
from millrace.operators.prefix import exact_quantiles, mode, ordered_index, running_sums, with_next
from millrace.operators.tiles import Feature, TileSpec, build_tiles, continuous_features, tiled_features
from millrace.operators.windows import over_time, top_n
from millrace.plans.models import CustomModel, Estimator, Registry, check_monitor_source, check_result, column_or_literal, estimator, infer_signature, inference_api, partitioned_api
from millrace.plans.store import Entity, FeatureStore, FeatureView, check_compute, realtime_features
from millrace.sources.connector import DataConnector, shard
from millrace.sources.dataset import synthetic_rows
from millrace.streaming.stream import refresh_tiles, stream_tiles


@pytest.fixture
def numbers(spark):
    rng = np.random.default_rng(1)
    values = [float(v) for v in rng.integers(0, 400, 3000)] + [None] * 20
    return spark.createDataFrame([(i, v, f"name{int(v or 0):04d}") for i, v in enumerate(values)], "id long, x double, s string").repartition(5), [v for v in values if v is not None]


def test_parts_along_an_order(spark, numbers, monkeypatch):
    df, values = numbers
    monkeypatch.setattr(prefix, "PART_ROWS", 37)
    assert exact_quantiles(df, "x", [0, 0.1, 0.5, 0.77, 1]) == pytest.approx(np.quantile(values, [0, 0.1, 0.5, 0.77, 1]).tolist())
    assert exact_quantiles(df.limit(0), "x", [0.5]) == [None] and mode(df.limit(0), "x") is None
    counts = pd.Series(values).value_counts()
    assert mode(df, "x") == min(counts[counts == counts.max()].index)
    index = {r["s"]: r["code"] for r in ordered_index(df, "s").collect()}
    assert index == {s: i for i, s in enumerate(sorted({f"name{int(v):04d}" for v in values}))}
    order = spark.createDataFrame([(float(i), float(i % 7)) for i in range(500)] + [(None, 5.0)], "k double, v double")
    for descending in (False, True):
        ks = sorted(range(500), reverse=descending)
        run = {r["k"]: r["run_v"] for r in running_sums(order, "k", ["v"], descending, parts=9).collect()}
        assert run.pop(None) is None and [run[float(k)] for k in ks] == np.cumsum([k % 7 for k in ks]).tolist()
        follow = {r["k"]: r["next_v"] for r in with_next(order.dropna(), "k", ["v"], descending, parts=9).collect()}
        assert [follow[float(k)] for k in ks] == [float(k % 7) for k in ks[1:]] + [None]


def test_encoders_with_many_categories(spark, numbers, monkeypatch):
    df, _ = numbers
    monkeypatch.setattr(preprocess, "MOST_LITERAL", 5)
    codes = {s: float(i) for i, s in enumerate(sorted({r["s"] for r in df.collect()}))}
    t = preprocess.OrdinalEncoder(["s"], ["c"], handle_unknown="use_encoded_value", unknown_value=-1, encoded_missing_value=-2).fit(df)
    odd = df.limit(50).union(spark.createDataFrame([(1, 1.0, "zzz"), (2, 1.0, None)], df.schema))
    out = t.transform(odd)
    assert out.columns == ["c", "id", "x", "s"]
    assert all(r["c"] == (-2 if r["s"] is None else codes.get(r["s"], -1)) for r in out.collect())
    with pytest.raises(Exception, match="unknown category"):
        preprocess.OrdinalEncoder(["s"]).fit(df).transform(odd).collect()
    assert preprocess.LabelEncoder("s", "c").fit(df).transform(odd.where("s is null")).first()["c"] == len(codes)


def test_bins_without_values(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    for strategy in ("uniform", "quantile"):
        out = preprocess.KBinsDiscretizer(["x"], ["b"], strategy=strategy).fit(df).transform(df.union(spark.createDataFrame([(3.0,)], "x double")))
        assert [r["b"] for r in out.collect()] == [None, None, 0.0]
        assert preprocess.KBinsDiscretizer(["x"], ["b"], strategy=strategy, encode="onehot-dense").fit(df).transform(df).columns == ["b_0", "x"]


def test_windows_see_nothing_of_the_future(spark):
    at = lambda us: datetime(2024, 1, 1, 0, 0, 10, us)
    events = spark.createDataFrame([(1, at(100_000), 1.0, "a"), (1, at(900_000), 2.0, "b"), (1, None, 4.0, "c"), (None, at(0), 8.0, "d")], "u int, ts timestamp_ntz, v double, s string")
    spine = spark.createDataFrame([(1, at(100_000)), (1, at(99_999)), (1, at(899_999)), (1, at(900_000)), (1, None), (2, at(0)), (1, datetime(2024, 1, 1, 0, 1, 10, 100_000))], "u int, at timestamp_ntz")
    features = [Feature.sum("v", "1m").alias("s"), Feature.count("v", "1m").alias("n"), Feature.stddev("v", "1m").alias("sd"), Feature.var("v", "1m").alias("var"), Feature.approx_count_distinct("s", "1m").alias("d"), Feature.approx_percentile("v", "1m").alias("p"), Feature.min("v", "1m", "0s").alias("low")]
    out = continuous_features(events, spine, TileSpec(("u",), "ts", "1m", tuple(features), continuous=True), "at")
    got = {(r["u"], r["at"]): tuple(r)[2:] for r in out.collect()}
    assert got[1, at(99_999)] == (0.0, 0, None, None, 0, None, None) == got[2, at(0)]
    assert got[1, at(100_000)] == (1.0, 1, 0.0, 0.0, 1, 1.0, 1.0) == got[1, at(899_999)]
    assert got[1, at(900_000)] == (3.0, 2, 0.5, 0.25, 2, 1.0, 1.0) and got[1, None][:2] == (0.0, 0)
    assert got[1, datetime(2024, 1, 1, 0, 1, 10, 100_000)][:2] == (2.0, 1)
    for bad in (Feature.last_n("v", "1m", n=2), Feature.sum("v", "lifetime")):
        with pytest.raises(ValueError, match="continuous"):
            TileSpec(("u",), "ts", "1m", (bad,), continuous=True)
    sums = over_time(events.where("u = 1"), ["u"], "ts", 1, {"total": F.sum("v")})
    assert {r["v"]: r["total"] for r in sums.collect()} == {1.0: 1.0, 2.0: 3.0, 4.0: None}
    with pytest.raises(ValueError):
        top_n(events, ["u"], ["ts"], 0)


def test_secondary_keys_may_be_unlimited(spark):
    events = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 5), f"k{i:03d}", 1.0) for i in range(30)], "u int, ts timestamp_ntz, k string, v double")
    spine = spark.createDataFrame([(1, datetime(2024, 1, 1, 2))], "u int, at timestamp_ntz")
    for most, n in ((None, 30), (7, 7)):
        spec = TileSpec(("u",), "ts", "1h", (Feature.count("v", "2h").alias("n"),), "k", most_secondary=most)
        assert len(tiled_features(events, spine, spec, "at").first()["secondary_keys"]) == n


def test_refresh_of_null_keys_and_secondary_keys(spark):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    events = spark.createDataFrame([(None, at(1), "a", 5.0), (None, at(2), None, 6.0), (1, at(3), "a", 1.0), (1, at(4), "b", 2.0), (1, None, "b", 9.0)], "u int, ts timestamp_ntz, k string, v double")
    for secondary in (None, "k"):
        spec = TileSpec(("u",), "ts", "1h", (Feature.sum("v", "1h"), Feature.count("v", "1h")), secondary)
        old = build_tiles(events.where("v not in (6, 2)"), spec)
        new = refresh_tiles(events, old, spec, events.where("v in (6, 2)"))
        assert sorted(map(str, new.collect())) == sorted(map(str, build_tiles(events, spec).collect()))


def test_stream_tiles_in_another_zone(spark, root):
    events = spark.createDataFrame([(1, datetime(2024, 1, 1, h, 30), "a" if h % 2 else "b", float(h)) for h in range(5)], "u int, ts timestamp_ntz, k string, v double")
    events.write.parquet(f"{root}/in")
    with pytest.raises(ValueError, match="stream"):
        stream_tiles(events, TileSpec(("u",), "ts", "1h", (Feature.last_n("v", "1h", n=1),)))
    spec = TileSpec(("u",), "ts", "2h", (Feature.sum("v", "2h"),), "k")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        tiles = stream_tiles(spark.readStream.schema(events.schema).parquet(f"{root}/in"), spec)
        query = tiles.writeStream.format("memory").queryName("zoned").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{root}/state").start()
        query.awaitTermination()
        assert sorted(map(tuple, spark.table("zoned").collect())) == sorted(map(tuple, build_tiles(events, spec).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_overwrite_and_snapshots(spark, root):
    store = FeatureStore(spark, root, clock=lambda: datetime(2024, 1, 2))
    user = store.register_entity(Entity("USER", ("u",)))
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1), 1.0)], "u int, ts timestamp_ntz, v double")
    made = lambda df, **o: FeatureView("V", [user], timestamp_col="ts", refresh_freq="1d", compute=lambda s: df, **o)
    view = store.register_feature_view(made(rows))
    for bad in (rows.drop("ts"), rows.withColumn("v", F.raise_error(F.lit("no")).cast("double"))):
        with pytest.raises(Exception):
            store.register_feature_view(made(bad), overwrite=True)
        assert store.read_feature_view(store.get_feature_view("V", "V1")).count() == 1
    store.register_feature_view(made(rows.union(rows)), overwrite=True)
    assert store.read_feature_view(view).count() == 2
    with pytest.raises(ValueError, match="backfill"):
        store.register_feature_view(made(rows), version="V2", seed=rows)
    seen = {"df": rows}
    snap = store.register_feature_view(FeatureView("S", [user], timestamp_col="ts", refresh_freq="0 2 * * * UTC", append_only=True, compute=lambda s: seen["df"]))
    seen["df"] = rows.withColumn("w", F.lit("new"))
    for _ in range(2):
        store.refresh_feature_view(snap, batch="b")
    got = store.read_feature_view(snap)
    assert got.columns == ["u", "ts", "v", "w"] and sorted(map(str, (r["w"] for r in got.collect()))) == ["None", "new"]
    seen["df"] = rows.select("u", "ts")
    with pytest.raises(ValueError, match="end"):
        store.refresh_feature_view(snap)
    with pytest.raises(ValueError, match="minute"):
        FeatureView("X", [user], refresh_freq="5s")
    store.register_stream_source("CLICKS", rows.schema)
    store.register_feature_view(FeatureView("C", [user], stream="CLICKS", compute=lambda s: rows))
    with pytest.raises(ValueError, match="used by"):
        store.delete_stream_source("CLICKS")


def test_batches_shards_and_synthetic_rows(spark):
    df = spark.createDataFrame([(i, None if i < 40 else i, f"text {i % 11} " * 20, datetime(2024, 1, 1)) for i in range(100)], "i int, n long, s string, t timestamp_ntz").repartition(7)
    batches = list(DataConnector(df).to_batches(9))
    assert [b.num_rows for b in batches] == [9] * 11 + [1] and len({b.schema for b in batches}) == 1 and batches[0].schema.field("n").type == pa.int64()
    assert sorted(x for b in batches for x in b.column(0).to_pylist()) == list(range(100))
    assert list(DataConnector(df.limit(0)).to_batches(5)) == []
    parts = [shard(df, 3, r, ["i"]) for r in range(3)]
    least = min(p.count() for p in parts)
    equal = [[r["i"] for r in shard(df, 3, r, ["i"], equal=True).collect()] for r in range(3)]
    assert [len(x) for x in equal] == [least] * 3 and all(set(x) <= {r["i"] for r in p.collect()} for x, p in zip(equal, parts))
    fake = synthetic_rows(df.withColumn("none", F.lit(None).cast("string")), 500, seed=3)
    assert {r["s"] for r in fake.collect()} == {f"text {i} " * 20 for i in range(11)} and fake.where("none is not null").count() == 0
    assert fake.columns == [*df.columns, "none"] and fake.count() == 500


def test_array_sums_and_partial_area(spark):
    df = spark.createDataFrame([("a", [1, 2, 3]), ("a", [10, None]), ("b", []), ("b", None)], "k string, x array<int>")
    assert {r["k"]: r["sums"] for r in metrics.array_sums(df, "x", ["k"]).collect()} == {"a": [11, 2, 3]}
    scores = spark.createDataFrame([(int(i % 3 == 0), float(i)) for i in range(30)], "y int, s double")
    assert metrics.roc_auc_score(scores, "y", "s", max_fpr=1.0) == pytest.approx(metrics.roc_auc_score(scores, "y", "s"))
    perfect = spark.createDataFrame([(0, 0.0), (0, 1.0), (1, 2.0)], "y int, s double")
    assert metrics.roc_auc_score(perfect, "y", "s", max_fpr=0.5) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        metrics.roc_auc_score(perfect, "y", "s", max_fpr=0)
    corners = metrics.roc_curve(perfect, "y", "s", drop_intermediate=True).collect()
    assert [(r["fpr"], r["tpr"]) for r in sorted(corners, key=lambda r: -r["threshold"])] == [(0, 0), (0, 1), (1, 1)]


class Adder(CustomModel):
    @inference_api
    def predict(self, frame, by=1.0):
        return pd.DataFrame({"y": frame.x + by})

    @partitioned_api
    def total(self, frame):
        return pd.DataFrame({"y": [float(frame.x.sum())]})


def test_runs_of_models(spark, root):
    df = spark.createDataFrame([(1, 1.0), (2, 5.0)], "g int, x double")
    v = Registry(spark, root).log_model(Adder(), "m", "v1", infer_signature(df.select("x"), spark.createDataFrame([], "y double")))
    frame = pd.DataFrame({"x": [3.0, 1.0, 2.0]}, index=[7, 5, 6])
    out = v.run(frame, params={"by": 2.0})
    assert out["y"].tolist() == [5.0, 3.0, 4.0] and out.index.tolist() == [7, 5, 6]
    with pytest.raises(ValueError, match="no parameters"):
        v.run(df, params={"other": 1})
    with pytest.raises(ValueError, match="partition column"):
        v.run(df, "total")
    assert {r["g"]: r["y"] for r in v.run(df, "total", partition_column="g").collect()} == {1: 1.0, 2: 5.0}


@pytest.mark.parametrize("name", ["LogisticRegression", "LinearSVC", "RandomForestClassifier", "DecisionTreeClassifier", "GradientBoostingClassifier", "HistGradientBoostingClassifier", "GaussianNB", "MultinomialNB", "ComplementNB", "OneVsRestClassifier"])
def test_classifiers_part_two_clouds(spark, name):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), y) for y in (0, 1) for a, b in zip(np.abs(rng.normal(1 + 4 * y, 0.4, 60)), np.abs(rng.normal(5 - 4 * y, 0.4, 60)))]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    assert estimator(name, None, ["y"]).fit(df).score(df) > 0.95


def test_other_estimators(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1, float(i % 2)) for i in range(60)], "x double, y double, b double")
    for name in ("RandomForestRegressor", "DecisionTreeRegressor", "GradientBoostingRegressor", "HistGradientBoostingRegressor", "HuberRegressor", "ElasticNet"):
        assert estimator(name, ["x"], ["y"], **({"alpha": 0.01} if name == "ElasticNet" else {})).fit(df).score(df) > 0.8
    bits = estimator("BernoulliNB", ["b"], ["label"]).fit(df.withColumn("label", F.col("b").cast("int")))
    assert bits.score(df.withColumn("label", F.col("b").cast("int"))) == 1.0
    for name in ("KMeans", "BisectingKMeans", "GaussianMixture"):
        found = estimator(name, ["x"], k=2).fit_predict(df)
        assert {r[0] for r in found.select("OUTPUT_0").distinct().collect()} == {0.0, 1.0}
    weighted = df.withColumn("w", F.when(F.col("x") < 30, 1.0).otherwise(0.0))
    assert estimator("LinearRegression", ["x"], ["y"], weight_col="w").fit(weighted).model.coefficients[0] == pytest.approx(2.0)
    with pytest.raises(ValueError, match="fit first"):
        Estimator(None, ["x"]).predict(df)


def test_checks(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), "a", 1.0, 2.0)], "ts timestamp_ntz, id string, p double, y double")
    check_monitor_source(df, "ts", ["id"], ["p"], ["y"])
    for bad in (dict(ts="id", ids=[], predictions=["p"]), dict(ts="ts", ids=["id"], predictions=["id"]), dict(ts="ts", ids=["p"], predictions=["p"]), dict(ts="ts", ids=[], predictions=["none"]), dict(ts="ts", ids=[], predictions=[]), dict(ts="ts", ids=[], predictions=["p"], segments=["y"]), dict(ts="ts", ids=[], predictions=["p"], actuals=["id"])):
        with pytest.raises(ValueError):
            check_monitor_source(df, **bad)
    assert check_result(df, rows=1, columns=["TS", "id", "p", "y"]) is df
    for bad in (dict(rows=2), dict(rows=0), dict(columns=["x"]), dict(single=True)):
        with pytest.raises(ValueError):
            check_result(df, **bad)
    assert df.select(column_or_literal("p"), column_or_literal("'p'").alias("t"), column_or_literal(3).alias("n"), column_or_literal(F.col("y"))).first() == (1.0, "p", 3, 2.0)


def _fine(frame):
    return pd.DataFrame({"z": np.sqrt(frame.p) + math.pi})


def test_source_checks_and_private_views(spark):
    outside = 3
    check_compute(_fine)
    for bad in (lambda f: f.assign(z=outside), lambda: None, lambda a, b: a, "text", lambda f: DataConnector):
        with pytest.raises(ValueError):
            check_compute(bad)
    requests = spark.createDataFrame([(1, datetime(2024, 1, 2), 4.0), (1, datetime(2024, 1, 2), 4.0), (2, datetime(2024, 1, 2), 9.0)], "u int, at timestamp_ntz, p double")
    history = spark.createDataFrame([(1, datetime(2024, 1, 1), 10.0), (1, datetime(2024, 1, 3), 99.0)], "u int, ts timestamp_ntz, seen double")
    out = realtime_features(requests, lambda f: pd.DataFrame({"z": f.p + f.seen.fillna(0)}), "z double", views=[(history, ["u"], "ts", ["seen"])], ts="at")
    assert out.columns == ["u", "at", "p", "z"] and sorted(r["z"] for r in out.collect()) == [9.0, 14.0, 14.0]


def test_spread_follows_the_largest_key(spark, monkeypatch):
    from millrace.operators import asof

    rng = np.random.default_rng(5)
    stamp = lambda: datetime(2024, 1, 1 + int(rng.integers(20)), int(rng.integers(24)), int(rng.integers(60)))
    right = spark.createDataFrame([(1 if i % 3 else 2, stamp(), float(i)) for i in range(200)] + [(None, stamp(), 0.0)], "k int, t timestamp_ntz, v double").dropDuplicates(["k", "t"])
    left = spark.createDataFrame([(i % 3, stamp(), i) for i in range(150)] + [(None, stamp(), -1)], "k int, at timestamp_ntz, i int")
    right, left = right.persist(), left.persist()
    want = sorted(map(str, asof.asof_join(left, right, ["k"], "at", "t", ["v"]).collect()))
    monkeypatch.setattr(asof, "PART_ROWS", 10)
    assert sorted(map(str, asof.asof_join(left, right, ["k"], "at", "t", ["v"], spread=None).collect())) == want


@pytest.mark.parametrize("aligned", [False, True])
def test_long_windows_as_differences(spark, monkeypatch, aligned):
    from millrace.operators import tiles

    rng = np.random.default_rng(8)
    stamp = lambda: datetime(2024, 1, 1 + int(rng.integers(4)), int(rng.integers(24)), int(rng.integers(60)))
    events = spark.createDataFrame([(int(i % 3) if i % 11 else None, stamp(), None if i % 5 == 0 else int(rng.integers(100))) for i in range(200)], "u int, ts timestamp_ntz, v long").persist()
    spine = spark.createDataFrame([(int(i % 4) if i % 13 else None, stamp() if i % 17 else None) for i in range(80)], "u int, at timestamp_ntz").persist()
    features = [Feature.sum("v", "12h").alias("a"), Feature.count("v", "4h", "6h").alias("b"), Feature.avg("v", "24h", "2h").alias("c"), Feature.max("v", "6h").alias("d"), Feature.last_n("v", "8h", n=2).alias("e")]
    spec = TileSpec(("u",), "ts", "2h", tuple(features))
    want = sorted(map(str, tiled_features(events, spine, spec, "at", aligned).collect()))
    monkeypatch.setattr(tiles, "LONG_WINDOW", 1)
    assert sorted(map(str, tiled_features(events, spine, spec, "at", aligned).collect())) == want
    only = TileSpec(("u",), "ts", "2h", tuple(features[:3]))
    assert tiled_features(events, spine, only, "at", aligned).count() == 80


def test_declared_sources_and_views(spark, tmp_path):
    import json

    from millrace.sources.examples import load_sources

    (tmp_path / "a.csv").write_text("id;name\n1;x\n2;\n")
    spark.range(3).write.parquet(f"{tmp_path}/b")
    sources = [{"name": "a", "path": "a.csv", "format": "csv", "schema": "id long, name string", "delimiter": ";"}, {"name": "b", "path": f"{tmp_path}/b", "format": "parquet"}, {"name": "c", "path": "c", "format": "xml"}]
    (tmp_path / "sources.json").write_text(json.dumps(sources, indent=1))
    found = load_sources(spark, f"{tmp_path}/sources.json", ["a", "b"], views=True)
    assert [tuple(r) for r in found["a"].orderBy("id").collect()] == [(1, "x"), (2, None)] and spark.table("b").count() == 3
    for bad in (["none"], ["c"]):
        with pytest.raises(ValueError):
            load_sources(spark, f"{tmp_path}/sources.json", bad)
    table = pa.table({"i": [1, 2], "s": ["a", None]})
    assert DataConnector.from_arrow(spark, table).to_arrow() == table
    assert DataConnector.from_arrow(spark, table.to_batches()).df.count() == 2
    store = FeatureStore(spark, f"file://{tmp_path}/store")
    store.register_feature_view(FeatureView("LIVE", [store.register_entity(Entity("E", ("id",)))], compute=lambda s: s.range(4)))
    assert spark.table("`LIVE$V1`").count() == 4


def test_files_of_about_equal_bytes(spark, root):
    from millrace.sources.dataset import FileSet

    df = spark.createDataFrame([(i, "x" * 1000, [1, 2]) for i in range(400)], "i long, s string, a array<int>").coalesce(1)
    files = FileSet.make(df, f"{root}/f", bytes_per_file=100_000)
    assert 4 <= len(files.files()) <= 5 and files.read().count() == 400
    assert FileSet.make(df.limit(0), f"{root}/e").read().count() == 0
