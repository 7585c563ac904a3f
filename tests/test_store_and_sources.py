from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators.tiles import Feature, TileSpec, build_tiles
from millrace.plans.models import CustomModel, Estimator, Experiments, Registry, grid, inference_api, infer_signature, partitioned_api, sampled_grid, search
from millrace.plans.store import Entity, FeatureStore, FeatureView, Rollup, realtime_features
from millrace.sources.connector import DataConnector, cast_for_dataset, check_not_null, shard
from millrace.sources.dataset import Dataset, FileSet, extend_schema, synthetic_rows
from millrace.streaming.stream import StreamSource, refresh_tiles

NOW = datetime(2024, 1, 1, 3, 0)


@pytest.fixture
def events(spark):
    rows = [(1, datetime(2024, 1, 1, h, 30), 10.0 * (h + 1)) for h in range(3)] + [(2, datetime(2024, 1, 1, 1, 0), 5.0)]
    return spark.createDataFrame(rows, "user_id int, ts timestamp_ntz, amount double")


@pytest.fixture
def store(spark, root, events):
    events.createOrReplaceTempView("store_events")
    s = FeatureStore(spark, root, clock=lambda: NOW)
    s.register_entity(Entity("USER", ("user_id",)))
    return s


def tiled(store):
    return store.register_feature_view(FeatureView("spend", [store.get_entity("user")], query="SELECT * FROM store_events", timestamp_col="ts", refresh_freq="1h", feature_granularity="1h", features=[Feature.sum("amount", "2h").alias("s2")]))


def test_views(store, spark):
    view = tiled(store)
    assert {r["user_id"]: r["s2"] for r in store.read_feature_view(view).collect()} == {1: 50.0, 2: 5.0}
    again = store.get_feature_view("SPEND", "V1")
    assert again.spec == view.spec
    assert store.read_feature_view(again, keys=[[2]]).collect()[0]["s2"] == 5.0
    with pytest.raises(ValueError, match="exists"):
        tiled(store)
    with pytest.raises(ValueError, match="used by"):
        store.delete_entity("USER")
    store.suspend_feature_view(view)
    with pytest.raises(ValueError, match="suspended"):
        store.refresh_feature_view(view)
    store.resume_feature_view(view)
    store.refresh_feature_view(view)
    assert store.get_refresh_history(view).count() == 2
    assert store.list_feature_views().count() == 1
    store.update_feature_view("spend", "V1", desc="new")
    assert store.list_feature_views("USER").first()["desc"] == "new"
    assert store.lineage().count() == 1
    store.delete_feature_view("spend", "V1")
    store.delete_entity("USER")
    assert store.list_entities().count() == 0


def test_failed_registration_leaves_nothing(store):
    with pytest.raises(ValueError, match="no such columns"):
        store.register_feature_view(FeatureView("bad", [store.get_entity("USER")], query="SELECT * FROM store_events", timestamp_col="nope"))
    assert store.list_feature_views().count() == 0


def test_training_set_dataset_and_rollup(store, spark):
    view = tiled(store)
    plain = store.register_feature_view(FeatureView("last", [store.get_entity("USER")], query="SELECT user_id, ts, amount FROM store_events", timestamp_col="ts"))
    spine = spark.createDataFrame([(1, datetime(2024, 1, 1, 2, 10), 1), (2, datetime(2024, 1, 1, 0, 10), 0)], "user_id int, at timestamp_ntz, label int")
    out = {r["user_id"]: r for r in store.generate_training_set(spine, [view, plain], spine_timestamp_col="at", auto_prefix=True).collect()}
    assert out[1]["SPEND_V1_s2"] == 30.0 and out[1]["LAST_V1_amount"] == 20.0
    assert out[2]["SPEND_V1_s2"] == 0.0 and out[2]["LAST_V1_amount"] is None
    ds = store.generate_dataset("train", "v1", spine, [view, plain], "at", ["label"])
    assert ds.read(True).columns == ["user_id", "s2", "amount"]
    assert [v.name for v in store.load_feature_views_from_dataset(ds)] == ["spend", "last"]
    spark.createDataFrame([(1, "all"), (2, "all")], "user_id int, grp string").createOrReplaceTempView("store_mapping")
    group = store.register_entity(Entity("GROUP", ("grp",)))
    rolled = store.register_feature_view(FeatureView("rolled", [group], timestamp_col="ts", refresh_freq="1h", feature_granularity="1h", features=view.features, rollup=Rollup("spend", "V1", "SELECT * FROM store_mapping")))
    assert store.read_feature_view(rolled).first()["s2"] == 55.0
    with pytest.raises(ValueError, match="parent"):
        store.delete_feature_view("spend", "V1")
    with pytest.raises(ValueError, match="either"):
        store.generate_training_set(spine)


def test_append_only(store):
    view = store.register_feature_view(FeatureView("snap", [store.get_entity("USER")], query="SELECT * FROM store_events", timestamp_col="ts", refresh_freq="1d", append_only=True))
    store.refresh_feature_view(view)
    assert store.read_feature_view(view).count() == 8


def test_datasets(spark, root):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, 3.5, "b")], "id int, x float, y string").withColumn("d", F.lit(3).cast("decimal(10,0)"))
    ds = Dataset(spark, root, "d")
    v = ds.create_version("v1", df, exclude_cols=["id"], label_cols=["y"], partition_by=["y"])
    assert dict(v.read().dtypes)["x"] == "double" and dict(v.read().dtypes)["d"] == "bigint"
    assert v.read(True).columns == ["x", "d"] and len(v.files()) == 2
    with pytest.raises(ValueError):
        ds.create_version("v1", df)
    assert ds.versions() == ["v1"]
    ds.delete_version("v1")
    assert ds.versions() == []
    files = FileSet.make(df, f"{root}/fs", rows_per_file=1)
    assert files.read().count() == 2
    with pytest.raises(Exception):
        FileSet.make(df, f"{root}/fs")
    assert extend_schema(df.select("id"), df.select("id", "x")).columns == ["id", "x"]
    with pytest.raises(ValueError):
        extend_schema(df, df.select("id"))
    fake = synthetic_rows(df, 20, seed=1).agg(F.min("x"), F.max("x"), F.count("*")).first()
    assert 2.5 <= fake[0] <= fake[1] <= 3.5 and fake[2] == 20


def test_connector(spark):
    df = spark.range(25).withColumn("x", F.col("id") * 2)
    sizes = [b.num_rows for b in DataConnector.from_dataframe(df).to_batches(10)]
    assert sizes == [10, 10, 5]
    assert [b.num_rows for b in DataConnector(df).to_batches(10, shuffle=True, drop_last_batch=True)] == [10, 10]
    assert len(DataConnector.from_sources([df, df]).to_pandas()) == 50
    assert sum(shard(df, 3, r, ["id"]).count() for r in range(3)) == 25
    assert len({shard(df, 3, r, ["id"], equal=True).count() for r in range(3)}) == 1
    with pytest.raises(ValueError):
        check_not_null(df.withColumn("n", F.lit(None)), ["id", "n"])
    assert cast_for_dataset(df.select(F.lit(1.5).cast("decimal(5,2)").alias("d"))).dtypes == [("d", "double")]


class Doubler(CustomModel):
    @inference_api
    def predict(self, frame):
        return pd.DataFrame({"y": frame.x * self.context["k"]})

    @partitioned_api
    def total(self, frame):
        return pd.DataFrame({"y": [float(frame.x.sum())]})


def test_models(spark, root):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0)], "g int, x double")
    reg = Registry(spark, root)
    v = reg.log_model(Doubler(k=3), "m", "v1", infer_signature(df.select("x"), spark.createDataFrame([], "y double")))
    assert sorted(r["y"] for r in v.run(df).collect()) == [3.0, 6.0, 15.0]
    assert {r["g"]: r["y"] for r in v.run(df, "total", partition_column="g").collect()} == {1: 3.0, 2: 5.0}
    reg.set_alias("m", "v1", "prod")
    reg.set_metric("m", "v1", "auc", 0.5)
    assert reg.get("m", "prod").record["metrics"] == {"auc": 0.5}
    with pytest.raises(ValueError):
        v.run(df.drop("x"))
    reg.delete("m")
    assert reg.models() == []


def test_estimators_and_search(spark, root):
    from pyspark.ml.regression import LinearRegression

    df = spark.createDataFrame([(float(i), 3.0 * i + 1) for i in range(60)], "x double, y double")
    e = Estimator(LinearRegression(solver="normal"), ["x"], ["y"]).fit(df)
    assert e.score(df) > 0.999 and "OUTPUT_y" in e.predict(df).columns
    best, all_ = search(df, grid({"regParam": [0.0, 1000.0]}), lambda p: Estimator(LinearRegression(solver="normal", **p), ["x"], ["y"]), folds=2)
    assert best["params"] == {"regParam": 0.0} and len(all_) == 2
    assert len(sampled_grid({"a": [1, 2, 3], "b": [1, 2]}, 4)) == 4
    ex = Experiments(spark, f"{root}/runs")
    ex.log("r1", {"lr": "0.1"}, [("loss", 0, 2.0), ("loss", 1, 1.0)])
    assert ex.runs().first()["loss"] == 1.0


def test_realtime_and_streams(spark, root, events):
    out = realtime_features(events.select("user_id", "amount"), lambda f: pd.DataFrame({"z": f.amount + 1}), "z double")
    assert out.columns == ["user_id", "amount", "z"] and all(r["z"] == r["amount"] + 1 for r in out.collect())
    source = StreamSource("s", spark.createDataFrame([], "a int, b string").schema, f"{root}/landing")
    assert source.ingest(spark, [{"a": 1, "b": "x"}]) == 1
    with pytest.raises(ValueError):
        source.ingest(spark, [{"a": 1}])
    assert spark.read.schema(source.schema).json(source.path).count() == 1
    spec = TileSpec(("user_id",), "ts", "1h", (Feature.sum("amount", "2h"),))
    tiles = build_tiles(events.where("amount < 30"), spec)
    late = events.where("amount = 30")
    assert sorted(map(str, refresh_tiles(events, tiles, spec, late).collect())) == sorted(map(str, build_tiles(events, spec).collect()))


def test_stream_sources_in_the_store(store, spark):
    schema = spark.createDataFrame([], "a int, b string").schema
    store.register_stream_source("clicks", schema)
    with pytest.raises(ValueError, match="exists"):
        store.register_stream_source("clicks", schema)
    assert store.stream_ingest("clicks", [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]) == 2
    store.update_stream_source("clicks", "new")
    assert store.list_stream_sources().first()["desc"] == "new"
    assert spark.read.schema(schema).json(store.get_stream_source("CLICKS").path).count() == 2
    store.run_backfill("v", spark.range(3))
    assert store.backfill_state("V") == "COMPLETED"
    with pytest.raises(Exception):
        store.run_backfill("v", spark.range(1).select(F.raise_error(F.lit("no"))))
    assert store.backfill_state("v") == "FAILED"
    store.delete_stream_source("clicks")
    with pytest.raises(ValueError):
        store.get_stream_source("clicks")


def test_vector_stages_and_monitoring(spark):
    from pyspark.ml.feature import PCA, VarianceThresholdSelector

    from millrace.plans.models import VectorTransformer, drift, windowed_metrics

    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0) for i in range(50)], "a double, b double, c double")
    assert VectorTransformer(PCA(k=1), ["a", "b"]).fit(df).transform(df).columns == ["a", "b", "c", "OUTPUT_0"]
    kept = VectorTransformer(VarianceThresholdSelector(varianceThreshold=0.0), ["a", "c"], "S", input_param="featuresCol").fit(df).transform(df)
    assert kept.columns[-1] == "S_0" and [r["S_0"] for r in kept.collect()] == [r["a"] for r in df.collect()]
    assert drift(df, df, "a") == 0 and drift(df, df.withColumn("a", F.col("a") + 25), "a") > 0.2
    timed = df.withColumn("ts", F.lit("2024-01-01 05:00:00").cast("timestamp_ntz"))
    assert windowed_metrics(timed, "ts", "1h", {"n": F.count("*")}).first()["n"] == 50
