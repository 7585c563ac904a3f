"""Queries over the feature store, datasets, streams, incremental refresh and models, with their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.intervals import from_seconds, micros_of, seconds_of, slice_start
from millrace.operators.tiles import Feature, TileSpec, build_tiles
from millrace.plans.models import CustomModel, Estimator, Experiments, Registry, chained, estimator, grid, inference_api, infer_signature, partitioned_api, pivoted, search, search_ridge, selector
from millrace.plans.store import Entity, FeatureGroup, FeatureStore, FeatureView, realtime_features
from millrace.queries.features import _EVENTS_SQL, _SPINE_SQL, _window_sql
from millrace.operators.sets import distinct_union, values_except
from millrace.operators.windows import latest_per_key, top_n
from millrace.sources.connector import DataConnector, key_filter, shard
from millrace.sources.dataset import Dataset, FileSet, read_versions
from millrace.streaming.stream import append_batches, apply_rowwise, backfill, refresh_tiles, stream_lists, stream_tiles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch(spark: SparkSession) -> str:
    """A new folder that the driver and the executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def _sum_spec() -> TileSpec:
    return TileSpec(("user_id",), "ts", "1h", (Feature.sum("value", "24h"), Feature.count("value", "24h")))


def _tiles_out(t: DataFrame) -> DataFrame:
    return t.select("user_id", "tile_start", F.round("_sum_value", 6).alias("sum_value"), F.col("_count_value").alias("count_value"))


def streaming_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files through tiles, each micro-batch's changes upserted by (key, tile)."""
    path = _scratch(spark)
    events = _table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    tiles = stream_tiles(stream, _sum_spec())

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/tiles/part={number}")

    query = tiles.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    newest = latest_per_key(spark.read.parquet(f"{path}/tiles"), ["user_id", "tile_start"], "batch")
    return _tiles_out(newest)


def streaming_tiles_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of a stream in three micro-batches: the second changes tiles of the first, and the third comes behind the watermark, so its events are left out."""
    path, events = _scratch(spark), _table(spark, sf_dir, "events")
    for i in range(3):
        part = events.where(F.col("event_id") % 3 == i)
        (part.where("ts < '2024-01-15'") if i == 2 else part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/tiles/part={number}")

    stream_tiles(stream, _sum_spec(), "1 hour").writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return _tiles_out(latest_per_key(spark.read.parquet(f"{path}/tiles"), ["user_id", "tile_start"], "batch"))


def streaming_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest and first values by user and hour of a stream whose events come in five micro-batches, each from the whole time: later batches change tiles of earlier ones."""
    path, events = _scratch(spark), _table(spark, sf_dir, "events")
    spec = TileSpec(("user_id",), "ts", "1h", (Feature.last_n("event_id", "24h", n=3), Feature.first_distinct_n("event_type", "24h", n=2)))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/tiles/part={number}")

    for i in range(5):  # files of any number, which the next start of the stream takes as one batch
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(5)) == i).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        stream_lists(stream, spec, "400 days").writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    newest = top_n(spark.read.parquet(f"{path}/tiles"), ["user_id", "tile_start"], [F.desc("batch")], 1)
    text = lambda name: F.array_join(F.transform(name, lambda x: x["value"].cast("string")), ",")
    return newest.select("user_id", "tile_start", text("_last_n_event_id").alias("newest"), text("_first_distinct_n_event_type").alias("first_types"))


def streaming_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row-wise transform on a stream, written batch by batch."""
    path = _scratch(spark)
    events = _table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", "value")
    changed = apply_rowwise(stream, lambda f: f.assign(twice=f.value * 2)[["event_id", "twice"]], "event_id long, twice double")
    append_batches(changed, f"{path}/rows", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("event_id", "twice")


def backfill_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _table(spark, sf_dir, "events").select("event_id", "ts", "value")
    rows = backfill(history, "ts", "2024-01-05 00:00:00", "2024-01-12 00:00:00", lambda f: f.assign(twice=f.value * 2)[["event_id", "twice"]], "event_id long, twice double")
    return rows.select("event_id", "twice")


def incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of the events but for every seventh, then refreshed with the late ones: only touched tiles are computed again."""
    events = _table(spark, sf_dir, "events")
    late = events.where("event_id % 7 = 3")
    tiles = build_tiles(events.where("event_id % 7 != 3"), _sum_spec())
    return _tiles_out(refresh_tiles(events, tiles, _sum_spec(), late))


def store_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered tiled view and a plain view with a time column, read by a training set."""
    events = _table(spark, sf_dir, "events")
    store = FeatureStore(spark, _scratch(spark))
    user = store.register_entity(Entity("USER", ("user_id",)))
    tiled = store.register_feature_view(FeatureView("spend", [user], timestamp_col="ts", refresh_freq="1h", feature_granularity="1h", features=[Feature.sum("value", "24h").alias("sum_24h")], compute=lambda s: events))
    buys = events.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("b_ts")).agg(F.max("value").alias("last_purchase"))
    plain = store.register_feature_view(FeatureView("buys", [user], timestamp_col="b_ts", refresh_freq="1d", compute=lambda s: buys))
    spine = events.select("user_id", from_seconds(slice_start(F.col("ts"), 86400) + 30_600).alias("at")).distinct()
    out = store.generate_training_set(spine, [tiled, plain.with_name("b")], spine_timestamp_col="at")
    return out.select("user_id", seconds_of(F.col("at")).alias("at_s"), F.round("sum_24h", 6).alias("sum_24h"), F.round("b_last_purchase", 6).alias("last_purchase"))


def store_feature_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two views without time columns read as one row for each key."""
    store = FeatureStore(spark, _scratch(spark))
    e = store.register_entity(Entity("CUSTOMER", ("c_custkey",)))
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    orders = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.max("o_totalprice").alias("most"))
    views = [store.register_feature_view(FeatureView(n, [e], compute=lambda s, df=df: df)) for n, df in (("balance", customer), ("orders", orders))]
    store.register_feature_group(FeatureGroup("ALL", [views[0], views[1].slice(["n_orders"])]))
    return store.read_feature_group("ALL", _table(spark, sf_dir, "customer").select("c_custkey"))


def dataset_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a dataset read together, without label columns."""
    nation = _table(spark, sf_dir, "nation")
    ds = Dataset(spark, _scratch(spark), "nations")
    v = [ds.create_version(f"v{i}", nation.where(F.col("n_nationkey") % 2 == i), label_cols=["n_regionkey"]) for i in (0, 1)]
    return read_versions(v, only_feature_cols=True).select("n_nationkey", "n_name")


def fileset_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").cast("decimal(18,2)").alias("balance"))
    return FileSet.make(supplier, f"{_scratch(spark)}/files", shuffle=True, seed=1, rows_per_file=20).read()


def sharded_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shards together are the table; each row says whether it came once."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    parts = [shard(orders, 4, r, ["o_orderkey"]) for r in range(4)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return both.groupBy("o_orderkey").agg(F.count("*").alias("times"))


def keys_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [[k, k % 3 + 1] for k in range(1, 60)]
    return key_filter(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], keys).select("l_orderkey", "l_linenumber", "l_partkey")


def category_union_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of two tables together, less those of a third."""
    a = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    b = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    few = _table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("nation"))
    return values_except(distinct_union([(a, "nation"), (b, "nation")], "nation"), few, "nation")


def realtime_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas function of request rows and stored features."""
    orders = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(orders, "c_custkey")
    out = realtime_features(rows, lambda f: pd.DataFrame({"cents": (f.c_acctbal * 100).round().astype("int64") + f.n}), "cents long")
    return out.select("c_custkey", "cents")


class _Rounded(CustomModel):
    @inference_api
    def predict(self, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"whole": frame.net.round().astype("int64")})


class _Margin(CustomModel):
    @inference_api
    def predict(self, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"net": frame.l_extendedprice * self.context["rate"]})

    @partitioned_api
    def total(self, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"net": [float((frame.l_extendedprice * 100).round().sum())]})


def _version(spark: SparkSession, df: DataFrame):
    out = spark.createDataFrame([], "net double")
    return Registry(spark, _scratch(spark)).log_model(_Margin(rate=0.5), "margin", "v1", infer_signature(df.select("l_extendedprice"), out))


def model_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return _version(spark, df).run(df).select("l_orderkey", "l_linenumber", F.round("net", 4).alias("net"))


def model_run_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice")
    return _version(spark, df).run(df, "total", partition_column="l_suppkey").select("l_suppkey", F.col("net").cast("long").alias("cents"))


def linear_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of price on quantity."""
    from pyspark.ml.regression import LinearRegression

    df = _table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    m = Estimator(LinearRegression(solver="normal"), ["l_quantity"], ["l_extendedprice"]).fit(df).model
    return spark.createDataFrame([(round(float(m.coefficients[0]), 3), round(float(m.intercept), 1))], "slope double, intercept double")


def monitored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and largest value by day and event type."""
    from millrace.plans.models import windowed_metrics

    return windowed_metrics(_table(spark, sf_dir, "events"), "ts", "1d", {"n": F.count("*"), "most": F.max("value")}, ["event_type"])


def run_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes as columns, by the pivot that lists experiments' runs: orders of each customer by status."""
    orders = _table(spark, sf_dir, "orders")
    return pivoted(orders, "o_custkey", "o_orderstatus", F.count("o_orderkey"), ["F", "O", "P"]).select("o_custkey", *[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s.lower()) for s in "FOP"])


def experiment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each order status, with its share of orders as a parameter and the mean price up to each year as a metric by step: the last step counts."""
    runs, orders = Experiments(spark, f"{_scratch(spark)}/runs"), _table(spark, sf_dir, "orders")
    for status in "FOP":
        mine = orders.where(F.col("o_orderstatus") == status)
        means = mine.groupBy(F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n")).orderBy("y").collect()  # a row for each year
        steps = [("mean_price", r["y"], sum(x["s"] for x in means[: i + 1]) / sum(x["n"] for x in means[: i + 1])) for i, r in enumerate(means)]
        runs.log(f"run{status}", {"orders": str(sum(r["n"] for r in means))}, steps)
    return runs.runs().select("run", "orders", F.round("mean_price", 2).alias("mean_price"))


def store_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of entities, views, groups and stream sources after some are made, changed and deleted."""
    store = FeatureStore(spark, _scratch(spark))
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    store.register_entity(Entity("CUSTOMER", ("c_custkey",), "old"))
    store.update_entity("customer", "new")
    store.register_entity(Entity("GONE", ("x",)))
    store.delete_entity("GONE")
    views = [store.register_feature_view(FeatureView("BALANCE", [store.get_entity("CUSTOMER")], refresh_freq=f, version=v, compute=lambda s: customer)) for v, f in (("V1", None), ("V2", "1 day"))]
    store.update_feature_view("BALANCE", "V2", refresh_freq="2 days", desc="daily")
    store.suspend_feature_view(views[1])
    store.register_feature_group(FeatureGroup("ALL", views))
    store.register_stream_source("CLICKS", spark.createDataFrame([], "a int").schema, "raw")
    store.update_stream_source("CLICKS", "clicks")
    store.register_stream_source("GONE", spark.createDataFrame([], "a int").schema)
    store.delete_stream_source("GONE")
    out = store.list_entities().select(F.lit("entity").alias("kind"), "name", F.lit(None).cast("string").alias("version"), F.col("desc").alias("about"))
    out = out.union(store.list_feature_views("CUSTOMER").select(F.lit("view"), "name", "version", F.concat_ws("/", "refresh_freq", "status", "desc")))
    out = out.union(store.list_feature_groups().select(F.lit("group"), "name", F.lit(None), F.col("views").cast("string")))
    out = out.union(store.list_stream_sources().select(F.lit("stream"), "name", F.lit(None), "desc"))
    return out.union(store.lineage().select(F.lit("lineage"), "source", F.lit(None), "target"))


def store_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tiled view of all events but every seventh, refreshed with the late ones only."""
    store, events = FeatureStore(spark, _scratch(spark)), _table(spark, sf_dir, "events")
    seen = {"rows": events.where("event_id % 7 != 3")}
    user = store.register_entity(Entity("USER", ("user_id",)))
    view = store.register_feature_view(FeatureView("SPEND", [user], timestamp_col="ts", refresh_freq="1h", feature_granularity="1h", features=_sum_spec().features, compute=lambda s: seen["rows"]))
    seen["rows"] = events
    store.refresh_feature_view(view, changed=events.where("event_id % 7 = 3"))
    return _tiles_out(store.tiles(view))


def store_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only view: a backfill table, two batches of which one is written twice, and a column that came later."""
    store, day = FeatureStore(spark, _scratch(spark)), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts")
    customer = _table(spark, sf_dir, "customer")
    seen = {"rows": customer.where("c_custkey % 2 = 0").select("c_custkey", day, "c_acctbal")}
    key = store.register_entity(Entity("CUSTOMER", ("c_custkey",)))
    seed = customer.where("c_custkey % 10 = 1").select("c_custkey", day, "c_acctbal")
    view = store.register_feature_view(FeatureView("SNAP", [key], timestamp_col="ts", refresh_freq="1 day", append_only=True, compute=lambda s: seen["rows"]), seed=seed)
    seen["rows"] = customer.where("c_custkey % 3 = 0").select("c_custkey", day, "c_acctbal", "c_mktsegment")
    for _ in range(2):
        store.refresh_feature_view(view, batch="second")
    return store.read_feature_view(view).groupBy("c_custkey").agg(F.count("*").alias("times"), F.max("c_mktsegment").alias("segment"))


def store_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view that a failed overwrite leaves as it was, and a good one replaces."""
    store, customer = FeatureStore(spark, _scratch(spark)), _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    key = store.register_entity(Entity("CUSTOMER", ("c_custkey",)))
    made = lambda df: FeatureView("BALANCE", [key], refresh_freq="1 day", compute=lambda s: df)
    view = store.register_feature_view(made(customer.where("c_custkey % 2 = 0")))
    try:
        store.register_feature_view(made(customer.select(F.col("c_custkey"), F.raise_error(F.lit("bad")).alias("c_acctbal"))), overwrite=True)
    except Exception:  # the failure that this query is about
        pass
    kept = store.read_feature_view(view).select("c_custkey", F.lit("first").alias("view"))
    store.register_feature_view(made(customer.where("c_custkey % 2 = 1")), overwrite=True)
    return kept.union(store.read_feature_view(view).select("c_custkey", F.lit("second")))


def store_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was read before two refreshes and an overwrite, what one of the refreshes made, and what there is now: all three read at the end."""
    store, customer = FeatureStore(spark, _scratch(spark)), _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    key, seen = store.register_entity(Entity("CUSTOMER", ("c_custkey",))), {"n": 2}
    made = lambda: FeatureView("BALANCE", [key], refresh_freq="1 day", compute=lambda s: customer.where(F.col("c_custkey") % seen["n"] == 0))
    view = store.register_feature_view(made())
    held = store.read_feature_view(view)
    for n in (7, 3):
        seen["n"] = n
        store.refresh_feature_view(view)
    seen["n"] = 5
    view = store.register_feature_view(made(), overwrite=True)
    parts = {"held": held, "refreshed": store.read_feature_view(view, version=2), "now": store.read_feature_view(view)}
    return reduce(lambda a, b: a.union(b), [df.select("c_custkey", F.lit(name).alias("read")) for name, df in parts.items()])


def store_refresh_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tiled view without the events of two days, refreshed with each day's: parts of other days stay where they are."""
    store, events = FeatureStore(spark, _scratch(spark)), _table(spark, sf_dir, "events")
    day = slice_start(F.col("ts"), 86400)
    days = sorted(r[0] for r in events.select(day.alias("d")).distinct().collect())[3:5]  # a row for each day
    seen = {"rows": events.where(~day.isin(days))}
    user = store.register_entity(Entity("USER", ("user_id",)))
    view = store.register_feature_view(FeatureView("SPEND", [user], timestamp_col="ts", refresh_freq="1h", feature_granularity="1h", features=_sum_spec().features, compute=lambda s: seen["rows"]))
    for i, d in enumerate(days):
        seen["rows"] = events.where(~day.isin(days[i + 1 :]))
        store.refresh_feature_view(view, changed=events.where(day == d))
    return _tiles_out(store.tiles(view))


def store_many_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five views on one key as of each event's time, joined in one sort."""
    store, events = FeatureStore(spark, _scratch(spark)), _table(spark, sf_dir, "events")
    user = store.register_entity(Entity("USER", ("user_id",)))
    part = lambda i: events.where(F.col("event_id") % 5 == i).groupBy("user_id", F.col("ts").alias("seen")).agg(F.max("value").alias(f"v{i}"))
    views = [store.register_feature_view(FeatureView(f"V{i}", [user], timestamp_col="seen", refresh_freq="1 day", compute=lambda s, i=i: part(i))) for i in range(5)]
    out = store.retrieve_feature_values(events.select("user_id", "ts").distinct(), views, "ts")
    return out.select("user_id", micros_of(F.col("ts")).alias("at_us"), *[f"v{i}" for i in range(5)])


def ridge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated scores of three penalties, from one scan; the folds go by order."""
    df = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 3).alias("fold"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    _, results = search_ridge(df, ["x"], "y", [0.0, 1e6, 1e8], folds=3, fold=F.col("fold"))
    return spark.createDataFrame([(r["params"]["alpha"], round(r["mean"], 6)) for r in results], "alpha double, score double")


def store_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training set saved as a dataset version, read without its label and time."""
    events = _table(spark, sf_dir, "events")
    store = FeatureStore(spark, _scratch(spark))
    user = store.register_entity(Entity("USER", ("user_id",)))
    view = store.register_feature_view(FeatureView("SPEND", [user], timestamp_col="ts", refresh_freq="1h", feature_granularity="1h", features=[Feature.sum("value", "24h").alias("sum_24h")], compute=lambda s: events))
    spine = events.select("user_id", from_seconds(slice_start(F.col("ts"), 86400) + 30_600).alias("at"), F.lit(1).alias("label")).distinct()
    out = store.generate_dataset("train", "v1", spine, [view], "at", ["label"]).read(only_feature_cols=True)
    return out.groupBy("user_id").agg(F.count("*").alias("days"), F.round(F.sum("sum_24h"), 4).alias("total"))


def stream_two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each micro-batch written to two tables at once: purchases, and the rest."""
    path = _scratch(spark)
    stream = spark.readStream.schema(_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", "event_type")
    append_batches(stream, {f"{path}/bought": lambda b: b.where("event_type = 'purchase'"), f"{path}/rest": lambda b: b.where("event_type <> 'purchase'")}, f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/bought").select("event_id", F.lit("bought").alias("place")).union(spark.read.parquet(f"{path}/rest").select("event_id", F.lit("rest")))


def connector_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 1,000 rows of several sources together."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    both = DataConnector.from_sources([DataConnector(orders.where("o_orderkey % 2 = 0")), orders.where("o_orderkey % 2 = 1")])

    def consume(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = rows = total = 0
        for batch in batches:  # a batch at a time
            n, rows, total = n + 1, rows + batch.num_rows, total + sum(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_pydict({"batches": [n], "rows": [rows], "total": [total]})

    found = both.over_batches(consume, "batches long, rows long, total long", 1000, shuffle=True)
    return found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("batches", "rows", "total")])


def registry_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a model with default, alias, tag and, as a metric, the sum of what each makes of a table; one is deleted."""
    registry, df = Registry(spark, _scratch(spark)), _table(spark, sf_dir, "lineitem").select("l_extendedprice")
    for i in range(3):
        version = registry.log_model(_Margin(rate=0.5 * i), "margin", f"v{i}", infer_signature(df, spark.createDataFrame([], "net double")))
        registry.set_metric("margin", f"v{i}", "total", round(version.run(df).agg(F.sum(F.round("net", 4))).first()[0], 2))
    registry.set_default("margin", "v1")
    registry.set_alias("margin", "v2", "next")
    registry.set_tag("margin", "v1", "stage", "live")
    registry.delete("margin", "v0")
    rows = [(v, registry.get("margin").version == v, registry.get("margin", "next").version == v, registry.get("margin", v).record["metrics"].get("total"), registry.get("margin", v).record["tags"].get("stage")) for v in registry.versions("margin")]
    return spark.createDataFrame(rows, "version string, is_default boolean, is_next boolean, total double, stage string")


def model_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model on the output of another, and the result of a batch run written and read."""
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    first = _version(spark, df)
    out = spark.createDataFrame([], "net double")
    second = Registry(spark, _scratch(spark)).log_model(_Rounded(), "rounded", "v1", infer_signature(out, spark.createDataFrame([], "whole long")))
    return chained(df, [(first, "predict"), (second, "predict")]).select("l_orderkey", "l_linenumber", "whole")


def penalised_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes of ridge and lasso on one feature."""
    df = _table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    slope = lambda name, **p: round(float(estimator(name, ["x"], ["y"], **p).fit(df).model.coefficients[0]), 4)
    return spark.createDataFrame([(slope("Ridge", alpha=1e6), slope("Lasso", alpha=10.0))], "ridge double, lasso double")


def count_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poisson, gamma and Tweedie models with a log link on one feature of 0 and 1: the logarithm of the means' ratio."""
    df = _table(spark, sf_dir, "lineitem").select((F.col("l_discount") > 0.05).cast("double").alias("x"), (F.col("l_quantity") + F.when(F.col("l_discount") > 0.05, 5.0).otherwise(0.0)).alias("y"))
    slope = lambda name, **p: round(float(estimator(name, ["x"], ["y"], **p).fit(df).model.coefficients[0]), 4)
    return spark.createDataFrame([(slope("PoissonRegressor"), slope("GammaRegressor"), slope("TweedieRegressor", power=1.5))], "poisson double, gamma double, tweedie double")


def naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class means of Gaussian naive Bayes."""
    df = _table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", (F.col("l_linestatus") == "O").cast("int").alias("y"))
    m = estimator("GaussianNB", ["l_quantity", "l_tax"], ["y"]).fit(df).model
    return spark.createDataFrame([(i, round(float(m.theta.toArray()[i][0]), 4), round(float(m.theta.toArray()[i][1]), 6)) for i in range(2)], "y int, quantity double, tax double")


def best_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one feature of three that an F test prefers for a cost that follows the quantity."""
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_quantity", "l_discount", (F.col("l_quantity") * 3 + F.col("l_tax")).alias("cost"))
    out = selector("SelectKBest", 1, ["l_tax", "l_quantity", "l_discount"], "cost", label_type="continuous", output="best").fit(df).transform(df)
    return out.select("l_orderkey", "l_linenumber", F.col("best_0").alias("best"))


def searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The penalty that cross-validation prefers for a straight line."""
    df = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("double").alias("x"), (F.col("o_orderkey") * 2.0 + 1).alias("y"))
    best, results = search(df, grid({"alpha": [1e12, 1e-3]}), lambda p: estimator("Ridge", ["x"], ["y"], **p), folds=2)
    return spark.createDataFrame([(best["index"], len(results), best["mean"] > 0.999)], "best long, candidates long, good boolean")


QUERIES = {
    f.__name__: f
    for f in (
        streaming_tiles, streaming_tiles_late, streaming_lists, store_pinned, store_refresh_day, store_many_views, ridge_search, streaming_append, backfill_range, incremental_refresh, store_training_set, store_feature_group, dataset_versions, fileset_roundtrip, sharded_read, keys_filtered, category_union_except,
        realtime_view, model_run, model_run_partitioned, linear_regression, monitored_windows, run_pivot,
        experiment_runs, store_catalog, store_refresh, store_snapshots, store_overwrite, store_dataset, stream_two_tables, connector_batches, registry_versions, model_chain,
        penalised_regression, count_regressions, naive_bayes, best_feature, searched,
    )
}

_TILES = f"WITH {_EVENTS_SQL} SELECT user_id, h AS tile_start, round(sum(value), 6) AS sum_value, count(value) AS count_value FROM e GROUP BY user_id, h"
ORACLES = {
    "experiment_runs": "SELECT 'run' || o_orderstatus AS run, CAST(count(*) AS VARCHAR) AS orders, round(avg(o_totalprice), 2) AS mean_price FROM orders GROUP BY o_orderstatus",
    "store_catalog": "SELECT * FROM (VALUES ('entity', 'CUSTOMER', NULL, 'new'), ('view', 'BALANCE', 'V1', 'ACTIVE/'), ('view', 'BALANCE', 'V2', '2 days/SUSPENDED/daily'), ('group', 'ALL', NULL, '2'), ('stream', 'CLICKS', NULL, 'clicks'), ('lineage', 'entity:CUSTOMER', NULL, 'view:BALANCE$V1'), ('lineage', 'entity:CUSTOMER', NULL, 'view:BALANCE$V2'), ('lineage', 'view:BALANCE$V1', NULL, 'group:ALL'), ('lineage', 'view:BALANCE$V2', NULL, 'group:ALL')) t(kind, name, version, about)",
    "store_refresh": _TILES,
    "store_snapshots": "WITH a AS (SELECT c_custkey, NULL AS s FROM customer WHERE c_custkey % 10 = 1 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 0) SELECT c_custkey, count(*) AS times, max(s) AS segment FROM a GROUP BY c_custkey",
    "store_overwrite": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'first' ELSE 'second' END AS view FROM customer",
    "store_dataset": f"WITH {_SPINE_SQL}, {_EVENTS_SQL}, a AS ({_window_sql('coalesce(sum(value), 0) AS sum_24h', 86400)}) SELECT user_id, count(*) AS days, round(sum(sum_24h), 4) AS total FROM a GROUP BY user_id",
    "stream_two_tables": "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'bought' ELSE 'rest' END AS place FROM events",
    "connector_batches": "SELECT CAST(ceil(count(*) / 1000.0) AS BIGINT) AS batches, count(*) AS rows, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders",
    "registry_versions": "WITH s AS (SELECT sum(round(l_extendedprice * 0.5, 4)) AS half, sum(round(l_extendedprice, 4)) AS whole FROM lineitem) SELECT 'v1' AS version, true AS is_default, false AS is_next, round(half, 2) AS total, 'live' AS stage FROM s UNION ALL SELECT 'v2', false, true, round(whole, 2), NULL FROM s",
    "model_chain": "SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice * 0.5, 0) AS BIGINT) AS whole FROM lineitem",
    "penalised_regression": "WITH t AS (SELECT CAST(l_quantity AS DOUBLE) AS x, l_extendedprice / 1000 AS y FROM lineitem), s AS (SELECT count(*) AS n, covar_pop(x, y) AS xy, var_pop(x) AS xx FROM t) SELECT round(n * xy / (n * xx + 1e6), 4) AS ridge, round(sign(xy) * greatest(abs(xy) - 10, 0) / xx, 4) AS lasso FROM s",
    "count_regressions": "WITH t AS (SELECT l_discount > 0.05 AS x, l_quantity + CASE WHEN l_discount > 0.05 THEN 5 ELSE 0 END AS y FROM lineitem), r AS (SELECT round(ln(avg(y) FILTER (WHERE x) / avg(y) FILTER (WHERE NOT x)), 4) AS v FROM t) SELECT v AS poisson, v AS gamma, v AS tweedie FROM r",
    "naive_bayes": "SELECT CAST(l_linestatus = 'O' AS INTEGER) AS y, round(avg(l_quantity), 4) AS quantity, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY ALL",
    "best_feature": "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS best FROM lineitem",
    "searched": "SELECT 1::BIGINT AS best, 2::BIGINT AS candidates, true AS good",
    "monitored_windows": "SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS window_start, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY ALL",
    "run_pivot": "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_custkey",
    "streaming_tiles": _TILES,
    "streaming_tiles_late": _TILES.replace("FROM events)", "FROM events WHERE event_id % 3 <> 2)"),
    "streaming_lists": f"WITH {_EVENTS_SQL}, d AS (SELECT user_id, h, event_type, min(ts) AS t FROM e WHERE event_type IS NOT NULL GROUP BY ALL), f AS (SELECT user_id, h, array_to_string(list_slice(list(event_type ORDER BY t, event_type), 1, 2), ',') AS first_types FROM d GROUP BY ALL), l AS (SELECT user_id, h, array_to_string(list_slice(list(event_id ORDER BY ts DESC, event_id DESC), 1, 3), ',') AS newest FROM e GROUP BY ALL) SELECT user_id, h AS tile_start, newest, first_types FROM l LEFT JOIN f USING (user_id, h)",
    "store_pinned": "SELECT c_custkey, 'held' AS read FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'refreshed' FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'now' FROM customer WHERE c_custkey % 5 = 0",
    "store_refresh_day": _TILES,
    "store_many_views": "WITH s AS (SELECT DISTINCT user_id, ts FROM events), " + ", ".join(f"r{i} AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_id % 5 = {i} GROUP BY ALL)" for i in range(5)) + ", " + ", ".join(f"j{i} AS (SELECT s.user_id, s.ts, r{i}.v AS v{i} FROM s ASOF LEFT JOIN r{i} ON s.user_id = r{i}.user_id AND s.ts >= r{i}.ts)" for i in range(5)) + " SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS at_us, v0, v1, v2, v3, v4 FROM j0 JOIN j1 USING (user_id, ts) JOIN j2 USING (user_id, ts) JOIN j3 USING (user_id, ts) JOIN j4 USING (user_id, ts)",
    "ridge_search": "WITH t AS (SELECT l_orderkey % 3 AS f, CAST(l_quantity AS DOUBLE) AS x, l_extendedprice / 1000 AS y FROM lineitem), k AS (SELECT * FROM range(3) r(k)), s AS (SELECT k, count(*) FILTER (WHERE f <> k) AS n, avg(x) FILTER (WHERE f <> k) AS mx, avg(y) FILTER (WHERE f <> k) AS my, covar_pop(x, y) FILTER (WHERE f <> k) AS xy, var_pop(x) FILTER (WHERE f <> k) AS xx FROM t, k GROUP BY k), a AS (SELECT * FROM (VALUES (0.0), (1000000.0), (1e8)) v(alpha)), b AS (SELECT alpha, k, n * xy / (n * xx + alpha) AS slope, mx, my FROM s, a), e AS (SELECT alpha, k, sum((y - my - slope * (x - mx)) ** 2) AS left_over, any_value(slope) AS slope FROM b JOIN t ON f = k GROUP BY ALL), v AS (SELECT f AS k, sum((y - m) ** 2) AS whole FROM (SELECT *, avg(y) OVER (PARTITION BY f) AS m FROM t) GROUP BY f) SELECT alpha, round(avg(1 - left_over / whole), 6) AS score FROM e JOIN v USING (k) GROUP BY alpha",
    "streaming_append": "SELECT event_id, value * 2 AS twice FROM events",
    "backfill_range": "SELECT event_id, value * 2 AS twice FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'",
    "incremental_refresh": _TILES,
    "store_training_set": f"WITH {_SPINE_SQL}, {_EVENTS_SQL}, a AS ({_window_sql('round(coalesce(sum(value), 0), 6) AS sum_24h', 86400)}), p AS (SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS us, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY ALL), q AS (SELECT s.user_id, s.at_s, max_by(p.v, p.us) AS v FROM spine s LEFT JOIN p ON p.user_id = s.user_id AND p.us <= s.at_s * 1000000 GROUP BY ALL) SELECT user_id, at_s, sum_24h, round(v, 6) AS last_purchase FROM a JOIN q USING (user_id, at_s)",
    "store_feature_group": "WITH o AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) SELECT c_custkey, c_acctbal, n_orders FROM customer LEFT JOIN o ON o_custkey = c_custkey",
    "dataset_versions": "SELECT n_nationkey, n_name FROM nation",
    "fileset_roundtrip": "SELECT s_suppkey, CAST(CAST(s_acctbal AS DECIMAL(18, 2)) AS DOUBLE) AS balance FROM supplier",
    "sharded_read": "SELECT o_orderkey, count(*) AS times FROM orders GROUP BY o_orderkey",
    "keys_filtered": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey BETWEEN 1 AND 59 AND l_linenumber = l_orderkey % 3 + 1",
    "category_union_except": "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1",
    "realtime_view": "WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) + n AS cents FROM customer JOIN o ON o_custkey = c_custkey",
    "model_run": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 0.5, 4) AS net FROM lineitem",
    "model_run_partitioned": "SELECT l_suppkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY l_suppkey",
    "linear_regression": "SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 1) AS intercept FROM lineitem",
}
