"""Queries over sources, store records, models and estimators that read the given tables, with their SQL."""

from __future__ import annotations

import json
import math
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.intervals import from_seconds, slice_start
from millrace.operators.metrics import covariance
from millrace.operators.preprocess import ColumnTransformer, MinMaxScaler, Pipeline, StandardScaler
from millrace.operators.tiles import Feature
from millrace.operators.windows import with_content_id
from millrace.plans.models import Experiments, Monitors, VectorTransformer, check_monitor_source, check_result, column_or_literal, drift, estimator, selector, validate_input, windowed_metrics
from millrace.plans.store import Entity, FeatureGroup, FeatureStore, FeatureView
from millrace.queries.features import _EVENTS_SQL, _SPINE_SQL, _window_sql
from millrace.queries.flows import _scratch, _table, _version
from millrace.sources.connector import DataConnector, check_not_null
from millrace.sources.dataset import Dataset, synthetic_rows
from millrace.sources.examples import load_sources


# --- sources and sinks


def connector_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders in three parts, from SQL, a dataset version and files, read as one source."""
    orders, path = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), _scratch(spark)
    check_not_null(orders, ["o_orderkey", "o_orderstatus"])
    orders.createOrReplaceTempView("connector_orders")
    version = Dataset(spark, path, "orders").create_version("v1", orders.where("o_orderkey % 3 = 1"))
    orders.where("o_orderkey % 3 = 2").write.parquet(f"{path}/files")
    both = DataConnector.from_sources([DataConnector.from_sql(spark, "SELECT * FROM connector_orders WHERE o_orderkey % 3 = 0"), DataConnector.from_dataset(version), DataConnector.from_files(spark, [f"{path}/files"])])
    return both.df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def connector_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by nation taken to pandas and Arrow and read back; the first rows alone as well."""
    by = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    frame, table = DataConnector(by).to_pandas(), DataConnector(by).to_arrow()
    head = DataConnector(by.orderBy("c_nationkey")).to_pandas(limit=3)
    read = {"pandas": spark.createDataFrame(frame), "arrow": DataConnector.from_arrow(spark, table).df, "head": spark.createDataFrame(head)}
    parts = [df.select(F.lit(k).alias("through"), "c_nationkey", "n") for k, df in read.items()]
    return parts[0].union(parts[1]).union(parts[2])


def declared_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables read by a declaration file."""
    path = _scratch(spark)
    listed = [{"name": n, "path": f"{sf_dir}/{n}.parquet", "format": "parquet"} for n in ("nation", "region")]
    spark.createDataFrame([(json.dumps(listed),)], "value string").coalesce(1).write.text(f"{path}/declared")
    found = load_sources(spark, spark.read.text(f"{path}/declared").inputFiles()[0])
    return found["nation"].join(found["region"], F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("nations"))


def synthetic_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many made-up rows as the table has, all within its ranges and of its values."""
    df = _table(spark, sf_dir, "supplier").select("s_acctbal", "s_name")
    fake = synthetic_rows(df, df.count(), seed=4)
    r = df.agg(F.min("s_acctbal"), F.max("s_acctbal")).first()
    known = fake.join(df.select("s_name").distinct(), "s_name", "left_semi")
    return known.agg(F.count("*").alias("known"), F.count_if(F.col("s_acctbal").between(r[0], r[1])).alias("in_range"))


def pushed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records pushed to a stream source, read back as a stream."""
    store, nation = FeatureStore(spark, _scratch(spark)), _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    source = store.register_stream_source("NATIONS", nation.schema)
    rows = [r.asDict() for r in nation.collect()]  # the push interface takes records; a table of 25
    for part in (rows[:10], rows[10:]):
        store.stream_ingest("NATIONS", part)
    out = f"{_scratch(spark)}/rows"
    query = source.read_stream(spark, max_files=1).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(nation.schema).parquet(out)


# --- the store


def _events_view(user: Entity, events: DataFrame, name: str = "SPEND", **more) -> FeatureView:
    return FeatureView(name, [user], timestamp_col="ts", refresh_freq="1h", feature_granularity="1h", features=[Feature.sum("value", "24h").alias("sum_24h"), Feature.count("value", "24h").alias("n_24h")], compute=lambda s: events, **more)


def store_saved_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training set without a column, saved as a table and read from there; of the view only one feature."""
    store, events = FeatureStore(spark, _scratch(spark)), _table(spark, sf_dir, "events")
    view = store.register_feature_view(_events_view(store.register_entity(Entity("USER", ("user_id",))), events))
    spine = events.select("user_id", from_seconds(slice_start(F.col("ts"), 86400) + 30_600).alias("at"), F.lit("x").alias("extra")).distinct()
    name = "saved_" + _scratch(spark)[-8:]
    saved = store.generate_training_set(spine, [view.slice(["n_24h"])], spine_timestamp_col="at", exclude_columns=["extra"], save_as=name)
    return saved.groupBy("user_id").agg(F.count("*").alias("days"), F.sum("n_24h").alias("events"))


def store_live_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view without data of its own, read by name in SQL, for some keys and one feature."""
    store = FeatureStore(spark, _scratch(spark))
    _table(spark, sf_dir, "orders").createOrReplaceTempView("live_orders")
    view = store.register_feature_view(FeatureView("LIVE_TOTALS", [store.register_entity(Entity("CUSTOMER", ("o_custkey",)))], query="SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM live_orders GROUP BY o_custkey"))
    again = store.get_feature_view("live_totals", "V1")
    by_sql = spark.table("`LIVE_TOTALS$V1`").where("o_custkey % 2 = 0").select("o_custkey", "most", F.lit("sql").alias("through"))
    return by_sql.union(store.read_feature_view(again, keys=[[k] for k in range(1, 40)], feature_names=["most"]).withColumn("through", F.lit("store")))


def store_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refreshes of an append-only view with the rows that each left, through a suspension; views, groups and sources that were deleted are gone."""
    clock = iter(datetime(2024, 1, d) for d in range(1, 29))
    store, customer = FeatureStore(spark, _scratch(spark), clock=lambda: next(clock), keep="365 days"), _table(spark, sf_dir, "customer")
    key, seen = store.register_entity(Entity("CUSTOMER", ("c_custkey",))), {"n": 0}
    rows = lambda s: customer.where(F.col("c_nationkey") == seen["n"]).select("c_custkey", F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"))
    view = store.register_feature_view(FeatureView("SNAP", [key], timestamp_col="ts", refresh_freq="1 day", append_only=True, compute=rows))
    for n in (1, 2):
        seen["n"] = n
        store.refresh_feature_view(view)
    store.suspend_feature_view(view)
    store.resume_feature_view(view)
    seen["n"] = 3
    store.refresh_feature_view(view)
    other = store.register_feature_view(FeatureView("GONE", [key], compute=lambda s: customer.select("c_custkey")))
    store.register_feature_group(FeatureGroup("GONE", [other]))
    store.delete_feature_group("GONE")
    store.delete_feature_view("GONE", "V1")
    held = [store.read_feature_view(view, version=i).agg(F.lit(i).cast("long").alias("refresh"), F.count("*").alias("rows")) for i in range(4)]
    counts = held[0].union(held[1]).union(held[2]).union(held[3])
    left = store.list_feature_views().count() + store.list_feature_groups().count()
    return store.get_refresh_history(view).join(counts, "refresh").select("name", "refresh", "rows", F.lit(left).cast("long").alias("views_and_groups"))


def store_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backfill that ends and one that fails: their states, and the rows of the first."""
    store, root = FeatureStore(spark, path := _scratch(spark)), path
    events = _table(spark, sf_dir, "events").select("event_id", "user_id")
    store.run_backfill("good", events.where("event_id % 2 = 0"))
    try:
        store.run_backfill("bad", events.select(F.raise_error(F.lit("bad")).cast("string").alias("x")))
    except Exception:  # the failure that this query is about
        pass
    states = F.lit(f"{store.backfill_state('good')}/{store.backfill_state('bad')}")
    return spark.read.parquet(f"{root}/backfill/GOOD").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", "n", states.alias("states"))


def store_reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The views that a dataset was made of, loaded from it by a store opened anew, give the same values again."""
    root, events = _scratch(spark), _table(spark, sf_dir, "events")
    store = FeatureStore(spark, root)
    view = store.register_feature_view(_events_view(store.register_entity(Entity("USER", ("user_id",))), events))
    spine = events.select("user_id", from_seconds(slice_start(F.col("ts"), 86400) + 30_600).alias("at")).distinct()
    store.generate_dataset("train", "v1", spine, [view], "at")
    again = FeatureStore(spark, root)
    views = again.load_feature_views_from_dataset(Dataset(spark, f"{root}/datasets", "train").version("v1"))
    return again.retrieve_feature_values(spine, views, "at").groupBy("user_id").agg(F.round(F.sum("sum_24h"), 4).alias("total"))


# --- models


def model_batch_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch run written as JSON lines and read back."""
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = _version(spark, df).run_batch(df, f"{_scratch(spark)}/out", format="json")
    return out.select("l_orderkey", "l_linenumber", F.round("net", 4).alias("net"))


def model_local_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas frame through a model comes back in its own order."""
    frame = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("l_extendedprice")).orderBy(F.desc("l_extendedprice"), "l_suppkey").limit(50).toPandas()  # 50 rows
    out = _version(spark, _table(spark, sf_dir, "lineitem")).run(frame[["l_suppkey", "l_extendedprice"]])
    return spark.createDataFrame([(i, int(k), round(float(v), 4)) for i, (k, v) in enumerate(zip(out.l_suppkey, out.net))], "place long, l_suppkey long, net double")


def input_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which whole-number types hold the keys of a table, by strict validation."""
    df, out = _table(spark, sf_dir, "orders").select("o_orderkey"), []
    for kind in ("tinyint", "smallint", "int", "bigint"):
        try:
            validate_input(df, spark.createDataFrame([], f"o_orderkey {kind}").schema, strict=True)
            out.append((kind, True))
        except ValueError:
            out.append((kind, False))
    return spark.createDataFrame(out, "kind string, fits boolean")


def pipeline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaling and a regression in one pipeline: predictions of price by quantity, and the inputs dropped."""
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    steps = Pipeline([("scale", StandardScaler(["l_quantity"], ["q"], drop_input_cols=True)), ("fit", estimator("LinearRegression", ["q"], ["l_extendedprice"], ["price"]))])
    out = steps.fit(df).predict(df)
    assert "l_quantity" not in out.columns
    return out.select("l_orderkey", "l_linenumber", F.round("price", 2).alias("price"))


def columns_scaled_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two transformers on columns of one table."""
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount")
    out = ColumnTransformer([("a", MinMaxScaler(["l_tax"], ["tax"])), ("b", MinMaxScaler(["l_discount"], ["discount"], feature_range=(0.0, 10.0)))]).fit_transform(df)
    return out.select("l_orderkey", "l_linenumber", F.round("tax", 6).alias("tax"), F.round("discount", 6).alias("discount"))


def monitored_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean error by month and segment of a prediction, on a source that was checked."""
    df = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("at"), "o_totalprice", (F.col("o_totalprice") * 1.5).alias("guess"), "o_orderstatus")
    check_monitor_source(df, "at", ["o_orderkey"], ["guess"], ["o_totalprice"], ["o_orderstatus"])
    return windowed_metrics(df, "at", "90 days", {"error": F.round(F.avg(F.abs(F.col("guess") - F.col("o_totalprice"))), 2)}, ["o_orderstatus"])


def population_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No drift of a column from itself, and that of its double: all in the upper bins."""
    df = _table(spark, sf_dir, "lineitem").select("l_quantity")
    return spark.createDataFrame([(round(drift(df, df, "l_quantity", bins=2), 6), round(drift(df, df.select((F.col("l_quantity") + 1000).alias("l_quantity")), "l_quantity", bins=2), 2))], "same double, moved double")


def monitored_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline that a monitor kept, against itself and against rows of which the cheap half is gone."""
    monitors, df = Monitors(spark, _scratch(spark)), _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.lit("2024-01-01").cast("timestamp_ntz").alias("at"))
    monitors.register("quantity", df, "at", ["l_orderkey"], ["l_quantity"], bins=2)
    moved = df.where(F.col("l_quantity") >= df.agg(F.expr("percentile(l_quantity, 0.5)")).first()[0])
    return spark.createDataFrame([(round(monitors.drift("quantity", df)["l_quantity"], 6), round(monitors.drift("quantity", moved)["l_quantity"], 2))], "same double, moved double")


def run_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each order status kept as a run's artifact, of which the later one counts."""
    runs = Experiments(spark, f"{_scratch(spark)}/runs")
    for r in _table(spark, sf_dir, "orders").groupBy("o_orderstatus").count().collect():  # three rows
        for text in ("draft", f"{r['count']} orders"):
            runs.log_artifact(r["o_orderstatus"], "report.txt", text.encode())
    return runs.artifacts().select("run", "name", F.col("content").cast("string").alias("content"))


def store_schema_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only view whose query gets a column more: the older batch has nulls there."""
    store, customer = FeatureStore(spark, _scratch(spark)), _table(spark, sf_dir, "customer")
    day = F.lit("2024-01-01").cast("timestamp_ntz").alias("ts")
    key = store.register_entity(Entity("CUSTOMER", ("c_custkey",)))
    store.register_feature_view(FeatureView("SNAP", [key], timestamp_col="ts", refresh_freq="1 day", append_only=True, compute=lambda s: customer.where("c_custkey % 2 = 0").select("c_custkey", day)))
    view = store.update_feature_view("SNAP", "V1", desc="wider", compute=lambda s: customer.where("c_custkey % 3 = 0").select("c_custkey", day, "c_mktsegment"))
    store.refresh_feature_view(view)
    return store.read_feature_view(view).groupBy("c_custkey").agg(F.count("*").alias("times"), F.count("c_mktsegment").alias("known"))


def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from rows' values are the same however the rows are dealt out, and differ between equal rows."""
    df = _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    # ids compress so well that adaptive execution, which goes by bytes written, would give millions of them to one task
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() >> 20)
    one, two = (with_content_id(d).repartition(parts, "row_id") for d in (df, df.repartition(7, "l_quantity")))
    return one.join(two.select("row_id"), "row_id").groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.count_distinct("row_id").alias("ids"))


def single_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result whose shape was checked, with a column by name and literals of three kinds."""
    one = check_result(_table(spark, sf_dir, "orders").agg(F.sum("o_custkey").alias("total")), single=True)
    return check_result(one.select(column_or_literal("total").alias("total"), column_or_literal("'text'").alias("text"), column_or_literal(2).alias("two")), rows=1, columns=["total", "text", "two"])


# --- estimators


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", (F.col("l_quantity") > 25).cast("double").alias("y"))


def classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of classifiers on a label that one threshold decides: the rows on which each is right."""
    df = _labelled(spark, sf_dir).cache()
    trees = {"maxBins": 64, "seed": 1}
    families = {"DecisionTreeClassifier": trees, "RandomForestClassifier": trees | {"numTrees": 3, "featureSubsetStrategy": "all"}, "GradientBoostingClassifier": trees | {"maxIter": 2}, "HistGradientBoostingClassifier": {"maxIter": 2, "seed": 1}}
    out = []
    for name, params in families.items():
        fitted = estimator(name, ["l_quantity", "l_tax"], ["y"], ["guess"], **params).fit(df)
        out.append((name, fitted.predict(df).where("guess = y").count(), fitted.score(df)))
    df.unpersist()
    return spark.createDataFrame(out, "family string, right long, score double")


def linear_classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families that part classes by a plane, on classes far apart: the rows on which each is right."""
    y = (F.col("l_quantity") > 25).cast("double")
    df = _table(spark, sf_dir, "lineitem").select((y * 4 - 2 + F.col("l_discount")).alias("x"), F.col("l_tax"), y.alias("y")).cache()
    families = {"LogisticRegression": {}, "LinearSVC": {"maxIter": 20}, "OneVsRestClassifier": {}, "MLPClassifier": {"layers": [2, 3, 2], "seed": 1, "maxIter": 60}}
    out = [(n, estimator(n, ["x", "l_tax"], ["y"], ["guess"], **p).fit_predict(df).where("guess = y").count()) for n, p in families.items()]
    df.unpersist()
    return spark.createDataFrame(out, "family string, right long")


def regressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of trees on a value that one threshold decides: the largest error of each."""
    df = _labelled(spark, sf_dir).cache()
    trees = {"maxBins": 64, "seed": 1}
    families = {"DecisionTreeRegressor": trees, "RandomForestRegressor": trees | {"numTrees": 3, "featureSubsetStrategy": "all"}, "GradientBoostingRegressor": trees | {"maxIter": 2}, "HistGradientBoostingRegressor": {"maxIter": 2, "seed": 1}, "HuberRegressor": {}}
    out = [(n, float(estimator(n, ["l_quantity"] if n != "HuberRegressor" else ["y2"], ["y"], ["guess"], **p).fit(d).predict(d).agg(F.round(F.max(F.abs(F.col("guess") - F.col("y"))), 4)).first()[0]) + 0.0) for n, p in families.items() for d in [df.withColumn("y2", F.col("y") * 3 + 1)]]
    df.unpersist()
    return spark.createDataFrame(out, "family string, error double")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of two groups far apart, by three ways of clustering."""
    df = _table(spark, sf_dir, "orders").select((F.when(F.col("o_orderstatus") == "F", 100.0).otherwise(0.0) + F.col("o_orderkey") % 7 / 10).alias("x")).cache()
    out = []
    for name in ("KMeans", "BisectingKMeans", "GaussianMixture"):
        sizes = sorted(r["count"] for r in estimator(name, ["x"], None, ["group"], k=2, seed=3).fit_predict(df).groupBy("group").count().collect())
        out.append((name, sizes[0], sizes[-1]))
    df.unpersist()
    return spark.createDataFrame(out, "family string, small long, large long")


def bayes_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed shares of the classes by the kinds of naive Bayes over counts."""
    df = _labelled(spark, sf_dir).withColumn("even", (F.col("l_quantity") % 2).cast("double"))
    families = {"MultinomialNB": ["l_quantity", "even"], "BernoulliNB": ["even"]}
    out = []
    for name, columns in families.items():
        m = estimator(name, columns, ["y"]).fit(df).model
        out += [(name, k, round(math.exp(float(m.pi[k])), 6)) for k in range(2)]
    return spark.createDataFrame(out, "family string, y int, share double")


def elastic_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slope that both penalties leave on one feature."""
    df = _table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    m = estimator("ElasticNet", ["x"], ["y"], alpha=20.0, l1_ratio=0.25).fit(df).model
    return spark.createDataFrame([(round(float(m.coefficients[0]), 4),)], "slope double")


def principal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of variance of the two principal axes, the covariance that they come from, and which columns vary enough."""
    from pyspark.ml.feature import PCA, VarianceThresholdSelector

    df = _table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"))
    pca = VectorTransformer(PCA(k=2), ["a", "b"], "axis", input_param="inputCol").fit(df)
    kept = VectorTransformer(VarianceThresholdSelector(varianceThreshold=50.0), ["a", "l_tax"], "kept", input_param="featuresCol").fit(_table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("a"), "l_tax"))
    c = covariance(df, ["a", "b"])
    return spark.createDataFrame([(round(float(pca.model.explainedVariance[0]), 6), round(float(c[0, 1]), 4), kept.size)], "first_share double, cov double, kept long")


def feature_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By each rule, whether the column that the label follows is the one that is kept."""
    df = _table(spark, sf_dir, "lineitem").select("l_tax", "l_quantity", (F.col("l_quantity") > 25).cast("int").alias("y"))
    rules = {"SelectPercentile": 0.5, "SelectFpr": 1e-30, "SelectFdr": 1e-30, "SelectFwe": 1e-30, "GenericUnivariateSelect:numTopFeatures": 1}
    out = None
    for name, threshold in rules.items():
        kept = selector(name, threshold, ["l_tax", "l_quantity"], "y", output="best").fit(df).transform(df)
        one = kept.agg(F.lit(name).alias("rule"), F.sum("best_0").cast("long").alias("total"))
        out = one if out is None else out.union(one)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        connector_sources, connector_frames, declared_tables, synthetic_ranges, pushed_events, store_saved_set, store_live_view, store_history, store_backfill, store_reloaded,
        model_batch_run, model_local_order, input_ranges, pipeline_predictions, columns_scaled_apart, monitored_errors, monitored_drift, run_artifacts, store_schema_change, content_ids, population_drift, single_result,
        classifiers, linear_classifiers, regressors, clusters, bayes_priors, elastic_net, principal_axes, feature_selectors,
    )
}

_DAYS = f"WITH {_SPINE_SQL}, {_EVENTS_SQL}, "
ORACLES = {
    "connector_sources": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL",
    "connector_frames": "WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL) SELECT 'pandas' AS through, * FROM n UNION ALL SELECT 'arrow', * FROM n UNION ALL (SELECT 'head', * FROM n ORDER BY c_nationkey LIMIT 3)",
    "declared_tables": "SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "synthetic_ranges": "SELECT count(*) AS known, count(*) AS in_range FROM supplier",
    "pushed_events": "SELECT n_nationkey, n_name FROM nation",
    "store_saved_set": _DAYS + f"a AS ({_window_sql('count(value) AS n', 86400)}) SELECT user_id, count(*) AS days, CAST(sum(n) AS BIGINT) AS events FROM a GROUP BY user_id",
    "store_live_view": "WITH t AS (SELECT o_custkey, max(o_totalprice) AS most FROM orders GROUP BY ALL) SELECT *, 'sql' AS through FROM t WHERE o_custkey % 2 = 0 UNION ALL SELECT *, 'store' FROM t WHERE o_custkey BETWEEN 1 AND 39",
    "store_history": "SELECT 'SNAP$V1' AS name, i AS refresh, (SELECT count(*) FROM customer WHERE c_nationkey <= i) AS rows, 1::BIGINT AS views_and_groups FROM range(4) t(i)",
    "store_backfill": "SELECT user_id, count(*) AS n, 'COMPLETED/FAILED' AS states FROM events WHERE event_id % 2 = 0 GROUP BY ALL",
    "store_reloaded": _DAYS + f"a AS ({_window_sql('coalesce(sum(value), 0) AS s', 86400)}) SELECT user_id, round(sum(s), 4) AS total FROM a GROUP BY user_id",
    "model_batch_run": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 0.5, 4) AS net FROM lineitem",
    "model_local_order": "WITH m AS (SELECT l_suppkey, max(l_extendedprice) AS p FROM lineitem GROUP BY ALL) SELECT row_number() OVER (ORDER BY p DESC, l_suppkey) - 1 AS place, l_suppkey, round(p * 0.5, 4) AS net FROM m ORDER BY p DESC, l_suppkey LIMIT 50",
    "input_ranges": "SELECT kind, (SELECT max(abs(o_orderkey)) FROM orders) < most AS fits FROM (VALUES ('tinyint', 128::HUGEINT), ('smallint', 32768), ('int', 2147483648), ('bigint', 9223372036854775808)) t(kind, most)",
    "pipeline_predictions": "WITH r AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, round(a * l_quantity + b, 2) AS price FROM lineitem, r",
    "columns_scaled_apart": "WITH r AS (SELECT min(l_tax) AS a, max(l_tax) AS b, min(l_discount) AS c, max(l_discount) AS d FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_tax - a) / (b - a), 6) AS tax, round((l_discount - c) / (d - c) * 10, 6) AS discount FROM lineitem, r",
    "monitored_errors": "SELECT CAST(floor(epoch(o_orderdate) / 7776000) AS BIGINT) * 7776000 AS window_start, o_orderstatus, round(avg(abs(o_totalprice * 1.5 - o_totalprice)), 2) AS error FROM orders GROUP BY ALL",
    "population_drift": "WITH m AS (SELECT quantile_cont(l_quantity, 0.5) AS m FROM lineitem), s AS (SELECT avg(CAST(l_quantity < m AS INTEGER)) AS p FROM lineitem, m) SELECT 0.0::DOUBLE AS same, round((1e-4 - p) * ln(1e-4 / p) + p * ln(1 / (1 - p)), 2) AS moved FROM s",
    "monitored_drift": "WITH m AS (SELECT quantile_cont(l_quantity, 0.5) AS m FROM lineitem), s AS (SELECT avg(CAST(l_quantity < m AS INTEGER)) AS p FROM lineitem, m) SELECT 0.0::DOUBLE AS same, round((1e-4 - p) * ln(1e-4 / p) + p * ln(1 / (1 - p)), 2) AS moved FROM s",
    "run_artifacts": "SELECT o_orderstatus AS run, 'report.txt' AS name, count(*) || ' orders' AS content FROM orders GROUP BY ALL",
    "store_schema_change": "SELECT c_custkey, CAST(c_custkey % 2 = 0 AS BIGINT) + CAST(c_custkey % 3 = 0 AS BIGINT) AS times, CAST(c_custkey % 3 = 0 AS BIGINT) AS known FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
    "content_ids": "SELECT l_returnflag, count(*) AS rows, count(*) AS ids FROM lineitem GROUP BY ALL",
    "single_result": "SELECT CAST(sum(o_custkey) AS BIGINT) AS total, 'text' AS text, 2 AS two FROM orders",
    "classifiers": "SELECT family, (SELECT count(*) FROM lineitem) AS right, 1.0::DOUBLE AS score FROM (VALUES ('DecisionTreeClassifier'), ('RandomForestClassifier'), ('GradientBoostingClassifier'), ('HistGradientBoostingClassifier')) t(family)",
    "linear_classifiers": "SELECT family, (SELECT count(*) FROM lineitem) AS right FROM (VALUES ('LogisticRegression'), ('LinearSVC'), ('OneVsRestClassifier'), ('MLPClassifier')) t(family)",
    "regressors": "SELECT family, 0.0::DOUBLE AS error FROM (VALUES ('DecisionTreeRegressor'), ('RandomForestRegressor'), ('GradientBoostingRegressor'), ('HistGradientBoostingRegressor'), ('HuberRegressor')) t(family)",
    "clusters": "WITH n AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS a, count(*) FILTER (WHERE o_orderstatus <> 'F') AS b FROM orders) SELECT family, least(a, b) AS small, greatest(a, b) AS large FROM n, (VALUES ('KMeans'), ('BisectingKMeans'), ('GaussianMixture')) t(family)",
    "bayes_priors": "WITH n AS (SELECT CAST(l_quantity > 25 AS INTEGER) AS y, count(*) AS n FROM lineitem GROUP BY ALL) SELECT family, y, round((n + 1.0) / (sum(n) OVER (PARTITION BY family) + 2), 6) AS share FROM n, (VALUES ('MultinomialNB'), ('BernoulliNB')) t(family)",
    "elastic_net": "WITH t AS (SELECT CAST(l_quantity AS DOUBLE) AS x, l_extendedprice / 1000 AS y FROM lineitem), s AS (SELECT covar_pop(x, y) AS xy, var_pop(x) AS xx FROM t) SELECT round(sign(xy) * greatest(abs(xy) - 5, 0) / (xx + 15), 4) AS slope FROM s",
    "principal_axes": "WITH s AS (SELECT var_samp(CAST(l_quantity AS DOUBLE)) AS a, var_samp(l_extendedprice / 1000) AS b, covar_samp(CAST(l_quantity AS DOUBLE), l_extendedprice / 1000) AS c FROM lineitem) SELECT round(((a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c)) / (a + b), 6) AS first_share, round(c, 4) AS cov, 1::BIGINT AS kept FROM s",
    "feature_selectors": "SELECT rule, (SELECT CAST(sum(l_quantity) AS BIGINT) FROM lineitem) AS total FROM (VALUES ('SelectPercentile'), ('SelectFpr'), ('SelectFdr'), ('SelectFwe'), ('GenericUnivariateSelect:numTopFeatures')) t(rule)",
}
