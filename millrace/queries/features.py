"""Queries over tiles, as-of joins, rollups and windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.intervals import from_seconds, seconds_of, slice_start
from millrace.operators.asof import asof_join, validity_join
from millrace.operators.prefix import ordered_index
from millrace.operators.tiles import Feature, TileSpec, build_tiles, continuous_features, merge_tiles, read_at, rollup_tiles
from millrace.operators.windows import carried_forward, over_time, top_n


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spine(events: DataFrame) -> DataFrame:
    """Each user at 08:30 of each day on which the user was seen."""
    day = slice_start(F.col("ts"), 86400)
    return events.select("user_id", from_seconds(day + 30_600).alias("at")).distinct()


_SPINE_SQL = "spine AS (SELECT DISTINCT user_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) + 30600 AS at_s FROM events)"
#: Boundary at 08:00, windows over whole hours.
_EVENTS_SQL = "e AS (SELECT user_id, event_type, value, event_id, ts, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS h FROM events)"


def _out(df: DataFrame) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c != "at"]
    return df.select(seconds_of(F.col("at")).alias("at_s"), *rounded)


def _tiled(spark: SparkSession, sf_dir: str, features: list[Feature], granularity: str = "1h", secondary: str | None = None) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    spec = TileSpec(("user_id",), "ts", granularity, tuple(features), secondary)
    return _out(merge_tiles(_spine(events), build_tiles(events, spec), spec, "at"))


def tiles_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = TileSpec(("user_id",), "ts", "1h", (Feature.sum("value", "24h"), Feature.count("value", "24h")))
    t = build_tiles(_table(spark, sf_dir, "events"), spec)
    return t.select("user_id", "tile_start", F.round("_sum_value", 6).alias("sum_value"), F.col("_count_value").alias("count_value"))


def tiled_sum_count_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiled(spark, sf_dir, [Feature.sum("value", "24h").alias("sum_24h"), Feature.count("value", "24h").alias("count_24h"), Feature.avg("value", "72h").alias("avg_72h")])


def tiled_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiled(spark, sf_dir, [Feature.min("value", "48h").alias("min_48h"), Feature.max("value", "48h").alias("max_48h")])


def tiled_stddev_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over whole cents, whose sums are exact in any order."""
    events = _table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    spec = TileSpec(("user_id",), "ts", "1h", (Feature.stddev("cents", "168h").alias("sd"), Feature.var("cents", "168h").alias("var")))
    return _out(merge_tiles(_spine(events), build_tiles(events, spec), spec, "at"))


def tiled_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiled(spark, sf_dir, [Feature.sum("value", "24h", "24h").alias("sum_before"), Feature.count("value", "24h", "48h").alias("count_before")])


def tiled_last_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiled(spark, sf_dir, [Feature.last_n("event_id", "72h", n=3).alias("last_ids"), Feature.first_n("event_id", "72h", n=3).alias("first_ids")]).select("user_id", "at_s", F.array_join("last_ids", ",").alias("last_ids"), F.array_join("first_ids", ",").alias("first_ids"))


def tiled_distinct_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiled(spark, sf_dir, [Feature.last_distinct_n("event_type", "168h", n=3).alias("last_types"), Feature.first_distinct_n("event_type", "168h", n=2).alias("first_types")]).select("user_id", "at_s", F.array_join("last_types", ",").alias("last_types"), F.array_join("first_types", ",").alias("first_types"))


def tiled_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiled(spark, sf_dir, [Feature.sum("value", "lifetime").alias("sum_all"), Feature.count("value", "lifetime").alias("count_all"), Feature.max("value", "lifetime").alias("max_all")])


def tiled_secondary_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _tiled(spark, sf_dir, [Feature.count("value", "72h").alias("counts"), Feature.max("value", "72h").alias("maxima")], secondary="event_type")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.6f", x.cast("double"))), ",")
    return df.select("user_id", "at_s", F.array_join("secondary_keys", ",").alias("event_types"), F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").alias("counts"), text("maxima").alias("maxima"))


def tiled_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiled(spark, sf_dir, [Feature.approx_count_distinct("event_type", "168h").alias("types")])


def tiled_approx_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiled(spark, sf_dir, [Feature.approx_percentile("value", "168h", percentile=0.9).alias("p90")])


def tiled_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    spec = TileSpec(("user_id",), "ts", "1m", (Feature.sum("value", "90m").alias("sum_90m"), Feature.count("value", "90m").alias("count_90m")), continuous=True)
    spine = events.select("user_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("at")).distinct()
    return _out(continuous_features(events, spine, spec, "at"))


def asof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event the latest order, as of its time, of the customer with the user's number."""
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("ts") - F.expr("interval 8000 days")).alias("t"))
    orders = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("o_t")).agg(F.max("o_totalprice").alias("price"))
    return asof_join(events, orders, ["user_id"], "t", "o_t", ["price"]).select("event_id", "user_id", "price")


def asof_previous_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict as-of join of the events with themselves: the latest event of the user before this one."""
    events = _table(spark, sf_dir, "events")
    right = events.groupBy("user_id", F.col("ts").alias("r_ts")).agg(F.max("value").alias("before"))
    return asof_join(events.select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "r_ts", ["before"], strict=True).select("event_id", "before")


def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two views on one spine: tiled sums, and the last purchase as of the spine's time."""
    events = _table(spark, sf_dir, "events")
    spine = _spine(events)
    spec = TileSpec(("user_id",), "ts", "1h", (Feature.sum("value", "24h").alias("sum_24h"), Feature.avg("value", "168h").alias("avg_168h")))
    buys = events.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("b_ts")).agg(F.max("value").alias("last_purchase"))
    return _out(asof_join(merge_tiles(spine, build_tiles(events, spec), spec, "at"), buys, ["user_id"], "at", "b_ts", ["last_purchase"]))


def rollup_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of customers' orders, rolled up to their nations."""
    orders = _table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    spec = TileSpec(("o_custkey",), "o_orderdate", "30d", (Feature.sum("o_totalprice", "30d"), Feature.count("o_totalprice", "30d"), Feature.max("o_totalprice", "30d")))
    mapping = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rolled = rollup_tiles(build_tiles(orders, spec), mapping, spec, ["c_nationkey"])
    return rolled.select("c_nationkey", "tile_start", F.round("_sum_o_totalprice", 2).alias("sum_price"), F.col("_count_o_totalprice").alias("n_orders"), F.col("_max_o_totalprice").alias("max_price"))


def _validity(customer: DataFrame) -> DataFrame:
    """Customers change from their segment to SEGMENT2 at 1996-01-01."""
    cut = F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")
    old = customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), F.lit("1900-01-01 00:00:00").cast("timestamp_ntz").alias("valid_from"), cut.alias("valid_to"))
    new = customer.select(F.col("c_custkey").alias("o_custkey"), F.concat("c_mktsegment", F.lit("2")).alias("segment"), cut.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    return old.unionByName(new)


def rollup_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with segments that hold for a time: tiles go to the segment valid at their start."""
    orders = _table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    spec = TileSpec(("o_custkey",), "o_orderdate", "1d", (Feature.sum("o_totalprice", "1d"), Feature.count("o_totalprice", "1d")))
    rolled = rollup_tiles(build_tiles(orders, spec), _validity(_table(spark, sf_dir, "customer")), spec, ["segment"], "valid_from", "valid_to")
    return rolled.groupBy("segment").agg(F.round(F.sum("_sum_o_totalprice"), 2).alias("sum_price"), F.sum("_count_o_totalprice").alias("n_orders"), F.count("*").alias("n_tiles"))


def scd2_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    joined = validity_join(orders, _validity(_table(spark, sf_dir, "customer")), ["o_custkey"], "o_orderdate", "valid_from", "valid_to")
    return joined.select("o_orderkey", "segment")


def range_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and mean over the hour up to each event, by user."""
    e = over_time(_table(spark, sf_dir, "events"), ["user_id"], "ts", 3600, {"sum_1h": F.sum("value"), "avg_1h": F.avg("value")})
    return e.select("event_id", F.round("sum_1h", 6).alias("sum_1h"), F.round("avg_1h", 6).alias("avg_1h"))


def running_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last purchase value carried forward over each user's events."""
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    return carried_forward(_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], bought, "last_purchase").select("event_id", "last_purchase")


def top_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(_table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2).select("o_custkey", "rank", "o_orderkey", "o_totalprice")


def category_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense rank of each category, the index that encoders use."""
    return ordered_index(_table(spark, sf_dir, "part"), "p_type").select("p_type", F.col("code").cast("int").alias("code"))


def rollup_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest and two oldest orders of each nation's tiles, out of its customers' tiles."""
    orders = _table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    spec = TileSpec(("o_custkey",), "o_orderdate", "30d", (Feature.last_n("o_orderkey", "30d", n=3), Feature.first_n("o_orderkey", "30d", n=2)))
    mapping = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rolled = rollup_tiles(build_tiles(orders, spec), mapping, spec, ["c_nationkey"])
    text = lambda name: F.array_join(F.transform(F.sort_array(name), lambda x: x["value"].cast("string")), ",")
    return rolled.select("c_nationkey", "tile_start", text("_last_n_o_orderkey").alias("newest"), text("_first_n_o_orderkey").alias("oldest"))


def rollup_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifetime features over rolled-up tiles, at the start of each year."""
    orders = _table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    features = (Feature.sum("o_totalprice", "lifetime").alias("sum_all"), Feature.count("o_totalprice", "lifetime").alias("n_all"))
    spec = TileSpec(("o_custkey",), "o_orderdate", "1d", features)
    mapping = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rolled = rollup_tiles(build_tiles(orders, spec), mapping, spec, ["c_nationkey"])
    years = F.explode(F.array(*[F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz") for y in range(1993, 1999)]))
    spine = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), years.alias("at"))
    out = merge_tiles(spine, rolled, TileSpec(("c_nationkey",), "o_orderdate", "1d", features), "at")
    return out.select("c_nationkey", seconds_of(F.col("at")).alias("at_s"), F.round("sum_all", 2).alias("sum_all"), "n_all")


def tiled_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current values of every user at one time."""
    spec = TileSpec(("user_id",), "ts", "1h", (Feature.sum("value", "240h").alias("sum_240h"), Feature.count("value", "240h").alias("count_240h")))
    out = read_at(build_tiles(_table(spark, sf_dir, "events"), spec), spec, F.lit("2024-01-20 12:30:00"))
    return out.select("user_id", F.round("sum_240h", 6).alias("sum_240h"), "count_240h")


def tiled_long_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of many tiles over whole cents, taken as differences of running sums."""
    events = _table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    spec = TileSpec(("user_id",), "ts", "1h", (Feature.sum("cents", "480h").alias("sum_480h"), Feature.count("cents", "240h", "48h").alias("count_before"), Feature.avg("cents", "240h").alias("avg_240h")))
    return _out(merge_tiles(_spine(events), build_tiles(events, spec), spec, "at"))


def asof_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event the latest value of each column of the user's earlier events by itself, nulls passed over."""
    events = _table(spark, sf_dir, "events")
    right = events.select("user_id", F.col("ts").alias("r_ts"), F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("bought"), F.when(F.col("event_type") == "click", F.col("event_id")).alias("clicked"))
    right = right.groupBy("user_id", "r_ts").agg(F.max("bought").alias("bought"), F.max("clicked").alias("clicked"))
    return asof_join(events.select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "r_ts", ["bought", "clicked"], strict=True, per_column=True).select("event_id", "bought", "clicked")


def _window_sql(parts: str, low: int, high: int = 0) -> str:
    """An aggregate over complete hours in [B - low, B - high), B = 08:00 of the spine's day (08:30 cut to the hour)."""
    return f"SELECT s.user_id, s.at_s, {parts} FROM spine s LEFT JOIN e ON e.user_id = s.user_id AND e.h >= s.at_s - 1800 - {low} AND e.h < s.at_s - 1800 - {high} GROUP BY s.user_id, s.at_s"


_WITH = f"WITH {_SPINE_SQL}, {_EVENTS_SQL} "
QUERIES = {
    f.__name__: f
    for f in (
        tiles_hourly, tiled_sum_count_avg, tiled_min_max, tiled_stddev_var, tiled_offset, tiled_last_first_n, tiled_distinct_n, tiled_lifetime, tiled_secondary_key, tiled_approx_distinct, tiled_approx_percentile,
        tiled_continuous, asof_orders, asof_previous_event, training_set, rollup_segments, rollup_validity, scd2_join, range_window, running_fill, top_n_per_group, category_index,
        rollup_lists, rollup_lifetime, tiled_now, tiled_long_windows, asof_filled,
    )
}

ORACLES = {
    "tiles_hourly": f"WITH {_EVENTS_SQL} SELECT user_id, h AS tile_start, round(sum(value), 6) AS sum_value, count(value) AS count_value FROM e GROUP BY user_id, h",
    "tiled_sum_count_avg": _WITH + f", a AS ({_window_sql('round(coalesce(sum(value), 0), 6) AS sum_24h, count(value) AS count_24h', 86400)}), b AS ({_window_sql('round(avg(value), 6) AS avg_72h', 259200)}) SELECT user_id, at_s, sum_24h, count_24h, avg_72h FROM a JOIN b USING (user_id, at_s)",
    "tiled_min_max": _WITH + _window_sql("min(value) AS min_48h, max(value) AS max_48h", 172800),
    "tiled_stddev_var": _WITH + ", c AS (SELECT user_id, h, CAST(round(value * 100) AS BIGINT) AS cents FROM e), m AS (SELECT s.user_id, s.at_s, sum(CAST(cents AS DOUBLE)) AS t, sum(CAST(cents AS DOUBLE) * cents) AS q, CAST(count(cents) AS DOUBLE) AS n FROM spine s LEFT JOIN c ON c.user_id = s.user_id AND c.h >= s.at_s - 1800 - 604800 AND c.h < s.at_s - 1800 GROUP BY s.user_id, s.at_s), v AS (SELECT user_id, at_s, CASE WHEN n > 0 THEN greatest(q / n - (t / n) * (t / n), 0) END AS var FROM m) SELECT user_id, at_s, round(sqrt(var), 6) AS sd, round(var, 6) AS var FROM v",
    "tiled_offset": _WITH + f", a AS ({_window_sql('round(coalesce(sum(value), 0), 6) AS sum_before', 172800, 86400)}), b AS ({_window_sql('count(value) AS count_before', 259200, 172800)}) SELECT user_id, at_s, sum_before, count_before FROM a JOIN b USING (user_id, at_s)",
    "tiled_last_first_n": _WITH + _window_sql("array_to_string(list_reverse(list_slice(list(event_id ORDER BY ts DESC, event_id DESC) FILTER (WHERE event_id IS NOT NULL), 1, 3)), ',') AS last_ids, array_to_string(list_slice(list(event_id ORDER BY ts, event_id) FILTER (WHERE event_id IS NOT NULL), 1, 3), ',') AS first_ids", 259200),
    "tiled_distinct_n": _WITH + ", d AS (SELECT s.user_id, s.at_s, e.event_type, max(e.ts) AS newest, min(e.ts) AS oldest FROM spine s JOIN e ON e.user_id = s.user_id AND e.h >= s.at_s - 1800 - 604800 AND e.h < s.at_s - 1800 WHERE e.event_type IS NOT NULL GROUP BY ALL), g AS (SELECT user_id, at_s, array_to_string(list_reverse(list_slice(list(event_type ORDER BY newest DESC, event_type DESC), 1, 3)), ',') AS last_types, array_to_string(list_slice(list(event_type ORDER BY oldest, event_type), 1, 2), ',') AS first_types FROM d GROUP BY user_id, at_s) SELECT s.user_id, s.at_s, last_types, first_types FROM spine s LEFT JOIN g USING (user_id, at_s)",
    "tiled_lifetime": _WITH + "SELECT s.user_id, s.at_s, round(sum(value), 6) AS sum_all, CASE WHEN count(e.h) > 0 THEN count(value) END AS count_all, max(value) AS max_all FROM spine s LEFT JOIN e ON e.user_id = s.user_id AND e.h + 3600 <= s.at_s - 1800 GROUP BY s.user_id, s.at_s",
    "tiled_secondary_key": _WITH + ", d AS (SELECT s.user_id, s.at_s, e.event_type, count(value) AS n, max(value) AS m FROM spine s JOIN e ON e.user_id = s.user_id AND e.h >= s.at_s - 1800 - 259200 AND e.h < s.at_s - 1800 GROUP BY ALL), g AS (SELECT user_id, at_s, array_to_string(list(event_type ORDER BY event_type), ',') AS event_types, array_to_string(list(CAST(n AS VARCHAR) ORDER BY event_type), ',') AS counts, array_to_string(list(printf('%.6f', m) ORDER BY event_type), ',') AS maxima FROM d GROUP BY user_id, at_s) SELECT s.user_id, s.at_s, coalesce(event_types, '') AS event_types, coalesce(counts, '') AS counts, coalesce(maxima, '') AS maxima FROM spine s LEFT JOIN g USING (user_id, at_s)",
    "tiled_approx_distinct": _WITH + _window_sql("count(DISTINCT event_type) AS types", 604800),
    "tiled_approx_percentile": _WITH + _window_sql("round(quantile_disc(value, 0.9), 6) AS p90", 604800),
    "tiled_continuous": "WITH s AS (SELECT DISTINCT user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS at_s FROM events), e AS (SELECT user_id, value, epoch_us(ts) AS us FROM events) SELECT s.user_id, s.at_s, round(coalesce(sum(value), 0), 6) AS sum_90m, count(value) AS count_90m FROM s LEFT JOIN e ON e.user_id = s.user_id AND e.us > (s.at_s - 5400) * 1000000 AND e.us <= s.at_s * 1000000 GROUP BY s.user_id, s.at_s",
    "asof_orders": "WITH e AS (SELECT event_id, user_id, ts - INTERVAL 8000 DAY AS t FROM events), o AS (SELECT o_custkey AS user_id, o_orderdate AS o_t, max(o_totalprice) AS price FROM orders GROUP BY ALL) SELECT event_id, e.user_id, price FROM e ASOF LEFT JOIN o ON e.user_id = o.user_id AND e.t >= o.o_t",
    "asof_previous_event": "WITH r AS (SELECT user_id, ts, max(value) AS before FROM events GROUP BY ALL) SELECT e.event_id, r.before FROM events e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts > r.ts",
    "training_set": _WITH + f", a AS ({_window_sql('round(coalesce(sum(value), 0), 6) AS sum_24h', 86400)}), b AS ({_window_sql('round(avg(value), 6) AS avg_168h', 604800)}), p AS (SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS us, max(value) AS last_purchase FROM events WHERE event_type = 'purchase' GROUP BY ALL), q AS (SELECT s.user_id, s.at_s, max_by(p.last_purchase, p.us) AS last_purchase FROM spine s LEFT JOIN p ON p.user_id = s.user_id AND p.us <= s.at_s * 1000000 GROUP BY ALL) SELECT user_id, at_s, sum_24h, avg_168h, round(last_purchase, 6) AS last_purchase FROM a JOIN b USING (user_id, at_s) JOIN q USING (user_id, at_s)",
    "rollup_segments": "SELECT c_nationkey, CAST(floor(epoch(o_orderdate) / 2592000) AS BIGINT) * 2592000 AS tile_start, round(sum(o_totalprice), 2) AS sum_price, count(o_totalprice) AS n_orders, max(o_totalprice) AS max_price FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL",
    "rollup_validity": "WITH t AS (SELECT o_custkey, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) * 86400 AS d, sum(o_totalprice) AS s, count(o_totalprice) AS n FROM orders GROUP BY ALL), j AS (SELECT CASE WHEN d < epoch(TIMESTAMP '1996-01-01') THEN c_mktsegment ELSE c_mktsegment || '2' END AS segment, d, s, n FROM t JOIN customer ON c_custkey = o_custkey) SELECT segment, round(sum(s), 2) AS sum_price, CAST(sum(n) AS BIGINT) AS n_orders, count(DISTINCT d) AS n_tiles FROM j GROUP BY segment",
    "scd2_join": "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN c_mktsegment ELSE c_mktsegment || '2' END AS segment FROM orders JOIN customer ON c_custkey = o_custkey",
    "range_window": "WITH e AS (SELECT *, epoch_us(ts) AS us FROM events) SELECT event_id, round(sum(value) OVER w, 6) AS sum_1h, round(avg(value) OVER w, 6) AS avg_1h FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)",
    "rollup_lists": "SELECT c_nationkey, CAST(floor(epoch(o_orderdate) / 2592000) AS BIGINT) * 2592000 AS tile_start, array_to_string(list_reverse(list_slice(list(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC), 1, 3)), ',') AS newest, array_to_string(list_slice(list(o_orderkey ORDER BY o_orderdate, o_orderkey), 1, 2), ',') AS oldest FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL",
    "rollup_lifetime": "WITH y AS (SELECT make_timestamp(n, 1, 1, 0, 0, 0) AS moment FROM range(1993, 1999) t(n)), o AS (SELECT c_nationkey, o_orderdate, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey) SELECT n_nationkey AS c_nationkey, CAST(epoch(moment) AS BIGINT) AS at_s, round(sum(o_totalprice), 2) AS sum_all, CASE WHEN count(o_orderdate) > 0 THEN count(o_totalprice) END AS n_all FROM nation CROSS JOIN y LEFT JOIN o ON c_nationkey = n_nationkey AND date_trunc('day', o_orderdate) + INTERVAL 1 DAY <= moment GROUP BY ALL",
    "tiled_now": "WITH u AS (SELECT DISTINCT user_id FROM events), e AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10 12:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00') SELECT u.user_id, round(coalesce(sum(value), 0), 6) AS sum_240h, count(value) AS count_240h FROM u LEFT JOIN e USING (user_id) GROUP BY u.user_id",
    "tiled_long_windows": _WITH.replace("value, event_id", "CAST(round(value * 100) AS BIGINT) AS cents, value, event_id") + f", a AS ({_window_sql('CAST(coalesce(sum(cents), 0) AS BIGINT) AS sum_480h', 1728000)}), b AS ({_window_sql('count(cents) AS count_before', 1036800, 172800)}), c AS ({_window_sql('round(avg(cents), 6) AS avg_240h', 864000)}) SELECT user_id, at_s, sum_480h, count_before, avg_240h FROM a JOIN b USING (user_id, at_s) JOIN c USING (user_id, at_s)",
    "asof_filled": "WITH r AS (SELECT user_id, ts, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS bought, max(CASE WHEN event_type = 'click' THEN event_id END) AS clicked FROM events GROUP BY ALL), b AS (SELECT user_id, ts, bought FROM r WHERE bought IS NOT NULL), c AS (SELECT user_id, ts, clicked FROM r WHERE clicked IS NOT NULL), x AS (SELECT e.event_id, b.bought FROM events e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.ts > b.ts), y AS (SELECT e.event_id, c.clicked FROM events e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts > c.ts) SELECT event_id, bought, clicked FROM x JOIN y USING (event_id)",
    "running_fill": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events",
    "top_n_per_group": "SELECT o_custkey, CAST(rank AS INTEGER) AS rank, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2",
    "category_index": "SELECT p_type, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_type FROM part)",
}
