"""Queries over preprocessing and metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import metrics as M
from millrace.operators import preprocess as P


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


def _scaled(df: DataFrame, t: P.Transformer) -> DataFrame:
    out = t.fit(df).transform(df)
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in t.output_cols])


_IN, _OUT = ["l_quantity", "l_discount"], ["q", "d"]


def standard_scaler(spark, sf_dir):
    return _scaled(_lines(spark, sf_dir), P.StandardScaler(_IN, _OUT))


def min_max_scaler(spark, sf_dir):
    return _scaled(_lines(spark, sf_dir), P.MinMaxScaler(_IN, _OUT, feature_range=(-1, 1)))


def max_abs_scaler(spark, sf_dir):
    return _scaled(_lines(spark, sf_dir), P.MaxAbsScaler(_IN, _OUT))


def robust_scaler(spark, sf_dir):
    return _scaled(_lines(spark, sf_dir), P.RobustScaler(_IN, _OUT))


def normalizer(spark, sf_dir):
    return _scaled(_lines(spark, sf_dir), P.Normalizer(_IN, _OUT))


def binarizer(spark, sf_dir):
    return _scaled(_lines(spark, sf_dir), P.Binarizer(_IN, _OUT, threshold=0.05))


def k_bins_uniform(spark, sf_dir):
    return _scaled(_lines(spark, sf_dir), P.KBinsDiscretizer(_IN, _OUT, n_bins=4, strategy="uniform"))


def k_bins_quantile(spark, sf_dir):
    return _scaled(_lines(spark, sf_dir), P.KBinsDiscretizer(["l_quantity"], ["q"], n_bins=4))


def ordinal_encoder(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return P.OrdinalEncoder(["o_orderpriority", "o_orderstatus"], ["priority", "status"]).fit_transform(df).select("o_orderkey", "priority", "status")


def label_encoder(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"))
    return P.LabelEncoder("segment", "code").fit_transform(df).select("c_custkey", "code")


def one_hot_encoder(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    t = P.OneHotEncoder(["o_orderstatus"], ["status"]).fit(df)
    out = t.transform(df)
    return out.select("o_orderkey", F.col("status_F").alias("f"), F.col("status_O").alias("o"), F.col("status_P").alias("p"))


def one_hot_infrequent(spark, sf_dir):
    """The two most frequent types by count, then name; all others share a column."""
    df = _table(spark, sf_dir, "part").select("p_partkey", "p_type")
    t = P.OneHotEncoder(["p_type"], ["type"], max_categories=3).fit(df)
    return t.transform(df).select("p_partkey", F.col("type__INFREQUENT").alias("infrequent"))


def simple_imputer(spark, sf_dir):
    df = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0.02, F.col("l_quantity")).alias("l_quantity"))
    return _scaled(df, P.SimpleImputer(["l_quantity"], ["q"], strategy="median"))


def imputer_most_frequent(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"))
    return P.SimpleImputer(["segment"], ["filled"], strategy="most_frequent").fit_transform(df).select("c_custkey", "filled")


def missing_indicator(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"))
    return P.MissingIndicator(["segment"], ["missing"]).fit_transform(df).select("c_custkey", "missing")


def polynomial_features(spark, sf_dir):
    df = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"))
    out = P.PolynomialFeatures(["a", "b"], include_bias=False).transform(df)
    return out.select("l_orderkey", "l_linenumber", F.round("a^2", 6).alias("aa"), F.round("a b", 6).alias("ab"), F.round("b^2", 6).alias("bb"))


def column_statistics(spark, sf_dir):
    df = P.column_statistics(_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return df.select("column", F.col("count").cast("long").alias("n"), "max", F.round("mean", 6).alias("mean"), "median", "min", F.round("stddev", 6).alias("stddev"), F.round("var_pop", 6).alias("var_pop"))


# --- metrics --------------------------------------------------------------------------------------------------


def _row(spark: SparkSession, **values: float) -> DataFrame:
    return spark.createDataFrame([tuple(round(float(v), 6) for v in values.values())], ", ".join(f"{k} double" for k in values))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a prediction and a score from the length of the text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    df = _table(spark, sf_dir, "labels").join(docs, "doc_id")
    return df.withColumn("pred", (F.col("n_chars") > 1500).cast("int")).withColumn("score", F.col("n_chars").cast("double")).withColumn("p", F.least(F.lit(0.9), F.greatest(F.lit(0.1), F.col("n_chars") / 10000.0)))


def accuracy(spark, sf_dir):
    return _row(spark, accuracy=M.accuracy_score(_judged(spark, sf_dir), "quality", "pred"))


def confusion(spark, sf_dir):
    return M.confusion_counts(_judged(spark, sf_dir), "quality", "pred").select("y_true", "y_pred", "weight")


def precision_recall_f1(spark, sf_dir):
    p, r, f, _ = M.precision_recall_fscore_support(_judged(spark, sf_dir), "quality", "pred", average="binary")
    return _row(spark, precision_=p, recall_=r, f1=f)


def fbeta_macro(spark, sf_dir):
    return _row(spark, f2=M.fbeta_score(_judged(spark, sf_dir), "quality", "pred", 2.0, average="macro"))


def log_loss(spark, sf_dir):
    return _row(spark, loss=M.log_loss(_judged(spark, sf_dir), "quality", "p"))


def roc_auc(spark, sf_dir):
    return _row(spark, auc=M.roc_auc_score(_judged(spark, sf_dir), "quality", "score"))


def roc_curve(spark, sf_dir):
    return M.roc_curve(_judged(spark, sf_dir), "quality", "score").where("threshold < 1e300").select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


def roc_corners(spark, sf_dir):
    """The ROC curve's start and the points that are no middle of a straight stretch."""
    c = M.roc_curve(_judged(spark, sf_dir), "quality", "score", drop_intermediate=True)
    return c.select(F.when(F.col("threshold") < 1e300, F.col("threshold")).alias("threshold"), F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


def partial_auc(spark, sf_dir):
    return _row(spark, auc=M.roc_auc_score(_judged(spark, sf_dir), "quality", "score", max_fpr=0.3))


def prf_averages(spark, sf_dir):
    """Micro and weighted averages of the F score over three classes."""
    df = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("y"), F.when(F.col("l_quantity") > 25, "N").when(F.col("l_linestatus") == "F", "A").otherwise("R").alias("p"))
    return _row(spark, micro=M.f1_score(df, "y", "p", "micro"), weighted=M.f1_score(df, "y", "p", "weighted"), weighted_recall=M.recall_score(df, "y", "p", "weighted"))


def prf_samples(spark, sf_dir):
    """Precision, recall and F of each row's set of labels, averaged over rows."""
    df = _table(spark, sf_dir, "lineitem").select((F.col("l_quantity") > 10).cast("int").alias("a"), (F.col("l_quantity") > 30).cast("int").alias("b"), (F.col("l_discount") > 0.03).cast("int").alias("c"), (F.col("l_tax") > 0.02).cast("int").alias("d"))
    p, r, f = M.samplewise_prf(df, ["a", "b"], ["c", "d"])
    return _row(spark, precision_=p, recall_=r, f1=f)


def log_loss_classes(spark, sf_dir):
    """Log loss over three classes with probabilities that don't add up to 1."""
    df = _table(spark, sf_dir, "lineitem").select("l_returnflag", ((F.col("l_quantity") + 1) / 60).alias("a"), (F.col("l_discount") + 0.1).alias("n"), (F.col("l_tax") + 0.2).alias("r"))
    return _row(spark, loss=M.log_loss(df, "l_returnflag", ["a", "n", "r"]))


def element_sums(spark, sf_dir):
    """Sums of an array's elements by their place, for each flag."""
    df = _table(spark, sf_dir, "lineitem").select("l_returnflag", F.array(F.round(F.col("l_quantity")).cast("long"), F.round(F.col("l_tax") * 100).cast("long")).alias("x"))
    return M.array_sums(df, "x", ["l_returnflag"]).select("l_returnflag", F.col("sums")[0].alias("quantity"), F.col("sums")[1].alias("tax"))


def ordinal_encoder_table(spark, sf_dir):
    """More categories than a literal map holds: names of customers, numbered as a table and joined."""
    df = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return P.OrdinalEncoder(["c_name"], ["code"]).fit_transform(df).select("c_custkey", "code")


def one_hot_sparse(spark, sf_dir):
    """The sparse form without the category F: place of the category and length."""
    df = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    out = P.OneHotEncoder(["o_orderstatus"], ["status"], sparse=True, drop=["F"]).fit_transform(df)
    return out.select("o_orderkey", F.coalesce(F.col("status")["0"], F.lit(0)).alias("o"), F.coalesce(F.col("status")["1"], F.lit(0)).alias("p"), F.col("status")["array_length"].alias("size"))


def k_bins_onehot(spark, sf_dir):
    """Bins of equal width as columns of 0 and 1."""
    out = P.KBinsDiscretizer(["l_quantity"], ["q"], n_bins=3, strategy="uniform", encode="onehot-dense").fit_transform(_lines(spark, sf_dir))
    return out.select("l_orderkey", "l_linenumber", "q_0", "q_1", "q_2")


def precision_recall_curve(spark, sf_dir):
    return M.precision_recall_curve(_judged(spark, sf_dir), "quality", "score").where("threshold is not null").select("threshold", F.round("precision", 6).alias("precision_"), F.round("recall", 6).alias("recall_"))


def _prices(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").where("l_quantity is not null")
    return df.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("f"), (1 + F.col("l_discount")).alias("w"))


def regression_errors(spark, sf_dir):
    df = _prices(spark, sf_dir)
    return _row(spark, mae=M.mean_absolute_error(df, "y", "f"), mape=M.mean_absolute_percentage_error(df, "y", "f"), rmse=M.mean_squared_error(df, "y", "f", squared=False), wmae=M.mean_absolute_error(df, "y", "f", sample_weight="w"))


def r2_and_variance(spark, sf_dir):
    df = _prices(spark, sf_dir)
    return _row(spark, r2=M.r2_score(df, "y", "f"), explained=M.explained_variance_score(df, "y", "f"))


def d2_scores(spark, sf_dir):
    df = _prices(spark, sf_dir)
    return _row(spark, d2_absolute=M.d2_absolute_error_score(df, "y", "f"), d2_pinball=M.d2_pinball_score(df, "y", "f", alpha=0.25))


def correlation(spark, sf_dir):
    m = M.correlation(_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return _row(spark, qp=m[0, 1], qd=m[0, 2], pd=m[1, 2])


def covariance(spark, sf_dir):
    m = M.covariance(_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return _row(spark, qq=m[0, 0], qd=m[0, 1], dt=m[1, 2])


QUERIES = {
    f.__name__: f
    for f in (
        standard_scaler, min_max_scaler, max_abs_scaler, robust_scaler, normalizer, binarizer, k_bins_uniform, k_bins_quantile, ordinal_encoder, label_encoder, one_hot_encoder, one_hot_infrequent,
        simple_imputer, imputer_most_frequent, missing_indicator, polynomial_features, column_statistics, accuracy, confusion, precision_recall_f1, fbeta_macro, log_loss, roc_auc, roc_curve,
        precision_recall_curve, regression_errors, r2_and_variance, d2_scores, correlation, covariance,
        roc_corners, partial_auc, prf_averages, prf_samples, log_loss_classes, element_sums, ordinal_encoder_table, one_hot_sparse, k_bins_onehot,
    )
}

_STATS = "WITH s AS (SELECT avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs, avg(l_discount) AS dm, stddev_pop(l_discount) AS ds, min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_discount) AS d0, max(l_discount) AS d1, max(abs(l_quantity)) AS qa, max(abs(l_discount)) AS da, quantile_cont(l_quantity, 0.5) AS qc, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS qr, quantile_cont(l_discount, 0.5) AS dc, quantile_cont(l_discount, 0.75) - quantile_cont(l_discount, 0.25) AS dr FROM lineitem) SELECT l_orderkey, l_linenumber, "
_JUDGED = "WITH j AS (SELECT l.quality, CAST(n_chars > 1500 AS INTEGER) AS pred, CAST(n_chars AS DOUBLE) AS score, least(0.9, greatest(0.1, n_chars / 10000.0)) AS p FROM labels l JOIN documents d USING (doc_id)) "
_CELLS = _JUDGED + ", c AS (SELECT CAST(sum(CASE WHEN quality = 1 AND pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN quality = 0 AND pred = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp, CAST(sum(CASE WHEN quality = 1 AND pred = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn, CAST(sum(CASE WHEN quality = 0 AND pred = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn FROM j) "
_CURVE = _JUDGED + ", g AS (SELECT score, CAST(sum(quality) AS DOUBLE) AS pos, CAST(sum(1 - quality) AS DOUBLE) AS neg FROM j GROUP BY score), r AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS rp, sum(neg) OVER (ORDER BY score DESC) AS rn, sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM g) "
_SEGMENT = "WITH s AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS segment FROM customer) "
_PRICES = "WITH t AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS f, 1 + l_discount AS w FROM lineitem WHERE l_quantity IS NOT NULL) "

ORACLES = {
    "standard_scaler": _STATS + "round((l_quantity - qm) / qs, 6) AS q, round((l_discount - dm) / ds, 6) AS d FROM lineitem, s",
    "min_max_scaler": _STATS + "round((l_quantity - q0) * (2 / (q1 - q0)) - 1, 6) AS q, round((l_discount - d0) * (2 / (d1 - d0)) - 1, 6) AS d FROM lineitem, s",
    "max_abs_scaler": _STATS + "round(l_quantity / qa, 6) AS q, round(l_discount / da, 6) AS d FROM lineitem, s",
    "robust_scaler": _STATS + "round((l_quantity - qc) / qr, 6) AS q, round((l_discount - dc) / dr, 6) AS d FROM lineitem, s",
    "normalizer": "SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity / nullif(sqrt(l_quantity * l_quantity + l_discount * l_discount), 0), 0), 6) AS q, round(coalesce(l_discount / nullif(sqrt(l_quantity * l_quantity + l_discount * l_discount), 0), 0), 6) AS d FROM lineitem",
    "binarizer": "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS q, CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS d FROM lineitem",
    "k_bins_uniform": _STATS + "CAST((l_quantity >= q0 + (q1 - q0) * 1 / 4)::INT + (l_quantity >= q0 + (q1 - q0) * 2 / 4)::INT + (l_quantity >= q0 + (q1 - q0) * 3 / 4)::INT AS DOUBLE) AS q, CAST((l_discount >= d0 + (d1 - d0) * 1 / 4)::INT + (l_discount >= d0 + (d1 - d0) * 2 / 4)::INT + (l_discount >= d0 + (d1 - d0) * 3 / 4)::INT AS DOUBLE) AS d FROM lineitem, s",
    "k_bins_quantile": "WITH s AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS e FROM lineitem) SELECT l_orderkey, l_linenumber, CAST((l_quantity >= e[1])::INT + (l_quantity >= e[2])::INT + (l_quantity >= e[3])::INT AS DOUBLE) AS q FROM lineitem, s",
    "ordinal_encoder": "WITH p AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS k FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)), s AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS k FROM (SELECT DISTINCT o_orderstatus AS v FROM orders)) SELECT o_orderkey, p.k AS priority, s.k AS status FROM orders JOIN p ON p.v = o_orderpriority JOIN s ON s.v = o_orderstatus",
    "label_encoder": _SEGMENT + ", k AS (SELECT segment AS v, CAST(row_number() OVER (ORDER BY segment) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT segment FROM s WHERE segment IS NOT NULL)) SELECT c_custkey, coalesce(code, (SELECT CAST(count(*) AS DOUBLE) FROM k)) AS code FROM s LEFT JOIN k ON v = segment",
    "one_hot_encoder": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f, CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS o, CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM orders",
    "one_hot_infrequent": "WITH c AS (SELECT p_type, row_number() OVER (ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY p_type) SELECT p_partkey, CASE WHEN r > 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS infrequent FROM part JOIN c USING (p_type)",
    "simple_imputer": "WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.02 THEN l_quantity END AS x FROM lineitem), m AS (SELECT quantile_cont(x, 0.5) AS v FROM t) SELECT l_orderkey, l_linenumber, coalesce(x, v) AS q FROM t, m",
    "imputer_most_frequent": _SEGMENT + ", m AS (SELECT segment AS v FROM s WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1) SELECT c_custkey, coalesce(segment, v) AS filled FROM s, m",
    "missing_indicator": _SEGMENT + "SELECT c_custkey, segment IS NULL AS missing FROM s",
    "polynomial_features": "SELECT l_orderkey, l_linenumber, round(l_quantity * l_quantity, 6) AS aa, round(l_quantity * l_discount, 6) AS ab, round(l_discount * l_discount, 6) AS bb FROM lineitem",
    "column_statistics": "SELECT 'l_quantity' AS \"column\", count(l_quantity) AS n, max(l_quantity) AS max, round(avg(l_quantity), 6) AS mean, quantile_cont(l_quantity, 0.5) AS median, min(l_quantity) AS min, round(stddev_samp(l_quantity), 6) AS stddev, round(var_pop(l_quantity), 6) AS var_pop FROM lineitem UNION ALL SELECT 'l_discount', count(l_discount), max(l_discount), round(avg(l_discount), 6), quantile_cont(l_discount, 0.5), min(l_discount), round(stddev_samp(l_discount), 6), round(var_pop(l_discount), 6) FROM lineitem",
    "accuracy": _JUDGED + "SELECT round(avg(CASE WHEN quality = pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM j",
    "confusion": _JUDGED + "SELECT quality AS y_true, pred AS y_pred, CAST(count(*) AS DOUBLE) AS weight FROM j GROUP BY ALL",
    "precision_recall_f1": _CELLS + "SELECT round(tp / (tp + fp), 6) AS precision_, round(tp / (tp + fn), 6) AS recall_, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c",
    "fbeta_macro": _CELLS + "SELECT round((5 * tp / (5 * tp + 4 * fn + fp) + 5 * tn / (5 * tn + 4 * fp + fn)) / 2, 6) AS f2 FROM c",
    "log_loss": _JUDGED + "SELECT round(avg(-ln(CASE WHEN quality = 1 THEN CAST(p AS DOUBLE) ELSE 1 - CAST(p AS DOUBLE) END)), 6) AS loss FROM j",
    "roc_auc": _CURVE + "SELECT round(sum(pos * (tn - rn + neg / 2)) / max(tp * tn), 6) AS auc FROM r",
    "roc_curve": _CURVE + "SELECT score AS threshold, round(rn / tn, 6) AS fpr, round(rp / tp, 6) AS tpr FROM r",
    "roc_corners": _CURVE + ", n AS (SELECT *, lead(pos) OVER (ORDER BY score DESC) AS np, lead(neg) OVER (ORDER BY score DESC) AS nn FROM r) SELECT score AS threshold, round(rn / tn, 6) AS fpr, round(rp / tp, 6) AS tpr FROM n WHERE np IS NULL OR np <> pos OR nn <> neg UNION ALL SELECT NULL, 0, 0",
    "partial_auc": _CURVE + ", a AS (SELECT *, greatest(0, least(neg, 0.3 * tn - (rn - neg))) AS w FROM r), b AS (SELECT sum(CASE WHEN neg > 0 THEN w * (rp - pos + pos * w / neg / 2) ELSE 0 END) / max(tp * tn) AS part FROM a) SELECT round(0.5 * (1 + (part - 0.045) / (0.3 - 0.045)), 6) AS auc FROM b",
    "prf_averages": "WITH t AS (SELECT l_returnflag AS y, CASE WHEN l_quantity > 25 THEN 'N' WHEN l_linestatus = 'F' THEN 'A' ELSE 'R' END AS p FROM lineitem), k AS (SELECT unnest(['A', 'N', 'R']) AS c), g AS (SELECT c, CAST(count(*) FILTER (WHERE y = c AND p = c) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE p = c) AS DOUBLE) AS pc, CAST(count(*) FILTER (WHERE y = c) AS DOUBLE) AS tc FROM t, k GROUP BY c) SELECT round(2 * sum(tp) / (sum(pc) + sum(tc)), 6) AS micro, round(sum(tc * 2 * tp / (pc + tc)) / sum(tc), 6) AS weighted, round(sum(tp) / sum(tc), 6) AS weighted_recall FROM g",
    "prf_samples": "WITH t AS (SELECT CAST(l_quantity > 10 AS INT) AS a, CAST(l_quantity > 30 AS INT) AS b, CAST(l_discount > 0.03 AS INT) AS c, CAST(l_tax > 0.02 AS INT) AS d FROM lineitem), u AS (SELECT CAST(a * c + b * d AS DOUBLE) AS h, CAST(a + b AS DOUBLE) AS n, CAST(c + d AS DOUBLE) AS m FROM t) SELECT round(avg(CASE WHEN m > 0 THEN h / m ELSE 0 END), 6) AS precision_, round(avg(CASE WHEN n > 0 THEN h / n ELSE 0 END), 6) AS recall_, round(avg(CASE WHEN n + m > 0 THEN 2 * h / (n + m) ELSE 0 END), 6) AS f1 FROM u",
    "log_loss_classes": "WITH t AS (SELECT l_returnflag AS y, (l_quantity + 1) / 60 AS a, l_discount + 0.1 AS n, l_tax + 0.2 AS r FROM lineitem), c AS (SELECT y, least(greatest(a, 1e-15), 1 - 1e-15) AS a, least(greatest(n, 1e-15), 1 - 1e-15) AS n, least(greatest(r, 1e-15), 1 - 1e-15) AS r FROM t) SELECT round(avg(-ln(CASE y WHEN 'A' THEN a WHEN 'N' THEN n ELSE r END / (a + n + r))), 6) AS loss FROM c",
    "element_sums": "SELECT l_returnflag, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS quantity, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax FROM lineitem GROUP BY l_returnflag",
    "ordinal_encoder_table": "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS DOUBLE) AS code FROM customer",
    "one_hot_sparse": "SELECT o_orderkey, CAST(o_orderstatus = 'O' AS INTEGER) AS o, CAST(o_orderstatus = 'P' AS INTEGER) AS p, 2 AS size FROM orders",
    "k_bins_onehot": "WITH s AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem), t AS (SELECT l_orderkey, l_linenumber, (l_quantity >= a + (b - a) * 1 / 3)::INT + (l_quantity >= a + (b - a) * 2 / 3)::INT AS k FROM lineitem, s) SELECT l_orderkey, l_linenumber, CAST(k = 0 AS DOUBLE) AS q_0, CAST(k = 1 AS DOUBLE) AS q_1, CAST(k = 2 AS DOUBLE) AS q_2 FROM t",
    "precision_recall_curve": _CURVE + "SELECT score AS threshold, round(rp / (rp + rn), 6) AS precision_, round(rp / tp, 6) AS recall_ FROM r",
    "regression_errors": _PRICES + "SELECT round(avg(abs(y - f)), 6) AS mae, round(avg(abs(y - f) / abs(y)), 6) AS mape, round(sqrt(avg((y - f) * (y - f))), 6) AS rmse, round(sum(w * abs(y - f)) / sum(w), 6) AS wmae FROM t",
    "r2_and_variance": _PRICES + "SELECT round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 6) AS r2, round(1 - var_pop(y - f) / var_pop(y), 6) AS explained FROM t",
    "d2_scores": _PRICES + ", q AS (SELECT quantile_cont(y, 0.5) AS m, quantile_cont(y, 0.25) AS l FROM t) SELECT round(1 - avg(abs(y - f)) / avg(abs(y - m)), 6) AS d2_absolute, round(1 - avg(greatest(0.25 * (y - f), -0.75 * (y - f))) / avg(greatest(0.25 * (y - l), -0.75 * (y - l))), 6) AS d2_pinball FROM t, q",
    "correlation": "SELECT round(corr(l_quantity, l_extendedprice), 6) AS qp, round(corr(l_quantity, l_discount), 6) AS qd, round(corr(l_extendedprice, l_discount), 6) AS pd FROM lineitem",
    "covariance": "SELECT round(var_samp(l_quantity), 6) AS qq, round(covar_samp(l_quantity, l_discount), 6) AS qd, round(covar_samp(l_discount, l_tax), 6) AS dt FROM lineitem",
}
