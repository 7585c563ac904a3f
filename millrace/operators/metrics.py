"""Evaluation metrics as aggregations over tables of true and predicted values.

Every metric is one grouping (or a few) with partial sums; what reaches the
driver is one row, or one for each class or column. Weights are a column name;
without one each row weighs 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.prefix import exact_quantiles, running_sums, with_next

Names = str | Sequence[str]


def _list(names: Names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _weight(w: str | None) -> Column:
    return (F.col(w) if w else F.lit(1.0)).cast("double")


def _average(values: list[float], multioutput: str | Sequence[float]):
    if isinstance(multioutput, str):
        if multioutput == "raw_values":
            return values
        if multioutput != "uniform_average":
            raise ValueError(f"multioutput: {multioutput!r}")
        return float(np.mean(values))
    return float(np.average(values, weights=multioutput))


# --- classification -------------------------------------------------------------------------------------------


def accuracy_score(df: DataFrame, y_true: Names, y_pred: Names, normalize: bool = True, sample_weight: str | None = None) -> float:
    """Share (or weighted count) of rows on which all label columns agree; 0 for an empty table."""
    same = F.lit(True)
    for t, p in zip(_list(y_true), _list(y_pred), strict=True):
        same = same & F.col(t).eqNullSafe(F.col(p))
    w = _weight(sample_weight)
    r = df.agg(F.sum(F.when(same, w).otherwise(0.0)).alias("hit"), F.sum(w).alias("all")).first()
    return (r["hit"] or 0.0) / r["all"] if normalize and r["all"] else r["hit"] or 0.0


def confusion_counts(df: DataFrame, y_true: str, y_pred: str, sample_weight: str | None = None) -> DataFrame:
    """One row for each pair of labels that occurs: y_true, y_pred, weight. Rows with a null label are left out."""
    rows = df.where(F.col(y_true).isNotNull() & F.col(y_pred).isNotNull())
    return rows.groupBy(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(F.sum(_weight(sample_weight)).alias("weight"))


def confusion_matrix(df: DataFrame, y_true: str, y_pred: str, labels: Sequence | None = None, sample_weight: str | None = None, normalize: str | None = None) -> np.ndarray:
    """Rows are true labels, columns predicted ones, in the order of ``labels`` (default: sorted)."""
    cells = confusion_counts(df, y_true, y_pred, sample_weight).collect()  # at most the square of the number of classes
    labels = list(labels) if labels is not None else sorted({r["y_true"] for r in cells} | {r["y_pred"] for r in cells})
    at = {v: i for i, v in enumerate(labels)}
    out = np.zeros((len(labels), len(labels)))
    for r in cells:
        if r["y_true"] in at and r["y_pred"] in at:
            out[at[r["y_true"]], at[r["y_pred"]]] += r["weight"]
    if normalize:
        total = {"true": out.sum(axis=1, keepdims=True), "pred": out.sum(axis=0, keepdims=True), "all": out.sum()}[normalize]
        out = np.divide(out, total, out=np.zeros_like(out), where=np.broadcast_to(total, out.shape) != 0)
    return out


def precision_recall_fscore_support(df: DataFrame, y_true: str, y_pred: str, average: str | None = None, beta: float = 1.0, labels: Sequence | None = None, pos_label=1, sample_weight: str | None = None, zero_division: float = 0.0):
    """Precision, recall, F-beta and support; arrays by label without ``average`` (micro, macro, weighted, binary)."""
    cells = confusion_counts(df, y_true, y_pred, sample_weight).collect()
    classes = list(labels) if labels is not None else sorted({r["y_true"] for r in cells} | {r["y_pred"] for r in cells})
    if average == "binary":
        classes = [pos_label]
    tp = np.array([sum(r["weight"] for r in cells if r["y_true"] == c == r["y_pred"]) for c in classes], dtype=float)
    predicted = np.array([sum(r["weight"] for r in cells if r["y_pred"] == c) for c in classes], dtype=float)
    true = np.array([sum(r["weight"] for r in cells if r["y_true"] == c) for c in classes], dtype=float)
    if average == "micro":
        tp, predicted, true = (np.array([x.sum()]) for x in (tp, predicted, true))
    div = lambda a, b: np.divide(a, b, out=np.full_like(a, zero_division), where=b > 0)
    p, r = div(tp, predicted), div(tp, true)
    f = div((1 + beta**2) * tp, beta**2 * true + predicted)
    if average is None:
        return p, r, f, true
    if average == "weighted":
        if true.sum() == 0:
            return zero_division, zero_division, zero_division, None
        return tuple(float(np.average(x, weights=true)) for x in (p, r, f)) + (None,)
    return float(p.mean()), float(r.mean()), float(f.mean()), None


def precision_score(df, y_true, y_pred, average="binary", **options):
    return precision_recall_fscore_support(df, y_true, y_pred, average, **options)[0]


def recall_score(df, y_true, y_pred, average="binary", **options):
    return precision_recall_fscore_support(df, y_true, y_pred, average, **options)[1]


def fbeta_score(df, y_true, y_pred, beta, average="binary", **options):
    return precision_recall_fscore_support(df, y_true, y_pred, average, beta, **options)[2]


def f1_score(df, y_true, y_pred, average="binary", **options):
    return fbeta_score(df, y_true, y_pred, 1.0, average, **options)


def samplewise_prf(df: DataFrame, y_true: Names, y_pred: Names, beta: float = 1.0, zero_division: float = 0.0) -> tuple[float, float, float]:
    """Precision, recall and F-beta of each row's set of labels (columns of 0 and 1), averaged over rows."""
    add = lambda cols: sum((c for c in cols[1:]), cols[0])
    t, p = [F.col(c).cast("double") for c in _list(y_true)], [F.col(c).cast("double") for c in _list(y_pred)]
    both, true, predicted = add([a * b for a, b in zip(t, p, strict=True)]), add(t), add(p)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(zero_division)
    r = df.agg(F.avg(ratio(both, predicted)), F.avg(ratio(both, true)), F.avg(ratio((1 + beta**2) * both, beta**2 * true + predicted))).first()
    return tuple(float(x) for x in r)


def log_loss(df: DataFrame, y_true: str, y_pred: Names, labels: Sequence | None = None, eps: float = 1e-15, normalize: bool = True, sample_weight: str | None = None) -> float:
    """Negative log-likelihood; one column: the probability of the larger label, several: one for each label in sorted order."""
    columns = _list(y_pred)
    labels = list(labels) if labels is not None else sorted(r[0] for r in df.select(y_true).distinct().collect())
    if len(columns) == 1:
        p = F.least(F.greatest(F.col(columns[0]).cast("double"), F.lit(eps)), F.lit(1 - eps))
        chosen = F.when(F.col(y_true) == F.lit(labels[-1]), p).otherwise(1 - p)
    else:
        clipped = [F.least(F.greatest(F.col(c).cast("double"), F.lit(eps)), F.lit(1 - eps)) for c in columns]
        chosen = F.lit(None).cast("double")
        for label, p in zip(labels, clipped, strict=True):
            chosen = F.when(F.col(y_true) == F.lit(label), p).otherwise(chosen)
        chosen = chosen / sum(clipped[1:], clipped[0])
    w = _weight(sample_weight)
    r = df.agg(F.sum(-F.ln(chosen) * w).alias("loss"), F.sum(w).alias("all")).first()
    return r["loss"] / r["all"] if normalize else r["loss"]


# --- ranking --------------------------------------------------------------------------------------------------


def _by_score(df: DataFrame, y_true: str, y_score: str, pos_label, sample_weight: str | None) -> DataFrame:
    w, hit = _weight(sample_weight), F.col(y_true) == F.lit(pos_label)
    rows = df.where(F.col(y_true).isNotNull() & F.col(y_score).isNotNull())
    return rows.groupBy(F.col(y_score).cast("double").alias("score")).agg(F.sum(F.when(hit, w).otherwise(0.0)).alias("pos"), F.sum(F.when(hit, 0.0).otherwise(w)).alias("neg"))


def score_counts(df: DataFrame, y_true: str, y_score: str, pos_label=1, sample_weight: str | None = None) -> DataFrame:
    """One row for each distinct score, with running weights from the highest score down: score, pos, neg, run_pos, run_neg."""
    return running_sums(_by_score(df, y_true, y_score, pos_label, sample_weight), "score", ["pos", "neg"], descending=True)


def _class_weights(df: DataFrame, y_true: str, pos_label, sample_weight: str | None) -> tuple[float, float]:
    w, hit = _weight(sample_weight), F.col(y_true) == F.lit(pos_label)
    r = df.where(F.col(y_true).isNotNull()).agg(F.sum(F.when(hit, w).otherwise(0.0)), F.sum(F.when(hit, 0.0).otherwise(w))).first()
    return float(r[0] or 0), float(r[1] or 0)


def roc_curve(df: DataFrame, y_true: str, y_score: str, pos_label=1, sample_weight: str | None = None, drop_intermediate: bool = False) -> DataFrame:
    """threshold, fpr, tpr for each distinct score, highest first; the start at (0, 0) is threshold infinity.

    drop_intermediate leaves out points in the middle of a straight stretch:
    those whose score and the next one add equal weights.
    """
    p, n = _class_weights(df, y_true, pos_label, sample_weight)
    points = score_counts(df, y_true, y_score, pos_label, sample_weight)
    if drop_intermediate:
        near = with_next(points, "score", ["pos", "neg"], descending=True)
        points = near.where(F.col("next_pos").isNull() | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg")))
    points = points.select(F.col("score").alias("threshold"), (F.col("run_neg") / F.lit(n or math.nan)).alias("fpr"), (F.col("run_pos") / F.lit(p or math.nan)).alias("tpr"))
    start = df.sparkSession.createDataFrame([(math.inf, 0.0, 0.0)], points.schema)
    return start.union(points)


def precision_recall_curve(df: DataFrame, y_true: str, y_score: str, pos_label=1, sample_weight: str | None = None) -> DataFrame:
    """threshold, precision, recall for each distinct score; the end at precision 1 and recall 0 has a null threshold."""
    p, _ = _class_weights(df, y_true, pos_label, sample_weight)
    run = F.col("run_pos")
    points = score_counts(df, y_true, y_score, pos_label, sample_weight).select(F.col("score").alias("threshold"), (run / (run + F.col("run_neg"))).alias("precision"), (run / F.lit(p or math.nan)).alias("recall"))
    return points.union(df.sparkSession.createDataFrame([(None, 1.0, 0.0)], points.schema))


def roc_auc_score(df: DataFrame, y_true: str, y_score: str, pos_label=1, sample_weight: str | None = None, max_fpr: float | None = None) -> float:
    """Area under the ROC curve: for each score its positives times the negatives below, ties counting half.

    max_fpr: the area up to that false-positive rate, stretched so that chance
    is 0.5 and a perfect score 1.
    """
    if max_fpr is not None and not 0 < max_fpr <= 1:
        raise ValueError("max_fpr must be above 0 and at most 1")
    by = _by_score(df, y_true, y_score, pos_label, sample_weight).persist()
    try:
        p, n = (float(x or 0) for x in by.agg(F.sum("pos"), F.sum("neg")).first())
        if not p or not n:
            raise ValueError("the area is defined for two classes only")
        if max_fpr is None or max_fpr == 1:
            below = F.lit(n) - F.col("run_neg") + F.col("neg") / 2
            return running_sums(by, "score", ["neg"], descending=True).agg(F.sum(F.col("pos") * below)).first()[0] / (p * n)
        # each score is a straight stretch from (x, y) to (x + neg, y + pos); it counts up to the limit
        x, y, limit = F.col("run_neg") - F.col("neg"), F.col("run_pos") - F.col("pos"), F.lit(max_fpr * n)
        wide = F.greatest(F.lit(0.0), F.least(F.col("neg"), limit - x))
        area = F.when(F.col("neg") > 0, wide * (y + F.col("pos") * wide / F.col("neg") / 2)).otherwise(0.0)
        part = running_sums(by, "score", ["pos", "neg"], descending=True).agg(F.sum(area)).first()[0] / (p * n)
        least = max_fpr**2 / 2
        return 0.5 * (1 + (part - least) / (max_fpr - least))
    finally:
        by.unpersist()


def roc_auc_multiclass(df: DataFrame, y_true: str, scores: Sequence[str], labels: Sequence, average: str = "macro", multi_class: str = "ovr") -> float:
    """One class against the rest (ovr) or each pair both ways (ovo), averaged plainly or by prevalence."""
    size = {r[0]: r[1] for r in df.groupBy(y_true).count().collect()}
    if multi_class == "ovr":
        parts = [(roc_auc_score(df.withColumn("_hit", (F.col(y_true) == F.lit(c)).cast("int")), "_hit", s), size.get(c, 0)) for c, s in zip(labels, scores, strict=True)]
    else:
        parts = []
        for i, a in enumerate(labels):
            for j in range(i + 1, len(labels)):
                pair = df.where(F.col(y_true).isin(a, labels[j]))
                both = (roc_auc_score(pair, y_true, scores[i], a) + roc_auc_score(pair, y_true, scores[j], labels[j])) / 2
                parts.append((both, size.get(a, 0) + size.get(labels[j], 0)))
    values, weights = zip(*parts, strict=True)
    return float(np.average(values, weights=weights if average == "weighted" else None))


# --- regression -----------------------------------------------------------------------------------------------


def _pairs(y_true: Names, y_pred: Names) -> list[tuple[Column, Column]]:
    return [(F.col(t).cast("double"), F.col(p).cast("double")) for t, p in zip(_list(y_true), _list(y_pred), strict=True)]


def _means(df: DataFrame, values: list[Column], sample_weight: str | None) -> list[float]:
    w = _weight(sample_weight)
    r = df.agg(*[(F.sum(v * w) / F.sum(w)).alias(f"m{i}") for i, v in enumerate(values)]).first()
    return list(r)


def mean_absolute_error(df, y_true, y_pred, sample_weight=None, multioutput="uniform_average"):
    return _average(_means(df, [F.abs(t - p) for t, p in _pairs(y_true, y_pred)], sample_weight), multioutput)


def mean_absolute_percentage_error(df, y_true, y_pred, sample_weight=None, multioutput="uniform_average"):
    eps = float(np.finfo(np.float64).eps)
    return _average(_means(df, [F.abs(t - p) / F.greatest(F.abs(t), F.lit(eps)) for t, p in _pairs(y_true, y_pred)], sample_weight), multioutput)


def mean_squared_error(df, y_true, y_pred, squared=True, sample_weight=None, multioutput="uniform_average"):
    values = _means(df, [(t - p) * (t - p) for t, p in _pairs(y_true, y_pred)], sample_weight)
    return _average(values if squared else [math.sqrt(v) for v in values], multioutput)


def r2_score(df: DataFrame, y_true: str, y_pred: str) -> float:
    """1 less the residual over the total sum of squares; a constant truth gives 0 (1 if it is met exactly)."""
    (t, p), = _pairs(y_true, y_pred)
    mean = df.agg(F.avg(t)).first()[0]
    r = df.agg(F.sum((t - p) * (t - p)).alias("res"), F.sum((t - F.lit(mean)) * (t - F.lit(mean))).alias("tot")).first()
    return 1 - r["res"] / r["tot"] if r["tot"] else (1.0 if r["res"] == 0 else 0.0)


def explained_variance_score(df, y_true, y_pred, sample_weight=None, multioutput="uniform_average", force_finite=True):
    """1 less the variance of the residual over that of the truth; "variance_weighted" weighs outputs by the latter."""
    out, spread = [], []
    for t, p in _pairs(y_true, y_pred):
        m_e, m_t = _means(df, [t - p, t], sample_weight)
        e, v = _means(df, [F.pow(t - p - F.lit(m_e), F.lit(2)), F.pow(t - F.lit(m_t), F.lit(2))], sample_weight)
        out.append(1 - e / v if v else (1.0 if e == 0 else 0.0) if force_finite else math.nan if e == 0 else -math.inf)
        spread.append(v)
    if multioutput == "variance_weighted":
        return float(np.average(out, weights=spread)) if sum(spread) else float(np.mean(out))
    return _average(out, multioutput)


def d2_pinball_score(df, y_true, y_pred, alpha=0.5, sample_weight=None, multioutput="uniform_average"):
    """1 less the pinball loss over that of the best constant, the alpha quantile of the truth."""
    out = []
    for t, p in _pairs(y_true, y_pred):
        best = weighted_quantile(df.withColumn("_t", t), "_t", alpha, sample_weight)
        pin = lambda a, b: F.greatest(alpha * (a - b), (alpha - 1) * (a - b))
        num, den = _means(df, [pin(t, p), pin(t, F.lit(best))], sample_weight)
        out.append(1 - num / den if den else (1.0 if num == 0 else 0.0))
    return _average(out, multioutput)


def d2_absolute_error_score(df, y_true, y_pred, sample_weight=None, multioutput="uniform_average"):
    return d2_pinball_score(df, y_true, y_pred, 0.5, sample_weight, multioutput)


def weighted_quantile(df: DataFrame, column: str, q: float, sample_weight: str | None = None) -> float:
    """The linear quantile without weights; with them the smallest value at which the weight so far reaches q of all."""
    if sample_weight is None:
        return exact_quantiles(df, column, [q])[0]
    by = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.sum(_weight(sample_weight)).alias("w"))
    total = by.agg(F.sum("w")).first()[0]
    return running_sums(by, "v", ["w"]).where(F.col("run_w") >= q * total - 1e-12 * total).agg(F.min("v")).first()[0]


def array_sums(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sums of an array column's elements by their place, for each group: keys, sums (as long as the longest array; null elements count as 0)."""
    spread = df.select(*keys, F.posexplode(column).alias("_at", "_x")).groupBy(*keys, "_at").agg(F.coalesce(F.sum("_x"), F.lit(0)).alias("_s"))
    rows = F.sort_array(F.collect_list(F.struct("_at", "_s")))  # as many as the array's places
    return spread.groupBy(*keys).agg(F.transform(rows, lambda r: r["_s"]).alias("sums"))


# --- correlation ----------------------------------------------------------------------------------------------

#: Columns of a block of the matrix of products, values of a batch, and partial matrices that one task adds up.
BLOCK_COLUMNS, BATCH_VALUES, ADDED = 64, 1 << 20, 64


@dataclass
class _Products:
    """Rows, means and centred sums of products (some rows of that matrix) of a part of a table. Parts merge by the difference of their means, so large means do no harm."""

    rows: int
    mean: np.ndarray
    sums: np.ndarray
    bad: np.ndarray

    def merge(self, other: "_Products", first: int) -> "_Products":
        n = self.rows + other.rows
        if not n:
            return self
        d = other.mean - self.mean
        near = d[first : first + len(self.sums)]
        return _Products(n, self.mean + d * (other.rows / n), self.sums + other.sums + np.outer(near, d) * (self.rows * other.rows / n), self.bad + other.bad)

    def row(self, by: int, place: int, task: int) -> tuple:
        return (by, place, task, self.rows, self.mean.tobytes(), self.sums.tobytes(), self.bad.tobytes())


_PRODUCTS = "by int, place int, task int, rows long, mean binary, sums binary, bad binary"
_PRODUCTS_ARROW = pa.schema([("by", pa.int32()), ("place", pa.int32()), ("task", pa.int32()), ("rows", pa.int64()), ("mean", pa.binary()), ("sums", pa.binary()), ("bad", pa.binary())])


def _packed_products(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_PRODUCTS_ARROW.names, r, strict=True)) for r in rows], _PRODUCTS_ARROW)


def _partial_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One matrix for each group (the last column) of the partition, handed on in blocks of rows."""
    totals, task = {}, TaskContext.get().partitionId()
    for batch in batches:
        *columns, by = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        wide = np.column_stack([c.astype(float) for c in columns])
        for g in np.unique(by):
            mine = wide[by == g]
            step = max(1, BATCH_VALUES // wide.shape[1])
            for at in range(0, len(mine), step):
                x = mine[at : at + step]
                unknown = np.isnan(x)
                x = np.where(unknown, 0.0, x)
                mean = x.mean(axis=0)
                centred = x - mean
                part = _Products(len(x), mean, centred.T @ centred, unknown.sum(axis=0))
                totals[g] = part if g not in totals else totals[g].merge(part, 0)
    for g, total in totals.items():
        blocks = [(at, _Products(total.rows, total.mean, total.sums[at : at + BLOCK_COLUMNS], total.bad)) for at in range(0, len(total.mean), BLOCK_COLUMNS)]
        yield _packed_products([b.row(int(g), at, task) for at, b in blocks])


def _added_products(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, (by, place) = None, (k.as_py() for k in key[:2])
    for batch in batches:
        for r in batch.to_pylist():
            mean = np.frombuffer(r["mean"])
            part = _Products(r["rows"], mean, np.frombuffer(r["sums"]).reshape(-1, len(mean)), np.frombuffer(r["bad"], dtype=np.int64))
            total = part if total is None else total.merge(part, place)
    yield _packed_products([total.row(by, place, 0)])


def products(df: DataFrame, columns: Sequence[str], by: Column | None = None) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """For each value of ``by`` (small whole numbers; none: 0): rows, means and the matrix of centred sums of products, in one scan.

    Each partition makes a partial matrix, whose blocks of rows are added up in
    two steps. A column with a null or NaN is NaN all over.
    """
    numbers = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
    partial = df.select(*numbers, (F.lit(0) if by is None else by).cast("int").alias("_by")).mapInArrow(_partial_products, _PRODUCTS)
    few = partial.withColumn("task", F.col("task") % ADDED).groupBy("by", "place", "task").applyInArrow(_added_products, _PRODUCTS)
    blocks = few.groupBy("by", "place").applyInArrow(_added_products, _PRODUCTS).collect()  # the matrix of each group
    k, out = len(columns), {}
    for r in blocks:
        part, bad = np.frombuffer(r["sums"]).reshape(-1, k), np.frombuffer(r["bad"], dtype=np.int64) > 0
        n, mean, sums = out.setdefault(r["by"], (r["rows"], np.where(bad, math.nan, np.frombuffer(r["mean"])), np.full((k, k), math.nan)))
        sums[r["place"] : r["place"] + len(part)] = np.where(bad, math.nan, part)
        sums[bad, :] = math.nan
    return out


def _sums(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray]:
    n, _, sums = products(df, columns).get(0, (0, None, np.full((len(columns),) * 2, math.nan)))
    return n, sums


def covariance(df: DataFrame, columns: Sequence[str], ddof: int = 1) -> np.ndarray:
    """Covariance matrix; a null or NaN in any column makes its row and column NaN."""
    n, s = _sums(df, columns)
    return s / (n - ddof) if n > ddof else np.full_like(s, math.nan)


def correlation(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson correlation matrix; nulls and NaNs as in covariance."""
    _, s = _sums(df, columns)
    d = np.sqrt(np.diag(s))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = s / np.outer(d, d)
    np.fill_diagonal(out, np.where(np.isnan(np.diag(out)), np.nan, 1.0))
    return out
