import math

import numpy as np
import pytest

from millrace.operators import metrics as M
from millrace.operators import preprocess as P
from millrace.operators.prefix import running_sums


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, 1.0, "a", 5.0), (2, 2.0, "b", 5.0), (3, 4.0, "a", 5.0), (4, 9.0, None, 5.0)], "id int, x double, s string, c double").cache()


def column(frame, name):
    return [r[name] for r in frame.orderBy("id").collect()]


def test_scalers(df):
    x = np.array([1, 2, 4, 9.0])
    assert np.allclose(column(P.StandardScaler(["x", "c"], ["y", "z"]).fit_transform(df), "y"), (x - 4) / x.std())
    assert column(P.StandardScaler(["c"], ["z"]).fit_transform(df), "z") == [0.0] * 4
    assert np.allclose(column(P.MinMaxScaler(["x"], ["y"]).fit_transform(df), "y"), (x - 1) / 8)
    assert column(P.MinMaxScaler(["c"], ["y"]).fit_transform(df), "y") == [0.0] * 4
    assert np.allclose(column(P.MaxAbsScaler(["x"], ["y"]).fit_transform(df), "y"), x / 9)
    q = np.percentile(x, [25, 50, 75])
    assert np.allclose(column(P.RobustScaler(["x"], ["y"]).fit_transform(df), "y"), (x - q[1]) / (q[2] - q[0]))
    assert np.allclose(column(P.Normalizer(["x", "c"], ["y", "z"], norm="max").fit_transform(df), "y"), x / np.maximum(x, 5))
    assert column(P.Binarizer(["x"], ["y"], threshold=2).fit_transform(df), "y") == [0.0, 0.0, 1.0, 1.0]
    with pytest.raises(ValueError):
        P.Binarizer(["s"], ["y"]).fit_transform(df)


def test_encoders(spark, df):
    assert column(P.OrdinalEncoder(["s"], ["y"], encoded_missing_value=-1).fit_transform(df), "y") == [0.0, 1.0, 0.0, -1.0]
    assert column(P.LabelEncoder("s", "y").fit_transform(df), "y") == [0.0, 1.0, 0.0, 2.0]
    new = spark.createDataFrame([(1, "zz")], "id int, s string")
    assert column(P.OrdinalEncoder(["s"], ["y"], handle_unknown="use_encoded_value", unknown_value=9).fit(df).transform(new), "y") == [9.0]
    with pytest.raises(Exception, match="unknown category"):
        P.OrdinalEncoder(["s"], ["y"]).fit(df).transform(new).collect()
    hot = P.OneHotEncoder(["s"], ["y"]).fit_transform(df)
    assert hot.columns == ["y_a", "y_b", "y_None", "id", "x", "s", "c"]
    assert [r[:3] for r in hot.orderBy("id").collect()] == [(1, 0, 0), (0, 1, 0), (1, 0, 0), (0, 0, 1)]
    assert P.OneHotEncoder(["s"], ["y"], drop="first").fit_transform(df).columns[:2] == ["y_b", "y_None"]
    assert column(P.OneHotEncoder(["s"], ["y"], sparse=True).fit_transform(df), "y")[1] == {"1": 1, "array_length": 3}
    assert "y__INFREQUENT" in P.OneHotEncoder(["s"], ["y"], min_frequency=2).fit_transform(df).columns


def test_bins_imputer_and_more(spark, df):
    assert column(P.KBinsDiscretizer(["x"], ["y"], n_bins=4, strategy="uniform").fit_transform(df), "y") == [0.0, 0.0, 1.0, 3.0]
    assert column(P.KBinsDiscretizer(["x"], ["y"], n_bins=2).fit_transform(df), "y") == [0.0, 0.0, 1.0, 1.0]
    assert P.KBinsDiscretizer(["x"], ["y"], n_bins=2, encode="onehot-dense").fit_transform(df).columns[:2] == ["y_0", "y_1"]
    assert column(P.SimpleImputer(["s"], ["y"], strategy="most_frequent").fit_transform(df), "y")[3] == "a"
    assert column(P.SimpleImputer(["s"], ["y"], strategy="constant").fit_transform(df), "y")[3] == "missing_data"
    gaps = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "id int, x double")
    assert column(P.SimpleImputer(["x"], ["y"]).fit_transform(gaps), "y") == [1.0, 2.0, 3.0]
    assert column(P.MissingIndicator(["x"], ["y"]).fit_transform(gaps), "y") == [False, True, False]
    pipe = P.Pipeline([("impute", P.SimpleImputer(["x"])), ("scale", P.MinMaxScaler(["x"]))]).fit(gaps)
    assert column(pipe.transform(gaps), "x") == [0.0, 0.5, 1.0]
    assert P.column_statistics(gaps, ["x"]).first()["count"] == 2


def test_classification(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, 1.0), (2, 1, 1.0), (2, 2, 3.0)], "t int, p int, w double")
    assert M.accuracy_score(df, "t", "p") == 0.6
    assert M.accuracy_score(df, "t", "p", sample_weight="w") == 5 / 8
    assert M.confusion_matrix(df, "t", "p").tolist() == [[1, 1, 0], [0, 1, 0], [0, 1, 1]]
    p, r, f, s = M.precision_recall_fscore_support(df, "t", "p")
    assert np.allclose(p, [1, 1 / 3, 1]) and np.allclose(r, [0.5, 1, 0.5]) and s.tolist() == [2, 1, 2]
    assert np.isclose(M.f1_score(df, "t", "p", average="macro"), np.mean([2 / 3, 0.5, 2 / 3]))
    assert np.isclose(M.recall_score(df, "t", "p", average="micro"), 0.6)
    assert np.isclose(M.precision_score(df, "t", "p", average="weighted"), (2 + 1 / 3 + 2) / 5)


def test_ranking(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s double")
    assert M.roc_auc_score(df, "y", "s") == 0.75
    assert [tuple(r) for r in M.roc_curve(df, "y", "s").orderBy("fpr", "tpr").collect()][0][1:] == (0.0, 0.0)
    pr = {r[0]: r[1:] for r in M.precision_recall_curve(df, "y", "s").collect()}
    assert pr[0.8] == (1.0, 0.5) and pr[None] == (1.0, 0.0) and np.isclose(pr[0.35][0], 2 / 3)
    ties = spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, s double")
    assert M.roc_auc_score(ties, "y", "s") == 0.5
    probs = spark.createDataFrame([(1, 0.9), (0, 0.2)], "y int, p double")
    assert np.isclose(M.log_loss(probs, "y", "p"), -(math.log(0.9) + math.log(0.8)) / 2)


def test_regression_and_correlation(spark):
    rng = np.random.default_rng(3)
    y, f, w = rng.normal(size=300), rng.normal(size=300), rng.uniform(1, 2, 300)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, f, w)], "y double, f double, w double")
    assert np.isclose(M.mean_absolute_error(df, "y", "f", sample_weight="w"), np.average(abs(y - f), weights=w))
    assert np.isclose(M.mean_squared_error(df, "y", "f", squared=False), np.sqrt(((y - f) ** 2).mean()))
    assert np.isclose(M.r2_score(df, "y", "f"), 1 - ((y - f) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert np.isclose(M.explained_variance_score(df, "y", "f"), 1 - np.var(y - f) / np.var(y))
    assert np.isclose(M.d2_absolute_error_score(df, "y", "f"), 1 - abs(y - f).mean() / abs(y - np.median(y)).mean())
    assert np.allclose(M.correlation(df, ["y", "f", "w"]), np.corrcoef([y, f, w]))
    assert np.allclose(M.covariance(df, ["y", "f"], ddof=0), np.cov([y, f], ddof=0))
    holes = df.union(spark.createDataFrame([(None, 1.0, 1.0)], "y double, f double, w double"))
    assert np.isnan(M.correlation(holes, ["y", "f"])[0, 1])
    assert M.weighted_quantile(df, "y", 0.5, "w") in y


def test_running_sums(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(500)], "k double, v long")
    out = running_sums(df, "k", ["v"], descending=True, parts=7).collect()
    assert all(r["run_v"] == 500 - r["k"] for r in out) and len(out) == 500
