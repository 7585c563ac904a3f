"""Models: signatures, a registry of versions, batch inference, estimators, search."""

from __future__ import annotations

import base64
import functools
import inspect
import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from millrace.operators.metrics import products
from millrace.operators.prefix import exact_quantiles_of
from millrace.sources.catalog import JsonCatalog


def inference_api(f):
    """Marks a method (self, frame) -> frame that is called on batches of rows."""
    f._api = "function"
    return f


def partitioned_api(f):
    """Marks a method (self, frame) -> frame that is called once for each partition of the partition column."""
    f._api = "partitioned"
    return f


class CustomModel:
    """Base of user models; ``context`` holds what they need."""

    def __init__(self, **context) -> None:
        self.context = context

    def methods(self) -> dict[str, str]:
        return {n: f._api for n in dir(type(self)) if hasattr(f := getattr(type(self), n), "_api")}


def infer_signature(inputs: DataFrame, outputs: DataFrame) -> dict:
    return {"inputs": inputs.schema.jsonValue(), "outputs": outputs.schema.jsonValue()}


def validate_input(df: DataFrame, schema: StructType, strict: bool = False) -> DataFrame:
    """The schema's columns in its types; missing columns raise, and with strict numbers that do not fit."""
    limits = {"tinyint": 2**7, "smallint": 2**15, "int": 2**31, "bigint": 2**63, "float": 3.5e38}
    if missing := [f.name for f in schema.fields if f.name not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    checked = [f for f in schema.fields if f.dataType.simpleString() in limits]
    if strict and checked:
        r = df.agg(*[F.max(F.abs(F.col(f.name).cast("double" if f.dataType.simpleString() == "float" else "decimal(38,0)"))).alias(f"m{i}") for i, f in enumerate(checked)]).first()
        for f, m in zip(checked, r, strict=True):
            if m is not None and math.isfinite(m) and m >= limits[f.dataType.simpleString()]:
                raise ValueError(f"{f.name} has values beyond {f.dataType.simpleString()}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], *[c for c in df.columns if c not in schema.fieldNames()])


@functools.lru_cache(maxsize=4)
def _loaded(blob: bytes) -> CustomModel:
    """One copy of a model in each Python worker."""
    return cloudpickle.loads(blob)


def _pickled(model: CustomModel) -> bytes:
    """The model with the code of its class, so that executors need not import its module."""
    module = inspect.getmodule(type(model))
    if module is None or module.__name__ == "__main__":
        return cloudpickle.dumps(model)
    cloudpickle.register_pickle_by_value(module)
    try:
        return cloudpickle.dumps(model)
    finally:
        cloudpickle.unregister_pickle_by_value(module)


class ModelVersion:
    def __init__(self, spark: SparkSession, name: str, version: str, record: dict) -> None:
        self.spark, self.name, self.version, self.record = spark, name, version, record

    def model(self) -> CustomModel:
        return cloudpickle.loads(base64.b64decode(self.record["model"]))

    def run(self, df: DataFrame | pd.DataFrame, function_name: str = "predict", partition_column: str | None = None, params: dict | None = None, strict_input_validation: bool = False) -> DataFrame | pd.DataFrame:
        """The rows with the method's outputs; of a partitioned method, the partition column and its outputs alone.

        A partitioned method needs a partition column: each of its values is a
        group in one task's memory. A pandas frame comes back as one, in its
        own order. params must be the method's own and are the same for all
        rows.
        """
        if isinstance(df, pd.DataFrame):
            return self._run_local(df, function_name, partition_column, params, strict_input_validation)
        kind = self.record["methods"].get(function_name)
        if kind is None:
            raise ValueError(f"no method {function_name}; there are {sorted(self.record['methods'])}")
        inputs, outputs = (StructType.fromJson(self.record["signature"][k]) for k in ("inputs", "outputs"))
        df = validate_input(df, inputs, strict_input_validation)
        blob, names, params = base64.b64decode(self.record["model"]), inputs.fieldNames(), params or {}
        known = set(inspect.signature(getattr(_loaded(blob), function_name)).parameters) - {"frame"}
        if unknown := sorted(set(params) - known):
            raise ValueError(f"{function_name} has no parameters {unknown}")
        if kind == "partitioned":
            if not partition_column:
                raise ValueError(f"{function_name} is partitioned and needs a partition column")
            whole = lambda frame: getattr(_loaded(blob), function_name)(frame, **params)
            key, rows = partition_column, df
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.fields)
            kind_of = dict(df.dtypes)[key]

            def each(k, frame):
                out = whole(frame)[[c for c in outputs.fieldNames()]]
                out.insert(0, key, k[0])
                return out

            return rows.groupBy(key).applyInPandas(each, f"`{key}` {kind_of}, {schema}")
        clash = set(df.columns)
        full = StructType(list(df.schema.fields))
        for f in outputs.fields:
            full = full.add(f.name if f.name not in clash else f"{f.name}_output", f.dataType)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = _loaded(blob)
            for frame in frames:
                out = getattr(model, function_name)(frame[names], **params)[outputs.fieldNames()]
                joined = pd.concat([frame.reset_index(drop=True), out.reset_index(drop=True)], axis=1)
                joined.columns = full.fieldNames()
                yield joined

        return df.mapInPandas(run, full)

    def _run_local(self, frame: pd.DataFrame, function_name: str, partition_column: str | None, params: dict | None, strict: bool) -> pd.DataFrame:
        if self.record["methods"].get(function_name) == "partitioned":
            return self.run(self.spark.createDataFrame(frame), function_name, partition_column, params, strict).toPandas()
        numbered = self.spark.createDataFrame(frame.assign(_row=range(len(frame))))
        out = self.run(numbered, function_name, partition_column, params, strict).toPandas().sort_values("_row")
        return out.drop(columns="_row").set_index(frame.index)

    def run_batch(self, df: DataFrame, path: str, mode: str = "errorifexists", format: str = "parquet", **options) -> DataFrame:
        """run, written as files of a format and read back."""
        self.run(df, **options).write.mode(mode).format(format).save(path)
        return self.spark.read.format(format).load(path)


def chained(df: DataFrame, steps: Sequence[tuple[ModelVersion, str]]) -> DataFrame:
    """Each model's method on the rows that the one before it returned: an output is an input of the next by its name."""
    for version, method in steps:
        if version.record["methods"].get(method) == "partitioned":
            raise ValueError("only methods on rows can be chained")
        df = version.run(df, method)
    return df


class Registry:
    """Model versions below a folder, with default, aliases, tags and metrics."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.catalog = spark, JsonCatalog(spark, root)

    def log_model(self, model: CustomModel, name: str, version: str, signature: dict, metrics: dict | None = None, comment: str = "") -> ModelVersion:
        if self.catalog.get(name, version):
            raise ValueError(f"{name} {version} exists")
        record = {"model": base64.b64encode(_pickled(model)).decode(), "methods": model.methods(), "signature": signature, "metrics": metrics or {}, "tags": {}, "comment": comment}
        self.catalog.put(name, version, record, expected=0)
        if self.catalog.get("_models", name) is None:
            self.catalog.put("_models", name, {"default": version, "aliases": {}})
        return self.get(name, version)

    def get(self, name: str, version: str | None = None) -> ModelVersion:
        about = self.catalog.get("_models", name)
        if about is None:
            raise ValueError(f"no model {name}")
        version = about["aliases"].get(version or "", version or about["default"])
        record = self.catalog.get(name, version)
        if record is None:
            raise ValueError(f"{name} has no version {version}")
        return ModelVersion(self.spark, name, version, record)

    def models(self) -> list[str]:
        return self.catalog.names("_models")

    def versions(self, name: str) -> list[str]:
        return self.catalog.names(name)

    def set_default(self, name: str, version: str) -> None:
        self.get(name, version)
        self.catalog.change("_models", name, lambda about: about | {"default": version})

    def set_alias(self, name: str, version: str, alias: str) -> None:
        self.catalog.change("_models", name, lambda about: about | {"aliases": about["aliases"] | {alias: version}})

    def set_metric(self, name: str, version: str, metric: str, value: float) -> None:
        self.catalog.change(name, version, lambda record: record | {"metrics": record["metrics"] | {metric: value}})

    def set_tag(self, name: str, version: str, tag: str, value: str) -> None:
        self.catalog.change(name, version, lambda record: record | {"tags": record["tags"] | {tag: value}})

    def delete(self, name: str, version: str | None = None) -> None:
        for v in [version] if version else self.versions(name):
            self.catalog.delete(name, v)
        if not self.versions(name):
            self.catalog.delete("_models", name)


class Estimator:
    """A pyspark.ml estimator with plain columns in and out.

    ``stage`` is the estimator, or a function that makes it for the number of
    rows and the label's deviation; its features come from input_cols (default: all numeric columns but
    the label and weight) and its predictions go to output_cols. Rows with
    nulls in the inputs raise on fit, as Spark's assembler does.
    """

    def __init__(self, stage, input_cols: Sequence[str] | None = None, label_cols: Sequence[str] | None = None, output_cols: Sequence[str] | None = None, weight_col: str | None = None) -> None:
        self.stage, self.input_cols, self.weight = stage, list(input_cols) if input_cols is not None else None, weight_col
        self.label = label_cols[0] if label_cols else None
        self.output = output_cols[0] if output_cols else f"OUTPUT_{self.label}" if self.label else "OUTPUT_0"
        self.model = None

    def _assembled(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.input_cols, outputCol="_features").transform(df)

    def fit(self, df: DataFrame) -> "Estimator":
        if self.input_cols is None:
            self.input_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in (self.label, self.weight)]
        stage = self.stage(*df.agg(F.count("*"), F.stddev_pop(self.label)).first()) if inspect.isfunction(self.stage) else self.stage.copy()
        stage.setFeaturesCol("_features")
        if self.label:
            stage.setLabelCol(self.label)
        if self.weight:
            stage.setWeightCol(self.weight)
        counted = self._counted(df) if _weighs(stage) else None
        if counted is None:
            self.model = stage.fit(self._assembled(df))
            return self
        counted = counted.persist()
        try:
            self.model = stage.setWeightCol("_weight").fit(self._assembled(counted))
        finally:
            counted.unpersist()
        return self

    def _counted(self, df: DataFrame) -> DataFrame | None:
        """Each distinct row of inputs and label once, with the sum of its rows' weights; None unless that leaves a row for REPEATED at most."""
        columns = list(dict.fromkeys([*self.input_cols, self.label]))
        rows, distinct = df.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*columns))).first()
        if distinct * REPEATED > rows:
            return None
        return df.groupBy(*columns).agg(F.sum(self.weight or F.lit(1.0)).alias("_weight"))

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).predict(df)

    def predict(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("fit first")
        scored = self.model.transform(self._assembled(df))
        return scored.select(*df.columns, F.col("prediction").cast("double").alias(self.output))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        scored = self.model.transform(self._assembled(df)).withColumn("_p", vector_to_array("probability"))
        return scored.select(*df.columns, *[F.col("_p")[i].alias(f"{self.output}_{i}") for i in range(self.model.numClasses)])

    def score(self, df: DataFrame) -> float:
        """Accuracy of classifiers, R squared of regressors."""
        from millrace.operators.metrics import accuracy_score, r2_score

        out = self.predict(df).withColumn("_y", F.col(self.label).cast("double"))
        classifier = hasattr(self.model, "numClasses")
        return accuracy_score(out, "_y", self.output) if classifier else r2_score(out, "_y", self.output)


#: Rows for each distinct one from which on an estimator is fitted on distinct rows with weights.
REPEATED = 8


def _weighs(stage) -> bool:
    """Whether a stage makes of a row with a weight what it makes of as many equal rows.

    Not where rows are drawn or counted by themselves (forests, least rows of
    a node), nor with penalties, which go by deviations that Spark computes
    otherwise for weights; nor where one pass over the rows is all there is,
    or the loss has corners and the search may stop elsewhere (LinearSVC, Huber).
    """
    from pyspark.ml import classification as c
    from pyspark.ml import regression as r

    if isinstance(stage, c.OneVsRest):
        return _weighs(stage.getClassifier())
    if isinstance(stage, c.LogisticRegression):
        return stage.getRegParam() == 0
    if isinstance(stage, (c.DecisionTreeClassifier, c.GBTClassifier, r.DecisionTreeRegressor, r.GBTRegressor)):
        drawn = isinstance(stage, (c.GBTClassifier, r.GBTRegressor)) and (stage.getSubsamplingRate() < 1 or stage.isDefined(stage.validationIndicatorCol))
        return not drawn and stage.getMinInstancesPerNode() == 1
    return False


class VectorTransformer:
    """A pyspark.ml feature stage (PCA, selectors) with plain columns in and out: <output>_0, <output>_1, ..."""

    def __init__(self, stage, input_cols: Sequence[str], output: str = "OUTPUT", label_col: str | None = None, input_param: str = "inputCol") -> None:
        self.stage, self.input_cols, self.output, self.label, self.input_param, self.model = stage, list(input_cols), output, label_col, input_param, None

    def _assembled(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.input_cols, outputCol="_features").transform(df)

    def fit(self, df: DataFrame) -> "VectorTransformer":
        stage = self.stage.copy({self.stage.getParam(self.input_param): "_features", self.stage.getParam("outputCol"): "_out"})
        if self.label:
            stage = stage.copy({stage.getParam("labelCol"): self.label})
        self.model = stage.fit(self._assembled(df))
        first = self.model.transform(self._assembled(df)).select("_out").first()
        self.size = len(first["_out"]) if first else 0
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("fit first")
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(self._assembled(df)).withColumn("_out", vector_to_array("_out"))
        return out.select(*df.columns, *[F.col("_out")[i].alias(f"{self.output}_{i}") for i in range(self.size)])


def windowed_metrics(df: DataFrame, ts: str, window: str, metrics: dict[str, "F.Column"], segments: Sequence[str] = ()) -> DataFrame:
    """Monitoring: aggregates by time window (its start in seconds since 1970) and segment."""
    from millrace.functions.intervals import parse_interval, slice_start

    start = slice_start(F.col(ts), parse_interval(window)).alias("window_start")
    return df.where(F.col(ts).isNotNull()).groupBy(start, *segments).agg(*[c.alias(n) for n, c in metrics.items()])


def check_monitor_source(df: DataFrame, ts: str, ids: Sequence[str], predictions: Sequence[str], actuals: Sequence[str] = (), segments: Sequence[str] = (), task: str = "regression") -> None:
    """Raise unless the columns exist, no column has two uses, and their types suit the task: a time, numbers, and text for segments."""
    kinds = dict(df.dtypes)
    uses = [ts, *ids, *predictions, *actuals, *segments]
    if missing := [c for c in uses if c not in kinds]:
        raise ValueError(f"no such columns: {missing}")
    if again := sorted({c for c in uses if uses.count(c) > 1}):
        raise ValueError(f"used twice: {again}")
    if not kinds[ts].startswith("timestamp") and kinds[ts] != "date":
        raise ValueError(f"{ts} is no time")
    if not predictions:
        raise ValueError("a prediction column is needed")
    number = lambda c: isinstance(df.schema[c].dataType, NumericType)
    if task == "regression" and (bad := [c for c in (*predictions, *actuals) if not number(c)]):
        raise ValueError(f"not numeric: {bad}")
    if bad := [c for c in segments if kinds[c] != "string"]:
        raise ValueError(f"segments must be text: {bad}")


def check_result(df: DataFrame, rows: int | None = None, columns: Sequence[str] | None = None, single: bool = False) -> DataFrame:
    """The table, if it has so many rows, these columns, or (single) one cell; else ValueError."""
    if columns is not None and [c.lower() for c in df.columns] != [c.lower() for c in columns]:
        raise ValueError(f"columns {df.columns}, expected {list(columns)}")
    wanted = 1 if single else rows
    if single and len(df.columns) != 1:
        raise ValueError(f"{len(df.columns)} columns, expected one")
    if wanted is not None and (n := df.limit(wanted + 1).count()) != wanted:
        raise ValueError(f"{'more than ' + str(wanted) if n > wanted else n} rows, expected {wanted}")
    return df


def column_or_literal(x) -> "F.Column":
    """A column for a name or column, a literal for anything else; text in single quotes is a literal."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.lit(x[1:-1]) if len(x) > 1 and x[0] == x[-1] == "'" else F.col(x)
    return F.lit(x)


def drift(base: DataFrame, now: DataFrame, column: str, bins: int = 10, eps: float = 1e-4) -> float:
    """Population stability index of a numeric column over equal-weight bins of the base."""
    return drift_from(baseline(base, [column], bins), now, eps)[column]


def baseline(base: DataFrame, columns: Sequence[str], bins: int = 10) -> dict:
    """What a monitor keeps of a table: for each numeric column the edges of equal-weight bins and the share of rows in each, in one scan more than the quantiles take."""
    edges = dict(zip(columns, exact_quantiles_of(base, columns, [i / bins for i in range(1, bins)]), strict=True))
    return {"bins": bins, "edges": edges, "shares": _shares(base, edges, bins)}


def drift_from(kept: dict, now: DataFrame, eps: float = 1e-4) -> dict[str, float]:
    """Population stability index of each column of a baseline, in one scan of the table now."""
    found, out = _shares(now, kept["edges"], kept["bins"]), {}
    for c, before in kept["shares"].items():
        pairs = [(max(a, eps), max(b, eps)) for a, b in zip(before, found[c], strict=True)]
        out[c] = float(sum((b - a) * np.log(b / a) for a, b in pairs))
    return out


def _shares(df: DataFrame, edges: dict[str, list], bins: int) -> dict[str, list[float]]:
    code = lambda c, at: sum(((F.col(c) >= e).cast("int") for e in at[1:]), (F.col(c) >= at[0]).cast("int"))
    known = {c: at for c, at in edges.items() if at[0] is not None}
    cells = [F.count_if(F.col(c).isNotNull() & (code(c, at) == i)) for c, at in known.items() for i in range(bins)]
    counts = list(df.agg(*[x.alias(f"n{i}") for i, x in enumerate(cells)]).first()) if cells else []
    out = {c: [0.0] * bins for c in edges}
    for k, c in enumerate(known):
        mine = counts[k * bins : (k + 1) * bins]
        out[c] = [n / max(sum(mine), 1) for n in mine]
    return out


class Monitors:
    """Monitors by name: what is watched, by which window and segments, and the baseline that later rows are held against."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.catalog = spark, JsonCatalog(spark, root)

    def register(self, name: str, base: DataFrame, ts: str, ids: Sequence[str], predictions: Sequence[str], actuals: Sequence[str] = (), segments: Sequence[str] = (), window: str = "1 day", task: str = "regression", bins: int = 10) -> None:
        """Check the source and keep the baseline of its numeric predictions and actuals; a name that is taken raises."""
        check_monitor_source(base, ts, ids, predictions, actuals, segments, task)
        numbers = [c for c in (*predictions, *actuals) if isinstance(base.schema[c].dataType, NumericType)]
        self.catalog.put("monitor", name, {"ts": ts, "window": window, "segments": list(segments), "baseline": baseline(base, numbers, bins)}, expected=0)

    def names(self) -> list[str]:
        return self.catalog.names("monitor")

    def _record(self, name: str) -> dict:
        if (d := self.catalog.get("monitor", name)) is None:
            raise ValueError(f"no monitor {name}")
        return d

    def drift(self, name: str, now: DataFrame) -> dict[str, float]:
        return drift_from(self._record(name)["baseline"], now)

    def metrics(self, name: str, now: DataFrame, metrics: dict[str, "F.Column"]) -> DataFrame:
        d = self._record(name)
        return windowed_metrics(now, d["ts"], d["window"], metrics, d["segments"])

    def delete(self, name: str) -> None:
        self._record(name)
        self.catalog.delete("monitor", name)


def _penalised(absolute: float, quadratic: float, deviation: float | None, params: dict):
    from pyspark.ml.regression import LinearRegression

    quadratic *= deviation or 1.0
    both = absolute + quadratic
    return LinearRegression(**{"regParam": both, "elasticNetParam": absolute / both if both else 0.0, "standardization": False, "tol": 1e-9, "maxIter": 1000, **params})


def estimators() -> dict[str, Callable]:
    """Families with a pyspark.ml form, by name: each makes a configured stage from the parameters.

    Ridge, Lasso and ElasticNet take alpha as it stands before the penalty of
    least squares (Ridge: of their sum; the others: of half their mean) over
    features that are not scaled. Spark divides the quadratic penalty by the
    label's deviation, so the stage depends on that and the number of rows.
    """
    from pyspark.ml import classification as c
    from pyspark.ml import clustering as k
    from pyspark.ml import regression as r

    glm = lambda family, link="log": lambda **p: r.GeneralizedLinearRegression(**{"family": family, "link": link, **p})
    bayes = lambda kind: lambda **p: c.NaiveBayes(**{"modelType": kind, **p})
    return {
        "LinearRegression": lambda **p: r.LinearRegression(**p),
        "Ridge": lambda alpha=1.0, **p: lambda n, deviation: _penalised(0.0, alpha / max(n, 1), deviation, p),
        "Lasso": lambda alpha=1.0, **p: lambda n, deviation: _penalised(alpha, 0.0, deviation, p),
        "ElasticNet": lambda alpha=1.0, l1_ratio=0.5, **p: lambda n, deviation: _penalised(alpha * l1_ratio, alpha * (1 - l1_ratio), deviation, p),
        "HuberRegressor": lambda epsilon=1.35, **p: r.LinearRegression(**{"loss": "huber", "epsilon": epsilon, **p}),
        "GammaRegressor": glm("gamma"), "PoissonRegressor": glm("poisson"),
        "TweedieRegressor": lambda power=1.5, **p: r.GeneralizedLinearRegression(**{"family": "tweedie", "variancePower": power, "linkPower": 0.0, **p}),
        "RandomForestRegressor": lambda **p: r.RandomForestRegressor(**p), "DecisionTreeRegressor": lambda **p: r.DecisionTreeRegressor(**p),
        "GradientBoostingRegressor": lambda **p: r.GBTRegressor(**p), "HistGradientBoostingRegressor": lambda **p: r.GBTRegressor(**{"maxBins": 255, **p}),
        "LogisticRegression": lambda **p: c.LogisticRegression(**p), "LinearSVC": lambda **p: c.LinearSVC(**p),
        "RandomForestClassifier": lambda **p: c.RandomForestClassifier(**p), "DecisionTreeClassifier": lambda **p: c.DecisionTreeClassifier(**p),
        "GradientBoostingClassifier": lambda **p: c.GBTClassifier(**p), "HistGradientBoostingClassifier": lambda **p: c.GBTClassifier(**{"maxBins": 255, **p}),
        "GaussianNB": bayes("gaussian"), "MultinomialNB": bayes("multinomial"), "BernoulliNB": bayes("bernoulli"), "ComplementNB": bayes("complement"),
        "OneVsRestClassifier": lambda classifier=None, **p: c.OneVsRest(classifier=classifier or c.LogisticRegression(), **p),
        "MLPClassifier": lambda **p: c.MultilayerPerceptronClassifier(**p),
        "KMeans": lambda **p: k.KMeans(**p), "BisectingKMeans": lambda **p: k.BisectingKMeans(**p), "GaussianMixture": lambda **p: k.GaussianMixture(**p),
    }


def estimator(name: str, input_cols: Sequence[str] | None = None, label_cols: Sequence[str] | None = None, output_cols: Sequence[str] | None = None, weight_col: str | None = None, **params) -> Estimator:
    """An estimator by its family's name."""
    return Estimator(estimators()[name](**params), input_cols, label_cols, output_cols, weight_col)


#: Selectors by name: what is chosen, and the name of the threshold.
SELECTORS = {"SelectKBest": "numTopFeatures", "SelectPercentile": "percentile", "SelectFpr": "fpr", "SelectFdr": "fdr", "SelectFwe": "fwe"}


def selector(name: str, threshold: float, input_cols: Sequence[str], label_col: str, feature_type: str = "continuous", label_type: str = "categorical", output: str = "OUTPUT") -> VectorTransformer:
    """Univariate selection: F test of classes or values, or chi-squared where both are categorical.

    GenericUnivariateSelect takes "mode:name", as in "GenericUnivariateSelect:fpr".
    """
    from pyspark.ml.feature import UnivariateFeatureSelector

    mode = name.split(":", 1)[1] if name.startswith("GenericUnivariateSelect:") else SELECTORS[name]
    stage = UnivariateFeatureSelector(selectionMode=mode).setFeatureType(feature_type).setLabelType(label_type).setSelectionThreshold(threshold)
    return VectorTransformer(stage, input_cols, output, label_col, input_param="featuresCol")


def grid(params: dict[str, Sequence]) -> list[dict]:
    return [dict(zip(params, values, strict=True)) for values in product(*params.values())]


def sampled_grid(params: dict[str, Sequence], n: int, seed: int = 0) -> list[dict]:
    rng, all_ = np.random.default_rng(seed), grid(params)
    return [all_[i] for i in sorted(rng.permutation(len(all_))[:n])]


def search(df: DataFrame, candidates: Sequence[dict], build: Callable[[dict], Estimator], folds: int = 3, key: Sequence[str] = (), at_once: int = 4) -> tuple[dict, list[dict]]:
    """Cross-validated score of each candidate, ``at_once`` fits at a time; folds by a hash of ``key`` (default: all columns). Returns the best (ties: the first) and all results by index."""
    fold = F.pmod(F.xxhash64(*(key or df.columns)), F.lit(folds))
    tagged = df.withColumn("_fold", fold)
    jobs = [(i, k) for i in range(len(candidates)) for k in range(folds)]

    def one(job: tuple[int, int]) -> float:
        i, k = job
        return build(candidates[i]).fit(tagged.where(F.col("_fold") != k).drop("_fold")).score(tagged.where(F.col("_fold") == k).drop("_fold"))

    with ThreadPoolExecutor(at_once) as pool:  # each fit is Spark jobs; the threads only wait for them
        scores = list(pool.map(one, jobs))
    results = [{"index": i, "params": p, "scores": scores[i * folds : (i + 1) * folds], "mean": float(np.mean(scores[i * folds : (i + 1) * folds]))} for i, p in enumerate(candidates)]
    return max(results, key=lambda r: r["mean"]), results


def search_ridge(df: DataFrame, input_cols: Sequence[str], label: str, alphas: Sequence[float], folds: int = 3, key: Sequence[str] = (), fold: Column | None = None) -> tuple[dict, list[dict]]:
    """As search over Ridge estimators, for all penalties and folds from one scan.

    The scan gives means and sums of products by fold. Those of all folds but
    one, merged, give the coefficients for any penalty by one small solve, and
    those of the fold left out give its R squared. Rows with nulls raise. fold:
    a column of fold numbers in place of the hash.
    """
    columns = [*input_cols, label]
    found = products(df, columns, F.pmod(F.xxhash64(*(key or df.columns)), F.lit(folds)) if fold is None else fold)
    if any(np.isnan(mean).any() for _, mean, _ in found.values()):
        raise ValueError("nulls or NaN in the columns")
    scores = np.full((len(alphas), folds), math.nan)
    for k in range(folds):
        n, mean, sums = _merged_products([v for f, v in found.items() if f != k], len(columns))
        held, held_mean, held_sums = found.get(k, (0, None, None))
        for i, alpha in enumerate(alphas):
            if n and held:
                slope = np.linalg.solve(sums[:-1, :-1] + alpha * np.eye(len(input_cols)), sums[:-1, -1])
                miss = (held_mean[-1] - mean[-1]) - (held_mean[:-1] - mean[:-1]) @ slope
                left = held_sums[-1, -1] - 2 * slope @ held_sums[:-1, -1] + slope @ held_sums[:-1, :-1] @ slope + held * miss**2
                scores[i, k] = 1 - left / held_sums[-1, -1]
    results = [{"index": i, "params": {"alpha": a}, "scores": [float(x) for x in scores[i]], "mean": float(np.mean(scores[i]))} for i, a in enumerate(alphas)]
    return max(results, key=lambda r: r["mean"]), results


def _merged_products(parts: Sequence[tuple[int, np.ndarray, np.ndarray]], k: int) -> tuple[int, np.ndarray, np.ndarray]:
    n = sum(rows for rows, *_ in parts)
    mean = sum((rows * m for rows, m, _ in parts), np.zeros(k)) / max(n, 1)
    return n, mean, sum((s + rows * np.outer(m - mean, m - mean) for rows, m, s in parts), np.zeros((k, k)))


def pivoted(rows: DataFrame, run: str, name: str, value: Column, names: Sequence | None = None) -> DataFrame:
    """One row for each run, with a column of the aggregated value for each name (given, or those that occur)."""
    return rows.groupBy(run).pivot(name, names).agg(value)


class Experiments:
    """Runs with parameters, and metrics by step, as appended Parquet rows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def log(self, run: str, params: dict[str, str] | None = None, metrics: Sequence[tuple[str, int, float]] = ()) -> None:
        rows = [(run, "param", k, None, str(v), None) for k, v in (params or {}).items()] + [(run, "metric", k, s, None, float(v)) for k, s, v in metrics]
        self.spark.createDataFrame(rows, "run string, kind string, name string, step long, text string, value double").write.mode("append").parquet(self.path)

    def runs(self) -> DataFrame:
        """One row for each run: a column for each parameter, and for each metric its value at the last step."""
        rows = self.spark.read.parquet(self.path)
        params = pivoted(rows.where("kind = 'param'"), "run", "name", F.max("text"))
        metrics = pivoted(rows.where("kind = 'metric'"), "run", "name", F.max_by("value", "step"))
        return params.join(metrics, "run", "full")

    def log_artifact(self, run: str, name: str, content: bytes) -> None:
        """A small file of a run; logged again, the later one counts."""
        rows = self.spark.createDataFrame([(run, name, bytearray(content))], "run string, name string, content binary")
        rows.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}.artifacts")

    def artifacts(self, run: str | None = None) -> DataFrame:
        """run, name and content of what was logged last under each name."""
        rows = self.spark.read.parquet(f"{self.path}.artifacts")
        newest = rows.groupBy("run", "name").agg(F.max_by("content", "at").alias("content"))
        return newest if run is None else newest.where(F.col("run") == run)
