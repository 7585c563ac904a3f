"""Preprocessing with fit and transform.

``fit`` is one aggregation (a few rows come back); ``transform`` is a
projection that Catalyst sees through, without joins or Python. Encoders keep
up to MOST_LITERAL categories of a column as a literal map; more are a table,
numbered without one task for all, that is joined.
"""

from __future__ import annotations

import statistics
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.prefix import exact_quantiles_of, modes, ordered_index

#: Most categories of a literal map.
MOST_LITERAL = 256


class Transformer:
    """Common parts: input, output and passed-through columns."""

    def __init__(self, input_cols: Sequence[str] | str, output_cols: Sequence[str] | str | None = None, passthrough_cols: Sequence[str] | None = None, drop_input_cols: bool = False) -> None:
        self.input_cols = [input_cols] if isinstance(input_cols, str) else list(input_cols)
        out = output_cols if output_cols is not None else self.input_cols
        self.output_cols = [out] if isinstance(out, str) else list(out)
        self.passthrough_cols = list(passthrough_cols or [])
        self.drop_input_cols = drop_input_cols
        self.state: dict | None = None
        if len(self.input_cols) != len(self.output_cols):
            raise ValueError("as many output as input columns are needed")
        if bad := set(self.input_cols) & set(self.passthrough_cols):
            raise ValueError(f"both input and passed through: {sorted(bad)}")

    def fit(self, df: DataFrame) -> "Transformer":
        if missing := [c for c in self.input_cols if c not in df.columns]:
            raise ValueError(f"no such columns: {missing}")
        self.state = self._fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.state is None:
            raise ValueError("fit first")
        outputs = {o: self._column(c, i).alias(o) for i, (c, o) in enumerate(zip(self.input_cols, self.output_cols, strict=True))}
        return self._placed(df, list(outputs.values()), set(outputs))

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def _placed(self, df: DataFrame, outputs: list[Column], names: set[str]) -> DataFrame:
        """New columns first, then the others in their order."""
        gone = names | (set(self.input_cols) if self.drop_input_cols else set())
        return df.select(*outputs, *[c for c in df.columns if c not in gone])

    def _fit(self, df: DataFrame) -> dict:
        return {}

    def _column(self, c: str, i: int) -> Column:
        raise NotImplementedError

    def _aggregate(self, df: DataFrame, **what) -> dict[str, list]:
        """Aggregates of each input column, in one job."""
        r = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}{i}") for k, f in what.items() for i, c in enumerate(self.input_cols)]).first()
        return {k: [r[f"{k}{i}"] for i in range(len(self.input_cols))] for k in what}

    def _no_nulls(self, df: DataFrame) -> None:
        r = df.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(f"n{i}") for i, c in enumerate(self.input_cols)]).first()
        if bad := [c for c, n in zip(self.input_cols, r, strict=True) if n]:
            raise ValueError(f"nulls in {bad}")


class StandardScaler(Transformer):
    """(x - mean) / population standard deviation; a deviation of 0 counts as 1."""

    def __init__(self, input_cols, output_cols=None, with_mean: bool = True, with_std: bool = True, **options) -> None:
        super().__init__(input_cols, output_cols, **options)
        self.with_mean, self.with_std = with_mean, with_std

    def _fit(self, df):
        return self._aggregate(df, mean=F.avg, std=F.stddev_pop)

    def _column(self, c, i):
        x = F.col(c).cast("double")
        x = x - F.lit(self.state["mean"][i]) if self.with_mean else x
        return x / F.lit(self.state["std"][i] or 1.0) if self.with_std else x


class MinMaxScaler(Transformer):
    """Linear map of [min, max] to the feature range; a range of 0 counts as 1."""

    def __init__(self, input_cols, output_cols=None, feature_range: tuple[float, float] = (0.0, 1.0), clip: bool = False, **options) -> None:
        super().__init__(input_cols, output_cols, **options)
        self.low, self.high, self.clip = float(feature_range[0]), float(feature_range[1]), clip
        if self.low >= self.high:
            raise ValueError("the feature range is empty")

    def _fit(self, df):
        return self._aggregate(df, min=F.min, max=F.max)

    def _column(self, c, i):
        low, high = self.state["min"][i], self.state["max"][i]
        scale = (self.high - self.low) / (((high or 0.0) - (low or 0.0)) or 1.0)
        x = (F.col(c).cast("double") - F.lit(low)) * F.lit(scale) + F.lit(self.low)
        return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(self.high)), F.lit(self.low))) if self.clip else x


class MaxAbsScaler(Transformer):
    def _fit(self, df):
        return self._aggregate(df, most=lambda x: F.max(F.abs(x)))

    def _column(self, c, i):
        return F.col(c).cast("double") / F.lit(self.state["most"][i] or 1.0)


class RobustScaler(Transformer):
    """(x - median) / quantile range, with exact linear quantiles; a range of 0 counts as 1."""

    def __init__(self, input_cols, output_cols=None, with_centering: bool = True, with_scaling: bool = True, quantile_range: tuple[float, float] = (25.0, 75.0), unit_variance: bool = False, **options) -> None:
        super().__init__(input_cols, output_cols, **options)
        self.with_centering, self.with_scaling, self.quantile_range, self.unit_variance = with_centering, with_scaling, quantile_range, unit_variance

    def _fit(self, df):
        low, high = (q / 100 for q in self.quantile_range)
        found = exact_quantiles_of(df, self.input_cols, [low, 0.5, high])
        return {k: [q[i] for q in found] for i, k in enumerate(("low", "median", "high"))}

    def _column(self, c, i):
        x = F.col(c).cast("double")
        span = (self.state["high"][i] or 0.0) - (self.state["low"][i] or 0.0)
        if self.unit_variance:
            normal = statistics.NormalDist()
            span /= normal.inv_cdf(self.quantile_range[1] / 100) - normal.inv_cdf(self.quantile_range[0] / 100)
        x = x - F.lit(self.state["median"][i]) if self.with_centering else x
        return x / F.lit(span or 1.0) if self.with_scaling else x


class Normalizer(Transformer):
    """Each row over its own norm (l1, l2 or max); a norm of 0 gives 0; nulls raise."""

    def __init__(self, input_cols, output_cols=None, norm: str = "l2", **options) -> None:
        super().__init__(input_cols, output_cols, **options)
        if norm not in ("l1", "l2", "max"):
            raise ValueError(f"norm: {norm!r}")
        self.norm = norm

    def transform(self, df):
        self._no_nulls(df)
        return super().transform(df)

    def _column(self, c, i):
        xs = [F.abs(F.col(n).cast("double")) for n in self.input_cols]
        if self.norm == "max":
            norm = F.greatest(*xs) if len(xs) > 1 else xs[0]
        else:
            norm = reduce(lambda a, b: a + b, [x * x for x in xs] if self.norm == "l2" else xs)
            norm = F.sqrt(norm) if self.norm == "l2" else norm
        return F.coalesce(F.try_divide(F.col(c).cast("double"), norm), F.lit(0.0))


class Binarizer(Transformer):
    """1.0 where strictly greater than the threshold, else 0.0; nulls raise."""

    def __init__(self, input_cols, output_cols=None, threshold: float = 0.0, **options) -> None:
        super().__init__(input_cols, output_cols, **options)
        self.threshold = threshold

    def transform(self, df):
        self._no_nulls(df)
        return super().transform(df)

    def _column(self, c, i):
        return F.when(F.col(c) > self.threshold, 1.0).otherwise(0.0)


class OrdinalEncoder(Transformer):
    """Place of the value among the sorted categories, as double.

    Null becomes ``encoded_missing_value`` (default null); a value that was
    not seen raises, or becomes ``unknown_value`` with
    handle_unknown="use_encoded_value".
    """

    def __init__(self, input_cols, output_cols=None, categories="auto", handle_unknown: str = "error", unknown_value: float | None = None, encoded_missing_value: float | None = None, **options) -> None:
        super().__init__(input_cols, output_cols, **options)
        self.categories, self.handle_unknown, self.unknown_value, self.encoded_missing_value = categories, handle_unknown, unknown_value, encoded_missing_value

    def _fit(self, df):
        if self.categories != "auto":
            return {"categories": [self.categories[c] for c in self.input_cols], "tables": [None] * len(self.input_cols)}
        found = [_categories(df, c) for c in self.input_cols]
        return {"categories": [f[0] for f in found], "tables": [f[1] for f in found]}

    def transform(self, df):
        if self.state is None:
            raise ValueError("fit first")
        joined, outputs = df, {}
        for i, (c, o) in enumerate(zip(self.input_cols, self.output_cols, strict=True)):
            if (table := self.state["tables"][i]) is None:
                hit = _in_map(F.col(c), self.state["categories"][i])
            else:
                hit = F.col(f"_code{i}")
                joined = joined.join(table.select(F.col(c).alias(f"_value{i}"), F.col("_code").cast("double").alias(f"_code{i}")), F.col(c) == F.col(f"_value{i}"), "left")
            outputs[o] = self._encoded(F.col(c), hit, c, i).alias(o)
        return self._placed(joined, list(outputs.values()), set(outputs)).drop(*[f"_{n}{i}" for i in range(len(self.input_cols)) for n in ("code", "value")])

    def _encoded(self, x: Column, hit: Column, c: str, i: int) -> Column:
        if self.handle_unknown == "error":
            found = F.when(x.isNotNull(), F.coalesce(hit, _raise(c, x)))
        else:
            found = F.coalesce(hit, F.lit(self.unknown_value).cast("double"))
        return F.when(x.isNull(), F.lit(self.encoded_missing_value).cast("double")).otherwise(found)


def _categories(df: DataFrame, column: str) -> tuple[list | None, DataFrame | None]:
    """The sorted distinct non-null values of a column as a list, or as a table with their places if there are more than MOST_LITERAL."""
    some = df.where(F.col(column).isNotNull()).select(column).distinct().limit(MOST_LITERAL + 1).collect()
    if len(some) <= MOST_LITERAL:
        return sorted(r[0] for r in some), None
    return None, ordered_index(df, column, "_code").persist()


def _in_map(x: Column, values: Sequence) -> Column:
    """Place of ``x`` among the values as double, or null."""
    if not values:
        return F.lit(None).cast("double")
    return F.element_at(F.create_map(*[F.lit(y) for k, v in enumerate(values) for y in (v, float(k))]), x)


def _raise(name: str, x: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"unknown category in {name}: "), x.cast("string"))).cast("double")


class LabelEncoder(OrdinalEncoder):
    """One column to 0 .. n-1; null is a class of its own, the last one; unseen values raise."""

    def __init__(self, input_cols, output_cols=None, **options) -> None:
        super().__init__(input_cols, output_cols, **options)
        if len(self.input_cols) != 1:
            raise ValueError("one column only")

    def _encoded(self, x, hit, c, i):
        table = self.state["tables"][0]
        size = len(self.state["categories"][0]) if table is None else table.count()
        return F.when(x.isNull(), F.lit(float(size))).otherwise(F.coalesce(hit, _raise(c, x)))


class OneHotEncoder(Transformer):
    """A column of 0 and 1 for each category, or one sparse map of place to 1.

    Rare categories (count below min_frequency, or beyond the max_categories
    most frequent) share one column _INFREQUENT. drop leaves out the first
    category ("first"), that of columns with two ("if_binary"), or a named one
    of each column (a list).
    handle_unknown: "error" or "ignore" (all zeros).
    """

    def __init__(self, input_cols, output_cols=None, sparse: bool = False, drop: str | Sequence[str] | None = None, handle_unknown: str = "error", min_frequency: int | float | None = None, max_categories: int | None = None, **options) -> None:
        super().__init__(input_cols, output_cols, **options)
        self.sparse, self.drop, self.handle_unknown, self.min_frequency, self.max_categories = sparse, drop, handle_unknown, min_frequency, max_categories

    def _fit(self, df):
        rows = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(self.input_cols)])).alias("e")).groupBy("e.i", "e.v").count().collect()  # one row for each category
        columns = []
        for i in range(len(self.input_cols)):
            counts = sorted((r["v"], r["count"]) for r in rows if r["i"] == i and r["v"] is not None)
            total = sum(r["count"] for r in rows if r["i"] == i)
            least = self.min_frequency * total if isinstance(self.min_frequency, float) else self.min_frequency or 0
            rare = {v for v, n in counts if n < least}
            kept = [(v, n) for v, n in counts if v not in rare]
            if self.max_categories is not None and len(kept) + bool(rare) > self.max_categories:
                by_count = sorted(kept, key=lambda x: (-x[1], x[0]))
                rare |= {v for v, _ in by_count[max(0, self.max_categories - 1) :]}
            names = [v for v, _ in counts if v not in rare] + (["_INFREQUENT"] if rare else [])
            nulls = any(r["i"] == i and r["v"] is None for r in rows)
            names += [None] if nulls else []
            if self.drop is None or isinstance(self.drop, str):
                gone = names[:1] if self.drop == "first" or self.drop == "if_binary" and len(names) == 2 else []
            elif (wanted := self.drop[i]) in names:
                gone = [wanted]
            else:
                raise ValueError(f"{self.input_cols[i]} has no category {wanted!r} to drop")
            columns.append({"names": names, "rare": sorted(rare), "gone": gone})
        return {"columns": columns}

    def _group(self, c: str, spec: dict) -> Column:
        x = F.col(c).cast("string")
        if spec["rare"]:
            x = F.when(x.isin(spec["rare"]), F.lit("_INFREQUENT")).otherwise(x)
        known = [n for n in spec["names"] if n is not None]
        if self.handle_unknown == "error":
            bad = x.isNotNull() & ~x.isin(known) if known else x.isNotNull()
            x = F.when(bad, F.raise_error(F.concat(F.lit(f"unknown category in {c}: "), x)).cast("string")).otherwise(x)
        return x

    def transform(self, df):
        if self.state is None:
            raise ValueError("fit first")
        out = []
        for c, o, spec in zip(self.input_cols, self.output_cols, self.state["columns"], strict=True):
            x = self._group(c, spec)
            names = [n for n in spec["names"] if n not in spec["gone"]]
            if self.sparse:
                place = F.coalesce(*[F.when(x.isNull(), F.lit(k)) for k, n in enumerate(names) if n is None], _in_map(x, [n for n in names if n is not None]).cast("int"))  # null comes last, and is in no map
                size = F.create_map(F.lit("array_length"), F.lit(len(names)))
                out.append(F.when(place.isNull(), size).otherwise(F.map_concat(F.create_map(place.cast("string"), F.lit(1)), size)).alias(o))
            else:
                out += [F.when(x.eqNullSafe(F.lit(n)), 1.0).otherwise(0.0).alias(f"{o}_{n}") for n in names]
        return df.select(*out, *[c for c in df.columns if not (self.drop_input_cols and c in self.input_cols) and c not in (self.output_cols if self.sparse else [])])


class KBinsDiscretizer(Transformer):
    """Bins of equal width or equal weight; ordinal codes, or 0/1 columns. The value of an inner edge belongs to the bin above; a column without values has one bin."""

    def __init__(self, input_cols, output_cols=None, n_bins: int = 5, encode: str = "ordinal", strategy: str = "quantile", **options) -> None:
        super().__init__(input_cols, output_cols, **options)
        if strategy not in ("uniform", "quantile") or encode not in ("ordinal", "onehot", "onehot-dense") or n_bins < 2:
            raise ValueError("strategy is uniform or quantile, encode ordinal, onehot or onehot-dense, n_bins 2 or more")
        self.n_bins, self.encode, self.strategy = n_bins, encode, strategy

    def _fit(self, df):
        n = self.n_bins
        if self.strategy == "uniform":
            s = self._aggregate(df, low=F.min, high=F.max)
            edges = [[a + (b - a) * k / n for k in range(n + 1)] if a is not None else [] for a, b in zip(s["low"], s["high"], strict=True)]
        else:
            found = exact_quantiles_of(df, self.input_cols, [k / n for k in range(n + 1)])
            edges = [q if q[0] is not None else [] for q in found]
        return {"edges": [[e for i, e in enumerate(x) if i == 0 or e - x[i - 1] > 1e-8] for x in edges]}

    def _code(self, c, i) -> Column:
        x = F.col(c).cast("double")
        inner = self.state["edges"][i][1:-1]
        return F.when(x.isNotNull(), reduce(lambda a, e: a + F.when(x >= e, 1.0).otherwise(0.0), inner, F.lit(0.0)))

    def _column(self, c, i):
        return self._code(c, i)

    def transform(self, df):
        if self.encode == "ordinal":
            return super().transform(df)
        out = []
        for i, (c, o) in enumerate(zip(self.input_cols, self.output_cols, strict=True)):
            bins, code = max(1, len(self.state["edges"][i]) - 1), self._code(c, i)
            if self.encode == "onehot":
                out.append(F.create_map(code.cast("int").cast("string"), F.lit(1), F.lit("array_length"), F.lit(bins)).alias(o))
            else:
                out += [F.when(code == k, 1.0).otherwise(0.0).alias(f"{o}_{k}") for k in range(bins)]
        return df.select(*out, *[c for c in df.columns if not (self.drop_input_cols and c in self.input_cols) and c not in (self.output_cols if self.encode == "onehot" else [])])


class SimpleImputer(Transformer):
    """Fills missing values with mean, median, most_frequent (ties: the smallest) or a constant."""

    def __init__(self, input_cols, output_cols=None, strategy: str = "mean", fill_value=None, missing_values=None, **options) -> None:
        super().__init__(input_cols, output_cols, **options)
        if strategy not in ("mean", "median", "most_frequent", "constant"):
            raise ValueError(f"strategy: {strategy!r}")
        self.strategy, self.fill_value, self.missing_values = strategy, fill_value, missing_values

    def _missing(self, c: str, numeric: bool) -> Column:
        x = F.col(c)
        if self.missing_values is not None:
            return x == F.lit(self.missing_values)
        return x.isNull() | F.isnan(x.cast("double")) if numeric else x.isNull()

    def _fit(self, df):
        kinds = dict(df.dtypes)
        self._numeric = {c: kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal") for c in self.input_cols}
        if self.strategy == "constant":
            return {"fill": [self.fill_value if self.fill_value is not None else 0 if self._numeric[c] else "missing_data" for c in self.input_cols]}
        seen = {c: F.when(~self._missing(c, self._numeric[c]), F.col(c)) for c in self.input_cols}
        if self.strategy == "mean":
            return {"fill": list(df.agg(*[F.avg(seen[c]).alias(f"f{i}") for i, c in enumerate(self.input_cols)]).first())}
        names = [f"_x{i}" for i in range(len(self.input_cols))]
        one = df.select(*[seen[c].alias(n) for c, n in zip(self.input_cols, names, strict=True)])
        return {"fill": [q[0] for q in exact_quantiles_of(one, names, [0.5])] if self.strategy == "median" else modes(one, names)}

    def _column(self, c, i):
        fill = self.state["fill"][i]
        return F.col(c) if fill is None else F.when(self._missing(c, self._numeric[c]), F.lit(fill)).otherwise(F.col(c))


class MissingIndicator(Transformer):
    """True where a value is null (or NaN)."""

    def _column(self, c, i):
        return F.col(c).isNull() | F.coalesce(F.isnan(F.expr(f"try_cast(`{c}` as double)")), F.lit(False))


class PolynomialFeatures(Transformer):
    """Products of the inputs up to a degree: output names join the factors by a blank, as in "a b" or "a^2"."""

    def __init__(self, input_cols, degree: int = 2, interaction_only: bool = False, include_bias: bool = True, **options) -> None:
        super().__init__(input_cols, None, **options)
        self.degree, self.interaction_only, self.include_bias = degree, interaction_only, include_bias

    def transform(self, df):
        from itertools import combinations, combinations_with_replacement

        pick = combinations if self.interaction_only else combinations_with_replacement
        out = []
        for d in range(0 if self.include_bias else 1, self.degree + 1):
            for names in pick(self.input_cols, d):
                powers = {n: names.count(n) for n in dict.fromkeys(names)}
                label = " ".join(n if k == 1 else f"{n}^{k}" for n, k in powers.items()) or "1"
                out.append(reduce(lambda a, n: a * F.col(n).cast("double"), names, F.lit(1.0)).alias(label))
        names = {n for n in self.input_cols}
        return df.select(*out, *[c for c in df.columns if c not in names])


class ColumnTransformer:
    """Several transformers on columns of the same table, applied one after another."""

    def __init__(self, transformers: Sequence[tuple[str, Transformer]]) -> None:
        self.transformers = list(transformers)

    def fit(self, df):
        for _, t in self.transformers:
            t.fit(df)
        return self

    def transform(self, df):
        for _, t in self.transformers:
            df = t.transform(df)
        return df

    def fit_transform(self, df):
        return self.fit(df).transform(df)


class Pipeline:
    """Steps of which each is fitted on what the ones before it return; the last may be an estimator with predict."""

    def __init__(self, steps: Sequence[tuple[str, object]]) -> None:
        if len({n for n, _ in steps}) != len(steps):
            raise ValueError("step names repeat")
        self.steps = list(steps)

    def fit(self, df):
        for i, (_, s) in enumerate(self.steps):
            s.fit(df)
            if i + 1 < len(self.steps):
                df = s.transform(df)
        return self

    def transform(self, df):
        for _, s in self.steps:
            df = s.transform(df)
        return df

    def predict(self, df):
        for _, s in self.steps[:-1]:
            df = s.transform(df)
        return self.steps[-1][1].predict(df)

    def predict_proba(self, df):
        for _, s in self.steps[:-1]:
            df = s.transform(df)
        return self.steps[-1][1].predict_proba(df)

    def score(self, df):
        for _, s in self.steps[:-1]:
            df = s.transform(df)
        return self.steps[-1][1].score(df)


def column_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each column: count, max, mean, median, min, stddev, stddev_pop, variance, var_pop, mode."""
    stats = {"count": F.count, "max": F.max, "mean": F.avg, "min": F.min, "stddev": F.stddev, "stddev_pop": F.stddev_pop, "variance": F.variance, "var_pop": F.var_pop}
    numbers = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    apart = {c: {"median": q[0], "mode": m} for c, q, m in zip(columns, exact_quantiles_of(numbers, numbers.columns, [0.5]), modes(numbers, numbers.columns), strict=True)}
    order = ("count", "max", "mean", "median", "min", "stddev", "stddev_pop", "variance", "var_pop", "mode")
    value = lambda c, k: stats[k](F.col(c).cast("double")).cast("double") if k in stats else F.lit(apart[c][k]).cast("double")
    one = df.agg(*[F.struct(F.lit(c).alias("column"), *[value(c, k).alias(k) for k in order]).alias(f"s{i}") for i, c in enumerate(columns)])
    return one.select(F.explode(F.array(*[f"s{i}" for i in range(len(columns))])).alias("s")).select("s.*")
