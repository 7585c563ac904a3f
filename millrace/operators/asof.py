"""As-of joins: for each left row the latest right row that is not after it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.intervals import micros_of
from millrace.operators.prefix import part_of


#: Right rows of a key that one task sorts; a key with more is cut in parts of time. Most parts.
PART_ROWS, MOST_PARTS = 4 << 20, 512
#: Bytes that Spark's own estimate of the right rows must reach before their keys are counted.
COUNTED_BYTES = 64 << 20


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, columns: Sequence[str] | None = None, prefix: str = "", strict: bool = False, per_column: bool = False, tolerance_seconds: int | None = None, spread: int | None = None) -> DataFrame:
    """All left rows, each with ``columns`` of the latest right row with equal keys and right_ts <= left_ts.

    Both sides are united and sorted by key and time once; ``last`` over the
    rows so far carries the latest right row along, so there is one shuffle
    and no pair of rows is ever formed. strict asks for right_ts < left_ts.
    per_column takes the latest non-null value of each column instead of the
    latest row. Left rows with a null key or time stay, unmatched; right rows
    with one match nothing. Among right rows with equal time the one with the
    largest values wins. Repeated left rows stay. The right time is available
    as a column of ``columns`` if it is named there.

    Keys with more than PART_ROWS right rows are cut in parts of time, sorted
    apart, and the last right row of the parts before is brought to each.
    spread > 1 cuts every key in so many parts, 1 none.
    """
    names = list(columns) if columns is not None else [c for c in right.columns if c not in on and c != right_ts]
    if not per_column and tolerance_seconds is None:
        return asof_join_many(left, [(right, right_ts, names, prefix)], on, left_ts, strict, spread)
    if (spread or 1) > 1:
        raise ValueError("spread goes with whole rows and no tolerance only")
    both, rest = _united(left, [(right, right_ts, names, prefix)], on, left_ts, strict)
    w = _so_far(on)
    if per_column:
        hits = [F.last(F.col("_hit0")[c], ignorenulls=True).over(w).alias(prefix + c) for c in names]
    else:
        hits = [F.last("_hit0", ignorenulls=True).over(w).alias("_hit0")]
    since = F.last(F.when(F.col("_hit0").isNotNull(), F.col("_t")), ignorenulls=True).over(w).alias("_since")
    done = both.select("_row", "_t", *hits, *([since] if tolerance_seconds is not None else [])).where(F.col("_row").isNotNull())

    def value(c: str) -> Column:
        v = F.col(prefix + c) if per_column else F.col("_hit0")[c]
        if tolerance_seconds is None:
            return v
        return F.when(F.timestamp_diff("SECOND", F.col("_since"), F.col("_t")) <= tolerance_seconds, v)

    return done.select(*[F.col("_row")[c].alias(c) for c in left.columns], *[value(c).alias(prefix + c) for c in names]).unionByName(rest)


def asof_join_many(left: DataFrame, rights: Sequence[tuple[DataFrame, str, Sequence[str], str]], on: Sequence[str], left_ts: str, strict: bool = False, spread: int | None = None) -> DataFrame:
    """As asof_join with several right sides, (rows, time, columns, prefix) each, in one shuffle and one sort of all."""
    both, rest = _united(left, rights, on, left_ts, strict)
    hits = [f"_hit{i}" for i in range(len(rights))]
    heavy = _heavy(both, rights, on) if spread is None else None
    parts = spread if spread is not None else 1 if heavy is None else heavy[1]
    carried = [F.last(h, ignorenulls=True) for h in hits]
    if parts <= 1:
        done = both.select("_row", *[c.over(_so_far(on)).alias(h) for c, h in zip(carried, hits, strict=True)]).where(F.col("_row").isNotNull())
    else:
        done = _in_parts(both, on, hits, None if heavy is None else heavy[0], parts).where(F.col("_row").isNotNull())
    found = [F.col(f"_hit{i}")[c].alias(prefix + c) for i, (_, _, names, prefix) in enumerate(rights) for c in names]
    return done.select(*[F.col("_row")[c].alias(c) for c in left.columns], *found).unionByName(rest)


def _keys(on: Sequence[str]) -> list[str]:
    return [f"_k{i}" for i in range(len(on))]


def _so_far(on: Sequence[str], *more: str):
    return Window.partitionBy(*_keys(on), *more).orderBy("_t", "_tag", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _united(left: DataFrame, rights: Sequence[tuple], on: Sequence[str], left_ts: str, strict: bool) -> tuple[DataFrame, DataFrame]:
    """Left and right rows in one table (_k0.., _t, _tag, _tie, _row, _hit0..), and the left rows that can match nothing, in the result's form."""
    given = [prefix + c for _, _, names, prefix in rights for c in names]
    if clash := {c for c in given if c in left.columns or given.count(c) > 1}:
        raise ValueError(f"columns on both sides: {sorted(clash)}; give a prefix")
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on], F.col(left_ts).isNotNull())
    keys = [F.col(k).alias(name) for k, name in zip(on, _keys(on), strict=True)]
    row_type = "struct<" + ",".join(f"`{c}`:{t}" for c, t in left.dtypes) + ">"
    kinds = ["struct<" + ",".join(f"`{c}`:{dict(r.dtypes)[c]}" for c in names) + ">" for r, _, names, _ in rights]
    # with strict, left rows of a time come before the right rows of that time
    mine, theirs = (0, 1) if strict else (1, 0)

    def rows(df: DataFrame, keep: Column, ts: str, tag: int, row: Column, hit: int | None, names: Sequence[str] = ()) -> DataFrame:
        value = F.struct(*[F.col(c) for c in names]) if hit is not None else None
        hits = [(value if i == hit else F.lit(None).cast(kind)).alias(f"_hit{i}") for i, kind in enumerate(kinds)]
        return df.where(keep).select(*keys, F.col(ts).alias("_t"), F.lit(tag).alias("_tag"), row.alias("_row"), *hits)

    both = rows(left, whole, left_ts, mine, F.struct(*[F.col(c) for c in left.columns]), None)
    for i, (right, ts, names, _) in enumerate(rights):
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on], F.col(ts).isNotNull())
        both = both.unionByName(rows(right, known, ts, theirs, F.lit(None).cast(row_type), i, names))
    tie = F.col("_hit0") if len(rights) == 1 else F.struct(*[f"_hit{i}" for i in range(len(rights))])
    blank = [F.lit(None).cast(dict(r.dtypes)[c]).alias(prefix + c) for r, _, names, prefix in rights for c in names]
    return both.withColumn("_tie", tie), left.where(~whole).select(*left.columns, *blank)


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of a table's size, before it is computed."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _heavy(both: DataFrame, rights: Sequence[tuple], on: Sequence[str]) -> tuple[DataFrame, int] | None:
    """The keys with more than PART_ROWS right rows and the parts that the largest needs; none if there are none. Small tables aren't counted."""
    if sum(estimated_bytes(r) for r, *_ in rights) < COUNTED_BYTES:
        return None
    counts = both.where(F.col("_row").isNull()).groupBy(*_keys(on)).count().where(F.col("count") > PART_ROWS)
    most = counts.agg(F.max("count")).first()[0]
    return None if most is None else (counts.drop("count"), min(MOST_PARTS, -(-most // PART_ROWS)))


def _in_parts(both: DataFrame, on: Sequence[str], hits: Sequence[str], heavy: DataFrame | None, parts: int) -> DataFrame:
    """The rows with what was carried to them: by part, and from the last part before that had something."""
    keys = _keys(on)
    kind = dict(both.dtypes)["_t"]
    number = micros_of if kind.startswith("timestamp") or kind == "date" else lambda c: c.cast("double")
    flagged = both.withColumn("_heavy", F.lit(True)) if heavy is None else both.join(heavy.withColumn("_heavy", F.lit(True)), keys, "left")
    times = flagged.where("_heavy and _row is null").select(number(F.col("_t")).cast("double").alias("t"))
    cuts = sorted(set(times.approxQuantile("t", [i / parts for i in range(1, parts)], 0.25 / parts)))
    cut = flagged.withColumn("_part", F.when(F.col("_heavy"), part_of(number(F.col("_t")).cast("double"), cuts)).otherwise(F.lit(0)))
    within = _so_far(on, "_part")
    carried = cut.select(*keys, "_part", "_row", *[F.last(h, ignorenulls=True).over(within).alias(h) for h in hits])
    newest = [F.max(F.when(F.col(h).isNotNull(), F.struct("_t", F.col(h).alias("hit")))).alias(h) for h in hits]
    totals = cut.where("_heavy").groupBy(*keys, "_part").agg(*newest)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_part", *[F.last(F.col(h)["hit"], ignorenulls=True).over(earlier).alias(f"_before{h}") for h in hits])
    joined = carried.join(before, [*keys, "_part"], "left")  # a row for each part of a heavy key
    return joined.select("_row", *[F.coalesce(h, f"_before{h}").alias(h) for h in hits])


def running_by_key(df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, tuple]) -> DataFrame:
    """keys, order and for each row the aggregates (F.sum, F.min or F.max, of a column) over the rows of its key up to it.

    ``order`` must be distinct within a key. A key with more than PART_ROWS
    rows is cut in parts along it: each part is scanned by itself, and what the
    parts before come to is added. Null keys are a key.
    """
    rows = df.select(*keys, order, *[c.alias(n) for n, (_, c) in columns.items()])
    scan = lambda *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = None
    if estimated_bytes(df) >= COUNTED_BYTES:
        counts = rows.groupBy(*keys).count().where(F.col("count") > PART_ROWS)
        most = counts.agg(F.max("count")).first()[0]
    if counts is None or most is None:
        return rows.select(*keys, order, *[f(n).over(scan(*keys)).alias(n) for n, (f, _) in columns.items()])
    return _running_in_parts(rows, keys, order, columns, counts.drop("count"), min(MOST_PARTS, -(-most // PART_ROWS)))


def _running_in_parts(rows: DataFrame, keys: Sequence[str], order: str, columns: dict[str, tuple], heavy: DataFrame, parts: int) -> DataFrame:
    renamed = heavy.select(*[F.col(k).alias(f"_h_{k}") for k in keys]).withColumn("_heavy", F.lit(True))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys])
    flagged = rows.join(renamed, same, "left").drop(*[f"_h_{k}" for k in keys])
    cuts = sorted(set(flagged.where("_heavy").select(F.col(order).cast("double").alias("t")).approxQuantile("t", [i / parts for i in range(1, parts)], 0.25 / parts)))
    cut = flagged.withColumn("_part", F.when(F.col("_heavy"), part_of(F.col(order).cast("double"), cuts)).otherwise(F.lit(0)))
    w = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.select(*keys, order, "_part", *[f(n).over(w).alias(n) for n, (f, _) in columns.items()])
    totals = cut.where("_heavy").groupBy(*keys, "_part").agg(*[f(n).alias(n) for n, (f, _) in columns.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.col("_part").alias("_p"), *[f(n).over(earlier).alias(f"_before{n}") for n, (f, _) in columns.items()])
    joined = local.join(before, same & (F.col("_part") == F.col("_p")), "left")  # a row for each part of a heavy key
    add = {F.min: F.least, F.max: F.greatest}
    both = lambda f, n: add[f](n, f"_before{n}") if f in add else F.coalesce(F.col(n) + F.col(f"_before{n}"), F.col(n), F.col(f"_before{n}"))
    return joined.select(*keys, order, *[both(f, n).alias(n) for n, (f, _) in columns.items()])


def range_join_binned(left: DataFrame, right: DataFrame, on: Sequence[str], point: str, low: str, high: str, width: int, how: str = "inner") -> DataFrame:
    """Pairs with equal keys and low <= point < high, as an equi-join on bins of ``width``.

    point is on the right; low and high (same numeric unit, on the left) may
    span several bins, and a left row is repeated once for each. A key with
    many rows is spread over its bins, and only rows of one bin meet.
    """
    bins = F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width)))
    lefts = left.withColumn("_bin", bins)
    rights = right.withColumn("_bin", F.floor(F.col(point) / width))
    meets = (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))
    return lefts.join(rights, [*on, "_bin"], how).where(meets).drop("_bin")


def validity_join(facts: DataFrame, mapping: DataFrame, on: Sequence[str], at: str, valid_from: str, valid_to: str) -> DataFrame:
    """Facts with the mapping rows that are valid at their time: from <= at, and before to (null: still valid).

    Rows of a mapping whose time no other row of the key overlaps are found by
    an as-of join, which forms no pairs. Rows that overlap go to bins of their
    own length (powers of two), two at most, and facts to the bin of each such
    length; so pairs are formed about as often as they match. Null keys and
    times match nothing.
    """
    names = [*on, *[c for c in facts.columns if c not in on], *[c for c in mapping.columns if c not in on]]
    kind = dict(mapping.dtypes)[valid_from]
    number = (lambda c: micros_of(c).cast("double")) if kind.startswith("timestamp") or kind == "date" else lambda c: c.cast("double")
    low, high = number(F.col(valid_from)), F.coalesce(number(F.col(valid_to)), F.lit(float("inf")))
    rows = mapping.select(*[F.col(k).alias(f"_on{i}") for i, k in enumerate(on)], F.struct(*[c for c in mapping.columns if c not in on]).alias("_valid"), low.alias("_low"), high.alias("_high")).where("_low < _high")
    same = Window.partitionBy(*[f"_on{i}" for i in range(len(on))]).orderBy("_low", "_high")
    earlier = F.max("_high").over(same.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_alone", (F.coalesce(earlier, F.col("_low")) <= F.col("_low")) & (F.coalesce(F.lead("_low").over(same), F.col("_high")) >= F.col("_high")))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on], F.col(at).isNotNull())
    numbered = facts.where(known).withColumn("_at", number(F.col(at)))
    keys = [f"_on{i}" for i in range(len(on))]
    alone = marked.where("_alone").select(*[F.col(k).alias(o) for k, o in zip(keys, on, strict=True)], "_valid", "_low", "_high")
    swept = asof_join(numbered, alone, on, "_at", "_low", ["_valid", "_high"]).where(F.col("_at") < F.col("_high"))
    spread = lambda df: df.select(*[c for c in facts.columns], "_valid")
    out = spread(swept)
    crossing = marked.where("not _alone").withColumn("_level", F.when(F.col("_high") == float("inf"), F.lit(_OPEN)).otherwise(F.ceil(F.log2(F.col("_high") - F.col("_low"))).cast("int")))
    if levels := sorted(r[0] for r in crossing.select("_level").distinct().collect()):  # one for each power of two
        size = F.when(F.col("_level") == _OPEN, F.lit(float("inf"))).otherwise(F.pow(F.lit(2.0), F.col("_level")))
        place = lambda t: F.when(F.col("_level") == _OPEN, F.lit(0.0)).otherwise(F.floor(t / size).cast("double"))
        bins = crossing.withColumn("_bin", F.explode(F.array_distinct(F.array(*[place(t) for t in (F.col("_low"), (F.col("_low") + F.col("_high")) / 2, F.col("_high"))]))))
        asked = numbered.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels]))).withColumn("_bin", place(F.col("_at")))
        matches = reduce(lambda a, b: a & b, [F.col(o) == F.col(k) for o, k in zip(on, keys, strict=True)])
        b = bins.select(*keys, "_valid", "_low", "_high", F.col("_level").alias("_l"), F.col("_bin").alias("_b"))
        met = asked.join(b, matches & (F.col("_level") == F.col("_l")) & (F.col("_bin") == F.col("_b"))).where("_at >= _low and _at < _high")
        out = out.unionByName(spread(met))
    return out.select(*[c for c in names if c in facts.columns], *[F.col("_valid")[c].alias(c) for c in mapping.columns if c not in on])


#: The level of rows that are valid without an end.
_OPEN = 1 << 20
