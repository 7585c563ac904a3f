"""Running sums, ranks, exact quantiles and modes over whole tables, without one task for all rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a part, most parts, and values that are drawn for each cut between parts.
PART_ROWS, MOST_PARTS, DRAWN = 1 << 20, 512, 32


def parts_for(rows: int) -> int:
    return max(1, min(MOST_PARTS, -(-rows // PART_ROWS)))


def cut_points(df: DataFrame, order: str, parts: int) -> list:
    """At most parts - 1 values that cut the column's values into parts of about equal size, from the values with the smallest hashes."""
    if parts < 2:
        return []
    drawn = df.where(F.col(order).isNotNull()).select(order).orderBy(F.xxhash64(order), order).limit(parts * DRAWN).collect()  # bounded by MOST_PARTS * DRAWN
    values = sorted(r[0] for r in drawn)
    return sorted({values[i * len(values) // parts] for i in range(1, parts)}) if values else []


def part_of(x: Column, cuts: Sequence, first: int = 0) -> Column:
    """How many cuts lie below ``x``, by a balanced tree of comparisons."""
    if not cuts:
        return F.lit(first)
    middle = len(cuts) // 2
    return F.when(x > F.lit(cuts[middle]), part_of(x, cuts[middle + 1 :], first + middle + 1)).otherwise(part_of(x, cuts[:middle], first))


def running_sums(df: DataFrame, order: str, values: Sequence[str], descending: bool = False, parts: int | None = None) -> DataFrame:
    """df with run_<value>: the sum of the value over all rows up to and with this one.

    ``order`` must be distinct; rows where it is null come out without sums.
    The table is cut into parts along it (as many as its size asks for); each
    part is summed by itself, and what lies before it is added from a table of
    one row for each part. The table is read three times.
    """
    parts = parts or parts_for(df.count())
    cut = df.withColumn("_part", F.when(F.col(order).isNotNull(), part_of(F.col(order), cut_points(df, order, parts))))
    totals = cut.where("_part is not null").groupBy("_part").agg(*[F.sum(v).alias(f"_total_{v}") for v in values])
    before = Window.orderBy(F.desc("_part") if descending else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part"), *[F.coalesce(F.sum(f"_total_{v}").over(before), F.lit(0)).alias(f"_before_{v}") for v in values])
    within = Window.partitionBy("_part").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = cut.join(F.broadcast(offsets), "_part", "left")  # one row for each part, MOST_PARTS at most
    return joined.select(*df.columns, *[F.when(F.col("_part").isNotNull(), F.sum(v).over(within) + F.col(f"_before_{v}")).alias(f"run_{v}") for v in values])


def with_next(df: DataFrame, order: str, values: Sequence[str], descending: bool = False, parts: int | None = None) -> DataFrame:
    """df with next_<value>: the value in the row that follows along ``order`` (distinct and not null), null in the last one."""
    parts = parts or parts_for(df.count())
    cut = df.withColumn("_part", part_of(F.col(order), cut_points(df, order, parts)))
    way, first_of = (F.desc, F.max_by) if descending else (F.asc, F.min_by)
    firsts = cut.groupBy("_part").agg(first_of(F.struct(*[F.col(v).alias(v) for v in values]), F.col(order)).alias("_first"))
    follow = firsts.select("_part", F.lead("_first").over(Window.orderBy(way("_part"))).alias("_follow"))  # one row for each part
    within = Window.partitionBy("_part").orderBy(way(order))
    one = F.struct(*[F.col(v).alias(v) for v in values])
    found = cut.join(F.broadcast(follow), "_part").withColumn("_next", F.coalesce(F.lead(one).over(within), F.col("_follow")))
    return found.select(*df.columns, *[F.col("_next")[v].alias(f"next_{v}") for v in values])


def ordered_index(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """The distinct values of a column, without null, and the place of each in their order (from 0)."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct().withColumn("_one", F.lit(1).cast("long"))
    return running_sums(values, column, ["_one"]).select(column, (F.col("run__one") - 1).alias(name))


def exact_quantiles(df: DataFrame, column: str, at: Sequence[float]) -> list[float | None]:
    """Linear quantiles of a numeric column without its nulls; of no rows None."""
    return exact_quantiles_of(df, [column], at)[0]


#: Bits of a digit that one scan tells apart; the scans that all 64 take.
DIGIT, SCANS = 13, 5


def exact_quantiles_of(df: DataFrame, columns: Sequence[str], at: Sequence[float]) -> list[list[float | None]]:
    """Linear quantiles of several numeric columns, each without its nulls; of no rows None. NaN is the largest value.

    Radix selection: the bits of a double, put in the order of the values, are
    found digit by digit. Each of five scans counts, for all columns at once,
    the digits that follow the prefixes of the wanted ranks; a partition counts
    for itself and the counts are added. So neither columns nor values make
    more scans.
    """
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    places: list[list[float]] = []
    # by column: rank -> (prefix so far, rank among the values with that prefix)
    wanted: list[dict[int, tuple[int, int]]] = []
    for scan in range(SCANS):
        shift = DIGIT * (SCANS - 1 - scan)
        prefixes = [sorted({p for p, _ in w.values()}) for w in wanted] if scan else [[0]] * len(columns)
        found = _digit_counts(rows, prefixes, shift)
        if not scan:
            sizes = [sum(found.get((i, 0), {}).values()) for i in range(len(columns))]
            places = [[(n - 1) * q for q in at] if n else [] for n in sizes]
            wanted = [{r: (0, r) for p in ps for r in (math.floor(p), math.ceil(p))} for ps in places]
        for i, ranks in enumerate(wanted):
            for rank, (prefix, left) in ranks.items():
                for digit, n in sorted(found[i, prefix].items()):
                    if left < n:
                        break
                    left -= n
                ranks[rank] = (prefix << DIGIT | digit, left)
    values = [{r: _from_bits(bits) for r, (bits, _) in ranks.items()} for ranks in wanted]
    between = lambda v, p: v[math.floor(p)] if p == math.floor(p) else (1 - (p - math.floor(p))) * v[math.floor(p)] + (p - math.floor(p)) * v[math.ceil(p)]
    return [[between(v, p) for p in ps] if ps else [None] * len(at) for v, ps in zip(values, places, strict=True)]


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Bits of doubles as unsigned numbers in the doubles' order; both zeros are one value, and all NaN are one."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _from_bits(bits: int) -> float:
    bits = bits & ((1 << 64) - 1)
    raw = bits & ~(1 << 63) if bits >> 63 else ~bits & ((1 << 64) - 1)
    return float(np.array([raw], dtype=np.uint64).view(np.float64)[0])


def _digit_counts(rows: DataFrame, prefixes: Sequence[Sequence[int]], shift: int) -> dict[tuple[int, int], dict[int, int]]:
    """How often each digit follows each of a column's prefixes. At most 8192 digits for a column and prefix come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {(i, p): np.zeros(1 << DIGIT, dtype=np.int64) for i, ps in enumerate(prefixes) for p in ps}
        for batch in batches:
            for i, ps in enumerate(prefixes):
                bits = _ordered_bits(batch.column(i).drop_null().to_numpy(zero_copy_only=False))
                before = bits >> np.uint64(shift + DIGIT) if shift + DIGIT < 64 else np.zeros_like(bits)
                digits = ((bits >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
                for p in ps:
                    seen[i, p] += np.bincount(digits if shift + DIGIT >= 64 else digits[before == np.uint64(p)], minlength=1 << DIGIT)
        for (i, p), n in seen.items():
            some = np.flatnonzero(n)
            k = len(some)
            yield pa.RecordBatch.from_pydict({"i": pa.array([i] * k, pa.int32()), "p": pa.array([str(p)] * k, pa.string()), "d": pa.array(some, pa.int32()), "n": pa.array(n[some], pa.int64())})

    out: dict[tuple[int, int], dict[int, int]] = {}
    for r in rows.mapInArrow(count, "i int, p string, d int, n long").groupBy("i", "p", "d").agg(F.sum("n").alias("n")).collect():
        out.setdefault((r["i"], int(r["p"])), {})[r["d"]] = r["n"]
    return out


def modes(df: DataFrame, columns: Sequence[str]) -> list:
    """The most frequent value that is not null (ties: the smallest) of each column, or None; one aggregation for all columns of a type."""
    kinds, out = dict(df.dtypes), {}
    for kind in sorted({kinds[c] for c in columns}):
        mine = [c for c in columns if kinds[c] == kind]
        values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("x")) for i, c in enumerate(mine)])).alias("e")).where("e.x is not null")
        best = values.groupBy("e.i", "e.x").count().groupBy("i").agg(F.min(F.struct((-F.col("count")).alias("less"), "x"))["x"].alias("x"))
        out |= {mine[r["i"]]: r["x"] for r in best.collect()}  # a row for each column
    return [out.get(c) for c in columns]


def mode(df: DataFrame, column: str):
    """As modes, of one column."""
    return modes(df, [column])[0]
