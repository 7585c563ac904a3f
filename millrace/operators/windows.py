"""Windows within groups: latest and top rows, ranks, values carried forward, sums over a stretch of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.intervals import micros_of


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank from 1; the order should leave no ties."""
    if n < 1:
        raise ValueError("n must be positive")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """The row with the latest time of each key (ties: the largest row)."""
    return top_n(df, keys, [F.desc(ts), *[F.desc(c) for c in df.columns if c not in keys and c != ts]], 1, "_r").drop("_r")


def carried_forward(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, name: str) -> DataFrame:
    """df with the last value that is not null, up to and with each row of its group."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def over_time(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, aggregates: dict[str, Column]) -> DataFrame:
    """df with aggregates over the rows of its group from ``seconds`` before each row's time up to it, to the microsecond."""
    w = Window.partitionBy(*keys).orderBy("_us").rangeBetween(-seconds * 1_000_000, Window.currentRow)
    timed = df.withColumn("_us", micros_of(F.col(ts)))
    return timed.select(*df.columns, *[F.when(F.col("_us").isNotNull(), c.over(w)).alias(n) for n, c in aggregates.items()])


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """df with a number of its own for each row, repeated rows too; numbers are only the same again if the rows are dealt out alike."""
    return df.withColumn(name, F.monotonically_increasing_id())


#: Equal rows that one task numbers at once.
STRETCH = 1 << 16


def with_content_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """df with an id from each row's values, numbered among equal rows: the same again however the rows are dealt out. Columns must be of types that can be hashed and ordered.

    Equal rows are counted before they are sent, and written out again where
    they are numbered, in stretches of STRETCH: no task holds them all.
    """
    columns, parts = df.columns, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    floats = [c for c, kind in df.dtypes if "double" in kind or "float" in kind]
    # groups take 0.0 and -0.0 for one value, so the text parts them and the value comes from a row
    grouped = df.groupBy(*[c for c in columns if c not in floats], *[F.col(c).cast("string").alias(f"_text_{c}") for c in floats]).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in floats])
    hashed = F.concat_ws("-", *[F.lower(F.hex(F.xxhash64(F.lit(seed), *columns))) for seed in (1, 2)])
    # different rows may share a hash: nulls and the sign of 0.0 leave it as it is
    order = [c if c not in floats else f"_text_{c}" for c in columns]
    earlier = F.sum("_n").over(Window.partitionBy("_hash").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = grouped.withColumn("_hash", hashed).repartition(parts, "_hash").withColumn("_from", F.coalesce(earlier, F.lit(0)) + 1).withColumn("_to", F.col("_from") + F.col("_n") - 1)
    cut = F.explode(F.sequence("_from", "_to", F.lit(STRETCH))).alias("_from")
    long = placed.where(F.col("_n") > STRETCH).select(*columns, "_hash", cut, "_to").withColumn("_to", F.least(F.col("_to"), F.col("_from") + STRETCH - 1)).repartition(parts, "_hash", "_from")
    both = placed.where(F.col("_n") <= STRETCH).select(*columns, "_hash", "_from", "_to").union(long)
    return both.select(*columns, "_hash", F.explode(F.sequence("_from", "_to")).alias("_again")).select(*columns, F.concat_ws("-", "_hash", F.col("_again").cast("string")).alias(name))
