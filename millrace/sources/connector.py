"""Readers that hand a table over to a training loop in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


#: Ranges of a shard that equal shards are cut in.
_PLACES = 4096


class DataConnector:
    """A lazily evaluated table with sinks for pandas, Arrow and training frameworks."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    @classmethod
    def from_dataframe(cls, df: DataFrame) -> "DataConnector":
        return cls(df)

    @classmethod
    def from_sql(cls, spark: SparkSession, query: str) -> "DataConnector":
        return cls(spark.sql(query))

    @classmethod
    def from_dataset(cls, version) -> "DataConnector":
        return cls(version.read(only_feature_cols=True))

    @classmethod
    def from_files(cls, spark: SparkSession, paths: Sequence[str]) -> "DataConnector":
        """Files or folders of one format, told by extension (default: Parquet)."""
        formats = {p.rsplit(".", 1)[-1].lower() if "." in p.rsplit("/", 1)[-1] else "parquet" for p in paths}
        if len(formats) != 1:
            raise ValueError(f"formats must not be mixed: {sorted(formats)}")
        name = formats.pop()
        reader = spark.read.option("header", True) if name == "csv" else spark.read
        return cls(reader.format(name if name in ("csv", "json", "orc", "parquet", "text") else "parquet").load(list(paths)))

    @classmethod
    def from_arrow(cls, spark: SparkSession, rows: "pa.Table | Sequence[pa.RecordBatch]") -> "DataConnector":
        """Rows that are in the driver's memory already, as a result of another reader."""
        return cls(spark.createDataFrame(rows if isinstance(rows, pa.Table) else pa.Table.from_batches(rows)))

    @classmethod
    def from_sources(cls, sources: Sequence["DataConnector | DataFrame"]) -> "DataConnector":
        return cls(reduce(lambda a, b: a.unionByName(b), [s.df if isinstance(s, DataConnector) else s for s in sources]))

    def to_batches(self, batch_size: int, shuffle: bool = False, drop_last_batch: bool = False, seed: int | None = None, buffer_rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        """Arrow batches of exactly batch_size rows (the last may have fewer), all of one schema.

        Executors hand over Arrow batches; partitions come to the driver one
        after another, and what a batch leaves over begins the next one. With
        shuffle each call (epoch) reads the partitions (files, or stretches of
        them) in another order and draws rows from a buffer of buffer_rows;
        nothing is sorted or exchanged. A seed makes the order the same again.
        """
        if batch_size < 1 or buffer_rows < 1:
            raise ValueError("batch_size and buffer_rows must be positive")
        schema = to_arrow_schema(self.df.schema, timestamp_utc=True)
        rng = np.random.default_rng(seed)
        for batch in _cut(_buffered(_permuted(self.df, rng), buffer_rows, schema, rng) if shuffle else _record_batches(self.df), batch_size, schema):
            if batch.num_rows == batch_size or not drop_last_batch:
                yield batch

    def over_batches(self, consume: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, batch_size: int, shuffle: bool = False, drop_last_batch: bool = False, buffer_rows: int = 1 << 16) -> DataFrame:
        """What ``consume`` makes of the batches of to_batches, on the executors: each task gets its share of them, and no row goes to the driver.

        Batches are cut where the rows are read. What each partition leaves
        over, less than a batch, goes to one task, which cuts it again: all
        batches but one have batch_size rows. With shuffle, rows are drawn from
        a buffer and batches are dealt out at random.
        """
        if batch_size < 1 or buffer_rows < 1:
            raise ValueError("batch_size and buffer_rows must be positive")
        types = to_arrow_schema(self.df.schema, timestamp_utc=True)
        spread = int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rng = np.random.default_rng()
            for batch in _cut(_buffered(batches, buffer_rows, types, rng) if shuffle else batches, batch_size, types):
                place = int(rng.integers(1, 1 << 62)) if batch.num_rows == batch_size else 0
                for packed in _packed(iter([batch])):
                    yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), packed.column(0)], names=["place", "data"])

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            left: list[pa.RecordBatch] = []

            def batches() -> Iterator[pa.RecordBatch]:
                nonlocal left
                for part in rows:
                    for place, data in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                        for batch in pa.ipc.open_stream(data.as_buffer()):
                            if place:
                                yield batch
                                continue
                            left.append(batch)
                            if sum(b.num_rows for b in left) >= batch_size:
                                whole = list(_cut(left, batch_size, types))
                                left = [] if whole[-1].num_rows == batch_size else [whole.pop()]
                                yield from whole
                if left and not drop_last_batch:
                    yield from _cut(left, batch_size, types)

            yield from consume(batches())

        return self.df.mapInArrow(pieces, "place bigint, data binary").repartition(spread, "place").mapInArrow(run, schema)

    def to_pandas(self, limit: int | None = None) -> pd.DataFrame:
        return (self.df if limit is None else self.df.limit(limit)).toPandas()

    def to_arrow(self) -> pa.Table:
        return self.df.toArrow()

    def to_torch_dataset(self, batch_size: int, shuffle: bool = False, drop_last_batch: bool = False):
        """An IterableDataset of dicts of arrays; needs torch."""
        import torch

        connector = self

        class Rows(torch.utils.data.IterableDataset):
            def __iter__(self):
                for batch in connector.to_batches(batch_size, shuffle, drop_last_batch):
                    yield {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}

        return Rows()

    def to_tf_dataset(self, batch_size: int, shuffle: bool = False, drop_last_batch: bool = False):
        """A tf.data.Dataset; needs tensorflow."""
        import tensorflow as tf

        first = self.df.limit(1).toArrow()
        signature = {f.name: tf.TensorSpec(shape=(None,), dtype=tf.as_dtype(f.type.to_pandas_dtype())) for f in first.schema}
        rows = lambda: ({n: c.to_numpy(zero_copy_only=False) for n, c in zip(b.schema.names, b.columns, strict=True)} for b in self.to_batches(batch_size, shuffle, drop_last_batch))
        return tf.data.Dataset.from_generator(rows, output_signature=signature)

    def to_huggingface_dataset(self, limit: int | None = None):
        """A datasets.Dataset, whose files the executors write; needs datasets."""
        import datasets

        return datasets.Dataset.from_spark(self.df if limit is None else self.df.limit(limit))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        yield pa.RecordBatch.from_pydict({"data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _record_batches(df: DataFrame) -> Iterator[pa.RecordBatch]:
    """The rows as Arrow batches, one partition at the driver at a time."""
    for row in df.mapInArrow(_packed, "data binary").toLocalIterator(prefetchPartitions=True):
        yield from pa.ipc.open_stream(row["data"])


def _permuted(df: DataFrame, rng: np.random.Generator) -> Iterator[pa.RecordBatch]:
    """As _record_batches, the partitions in a drawn order: one job each, as only an RDD runs single partitions."""
    packed = df.mapInArrow(_packed, "data binary").rdd
    for p in rng.permutation(packed.getNumPartitions()):
        for data in df.sparkSession.sparkContext.runJob(packed, lambda rows: [bytes(r[0]) for r in rows], [int(p)]):
            yield from pa.ipc.open_stream(data)


def _buffered(batches: Iterator[pa.RecordBatch], size: int, schema: pa.Schema, rng: np.random.Generator) -> Iterator[pa.RecordBatch]:
    """The rows in the order in which they are drawn from a buffer: when it holds twice its size, half of its rows, drawn at random, go on."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch.cast(schema) if batch.schema != schema else batch)
        rows += batch.num_rows
        if rows >= 2 * size:
            mixed = pa.Table.from_batches(held, schema).take(pa.array(rng.permutation(rows)))
            yield from mixed.slice(size).to_batches()
            held, rows = mixed.slice(0, size).to_batches(), size
    if rows:
        yield from pa.Table.from_batches(held, schema).take(pa.array(rng.permutation(rows))).to_batches()


def _cut(batches: Iterable[pa.RecordBatch], size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of exactly ``size`` rows (the last may have fewer), all of one schema."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch.cast(schema) if batch.schema != schema else batch)
        rows += batch.num_rows
        if rows >= size:
            whole = pa.Table.from_batches(held, schema).combine_chunks()
            for at in range(0, rows - size + 1, size):
                yield _as_batch(whole.slice(at, size))
            rest = whole.slice(rows - rows % size)
            held, rows = rest.to_batches() if rest.num_rows else [], rest.num_rows
    if rows:
        yield _as_batch(pa.Table.from_batches(held, schema))


def _as_batch(table: pa.Table) -> pa.RecordBatch:
    return table.combine_chunks().to_batches()[0]


def shard(df: DataFrame, world_size: int, rank: int, order: Sequence[str], equal: bool = False) -> DataFrame:
    """The rows of one of ``world_size`` shards, dealt out by a hash of the ordering columns' values.

    Equal values go to the same shard. With equal, each shard gives as many
    rows as the smallest one has: in the order of a second hash, then of the
    columns.
    """
    if not 0 <= rank < world_size:
        raise ValueError("rank must be below world_size")
    tagged = df.withColumn("_shard", F.pmod(F.xxhash64(*order), F.lit(world_size)))
    mine = tagged.where(F.col("_shard") == rank).drop("_shard")
    if not equal:
        return mine
    sizes = {r["_shard"]: r["count"] for r in tagged.groupBy("_shard").count().collect()}  # one row for each shard
    least = min(sizes.get(r, 0) for r in range(world_size))
    # whole ranges of a second hash come first, and only the range that holds the last wanted row is ranked
    place = F.pmod(F.xxhash64(F.lit(1), *order), F.lit(_PLACES))
    counts = sorted((r["p"], r["count"]) for r in mine.groupBy(place.alias("p")).count().collect())  # _PLACES rows at most
    before, edge = 0, 0
    for p, n in counts:
        if before + n > least:
            edge = p
            break
        before, edge = before + n, p + 1
    ranked = mine.where(place == edge).withColumn("_r", F.row_number().over(Window.partitionBy(place).orderBy(*order, *df.columns))).where(F.col("_r") <= least - before).drop("_r")
    return mine.where(place < edge).unionByName(ranked)


def cast_for_dataset(df: DataFrame) -> DataFrame:
    """Decimals to bigint (scale 0) or double, float to double, byte to smallint; the rest as it is."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        to = None
        if kind.startswith("decimal"):
            to = "bigint" if kind.endswith(",0)") else "double"
        elif kind in ("float", "tinyint"):
            to = {"float": "double", "tinyint": "smallint"}[kind]
        out.append(F.col(f.name).cast(to).alias(f.name) if to else F.col(f.name))
    return df.select(*out)


def check_not_null(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise if any of the columns has a null."""
    r = df.agg(*[(F.count("*") - F.count(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    if bad := {c: n for c, n in zip(columns, r, strict=True) if n}:
        raise ValueError(f"nulls: {bad}")


def key_filter(df: DataFrame, keys: Sequence[str], values: Sequence[Sequence]) -> DataFrame:
    """Rows whose keys equal one of the tuples, compared in the column's own type; None equals null only."""
    if any(len(v) != len(keys) for v in values):
        raise ValueError("each tuple needs a value for every key")
    kinds = dict(df.dtypes)
    wanted = df.sparkSession.createDataFrame([tuple(None if x is None else str(x) for x in v) for v in values], ", ".join(f"`_key_{k}` string" for k in keys))
    wanted = wanted.select(*[F.col(f"_key_{k}").cast(kinds[k]).alias(f"_key_{k}") for k in keys]).distinct()
    return df.join(wanted, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]), "left_semi")
