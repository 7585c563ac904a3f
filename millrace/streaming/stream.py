"""Stream sources and streaming feature views."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from millrace.functions.intervals import micros_of, slice_start
from millrace.operators.tiles import LISTS, TileSpec, _lists, _partials, build_tiles


@dataclass(frozen=True)
class StreamSource:
    """A named, typed event schema over a landing folder of JSON files."""

    name: str
    schema: StructType
    path: str

    def read_stream(self, spark: SparkSession, max_files: int | None = None) -> DataFrame:
        reader = spark.readStream.schema(self.schema)
        return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(self.path)

    def ingest(self, spark: SparkSession, records: Sequence[dict]) -> int:
        """Append records to the landing folder; their keys must be the schema's."""
        names = set(self.schema.fieldNames())
        for r in records:
            if set(r) != names:
                raise ValueError(f"{self.name}: keys {sorted(set(r) ^ names)} do not match the schema")
        spark.createDataFrame([tuple(r[n] for n in self.schema.fieldNames()) for r in records], self.schema).write.mode("append").json(self.path)
        return len(records)


def apply_rowwise(df: DataFrame, transform: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
    """A pandas function of a batch of rows that keeps no state between rows; works on streams and tables alike."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield transform(frame)

    return df.mapInPandas(run, schema)


def stream_tiles(events: DataFrame, spec: TileSpec, late: str = "1 hour") -> DataFrame:
    """Tiles of a stream: tumbling windows behind a watermark, by the keys and the secondary key.

    tile_start is in seconds since 1970, as in tables, whatever the session's
    zone. Lists are a stream of their own, stream_lists.
    """
    if bad := [f.output for f in spec.features if f.function in LISTS]:
        raise ValueError(f"stream_lists makes {bad}")
    partials = {}
    for f in spec.features:
        partials |= _partials(f)
    keys = [*spec.keys, *([spec.secondary_key] if spec.secondary_key else [])]
    timed = events.withColumn("_ts", F.timestamp_micros(micros_of(F.col(spec.ts)))).withWatermark("_ts", late)
    tiles = timed.groupBy(*keys, F.window("_ts", f"{spec.seconds} seconds").alias("_w")).agg(*[c.alias(n) for n, c in partials.items()])
    return tiles.select(*keys, F.unix_timestamp("_w.start").alias("tile_start"), *partials)


#: States that the keys of a tile are dealt out to.
BUCKETS = 8


def stream_lists(events: DataFrame, spec: TileSpec, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """The list partials of a stream's tiles, as build_tiles has them, by keys and tile_start (update mode: a tile that got events comes again, whole).

    A tile's state holds the n newest or oldest values of each list and goes
    when the watermark has passed the tile. Events later than that are left
    out; until then the order in which they come makes no difference. Arrays
    are ordered as they rank. The keys of one tile share ``buckets`` states,
    so that Python is called for many keys at once; with many small batches
    and keys, more of them write less again. The number must stay the same
    for a checkpoint.
    """
    lists = {name: (f, n) for name, (f, n) in _lists(spec).items()}
    if not lists or len(lists) != len({f.output for f in spec.features}):
        raise ValueError("list features only, one for each function and column")
    kinds, zone = dict(events.dtypes), dict(events.dtypes)[spec.ts]
    keys = list(spec.keys)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket")
    stamped = F.timestamp_micros(micros_of(F.col(spec.ts))).alias("_ts")
    rows = events.where(F.col(spec.ts).isNotNull()).select(slice_start(F.col(spec.ts), spec.seconds).alias("tile_start"), bucket, stamped, micros_of(F.col(spec.ts)).alias("_at"), *keys, *[F.col(f.column).alias(name) for name, (f, _) in lists.items()])
    plan, seconds = {name: (f.function.startswith("last"), "distinct" in f.function, n) for name, (f, n) in lists.items()}, spec.seconds

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys, time and values of a row as bytes: pandas frames would make floats of whole numbers with nulls."""
        for batch in batches:
            values = zip(*[c.to_pylist() for c in batch.columns[3:]], strict=True)
            rows = pa.array([pickle.dumps(v) for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], rows], names=["tile_start", "_bucket", "_ts", "_row"])

    nan = float("nan")

    def one(key: tuple) -> tuple:
        """The key with one object for NaN, which only equals itself as an object."""
        return tuple(nan if x != x else x for x in key)

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        end = (int(key[0]) + seconds) * 1000
        if end <= state.getCurrentWatermarkMs():  # the tile is done; Spark lets events pass for a batch more
            return
        held: dict[tuple, list] = {one(k): items for k, items in pickle.loads(state.get[0])} if state.exists else {}
        fresh: dict[tuple, list] = {}
        for frame in frames:
            for row in frame["_row"]:
                at, *row = pickle.loads(row)
                k = one(tuple(row[: len(keys)]))
                if k not in fresh:
                    fresh[k] = [[] for _ in plan]
                for items, value in zip(fresh[k], row[len(keys) :], strict=True):
                    if value is not None and value == value:
                        items.append((at, value))
            for k, new in fresh.items():
                old = held.get(k) or [[] for _ in plan]
                held[k] = [best_values([*o, *i], *how) if i else o for o, i, how in zip(old, new, plan.values(), strict=True)]
                for items in new:
                    items.clear()
        state.update((pickle.dumps(list(held.items())),))
        state.setTimeoutTimestamp(end)
        yield pd.DataFrame({"tile_start": [key[0]], "_tiles": [pickle.dumps([(k, held[k]) for k in fresh])]})

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, tiles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = pickle.loads(tiles)
                columns = [[k[i] for k, _ in found] for i in range(len(keys))] + [[start] * len(found)]
                columns += [[[{"at": a, "value": v} for a, v in items[i]] or None for _, items in found] for i in range(len(plan))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.types, strict=True)], schema=types)

    fields = {f.name: f.dataType for f in events.schema.fields}
    items = [StructField(name, ArrayType(StructType([StructField("at", LongType()), StructField("value", fields[f.column])]))) for name, (f, _) in lists.items()]
    schema = StructType([*[StructField(k, fields[k]) for k in keys], StructField("tile_start", LongType()), *items])
    types = to_arrow_schema(schema, timestamp_utc=True)
    light = rows.mapInArrow(packed, "tile_start bigint, _bucket int, _ts timestamp, _row binary").withWatermark("_ts", late)
    made = light.groupBy("tile_start", "_bucket").applyInPandasWithState(advance, "tile_start bigint, _tiles binary", "held binary", "update", "EventTimeTimeout").mapInArrow(unpacked, schema)
    stamp = lambda x: F.timestamp_add("MICROSECOND", x["at"], F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast(zone)
    return made.select(*keys, "tile_start", *[F.transform(name, lambda x: F.struct(stamp(x).alias("at"), x["value"].alias("value"))).alias(name) for name in plan])


def best_values(items: list[tuple], newest: bool, distinct: bool, n: int) -> list[tuple]:
    """The n newest or oldest (time, value), ties by value; of equal values the newest or oldest one, if they are to be distinct."""
    if distinct:
        pick = max if newest else min
        once: dict = {}
        for at, value in items:
            once[value] = pick(once.get(value, at), at)
        items = [(at, value) for value, at in once.items()]
    return heapq.nlargest(n, items) if newest else heapq.nsmallest(n, items)


def backfill(history: DataFrame, ts: str, start: str | None, end: str | None, transform: Callable[[pd.DataFrame], pd.DataFrame] | None, schema: StructType | str | None) -> DataFrame:
    """History in [start, end) through the stream's transform."""
    if start:
        history = history.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        history = history.where(F.col(ts) < F.lit(end).cast("timestamp_ntz"))
    return history if transform is None else apply_rowwise(history, transform, schema)


def append_batches(stream: DataFrame, path: str | dict[str, Callable[[DataFrame], DataFrame]], checkpoint: str) -> StreamingQuery:
    """Write each micro-batch under its own number, so that a repeated batch replaces itself; ends when all is read.

    With a dict, each batch goes to several tables at once: to every path what
    its function makes of the batch.
    """
    parts = {path: lambda batch: batch} if isinstance(path, str) else path

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist() if len(parts) > 1 else batch
        try:
            for to, made in parts.items():
                made(held).write.mode("overwrite").parquet(f"{to}/batch={number}")
        finally:
            if len(parts) > 1:
                held.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def refresh_tiles(events: DataFrame, tiles: DataFrame, spec: TileSpec, changed: DataFrame) -> DataFrame:
    """Tiles after late or new events: only the groups (keys, secondary key, tile) that the changed events touch are computed again.

    Null keys are a group like any other. Changed events without a time touch nothing.
    """
    group = [*spec.keys, *([spec.secondary_key] if spec.secondary_key else []), "tile_start"]
    start = slice_start(F.col(spec.ts), spec.seconds)
    touched = changed.where(F.col(spec.ts).isNotNull()).withColumn("tile_start", start).select(*[F.col(c).alias(f"_t_{c}") for c in group]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in group])
    rows = events.withColumn("tile_start", start).join(touched, same, "left_semi").drop("tile_start")
    return tiles.join(touched, same, "left_anti").unionByName(build_tiles(rows, spec))
