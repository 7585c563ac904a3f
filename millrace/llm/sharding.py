"""Documents dealt out to shards of near-equal bytes by sampled splitters.

The key of a document is a hash of its text, so equal texts lie together. Keys
are drawn with weights that follow the sizes, their quantiles cut the keys into
ranges, and the exact bytes of each range are counted. A range that holds too
much is cut again at keys drawn from itself; one that is a single text (a group
of copies) is cut by row numbers, but only if it is a large part of a shard.
The largest piece goes first, each to the shard that has the fewest bytes.

The driver holds the draws and a row for each piece; both are bounded by
parameters, not by the documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.base import saved


@dataclass(frozen=True)
class Settings:
    """shards: how many; extra: bytes that a document has besides its text; least and most pieces; draws for each piece; most rounds of cutting."""

    shards: int = 24
    extra: int = 8
    pieces_a_shard: int = 64
    piece_bytes: int = 1 << 30
    most_pieces: int = 16384
    draws: int = 16
    rounds: int = 4

    def pieces(self, total: int) -> int:
        return int(min(max(self.shards * self.pieces_a_shard, total // self.piece_bytes), self.most_pieces))


def shard_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null) and piece of every row.

    size: UTF-8 bytes of the text and ``extra``; a null text has the key and the
    size of an empty one. slot numbers a shard's rows from 0 without gaps, by
    piece, key and doc_id (null first). Repeated rows each get a slot. Equal
    texts share a shard unless they fill more than half of one. An empty table
    gives no rows. Other columns play no part, whatever their names.
    """
    rows = _narrow(docs, settings)
    piece, cuts = _piece(rows, settings)
    cut = rows.withColumn("_range", _range_of(cuts)).withColumn("piece", piece.cast("int"))
    found = sorted(tuple(r) for r in cut.groupBy("piece").agg(F.sum("size"), F.count("*")).collect())  # a row for each piece
    places = docs.sparkSession.createDataFrame(_dealt(found, settings.shards), "piece int, shard int, _before long")
    number = F.row_number().over(Window.partitionBy("piece").orderBy("_key", F.asc_nulls_first("doc_id"), "_row")).cast("long") - 1
    dealt = cut.join(F.broadcast(places), "piece").withColumn("slot", F.col("_before") + number)  # most_pieces rows, and the parts of hot texts
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "piece")


def _narrow(docs: DataFrame, settings: Settings) -> DataFrame:
    """Sizes and keys without the texts, written once: later steps see the same row numbers whatever is lost."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id"), F.col("text"))
    return saved(slim.select("doc_id", (F.octet_length(text).cast("long") + settings.extra).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_key"), F.xxhash64(F.monotonically_increasing_id()).alias("_row")), "shard-rows")


def _drawn(rows: DataFrame, n: int, total: int) -> np.ndarray:
    """About n keys (in expectation, n at most), each row by itself with a chance that follows its share of ``total`` bytes, told by a hash."""
    u = (F.pmod(F.xxhash64("_key", "doc_id", "_row"), F.lit(1 << 53)) + 1) / F.lit(float((1 << 53) + 1))
    drawn = rows.where(u <= F.col("size") * F.lit(n / total)).select("_key")
    return np.sort(drawn.toPandas()["_key"].to_numpy(dtype=np.int64))


def _quantiles(keys: np.ndarray, parts: int) -> list[int]:
    return sorted({int(keys[i * len(keys) // parts]) for i in range(1, parts)}) if len(keys) and parts > 1 else []


def _range_of(cuts: Sequence[int]) -> Column:
    at = np.array(cuts, dtype=np.int64)

    @F.pandas_udf("int")
    def place(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in parts:
            yield pd.Series(np.searchsorted(at, keys.to_numpy(dtype=np.int64), side="left").astype(np.int32))

    return place("_key") if len(at) else F.lit(0)


def _piece(rows: DataFrame, settings: Settings) -> tuple[Column, list[int]]:
    """The piece of a row, by its range of keys ``_range`` and, where one text fills too much, its row number; and the cuts between ranges."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    wanted = settings.pieces(total)
    half = total / settings.shards / 2
    most = min(2 * total / wanted, half)
    cuts = _quantiles(_drawn(rows, wanted * settings.draws, max(total, 1)), wanted)
    for left in range(settings.rounds, -1, -1):
        ranged = rows.withColumn("_range", _range_of(cuts))
        found = ranged.groupBy("_range").agg(F.sum("size"), F.count("*"), F.min("_key"), F.max("_key")).collect()  # a row for each range
        over = [tuple(r) for r in found if r[1] > most and r[3] != r[4]]
        if not over or not left:
            break
        cuts = sorted({*cuts, *_cut_again(ranged, over, most, settings)})
    free, piece = len(cuts) + 1, F.col("_range")
    for r, held, n, low, high in sorted(tuple(r) for r in found):
        if held > half and n > 1 and low == high:  # twice as many as there are shards at most
            parts = int(min(n, -(-held // (half / 8))))
            piece = F.when(F.col("_range") == r, free + F.pmod("_row", F.lit(parts))).otherwise(piece)
            free += parts
    return piece, cuts


def _cut_again(ranged: DataFrame, over: list[tuple], most: float, settings: Settings) -> list[int]:
    """Cuts within the ranges that hold too much, from keys drawn there; a text with a large share of a range gets one of its own."""
    more = []
    wanted = min(settings.most_pieces, sum(int(held // most) + 2 for _, held, *_ in over))
    drawn = _drawn(ranged.where(F.col("_range").isin([r[0] for r in over])), wanted * settings.draws, sum(r[1] for r in over))
    for _, held, _, low, high in over:
        own = drawn[(drawn >= low) & (drawn <= high)]
        more += _quantiles(own, int(held // most) + 2)
        values, times = np.unique(own, return_counts=True)
        more += [int(k) + d for k, t in zip(values, times, strict=True) if 2 * t * held > most * len(own) for d in (-1, 0) if low <= int(k) + d < high]
    return more


def _dealt(pieces: list[tuple], shards: int) -> list[tuple[int, int, int]]:
    """(piece, shard, rows before it there): the largest first, to the shard with the fewest bytes so far."""
    heap, rows, out = [(0, s) for s in range(shards)], [0] * shards, []
    for p, size, n in sorted(pieces, key=lambda x: (-x[1], x[0])):
        held, s = heapq.heappop(heap)
        out.append((p, s, rows[s]))
        rows[s] += n
        heapq.heappush(heap, (held + size, s))
    return out
