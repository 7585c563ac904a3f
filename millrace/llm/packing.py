"""Packing of examples into fixed-length sequences: vector bin packing.

A piece asks for three things at once: tokens, one segment, and loss-bearing
tokens. Bins are filled one at a time by the dot-product heuristic: of the
pieces that fit, take the one whose demand, weighted by how scarce each
dimension is, points most nearly along the bin's free capacity.

Each task packs its own rows, so nothing is shuffled and a lost task is simply
run again; only the last bin of a task can stay open.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.base import narrow_batches, slices
from millrace.llm.tokens import CACHE_UNITS, default_tokenizer, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary"


#: Bytes of ids in a batch of pieces, about.
_BATCH_BYTES = 4 << 20


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold at most: tokens, segments (pieces) and loss-bearing tokens."""

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048


#: Of a conversation most tokens may be prompts; a sequence takes at most three quarters of its tokens as answers.
CONVERSATION_LIMITS = Limits(2048, 512, 1536)


@dataclass
class Piece:
    """Ids ``start`` to ``start + length`` of an example; ``mask`` has 1 for each id that bears loss (None: all but the example's first)."""

    doc_id: int | None
    start: int
    ids: bytes
    total: int
    mask: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.length = len(self.ids) // 4
        self.loss = self.length - (self.start == 0 and self.length > 0) if self.mask is None else int(self.mask.sum())

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        masks = (None, None) if self.mask is None else (self.mask[:n], self.mask[n:])
        return Piece(self.doc_id, self.start, self.ids[: 4 * n], self.total, masks[0]), Piece(self.doc_id, self.start + n, self.ids[4 * n :], self.total, masks[1])

    def most(self, tokens: int, loss: int) -> int:
        """Ids at its start that hold no more tokens and loss than these."""
        n = min(self.length, tokens)
        if self.mask is None:
            return min(n, loss + (self.start == 0))
        mask = self.mask[:n]
        return n if mask.sum() <= loss else int(np.searchsorted(np.cumsum(mask), loss, side="right"))


class Packer:
    """Fills bins from a bounded pool of pieces.

    With ``cut``, a piece may be divided to fill a bin to its last token, and
    what is left at the end goes to sequences whose lengths are powers of two,
    which need no padding. Without it pieces stay whole; one that breaks a
    limit by itself raises ValueError.
    """

    def __init__(self, limits: Limits, cut: bool = True, pool: int = 1024) -> None:
        self.limits, self.may_cut, self.most = limits, cut, pool
        self.pool: list[Piece] = []
        self.demand = np.zeros((2 * pool + 2, 3), dtype=np.float64)
        self.capacity = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Take a piece; yield the bins that are full by now."""
        if not self.may_cut and (piece.length > self.limits.tokens or piece.loss > self.limits.loss):
            raise ValueError(f"example {piece.doc_id} exceeds the limits of a sequence")
        while self.may_cut and piece.length >= self.limits.tokens and (n := self._head(piece, *map(int, self.capacity))) == self.limits.tokens:
            head, piece = piece.cut(n)
            yield [head]
        if piece.length == 0 and piece.total:
            return
        self._put(piece)
        if len(self.pool) >= self.most:
            while len(self.pool) > self.most // 2:
                yield self._fill()

    def rest(self) -> Iterator[list[Piece]]:
        """The bins that hold what is left."""
        while self.pool:
            bin_ = self._fill()
            total = sum(p.length for p in bin_)
            if self.may_cut and not self.pool and total < self.limits.tokens:
                yield from self._powers(bin_, total)
            else:
                yield bin_

    def _put(self, piece: Piece) -> None:
        if len(self.pool) + 1 >= len(self.demand):
            self.demand = np.vstack([self.demand, np.zeros_like(self.demand)])
        self.demand[len(self.pool)] = (piece.length, 1, piece.loss)
        self.pool.append(piece)

    def _take(self, i: int) -> Piece:
        piece, last = self.pool[i], self.pool.pop()
        if piece is not last:
            self.pool[i] = last
            self.demand[i] = self.demand[len(self.pool)]
        return piece

    def _fill(self) -> list[Piece]:
        free, bin_ = self.capacity.copy(), []
        weight = self.demand[: len(self.pool)].mean(axis=0) / self.capacity**2
        while self.pool and free[0] > 0 and free[1] > 0:
            ask = self.demand[: len(self.pool)]
            score = ask @ (weight * free)
            score[(ask > free).any(axis=1)] = -1
            i = int(score.argmax())
            if score[i] < 0:
                if not self.may_cut:
                    break
                i = int(ask[:, 0].argmax())
                n = self._head(self.pool[i], *map(int, free))
                if n == 0:
                    break
                head, tail = self._take(i).cut(n)
                if tail.length:
                    self._put(tail)
                bin_.append(head)
                break
            bin_.append(self._take(i))
            free -= (bin_[-1].length, 1, bin_[-1].loss)
        return bin_

    def _head(self, piece: Piece, tokens: int, segments: int, loss: int) -> int:
        """Ids that a piece can give to a bin with so much free."""
        return piece.most(tokens, loss) if segments > 0 else 0

    def _powers(self, bin_: list[Piece], total: int) -> Iterator[list[Piece]]:
        pieces = bin_[::-1]
        while total:
            want, out = 1 << (total.bit_length() - 1), []
            total -= want
            while want:
                piece = pieces.pop()
                if piece.length > want:
                    piece, tail = piece.cut(want)
                    pieces.append(tail)
                want -= piece.length
                out.append(piece)
            yield out


def pack_tokens(rows: Iterator[tuple], limits: Limits, cut: bool, first_id: int) -> Iterator[tuple]:
    """Pack (doc_id, ids, mask) rows; yield a tuple of ``PIECES`` for each piece."""
    return _placed((Piece(doc_id, 0, ids, len(ids) // 4, mask) for doc_id, ids, mask in rows), limits, first_id, cut)


def _placed(pieces: Iterator[Piece], limits: Limits, first_id: int, cut: bool = True) -> Iterator[tuple]:
    packer, sequence = Packer(limits, cut), first_id

    def placed(bin_: list[Piece]) -> Iterator[tuple]:
        at = 0
        for p in bin_:
            yield (p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.total, sequence, at, p.loss, p.ids)
            at += p.length

    for piece in pieces:
        for bin_ in packer.add(piece):
            yield from placed(bin_)
            sequence += 1
    for bin_ in packer.rest():
        yield from placed(bin_)
        sequence += 1


def pack_documents(docs: DataFrame, tokenizer: str | None = None, limits: Limits = Limits(), cut: bool = True, end_id: int | None = 1, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, cache_units: int = CACHE_UNITS, batch_bytes: int = 8 << 20) -> DataFrame:
    """Tokenize and pack every text; a row for each piece (see ``PIECES``).

    Every id of a document, and the end id after them, lies in exactly one
    piece. The first id of a document bears no loss, since nothing precedes
    it. A null or empty text is the end id alone. Repeated rows and ids are
    packed one by one; a null id stays null. Other columns are not read, so
    their names do not matter. An empty table gives no rows. cache_units and
    batch_bytes set what a Python worker holds: units of texts between
    batches, and bytes of text in one.
    """
    path = tokenizer or default_tokenizer()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, cache_units).encode, b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

        def rows() -> Iterator[tuple]:
            for batch in slices(batches, "text", batch_bytes):
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                    yield doc_id, ids + end, None

        yield from _batches(pack_tokens(rows(), limits, cut, TaskContext.get().partitionId() << 33), with_ids)

    return narrow_batches(docs).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(pack, _schema(with_ids))


def pack_conversations(conversations: DataFrame, tokenizer: str | None = None, limits: Limits = CONVERSATION_LIMITS, end_id: int = 1, loss_role: str = "assistant", turns_at_once: int = 4096, cache_units: int = CACHE_UNITS) -> DataFrame:
    """Pack instruction data: one example for each conversation, loss on the turns of ``loss_role`` only.

    Turns follow each other by ``turn`` (null first; ties: role, then text),
    each ended by ``end_id``; conv_id stands in doc_id. A null text is the end
    id alone. Examples longer than a sequence are cut. Turns come to the packer
    as a sorted stream, of which no more than a sequence is held, and a
    conversation is spread over tasks by ranges of ``turns_at_once`` turn
    numbers, whose places come from a table of token counts by range; pieces
    end with a range. Turns without a conv_id are examples of their own.
    Repeated rows stay. Other columns are not read. An empty table gives no
    rows.
    """
    path, end = tokenizer or default_tokenizer(), np.array([end_id], dtype="<u4").tobytes()
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    part = F.coalesce(alone, F.floor(F.col("turn") / turns_at_once), F.lit(-1)).cast("long")
    turns = narrow_batches(conversations).select(F.col("conv_id").cast("long").alias("doc_id"), part.alias("part"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, cache_units).encode
        for batch in slices(batches, "text", 8 << 20):
            sizes = [len(ids) // 4 + 1 for ids in encode(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "part", "tokens"])

    sizes = turns.where("doc_id is not null").select("doc_id", "part", "text").mapInArrow(counted, "doc_id long, part long, tokens long").groupBy("doc_id", "part").agg(F.sum("tokens").alias("tokens"))
    one = Window.partitionBy("doc_id")
    before = F.coalesce(F.sum("tokens").over(one.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sizes.select("doc_id", "part", before.alias("before"), F.sum("tokens").over(one).alias("total"))
    placed = turns.where("doc_id is not null").join(places, ["doc_id", "part"]).unionByName(turns.where("doc_id is null").selectExpr("*", "0L as before", "0L as total"))
    stream = placed.select("doc_id", "part", "before", "total", "turn", "role", "text").repartition("doc_id", "part").sortWithinPartitions("doc_id", "part", "turn", "role", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, cache_units).encode

        def said() -> Iterator[tuple]:
            for batch in slices(batches, "text", 8 << 20):
                for row, ids in zip(zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(5).to_pylist(), strict=True), encode(batch.column(6)), strict=True):
                    ids += end
                    yield *row[:4], ids, np.full(len(ids) // 4, row[4] == loss_role, dtype=np.int8)

        yield from _batches(_placed(examples(said(), limits.tokens), limits, TaskContext.get().partitionId() << 33), False)

    return stream.mapInArrow(pack, _schema(False))


def examples(said: Iterator[tuple], tokens: int) -> Iterator[Piece]:
    """Pieces of up to so many tokens from the turns (doc_id, part, before, total, ids, mask) of each range, in order."""
    last, start, held, masks, size, total = None, 0, [], [], 0, 0
    for doc_id, part, before, whole, ids, mask in said:
        if doc_id is None or (doc_id, part) != last:
            if size:
                yield Piece(last[0], start, b"".join(held), total, np.concatenate(masks))
            last, start, held, masks, size, total = (doc_id, part), before, [], [], 0, whole or len(mask)
        held, masks, size = [*held, ids], [*masks, mask], size + len(mask)
        while size >= tokens:
            head, rest = Piece(doc_id, start, b"".join(held), total, np.concatenate(masks)).cut(tokens)
            yield head
            start, held, masks, size = rest.start, [rest.ids], [rest.mask], rest.length
    if size:
        yield Piece(last[0], start, b"".join(held), total, np.concatenate(masks))


def _schema(with_ids: bool) -> str:
    return PIECES if with_ids else PIECES.rpartition(",")[0]


def _batches(rows: Iterator[tuple], with_ids: bool) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _schema(with_ids).split(", ")]
    types = [pa.binary() if n == "ids" else pa.int64() for n in names]
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) if with_ids else 0
        if len(held) >= 4096 or size >= _BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=False)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=False)], names=names)
