"""Benchmark decontamination: SimHash of item-sized windows.

For each benchmark item, every window of as many words is a candidate. A
window's SimHash (64 bits over its word shingles) is looked up in a
multi-index: the fingerprint is cut into four blocks of 16 bits, and each
table lists for a block value the items whose block lies within a quarter of
the radius. Two fingerprints within the radius agree that far in one block at
least, so the tables lose none of them. Exact weighted-shingle similarity
(sum of the smaller counts over sum of the larger ones) decides.

Windows of which too few shingles occur in any item cannot reach the wanted
similarity and get no fingerprint; that bound is exact and loses nothing.

Texts are not shuffled. The items are the stated query set: they go to the
tasks in blocks of bounded size (4096 items take about 160 MB a worker), with a
scan of the texts for each block.
"""

from __future__ import annotations

import functools
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import narrow_batches, slices, text_column
from millrace.llm.wordhash import LETTER_WORDS, ngram_hashes, word_hashes

HITS = "doc_id long, item_id long, start_word long, n_words long, hamming int, similarity double"
BLOCKS, BLOCK_BITS = 4, 16
_ONE = np.uint64(1)


@dataclass(frozen=True)
class Settings:
    """similarity: least weighted-shingle similarity. radius: largest Hamming distance of fingerprints (19: a pair at similarity 0.75 differs in 11 bits, with a standard deviation of 3)."""

    shingle: int = 5
    similarity: float = 0.75
    radius: int = 19


class ItemIndex:
    """Fingerprints and shingles of a block of items, and the block tables over them."""

    def __init__(self, items: list[tuple[int, str]], settings: Settings) -> None:
        self.settings = settings
        self.ids: list[int] = []
        self.sizes: list[int] = []
        self.counts: list[Counter] = []
        prints, grams = [], []
        words, at = word_hashes(pa.array([t for _, t in items], pa.string()), LETTER_WORDS)
        for (item_id, _), a, b in zip(items, at[:-1], at[1:], strict=True):
            if b > a:
                g = ngram_hashes(words[a:b], min(settings.shingle, b - a))
                self.ids.append(item_id)
                self.sizes.append(int(b - a))
                self.counts.append(Counter(g.tolist()))
                prints.append(simhashes(g, np.array([0]), len(g))[0])
                grams.append(g)
        self.prints = np.array(prints, dtype=np.uint64)
        self.of_size: dict[int, np.ndarray] = {s: np.array([i for i, t in enumerate(self.sizes) if t == s]) for s in sorted(set(self.sizes))}
        self.known: dict[int, np.ndarray] = {}
        for k in sorted({min(settings.shingle, s) for s in self.sizes}):
            self.known[k] = np.unique(np.concatenate([g for g, s in zip(grams, self.sizes, strict=True) if min(settings.shingle, s) == k]))
        self.gates = {k: _gate(v) for k, v in self.known.items()}
        self.tables = self._tables()

    def _tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        near = [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= self.settings.radius // BLOCKS]
        near = np.array(near, dtype=np.uint64)
        out = []
        for b in range(BLOCKS):
            values = (self.prints >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)
            keys = (values[:, None] ^ near[None, :]).astype(np.int64).ravel()
            order = np.argsort(keys, kind="stable")
            starts = np.searchsorted(keys[order], np.arange((1 << BLOCK_BITS) + 1))
            out.append((starts, (order // max(len(near), 1)).astype(np.int32)))
        return out

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs (place in prints, item, distance) within the radius."""
        found = []
        for b, (starts, items) in enumerate(self.tables):
            v = ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            n = starts[v + 1] - starts[v]
            row = np.repeat(np.arange(len(prints)), n)
            item = items[np.repeat(starts[v] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            close = np.bitwise_count(prints[row] ^ self.prints[item]) <= self.settings.radius
            found.append(row[close] * len(self.prints) + item[close])
        row, item = np.divmod(np.unique(np.concatenate(found)), max(len(self.prints), 1))
        return row, item, np.bitwise_count(prints[row] ^ self.prints[item])

    def search(self, words: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(item, start, words, distance, similarity) of the best window of each item that the text holds."""
        best: dict[int, tuple] = {}
        gram, k_now, touched = None, 0, None
        for size, _ in self.of_size.items():
            k = min(self.settings.shingle, size)
            span = min(size, len(words))
            if span < k:
                continue
            if k != k_now:
                gram, k_now = ngram_hashes(words, k), k
                touched = np.concatenate([[0], np.cumsum(_isin(gram, self.known[k], self.gates[k]))])
            if touched[-1] == 0:
                continue
            m = span - k + 1
            starts = np.flatnonzero(touched[m:] - touched[:-m] >= self.settings.similarity * m)
            if not len(starts):
                continue
            prints = simhashes(gram, starts, m)
            for row, item, distance in zip(*(x.tolist() for x in self.near(prints)), strict=True):
                if self.sizes[item] != size:
                    continue
                start = int(starts[row])
                s = similarity(Counter(gram[start : start + m].tolist()), self.counts[item])
                if s >= self.settings.similarity and (item not in best or (-s, start) < best[item][:2]):
                    best[item] = (-s, start, span, distance)
        for item, (s, start, span, distance) in sorted(best.items()):
            yield item, start, span, distance, -s


@functools.lru_cache(maxsize=1)
def item_index(items: tuple[tuple[int, str], ...], settings: Settings) -> ItemIndex:
    """The index of a block of items, once for each Python worker that meets the block again."""
    return ItemIndex(list(items), settings)


def simhashes(grams: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """SimHash of the m shingles from each start on; a bit that half of them have is 0."""
    low, high = int(starts.min()), int(starts.max()) + m
    bits = np.unpackbits(grams[low:high].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(bits) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    set_ = 2 * (sums[starts - low + m] - sums[starts - low]) > m
    return np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def similarity(a: Counter, b: Counter) -> float:
    both = (a & b).total()
    return both / (a.total() + b.total() - both)


_GATE_BITS = 20


def _gate(known: np.ndarray) -> np.ndarray:
    gate = np.zeros(1 << _GATE_BITS, dtype=bool)
    gate[(known >> np.uint64(64 - _GATE_BITS)).astype(np.int64)] = True
    return gate


def _isin(grams: np.ndarray, known: np.ndarray, gate: np.ndarray) -> np.ndarray:
    out = gate[(grams >> np.uint64(64 - _GATE_BITS)).astype(np.int64)]
    at = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)
    out[at] = known[place] == grams[at]
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), items_at_once: int = 4096, bytes_at_once: int = 32 << 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The best window for each document and item that it holds (see ``HITS``).

    Similarity is that of the item with a window of as many words (with the
    whole text where that is shorter), over shingles of five words, in words
    of letters and digits without regard to case. An item of fewer words is
    one shingle. Items and texts that are null or without words match nothing;
    rows that repeat are compared each by itself; ties go to the first
    window. Null ids are kept. Other columns are not read.
    """
    rows = narrow_batches(docs).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    found = None
    for items in _item_blocks(benchmark, items_at_once, bytes_at_once):
        hits = rows.mapInArrow(_hits(items, settings), HITS)
        found = hits if found is None else found.unionByName(hits)
    return found


def _item_blocks(benchmark: DataFrame, items_at_once: int, bytes_at_once: int) -> Iterator[list[tuple[int, str]]]:
    """The items (a stated query set) in blocks of bounded size; one block at least."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where(F.col("text").isNotNull())
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // items_at_once), -(-size // bytes_at_once))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield [tuple(r) for r in own.collect()]  # one bounded block


def _hits(items: list[tuple[int, str]], settings: Settings):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = item_index(tuple(items), settings)
        types = [pa.int64()] * 4 + [pa.int32(), pa.float64()]
        for batch in slices(batches, "text", 1 << 20):
            words, at = word_hashes(batch.column(1), LETTER_WORDS)
            ids = batch.column(0).to_pylist()
            out = []
            for d in _touched(words, at, index):
                out += [(ids[d], index.ids[i], start, n, distance, s) for i, start, n, distance, s in index.search(words[at[d] : at[d + 1]])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[c.split()[0] for c in HITS.split(", ")])

    return scan


def _touched(words: np.ndarray, at: np.ndarray, index: ItemIndex) -> list[int]:
    """Texts that hold a shingle of any item (or may: shingles that reach over a text's end count too)."""
    some: defaultdict[int, None] = defaultdict()
    for k, known in index.known.items():
        places = np.flatnonzero(_isin(ngram_hashes(words, k), known, index.gates[k]))
        for d in np.unique(np.searchsorted(at, places, side="right") - 1).tolist():
            some[d] = None
    return sorted(some)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), items_at_once: int = 4096, bytes_at_once: int = 32 << 20) -> DataFrame:
    """Documents without a benchmark item, with all their columns.

    Each row goes or stays for its own text, whatever its id: rows that repeat
    all go or all stay, null and empty texts stay. Nothing is shuffled; blocks
    of items filter one after another in the same scan. An empty table, or one
    of items, changes nothing.
    """

    def without(items: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = item_index(tuple(items), settings)
            for batch in slices(batches, "text", 1 << 20):
                words, at = word_hashes(text_column(batch, "text"), LETTER_WORDS)
                keep = np.ones(batch.num_rows, bool)
                for d in _touched(words, at, index):
                    keep[d] = next(index.search(words[at[d] : at[d + 1]]), None) is None
                yield batch.filter(pa.array(keep))

        return run

    kept = narrow_batches(docs)
    for items in _item_blocks(benchmark, items_at_once, bytes_at_once):
        kept = kept.mapInArrow(without(items), docs.schema)
    return kept
