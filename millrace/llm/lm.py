"""Language-model scores: stupid backoff over word n-grams, computed relationally.

S(w | c) = count(c w) / count(c) where the n-gram c w is in the table (seen
``least`` times or more), else backoff * S(w | c without its first word); at
the end count(w) / N. The log-score of a document is the sum over its words;
a word's context ends at the start of its document.

* Words and n-grams are told apart by 64-bit hashes. All orders share one
  space of keys and one table of counts.
* A stretch of documents of some millions of words (a chunk) gives each of its
  distinct keys once, with the number of times it has it: partial sums, so
  that a frequent n-gram brings a task one entry from each chunk at most.
* The table is cut into ranges of keys, as many as the number of words asks
  for. A chunk's sorted keys go to the ranges as packed blocks, a range adds up
  the counts, and gives each chunk the counts of its keys in the same order.
* A second scan sends each chunk's words, as numbers in its own list of words,
  to where the counts of its keys come back, and its documents are scored
  there. Both scans must deal out the same chunks: documents that come out of
  a shuffle are written first; if another source deals its rows out anew, the
  counts do not fit the words and the job fails.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import redirect_stdout
from dataclasses import dataclass
from io import StringIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import give_back, narrow_batches, saved, slices
from millrace.llm.wordhash import BLANK_WORDS, ngram_hashes, word_hashes

SCORES = "doc_id long, n_words long, log_score double, per_word double"
#: Words of a chunk (a text is never cut), bytes of text that are hashed at once, and words for each range of keys (all bound what a task holds).
CHUNK_WORDS, SLICE, RANGE_WORDS = 1 << 21, 8 << 20, 1 << 20
_BLOCKS = "chunk long, part int, keys binary, counts binary"
_OWN = "chunk long, listed binary, numbers binary, sizes binary, doc_ids array<long>"


@dataclass(frozen=True)
class Settings:
    """backoff: factor of the lower order. least: smallest count of an n-gram in the table. order: words of the longest n-gram."""

    backoff: float = 0.4
    least: int = 1
    order: int = 3


def grams(words: np.ndarray, order: int) -> np.ndarray:
    """Key of the n-gram from each place on, across the ends of texts too."""
    return words if order == 1 else ngram_hashes(words, order)


def _within(text: np.ndarray, order: int) -> np.ndarray:
    """Whether the n-gram from each place on lies in one text."""
    return text[: max(len(text) - order + 1, 0)] == text[order - 1 :]


def _keys(words: np.ndarray, text: np.ndarray, order: int) -> np.ndarray:
    """Keys of all n-grams of all orders, sorted, each as often as it occurs."""
    found = np.concatenate([grams(words, k)[_within(text, k)] for k in range(1, order + 1)])
    found.sort()
    return found


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys starts, and its length."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return first, np.diff(np.append(first, len(keys)))


def _edges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each range's keys start in sorted keys (one more entry at the end)."""
    starts = np.array([(p << 64) // parts for p in range(parts)], dtype=np.uint64)
    return np.append(np.searchsorted(keys, starts), len(keys))


# --- blocks: numbers as planes of bytes, so that equal high bytes pack well


def pack(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes), "zstd", asbytes=True)


def unpack(block: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(block[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(block[8:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(block: bytes) -> np.ndarray:
    return np.cumsum(unpack(block, np.uint64), dtype=np.uint64)


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"chunk": pa.int64(), "part": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


# --- steps


def _n_words(rows: DataFrame) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(len(word_hashes(batch.column(1), BLANK_WORDS)[0]) for batch in slices(batches, "text", SLICE))
        yield pa.RecordBatch.from_pydict({"n": np.array([n], dtype=np.int64)})

    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int | None], np.ndarray, np.ndarray]]:
    """Number, ids, words of each text and all words of each chunk of a task's rows."""
    chunk, ids, sizes, words, held = TaskContext.get().partitionId() << 32, [], [], [], 0
    for batch in slices(batches, "text", SLICE):
        found, at = word_hashes(batch.column(1), BLANK_WORDS)
        ids += batch.column(0).to_pylist()
        sizes.append(np.diff(at))
        words.append(found)
        held += len(found)
        if held >= CHUNK_WORDS:
            yield chunk, ids, np.concatenate(sizes), np.concatenate(words)
            chunk, ids, sizes, words, held = chunk + 1, [], [], [], 0
    if ids:
        yield chunk, ids, np.concatenate(sizes), np.concatenate(words)


def _counted(order: int, parts: int):
    """For each chunk a block of keys and their counts in it for each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, n, words in _chunks(batches):
            keys = _keys(words, np.repeat(np.arange(len(n)), n), order)
            first, counts = _runs(keys)
            keys = keys[first]
            edges = _edges(keys, parts)
            for p in range(0, parts, 256):
                yield _blocks([(chunk, q, pack_sorted(keys[a:b]), pack(counts[a:b])) for q, a, b in zip(range(p, min(p + 256, parts)), edges[p:], edges[p + 1 :]) if b > a] or [(chunk, p, pack_sorted(keys[:0]), pack(counts[:0]))])
            del keys, first, counts

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's list of words, its words as numbers in the list, the words of each text, and the ids."""
    for chunk, ids, n, words in _chunks(batches):
        listed, number = np.unique(words, return_inverse=True)
        packed = [pa.array([x], pa.binary()) for x in (pack_sorted(listed), pack(number.astype(np.uint32)), pack(n.astype(np.int64)))]
        yield pa.RecordBatch.from_arrays([pa.array([chunk]), *packed, pa.array([ids], pa.list_(pa.int64()))], names=[c.split()[0] for c in _OWN.split(", ")])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block of keys gets their counts in all chunks in place of its own."""
    held: dict[int, list[tuple]] = defaultdict(list)
    for batch in batches:
        chunk, part, keys, counts = (batch.column(i).to_pylist() for i in range(4))
        for c, p, k, n in zip(chunk, part, keys, counts, strict=True):
            held[p].append((c, k, n))
    for part, blocks in held.items():
        keys = np.concatenate([unpack_sorted(b[1]) for b in blocks])
        counts = np.concatenate([unpack(b[2], np.int64) for b in blocks])
        sizes = np.cumsum([0, *(int.from_bytes(b[1][:8], "little") for b in blocks)])
        order = np.argsort(keys, kind="stable")
        first, n = _runs(keys[order])
        counts[order] = np.repeat(np.add.reduceat(counts[order], first), n) if len(first) else counts
        for k in range(0, len(blocks), 256):
            yield _blocks([(blocks[i][0], part, None, pack(counts[sizes[i] : sizes[i + 1]])) for i in range(k, min(k + 256, len(blocks)))])
    give_back()


def _scored(settings: Settings, total: int):
    def run(blocks: pa.Table, own: pa.Table) -> pa.Table:
        listed, numbers, sizes, doc_ids = (own.column(i)[0] for i in range(1, 5))
        words, n = unpack_sorted(listed.as_py())[unpack(numbers.as_py(), np.uint32)], unpack(sizes.as_py(), np.int64)
        found = dict(zip(blocks.column(1).to_pylist(), (unpack(c.as_py(), np.int64) for c in blocks.column(3)), strict=True))
        text = np.repeat(np.arange(len(n)), n)
        counts = np.concatenate([found[p] for p in sorted(found)] or [np.zeros(0, np.int64)])
        value = word_values(text, occurrences(words, text, settings.order, counts), settings, total)
        score = np.bincount(text, weights=value, minlength=len(n))
        per_word = pa.array(score / np.maximum(n, 1), mask=n == 0)
        return pa.table([doc_ids.values, pa.array(n), pa.array(score), per_word], names=["doc_id", "n_words", "log_score", "per_word"])

    return run


def occurrences(words: np.ndarray, text: np.ndarray, order: int, counts: np.ndarray) -> list[np.ndarray]:
    """For each order the count of the n-gram at each place that has one, from the counts of the distinct keys in their order."""
    keys = [grams(words, k)[_within(text, k)] for k in range(1, order + 1)]
    edges = np.cumsum([len(k) for k in keys])[:-1]
    keys = np.concatenate(keys)
    place = np.argsort(keys)
    first, n = _runs(keys[place])
    if len(first) != len(counts):
        raise ValueError("the counts of a chunk are not those of its keys")
    del keys, first
    out = np.empty(len(place), np.int64)
    out[place] = np.repeat(counts, n)
    return np.split(out, edges)


def word_values(text: np.ndarray, counts: list[np.ndarray], settings: Settings, total: int) -> np.ndarray:
    """Log-score of each word; ``counts``: of each order, as occurrences() gives them."""
    context = counts[0]
    value = np.log(context) - np.log(max(total, 1))
    for k, seen in enumerate(counts[1:], 2):
        at = np.flatnonzero(_within(text, k))
        last = at + k - 1
        value[last] = np.where(seen >= settings.least, np.log(seen) - np.log(context[at]), np.log(settings.backoff) + value[last])
        context = np.ones(len(text), np.int64)
        context[at] = seen
    return value


def score_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, log_score (natural) and per_word for each row.

    Counts are taken over all the documents themselves. A null or empty text,
    or one of blanks only, has no words, log_score 0 and a null per_word.
    Repeated rows and ids are scored row by row; null ids stay null. Other
    columns are not read. An empty table gives no rows.
    """
    rows = narrow_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    if _shuffled(rows):
        rows = saved(rows, "documents")
    total = _n_words(rows)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_WORDS))
    blocks = rows.mapInArrow(_counted(settings.order, parts), _BLOCKS)
    summed = blocks.repartitionById(parts, "part").mapInArrow(_summed, _BLOCKS)
    return summed.groupBy("chunk").cogroup(rows.mapInArrow(_own, _OWN).groupBy("chunk")).applyInArrow(_scored(settings, total), SCORES)


def _shuffled(df: DataFrame) -> bool:
    """Whether the rows come out of a shuffle, which may deal them out differently the next time."""
    text = StringIO()
    with redirect_stdout(text):
        df.explain()
    return "Exchange" in text.getvalue()
