"""Spelling variants: words of a corpus that differ by one edit, and the form that each is taken for.

Words and their counts come from all texts by DataFrame functions. Two words
that differ by one edit agree on what lies before or behind it, so the inverted
index is dealt out by length and by the half that they share; within such a
shard positional bigrams point to words, the postings of a word's bigrams are
merged by a heap, and pairs with as many common bigrams as one edit leaves are
verified. A shard that holds many words is cut again at half of what its words
do not share, until what is left is a place or two, where the alphabet bounds it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from math import ceil, log2, log10

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import give_back, saved

#: Letters of a gram.
Q = 2
#: Letters that make up words.
LETTERS = "A-Za-zÀ-ÿ"


@dataclass(frozen=True)
class Settings:
    """Shortest word, least occurrences, how many times as frequent a form must be, and words of a shard from which on it is cut again."""

    letters: int = 7
    least: int = 2
    ratio: int = 10
    shard_words: int = 4096


def runs(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id and run: each maximal run of LETTERS of at least ``letters``, with A-Z lower-cased; a null text has none."""
    found = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{settings.letters},}}"), 0))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return docs.select("doc_id", found.alias("run")).select("doc_id", F.translate("run", upper, lower).alias("run"))


def misspelt(found: DataFrame, every: int = 31) -> DataFrame:
    """The runs of ``runs``, of which about one in ``every`` loses a letter: that at crc32(doc_id:run) modulo its length, where the crc divides by ``every``. A null doc_id is an empty string."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("_h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.withColumn("_h", h).select("doc_id", F.when(F.col("_h") % every == 0, cut).otherwise(F.col("run")).alias("run"))


def vocabulary(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """word and n of the runs that are long and frequent enough."""
    counts = found.where(F.length("run") >= settings.letters).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= settings.least)


def variants(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """word, n, n_near, form, form_n and root of each row of ``words`` (word, n; distinct words).

    Near words differ by exactly one letter put in, left out or replaced. A
    word's form is its most frequent near word (ties: the first in code-point
    order) if that has ``ratio`` times its occurrences; root follows forms to
    the last, the word itself where it has none. An empty table gives no rows;
    null words are left out. Words of any length take part.
    """
    words = saved(words.where("word is not null").select("word", "n"), "words")
    pairs = _near(words, settings)
    none = words.select("word", F.col("n"), F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<less:bigint,word:string>").alias("best"))
    met = none.unionByName(pairs.select("word", F.lit(None).cast("long").alias("n"), "near", F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")).alias("best")))
    merged = met.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    some = -F.col("best.less") >= settings.ratio * F.col("n")
    base = saved(merged.select("word", "n", "n_near", F.when(some, F.col("best.word")).alias("form"), F.when(some, -F.col("best.less")).alias("form_n")), "words-forms")
    roots = _roots(base, settings).select(F.col("word").alias("_w"), F.col("root").alias("_root"))
    return base.join(roots, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(base: DataFrame, settings: Settings) -> DataFrame:
    """The last form of each word that has one. A form is ``ratio`` times as frequent, so chains are as long as the largest count's logarithm, and each step doubles what is followed."""
    most = base.agg(F.max("n")).first()[0] or 1
    longest = int(log10(max(most, 1)) / log10(settings.ratio)) + 1 if settings.ratio > 1 else 64
    roots = base.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(ceil(log2(max(longest, 2)))):
        onward = roots.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        roots = saved(roots.join(onward, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_next", "root").alias("root")), "words-roots")
    return roots


# --- shards of the index


def _windows(words: DataFrame) -> DataFrame:
    """Each word in the shards that it may meet near words in.

    A pair has a class: the length of its shorter word. A word is a shorter (or
    equal) one in the class of its length, and the longer one in the class
    below. [low, high) are the places of the shorter word where the edit may
    be: the first half, or the second with its end.
    """
    both = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("class")
    return _halved(words.select("word", "n", both).where("class >= 0").select("*", F.lit(0).alias("low"), F.col("class").alias("high")))


def _halved(rows: DataFrame) -> DataFrame:
    """The rows in both halves of their windows; a window of a place stays whole."""
    low, high = F.col("low"), F.col("high")
    middle = F.floor((low + high) / 2).cast("int")
    part = lambda a, b: F.struct(a.alias("low"), b.alias("high"))
    halves = F.when(high - low > 1, F.array(part(low, middle), part(middle, high))).otherwise(F.array(part(low, high)))
    return rows.select("word", "n", "class", F.explode(halves).alias("w")).select("word", "n", "class", "w.low", "w.high")


def _key() -> Column:
    """What words of a shard share: class, window, and the letters around it."""
    behind = F.col("class") - F.col("high")
    tail = F.when(behind > 0, F.substring("word", F.length("word") - behind + 1, behind)).otherwise("")
    return F.concat_ws(":", "class", "low", "high", F.substring("word", F.lit(1), F.col("low")), tail)


def _near(words: DataFrame, settings: Settings) -> DataFrame:
    """word, near, best_n, best: near words in part, to be added up by word."""
    rows = _windows(words).withColumn("key", _key())
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    done = None
    for _ in range(max(1, longest).bit_length()):
        wide = rows.where(F.col("high") - F.col("low") > 1)
        hot = wide.groupBy("key").count().where(F.col("count") > settings.shard_words).select(F.col("key").alias("_hot"))
        if not hot.head(1):
            break
        hot = saved(hot, "words-hot")
        cold = rows.join(hot, F.col("key") == F.col("_hot"), "left_anti")
        done = cold if done is None else done.unionByName(cold)
        split = _halved(rows.join(hot, F.col("key") == F.col("_hot"), "left_semi"))
        rows = saved(split.withColumn("key", _key()), "words-windows")
    rows = rows if done is None else done.unionByName(rows)
    dealt = rows.select("key", "class", "low", "high", "word", "n").repartition("key").sortWithinPartitions("key", "word")
    return dealt.mapInArrow(_searched, "word string, near long, best_n long, best string")


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for _, group in groupby(_rows(batches), key=lambda r: r[0]):
        shard = list(group)
        if len(shard) > 1:
            out += _near_in(shard)
        if len(out) > 20_000:
            yield _near_batch(out)
            out = []
    if out:
        yield _near_batch(out)
    give_back()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _near_batch(rows: list[tuple]) -> pa.RecordBatch:
    word, near, best_n, best = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(word), pa.array(near, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best)], names=["word", "near", "best_n", "best"])


def _near_in(shard: list[tuple]) -> list[tuple]:
    """(word, near words, occurrences of the best, the best) of a shard's words that have any.

    Only grams that reach into the window are indexed; those outside it are in
    all words of the shard. One edit changes Q grams of the longer word at most.
    """
    _, size, low, high, *_ = shard[0]
    first, last = max(0, low - Q + 1), min(size - Q, high - 1)
    index: dict[tuple[int, str], list[int]] = {}
    short = [(w, n) for *_, w, n in shard if len(w) == size]
    found: dict[str, list] = {}
    need = last - first + 1 - Q
    if not short:
        return []

    def meet(w: str, n: int, lists: list[list[int]], least: int, among: int) -> None:
        for k in _candidates(lists, least, among):
            x, m = short[k]
            if _one_edit(x, w, low, high, size):
                for a, b, times in ((x, w, n), (w, x, m)):
                    had = found.get(a)
                    if had is None:
                        found[a] = [1, times, b]
                    else:
                        had[0] += 1
                        if (-times, b) < (-had[1], had[2]):
                            had[1:] = times, b

    for i, (w, n) in enumerate(short):
        grams = [(p, w[p : p + Q]) for p in range(first, last + 1)]
        meet(w, n, [index[g] for g in grams if g in index], need, i)
        for g in grams:
            index.setdefault(g, []).append(i)
    for *_, w, n in shard:
        if len(w) > size:
            at = [(p, w[p + d : p + d + Q]) for p in range(first, last + 1) for d in (0, 1)]
            meet(w, n, [index[g] for g in dict.fromkeys(at) if g in index], need + 1, len(short))
    return [(w, *v) for w, v in found.items()]


def _candidates(lists: list[list[int]], least: int, among: int) -> Iterator[int]:
    """Numbers that occur in at least ``least`` of the postings, which a heap merges in order; below ``among`` all, where no gram need be shared."""
    if least <= 0:
        yield from range(among)
    elif len(lists) >= least:
        for k, same in groupby(heapq.merge(*lists)):
            if sum(1 for _ in same) >= least:
                yield k


def _one_edit(x: str, y: str, low: int, high: int, size: int) -> bool:
    """Whether y (as long as x or a letter longer) is one edit away from x, at a place of the window; the last place where it may be counts, so a pair is found once."""
    if x == y:
        return False
    p = low
    while p < size and x[p] == y[p]:
        p += 1
    return x[:low] == y[:low] and (p < high or high == size) and (x[p:] == y[p + 1 :] if len(y) > len(x) else x[p + 1 :] == y[p + 1 :])
