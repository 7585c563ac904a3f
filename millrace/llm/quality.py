"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text: some on its
looks (quality), some on words and word stems that go with toxic texts
(toxicity), one of each kind is the annotation where a label exists.
Expectation-maximisation over the counts of vote patterns of all documents
estimates how often each labeller is right, without knowing the truth, and
gives each pattern a posterior. On the posteriors of a bounded sample of
labelled rows a linear scorer over hashed words, stems and votes is trained;
its score decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import give_back, narrow_batches, slices
from millrace.llm.wordhash import BLANK_WORDS, LETTER_WORDS, mix, text_bytes, word_and_stem_hashes, word_hashes

SCORES = "doc_id long, score double, keep boolean, n_words long"
GOOD, BAD, NONE = 0, 1, 2
#: Labellers on looks and on toxicity; the annotations follow each group in its patterns.
LOOKS = ("symbols", "capitals", "repeats", "distinct", "marks", "length")
TOXICITY = ("words", "stems", "many_stems")
STEM = 6


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows that the lexicon and the scorer are fitted on at most. buckets: size of the hashed feature space. reject: least score of a rejected text."""

    sample: int = 8192
    buckets: int = 1 << 20
    reject: float = 0.5
    rounds: int = 60


@dataclass
class Model:
    settings: Settings = field(default_factory=Settings)
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    stems: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    bias: float = -3.0
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    accuracy: dict[str, tuple[float, float]] = field(default_factory=dict)


# --- features and votes ---------------------------------------------------------------------------------------


def _measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """Looks of each text, from its bytes and word hashes."""
    data, at = text_bytes(texts)
    per_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    space = BLANK_WORDS[data] == 0
    letter = LETTER_WORDS[data] != 0
    symbol = ~space & ~letter
    upper = (data >= 0x41) & (data <= 0x5A)
    lower = (data >= 0x61) & (data <= 0x7A)
    alone = symbol.copy()
    alone[1:] &= space[:-1]
    alone[:-1] &= space[1:]
    words, w_at = word_hashes(texts, BLANK_WORDS)
    again = np.zeros(len(words), dtype=bool)
    again[1:] = words[1:] == words[:-1]
    again[w_at[:-1][w_at[:-1] < len(words)]] = False
    n = np.diff(w_at)
    safe = np.maximum(n, 1)
    repeats = np.diff(np.concatenate([[0], np.cumsum(again)])[w_at])
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(w_at[:-1], w_at[1:], strict=True)], dtype=np.int64)
    chars = np.maximum(per_text(~space), 1)
    return {"n": n, "symbols": per_text(symbol) / chars, "capitals": per_text(upper) / np.maximum(per_text(upper | lower), 1), "repeats": repeats / safe, "distinct": distinct / safe, "marks": per_text(alone) / safe, "length": per_text(letter) / safe}


def _look_votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """Votes by fixed thresholds, a column for each of LOOKS; texts of fewer than five words get none from the ratios."""

    def vote(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(m["n"] < 5, NONE, np.where(bad, BAD, np.where(good, GOOD, NONE)))

    s, c, r, d, k, w, n = (m[x] for x in ("symbols", "capitals", "repeats", "distinct", "marks", "length", "n"))
    few = 0.5 - 0.06 * np.log2(np.maximum(n, 64) / 64)  # long texts repeat words
    return np.stack([vote(s, s < 0.055, s > 0.09), vote(c, c < 0.15, c > 0.4), vote(r, r < 0.03, r > 0.1), vote(d, d > few, d < few - 0.15), vote(k, k < 0.02, k > 0.1), vote(w, (w > 3) & (w < 6.5), (w < 2) | (w > 7.5))], axis=1).astype(np.int8)


def _hashed(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct word features, and its stem features: a stem with 1, 2, 3 and 4 or more different words."""
    words, stems, at = word_and_stem_hashes(texts, LETTER_WORDS, STEM)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        w, first = np.unique(words[a:b], return_index=True)
        s, n = np.unique(stems[a:b][first], return_counts=True)
        n = np.minimum(n, 4)
        s = np.repeat(s, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1).astype(np.uint64)
        yield (w % np.uint64(buckets)).astype(np.int64), (mix(s) % np.uint64(buckets)).astype(np.int64) + buckets


def _toxic_votes(words: np.ndarray, stems: np.ndarray, model: Model) -> tuple[int, int, int]:
    w, s = np.isin(words, model.words).sum(), np.isin(stems, model.stems).sum()
    return (BAD if w else GOOD, BAD if s else GOOD, BAD if s >= 2 else NONE if s else GOOD)


def _patterns(texts: pa.Array, model: Model) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Votes (a row for each text), all features with the bad votes as features of their own, and word counts."""
    m = _measure(texts)
    looks = _look_votes(m)
    votes, features = [], []
    buckets = model.settings.buckets
    for look, (w, s) in zip(looks, _hashed(texts, buckets), strict=True):
        v = np.concatenate([look, _toxic_votes(w, s, model)])
        votes.append(v)
        features.append(np.concatenate([w, s, np.flatnonzero(v == BAD) + 2 * buckets]))
    return np.array(votes, dtype=np.int64).reshape(len(texts), len(LOOKS) + len(TOXICITY)), features, m["n"]


# --- fitting --------------------------------------------------------------------------------------------------


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of "bad" for each pattern, and each labeller's accuracies (on good, on bad).

    votes: patterns by labellers, with GOOD, BAD or NONE; counts: how many
    documents show each. Labellers are taken to err independently given the
    truth; to start with, the majority is right.
    """
    bad, good = (votes == BAD).astype(float), (votes == GOOD).astype(float)
    cast = bad.sum(1) + good.sum(1)
    post = np.where(cast > 0, (bad.sum(1) + 0.1) / (cast + 1), 0.1)
    total = counts.astype(float)
    right = np.full((votes.shape[1], 2), 0.7)
    for _ in range(rounds):
        on_bad, on_good = total * post, total * (1 - post)
        prior = np.clip(on_bad.sum() / max(total.sum(), 1), 1e-4, 1 - 1e-4)
        right[:, 0] = (on_good @ good + 7) / (on_good @ (good + bad) + 10)
        right[:, 1] = (on_bad @ bad + 7) / (on_bad @ (good + bad) + 10)
        right = np.clip(right, 0.05, 0.999)
        log_bad = np.log(prior) + bad @ np.log(right[:, 1]) + good @ np.log(1 - right[:, 1])
        log_good = np.log(1 - prior) + good @ np.log(right[:, 0]) + bad @ np.log(1 - right[:, 0])
        post = 1 / (1 + np.exp(np.clip(log_good - log_bad, -60, 60)))
    return post, right


class Sample:
    """Features of the sampled rows end to end, as 32-bit places in the feature space, and the row of each."""

    def __init__(self, rows: list[np.ndarray], space: int) -> None:
        self.flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(f) for f in rows])
        self.space, self.rows = space, len(rows)

    def counts(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each feature how many rows have it, and the sum of their weights."""
        return np.bincount(self.flat, minlength=self.space), np.bincount(self.flat, weights=weights[self.row], minlength=self.space)


def _lexicon(sample: Sample, toxic: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and stems that stand in at least four toxic texts and hardly in others."""
    n, t = sample.counts(toxic.astype(np.float64))
    clear = lambda low, high, precision: np.flatnonzero((t[low:high] >= 4) & (t[low:high] >= precision * n[low:high])) + low
    return clear(0, buckets, 0.9), clear(buckets, 2 * buckets, 0.8)


def _train(sample: Sample, target: np.ndarray, steps: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic regression on soft labels, over features that clearly go with either class (|z| of 4 or more)."""
    n, b = sample.counts(target)
    share = np.clip(target.mean(), 1e-4, 1 - 1e-4)
    z = (b - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share))
    clear = (np.abs(z) >= 4) & (n >= 4)
    names = np.flatnonzero(clear)
    keep = clear[sample.flat]
    place, row = np.searchsorted(names, sample.flat[keep]), sample.row[keep]
    w, bias = np.zeros(len(names)), float(np.log(share / (1 - share)))
    m_w, v_w, m_b, v_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    size = max(len(target), 1)
    for t in range(1, steps + 1):  # Adam on the whole sample
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, weights=w[place], minlength=len(target)), -30, 30)))
        err = p - target
        g_w = np.bincount(place, weights=err[row], minlength=len(names)) / size + 1e-5 * w
        g_b = err.mean()
        m_w, v_w = 0.9 * m_w + 0.1 * g_w, 0.999 * v_w + 0.001 * g_w**2
        m_b, v_b = 0.9 * m_b + 0.1 * g_b, 0.999 * v_b + 0.001 * g_b**2
        w -= 0.1 * (m_w / (1 - 0.9**t)) / (np.sqrt(v_w / (1 - 0.999**t)) + 1e-8)
        bias -= 0.1 * (m_b / (1 - 0.9**t)) / (np.sqrt(v_b / (1 - 0.999**t)) + 1e-8)
    return bias, names, w


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on documents (doc_id, text) and labels (doc_id, quality, toxic; nulls: unknown).

    A doc_id that is labelled more than once counts as toxic if one label says
    so, and as good if one says so. Of the labelled ids those with the
    smallest hashes, ``settings.sample`` at most, are the sample; its texts'
    features come to the driver. The vote patterns are counted over all
    documents. Without labels the votes on looks alone decide. The lexicon of
    toxic words comes from the same sample's labels, so its votes and the
    annotations are not independent, as expectation-maximisation takes them to
    be; that makes both look more accurate than they are.
    """
    model = Model(settings)
    one = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = narrow_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
    order = [F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t")]
    drawn = rows.join(F.broadcast(sample), "doc_id").select("text", "quality", "toxic", *order)  # the sample is bounded

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            looks = _look_votes(_measure(batch.column(0)))
            both = [np.concatenate(f).astype("<i4").tobytes() for f in _hashed(batch.column(0), settings.buckets)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([v.tobytes() for v in looks], pa.binary()), pa.array(both, pa.binary())], names=["quality", "toxic", "h", "t", "looks", "features"])

    # ids that repeat may bring more rows than the bound: those with the smallest hashes stay
    got = drawn.mapInArrow(features, "quality int, toxic int, h long, t long, looks binary, features binary").orderBy("h", "t").limit(settings.sample).collect()
    hashed = [np.frombuffer(r["features"], "<i4") for r in got]
    toxic = np.array([r["toxic"] or 0 for r in got])
    b = settings.buckets
    space = 2 * b + len(LOOKS) + len(TOXICITY)
    model.words, model.stems = _lexicon(Sample(hashed, space), toxic, b)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            votes, _, _ = _patterns(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes @ 3 ** np.arange(votes.shape[1]))], names=["doc_id", "pattern"])

    # rows without an id have no label; they are spread over the tasks of the join
    alone = F.when(F.col("doc_id").isNull(), F.spark_partition_id()).otherwise(-1)
    voted = rows.mapInArrow(patterns, "doc_id long, pattern long").withColumn("alone", alone).join(one.withColumn("alone", F.lit(-1)), ["doc_id", "alone"], "left")
    counted = voted.groupBy("pattern", "quality", "toxic").count().collect()  # 3**9 patterns with 3 x 3 annotations at most
    width = len(LOOKS) + len(TOXICITY)
    votes = np.array([[(r["pattern"] // 3**i) % 3 for i in range(width)] for r in counted], dtype=np.int64).reshape(len(counted), width)
    counts = np.array([r["count"] for r in counted])
    said_q = np.array([NONE if r["quality"] is None else BAD if r["quality"] == 0 else GOOD for r in counted], dtype=np.int64)
    said_t = np.array([NONE if r["toxic"] is None else BAD if r["toxic"] else GOOD for r in counted], dtype=np.int64)
    tables = []
    for names, part, said in ((LOOKS, votes[:, : len(LOOKS)], said_q), (TOXICITY, votes[:, len(LOOKS) :], said_t)):
        both = np.column_stack([part, said]) if len(counted) else np.zeros((0, part.shape[1] + 1), np.int64)
        post, right = expectation_maximisation(both, counts, settings.rounds)
        model.accuracy |= {n: (float(g), float(x)) for n, (g, x) in zip((*names, f"annotated_{names[0]}"), right, strict=True)}
        tables.append({tuple(v): p for v, p in zip(both.tolist(), post, strict=True)})
    if not got:
        model.bias, model.features, model.weights = -2.0, np.arange(len(LOOKS)) + 2 * b, np.full(len(LOOKS), 1.5)
        return model
    target, full = [], []
    for r, f in zip(got, hashed, strict=True):
        w, s = f[f < b], f[f >= b]
        looks, tox = np.frombuffer(r["looks"], np.int8).astype(np.int64), np.array(_toxic_votes(w, s, model))
        q = NONE if r["quality"] is None else BAD if r["quality"] == 0 else GOOD
        t = NONE if r["toxic"] is None else BAD if r["toxic"] else GOOD
        p_q, p_t = tables[0].get((*looks.tolist(), q), 0.5), tables[1].get((*tox.tolist(), t), 0.5)
        target.append(1 - (1 - p_q) * (1 - p_t))
        full.append(np.concatenate([f, (np.flatnonzero(np.concatenate([looks, tox]) == BAD) + 2 * b).astype(np.int32)]))
    model.bias, model.features, model.weights = _train(Sample(full, space), np.array(target))
    del got, hashed, full
    give_back()
    return model


def score(docs: DataFrame, model: Model, keep_columns: list[str] | None = None) -> DataFrame:
    """doc_id, score (0 to 1, of being bad), keep and n_words for each row.

    A null or empty text, or one without words, has score 1 and is not kept.
    Repeated rows each get theirs, null ids stay null, extra columns are not
    read. An empty table gives no rows.
    """
    names, weights = model.features, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            _, features, n = _patterns(batch.column(1), model)
            s = np.empty(len(features))
            for i, f in enumerate(features):
                at = np.searchsorted(names, f)
                at[at == len(names)] = 0
                s[i] = model.bias + (weights[at][names[at] == f].sum() if len(names) else 0)
            s = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            s[n == 0] = 1.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(s < model.settings.reject), pa.array(n)], names=["doc_id", "score", "keep", "n_words"])

    return narrow_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, SCORES)


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fit on the documents and their labels, then score them."""
    return score(docs, fit(docs, labels, settings))


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Documents that the classifier keeps, with all their columns: each row by its own text; rows without words go. Nothing is shuffled, an empty table stays empty."""
    model = fit(docs, labels, settings)
    text = docs.schema.fieldNames().index("text")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            _, features, n = _patterns(batch.column(text), model)
            keep = []
            for f, words in zip(features, n, strict=True):
                at = np.searchsorted(model.features, f)
                at[at == len(model.features)] = 0
                s = model.bias + (model.weights[at][model.features[at] == f].sum() if len(model.features) else 0)
                keep.append(bool(words) and 1 / (1 + np.exp(-np.clip(s, -30, 30))) < model.settings.reject)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
