"""Exact top-k by inner product: term-at-a-time accumulation.

Queries go out in blocks of bounded size. Every task holds a batch of
candidates as postings by term (component); for each term the weights of the
queries that have it are scattered, times the posting, into a dense array of
scores (queries by candidates). Each batch keeps its k best of every query by
partition selection, a task merges its batches, and the tasks' lists meet in
one grouping by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.base import fresh_dir

HITS = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id and v, an array of floor(scale * x); rows without an id, null vectors and those with null or non-finite components are left out."""
    v = F.col(vector_column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    ints = F.transform(v, lambda x: F.floor(x * scale).cast("long"))
    return vectors.where(F.col(id_column).isNotNull() & v.isNotNull() & fine).select(F.col(id_column).cast("long").alias("vec_id"), ints.alias("v"))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, query_block: int = 1024, batch_rows: int = 2048) -> DataFrame:
    """The k candidates with the largest inner product for each query, its own id left out.

    Both tables have vec_id and v (arrays of long; shorter arrays count as
    padded with zeros). Returns query_id, rank (from 1), vec_id, score; ties
    go to the smaller vec_id, fewer candidates give fewer rows. Rows that
    repeat an id: of the queries one stays (the smallest array), candidates
    all take part. The queries are cut into blocks of about ``query_block``
    rows by a hash of the id, and a scan of the candidates answers each
    block, so what goes to the tasks at once is bounded whatever their number.
    Vectors whose products might leave 64 bits raise OverflowError.
    """
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // query_block))
    if blocks > 1:  # written once by block, so that each block reads its own files
        path = fresh_dir(queries.sparkSession, "queries")
        queries.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).write.partitionBy("_block").parquet(path)
        queries = queries.sparkSession.read.parquet(path)
    found = None
    for b in range(blocks):
        own = queries.where(F.col("_block") == b) if blocks > 1 else queries
        rows = own.select("vec_id", "v").collect()  # one block: about query_block rows
        hits = _scan(candidates, [r[0] for r in rows], [r[1] for r in rows], k, batch_rows)
        found = hits if found is None else found.unionByName(hits)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _scan(candidates: DataFrame, ids: list[int], vectors: list[list[int]], k: int, batch_rows: int) -> DataFrame:
    width = max(map(len, vectors), default=0)
    weights = np.zeros((len(ids), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        weights[i, : len(v)] = v
    own = np.array(ids, dtype=np.int64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_ids = np.zeros((len(own), 0), dtype=np.int64)
        best = np.zeros((len(own), 0), dtype=np.int64)
        worst = -(1 << 62)  # below any score, and its negative is no overflow
        largest = int(np.abs(weights).max(initial=0)) * max(width, 1)
        terms = [(t, q := np.flatnonzero(weights[:, t]), weights[q, t]) for t in range(width)]
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                doc, postings = part.column(0).to_numpy(), _columns(part.column(1), width)
                if largest * int(np.abs(postings).max(initial=0)) >= -worst:
                    raise OverflowError("scores might leave 64 bits")
                scores = np.zeros((len(own), len(doc)), dtype=np.int64)
                for t, q, w in terms:
                    docs = np.flatnonzero(postings[t])
                    if len(docs) == len(doc) and len(q) == len(own):
                        scores += w[:, None] * postings[t]
                    elif len(q) and len(docs):
                        scores[np.ix_(q, docs)] += w[:, None] * postings[t][docs]
                scores[own[:, None] == doc] = worst
                both, ids_ = np.hstack([best, scores]), np.hstack([best_ids, np.broadcast_to(doc, scores.shape)])
                best, best_ids = _select(both, ids_, k)
        rows, cols = np.nonzero(best > worst)
        if len(rows):
            yield pa.RecordBatch.from_pydict({"query_id": own[rows], "vec_id": best_ids[rows, cols], "score": best[rows, cols]})

    return candidates.select("vec_id", "v").mapInArrow(search, HITS)


def _columns(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Postings: a row for each term, dense over the batch."""
    flat, lengths = vectors.flatten().to_numpy(), np.diff(vectors.offsets.to_numpy())
    if len(lengths) and (lengths == width).all():
        return np.ascontiguousarray(flat.reshape(-1, width).T)
    out = np.zeros((width, len(lengths)), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[term[term < width], row[term < width]] = flat[term < width]
    return out


def _select(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row; among equal scores the smaller ids."""
    n = scores.shape[1]
    if n > k:
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k] if k else np.zeros((len(scores), 1))
        out_s, out_i = [], []
        for s, i, m in zip(scores, ids, least[:, 0], strict=True):
            near = np.flatnonzero(s >= m)
            near = near[np.lexsort((i[near], -s[near]))[:k]]
            out_s.append(s[near])
            out_i.append(i[near])
        return np.array(out_s).reshape(len(scores), -1), np.array(out_i).reshape(len(scores), -1)
    return scores, ids
