"""Exact n-gram Jaccard join with signature trees.

1. Texts with equal shingle sets form a class; only classes are compared.
2. Prefix filter. In one fixed order of all shingles (frequent ones last), two
   sets that link share one of the first n - ceil(0.75 n) + 1 shingles of
   each. Classes that share such a shingle form a bucket. Near copies share
   many shingles, so the buckets that have the same smallest and the same
   largest class, which are mostly the same classes, are one bucket; a pair is
   met in few buckets then instead of one for each shingle it shares.
3. Star step. Each class is compared with its bucket's smallest class, which
   joins most groups of near copies without looking at all their pairs.
4. In the buckets that still hold several components, a signature tree over
   the classes is traversed against itself. A node holds the OR of its
   members' token bitmaps, their range of sizes, and their common component.
   Bitmaps grow with the sets, so those of long texts tell them apart too;
   each length has a tree, and trees of two lengths meet at the shorter one.
   A pair of nodes is left when the sizes, the largest possible overlap or an
   equal component rule out any new link. Large buckets are cut into chunks,
   and pairs of chunks go to different tasks.
   A group with many possible pairs first gives the likeliest partners of each
   class only; what they join is one component when the group is met again,
   with four times as many partners, until all its possible pairs are out.
5. Pairs that the tree's bitmaps don't rule out are tested in the same task with
   finer ones, whose length follows the set's, so that only likely links leave
   it; they are then verified on the whole sets.

No link is lost: a linking pair shares a bucket, and it is either inside one
component already or met in a traversal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.llm.base import discard, give_back, narrow_batches, saved, slices, text_column, unused
from millrace.llm.components import connected_components
from millrace.llm.wordhash import BLANK_WORDS, shingle_sets

#: Least and most bits of a class's token bitmap in the trees, where the finer one that pairs are tested with is cut to the same most bits, and most bits of the one that pairs are tested with before their sets are read (four bits a token).
SIGNATURE, MOST_SIGNATURE, MOST_BITS = 1024, 1 << 17, 1 << 20
#: Members of a leaf and children of a node; members that go to one task at once; pairs for each member up to which a group gives all of them.
LEAF, FANOUT, CHUNK, MANY = 16, 8, 4096, 32
#: Frequent shingles: seen in so many classes of the sample (one class in SAMPLE), at most so many of them. They only set the order.
SAMPLE, FREQUENT, MOST_FREQUENT = 16, 8, 65_536
#: Bits for each asked class that tell a scan whose sets are wanted, and most bits (the join behind drops those that only share a bit).
WANTED_BITS, MOST_WANTED = 16, 1 << 28


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) for each row.

    Two documents link when 100 * intersection >= percent * union of their
    sets of n-word shingles (fewer words: the whole sequence as one). Null
    and empty texts have no shingles and link with nothing: component_id is
    their own id. Rows that repeat an id or a text each give a row. Null ids
    stay null; a component of such rows only has a null id. An empty table
    gives no rows. Extra columns are not read. Shingles and sets are told
    apart by 64-bit hashes.
    """
    members, of_class = _components(docs, n, percent, id_column, text_column)
    found = members.where("n_shingles > 0").join(of_class, "key").select("doc_id", "n_shingles", "component_id")
    return found.union(members.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _components(docs: DataFrame, n: int, percent: int, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, n_shingles, key, sample), and for each class with shingles its key, and its component's smallest doc_id with the smallest class that has it."""
    rows = narrow_batches(docs).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(id_column, text_column).alias("same"))
    spark, made, held, kept = docs.sparkSession, [], [], []  # tables of a step, of a round, of all rounds: each goes when it has been used
    members = saved(rows.mapInArrow(_classes(n), "doc_id long, n_shingles long, key long, same long, sample binary"), "members")
    # one row speaks for each class, so that copies are not hashed again nor sent
    speakers = _wanted(saved(members.where("n_shingles > 0").groupBy("key").agg(F.min("same").alias("same")).select("same"), "asked", made))
    buckets = saved(_shared(rows.mapInArrow(_prefixes(n, percent, _frequent(members), speakers), "token long, key long, n int")), "buckets", held)
    nodes = saved(_nodes(rows, members, buckets, n, made), "nodes", kept)
    linked = lambda pairs: saved(_verified(rows, members, n, _possible(saved(pairs, "pairs", made), nodes, percent, made), percent, made), "links", made)

    star = buckets.where("key != pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b"), F.col("n").alias("n_a"), F.col("pivot_n").alias("n_b")).distinct()
    star = star.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    labels = saved(connected_components(linked(star.select("a", "b")), made), "labels")
    discard(spark, made)

    partners = 1
    while True:
        met = saved(_traversed(buckets, nodes, labels, percent, partners, made), "pairs", made)
        more = linked(met.select("a", "b").distinct())
        labels = saved(connected_components(more.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))), made), "labels")
        left = met.where("not whole").select("bucket").distinct()
        if not left.limit(1).count():
            break
        old, held = held, []
        buckets, partners = saved(buckets.join(left, "bucket", "left_semi"), "buckets", held), 4 * partners
        discard(spark, made + old)
        made.clear()
    discard(spark, made + held + kept)

    first = members.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("first"))
    first = first.join(labels, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("component", "key").alias("label"))
    named = F.struct(F.col("first").isNull().alias("none"), "first", "key")  # classes with an id come first
    least = first.groupBy("label").agg(F.min(named).alias("least"))
    return members, first.join(least, "label").select("key", F.col("least.first").alias("component_id"), F.col("least.key").alias("component_key"))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """One document of each component: a row with the component's smallest doc_id. Rows without an id or without shingles all stay.

    It goes by row: a row only goes if it is linked, in some steps, to the
    row that stays. Rows that share an id but no text stand for their own
    components. Where rows of one component share its smallest id, one of the
    smallest class stays; of those that also have equal sets, any one.
    Without links or rows the table stays as it is.
    """
    members, of_class = _components(docs, n, percent)
    found = members.where("doc_id is not null and n_shingles > 0").join(of_class, "key")
    copy, copy_key, own, single = (unused(docs.columns, c) for c in ("_copy", "_copy_key", "_key", "_single"))
    copies = found.where("doc_id != component_id or key != component_key").select(F.col("doc_id").alias(copy), F.col("key").alias(copy_key))
    if not _repeats(members):  # an id names a row, so the copies' ids will do
        return docs.join(copies.select(copy), F.col("doc_id") == F.col(copy), "left_anti")
    kept = _keyed(docs, n, own).join(copies.distinct(), (F.col("doc_id") == F.col(copy)) & (F.col(own) == F.col(copy_key)), "left_anti")
    alone = F.col("doc_id").isNull() | (F.col(own) == _key(np.zeros(0, np.uint64)))
    return kept.withColumn(single, F.when(alone, F.monotonically_increasing_id())).dropDuplicates(["doc_id", own, single]).select(docs.columns)


def _repeats(rows: DataFrame) -> bool:
    return bool(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count())


def _keyed(docs: DataFrame, n: int, name: str) -> DataFrame:
    """The documents with the key of their class in a last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            keys = [_key(tokens) for tokens in shingle_sets(text_column(batch, "text"), n, BLANK_WORDS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


# --- sets ----------------------------------------------------------------------------------------------------


def _key(tokens: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63)


def _signed(tokens: np.ndarray) -> np.ndarray:
    return tokens.astype("<u8").view("<i8")


def _sets(batches: Iterator[pa.RecordBatch], n: int, wanted=None) -> Iterator[tuple[int | None, int, int, np.ndarray]]:
    """doc_id, hash of id and text, class and shingles of each row; with ``wanted``, a test of those hashes, of one row for each of them in a task."""
    met: set[int] = set()
    for batch in slices(batches, "text", 1 << 20):
        if wanted is not None:
            batch = batch.filter(pa.array([wanted(x) and not (x in met or met.add(x)) for x in batch.column(2).to_pylist()], pa.bool_()))
        for doc_id, same, tokens in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(1), n, BLANK_WORDS), strict=True):
            yield doc_id, same, _key(tokens), tokens


def _first_sets(batches: Iterator[pa.RecordBatch], n: int, wanted=None, asked=None) -> Iterator[tuple[int, np.ndarray]]:
    """Each class that has shingles once in a task; those that pass ``asked`` only."""
    seen: set[int] = set()
    for _, _, key, tokens in _sets(batches, n, wanted):
        if len(tokens) and key not in seen and (asked is None or asked(key)):
            seen.add(key)
            yield key, tokens


def _classes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def rows() -> Iterator[tuple]:
            for d, same, k, t in _sets(batches, n):
                drawn = k % SAMPLE == 0 and k not in seen
                seen.add(k)
                yield d, len(t), k, same, t.astype("<u8").tobytes() if drawn else None

        yield from _rows(rows(), {"doc_id": pa.int64(), "n_shingles": pa.int64(), "key": pa.int64(), "same": pa.int64(), "sample": pa.binary()})

    return run


def _frequent(members: DataFrame) -> np.ndarray:
    """Shingles that the sampled classes show often, the most frequent ones at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_pydict({"token": np.frombuffer(x.as_buffer(), "<i8")})

    counts = members.where("sample is not null").select("sample").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    top = counts.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).collect()  # bounded by MOST_FREQUENT
    return np.sort(np.array([r[0] for r in top], dtype=np.int64).view(np.uint64))


def _prefixes(n: int, percent: int, frequent: np.ndarray, speakers=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, tokens in _first_sets(batches, n, speakers) if speakers else ():
            size = len(tokens)
            late = _among(tokens, frequent)
            head = np.concatenate([tokens[~late], tokens[late]])[: size - -(-percent * size // 100) + 1]
            yield pa.RecordBatch.from_pydict({"token": _signed(head), "key": np.full(len(head), key), "n": np.full(len(head), size, dtype=np.int32)})

    return run


def _among(tokens: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which tokens are in a sorted array; a set is small beside it, so each token is looked up."""
    if not len(known):
        return np.zeros(len(tokens), bool)
    return known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens


def _shared(entries: DataFrame) -> DataFrame:
    """bucket, key, n, pivot, pivot_n: the classes of the shingles that several classes have, once for each smallest and largest class (two that hash alike share a bucket, which loses nothing)."""
    w = Window.partitionBy("token")
    ends = entries.withColumns({"_first": F.min(F.struct("key", "n")).over(w), "_last": F.max("key").over(w)}).where("_first.key != _last")
    ends = ends.select(F.xxhash64("_first.key", "_last").alias("bucket"), "key", "n", F.col("_first.key").alias("pivot"), F.col("_first.n").alias("pivot_n"))
    return ends.dropDuplicates(["bucket", "key"])


def _wanted(numbers: DataFrame):
    """A test for the numbers (a column of distinct 64-bit ones) that may also let others pass, gathered by partial aggregation; None without any."""
    numbers = numbers.toDF("key")
    n = numbers.count()
    if not n:
        return None
    size = min(MOST_WANTED, max(1 << 15, 1 << (WANTED_BITS * n - 1).bit_length()))
    place = F.pmod("key", F.lit(size))
    parts = numbers.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()  # MOST_WANTED bits at most
    bits = {r["at"]: bytes(r["bits"]) for r in parts}

    def test(key: int) -> bool:
        at = key % size
        bucket, bit = (1 + (at - 1) // 32768, (at - 1) % 32768) if at > 0 else (0, 0)
        part = bits.get(bucket)
        return part is not None and bool(part[bit >> 3] >> (bit & 7) & 1)

    return test


def _chosen(nodes: DataFrame, keys: DataFrame, made: list[str]) -> DataFrame:
    """The nodes (key first) of these keys, and perhaps some others, which never leave their scan for nothing."""
    asked = _wanted(saved(keys.distinct(), "asked", made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(asked) and asked(k) for k in batch.column(0).to_pylist()], pa.bool_()))
        give_back()

    return nodes.mapInArrow(run, nodes.schema)


def _asked(members: DataFrame, keys: DataFrame, made: list[str]):
    """Tests for the classes, and for the hash of the row that speaks for each."""
    keys = saved(keys.distinct(), "asked", made)
    texts = members.select("key", "same").join(keys, "key", "left_semi").groupBy("key").agg(F.min("same").alias("same")).select("same")
    return _wanted(keys), _wanted(saved(texts, "asked", made))


def _nodes(rows: DataFrame, members: DataFrame, buckets: DataFrame, n: int, made: list[str]) -> DataFrame:
    """Bitmaps of the classes in buckets, and longer ones of the largest sets; some others may be among them."""
    asked, texts = _asked(members, buckets.select("key"), made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((k, len(t), fine_bits(len(t)), t) for k, t in (_first_sets(batches, n, texts, asked) if asked else ()))
        found = ((k, m, bitmap(t, min(size, MOST_SIGNATURE)), bitmap(t, size) if size > MOST_SIGNATURE else None) for k, m, size, t in found)
        yield from _rows(found, {"key": pa.int64(), "n": pa.int64(), "bits": pa.binary(), "longer": pa.binary()}, 256)

    found = rows.mapInArrow(run, "key long, n long, bits binary, longer binary")
    return found.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "bits", "longer")])


def bitmap(tokens: np.ndarray, size: int) -> bytes:
    bits = np.zeros(size, dtype=bool)
    bits[(tokens % np.uint64(size)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def signature_bits(n: int) -> int:
    """A power of two of one to two bits a token."""
    return min(MOST_SIGNATURE, max(SIGNATURE, 1 << max(n - 1, 0).bit_length()))


def fine_bits(n: int) -> int:
    """A power of two of four to eight bits a token."""
    return min(MOST_BITS, max(SIGNATURE, 1 << (4 * n - 1).bit_length()))


# --- pairs ---------------------------------------------------------------------------------------------------


def most_overlap(bits_a: np.ndarray, bits_b: np.ndarray, excess_a: np.ndarray, excess_b: np.ndarray) -> np.ndarray:
    """No two sets share more tokens: the common bits, and the tokens beyond one a bit of the set with fewer of those."""
    return np.bitwise_count(bits_a & bits_b).sum(axis=1, dtype=np.int64) + np.minimum(excess_a, excess_b)


def _bits(signatures: pa.Array) -> np.ndarray:
    """Bitmaps of one length, a row each."""
    return np.frombuffer(b"".join(signatures.to_pylist()), dtype=np.uint64).reshape(len(signatures), -1)


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int, made: list[str]) -> DataFrame:
    """Pairs (a, b) that their finer bitmaps don't rule out."""
    one = _chosen(nodes.select("key", "n", F.coalesce("longer", "bits").alias("fine")), _ends(pairs), made)
    a = one.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("fine").alias("s_a"))
    b = one.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("fine").alias("s_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n_a, n_b, s_a, s_b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                x, y = _folded(*(np.frombuffer(s.as_buffer(), np.uint64)[None] for s in (s_a, s_b)))
                most = most_overlap(x, y, n_a - _count(x), n_b - _count(y))[0]
                keep.append(most * (100 + percent) >= percent * (n_a + n_b))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).union(pairs.select("b"))


def _folded(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bitmaps of both, a row each, at the shorter length: a token's place there is its place in the longer one modulo that length."""
    size = min(x.shape[1], y.shape[1])
    fold = lambda z: np.bitwise_or.reduce(z.reshape(len(z), -1, size), axis=1)
    return fold(x), fold(y)


def _count(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=1, dtype=np.int64)


def _verified(rows: DataFrame, members: DataFrame, n: int, pairs: DataFrame, percent: int, made: list[str]) -> DataFrame:
    """Those of the pairs (a, b) of classes that link, by their whole sets; only texts that a pair asks for are hashed again."""
    pairs = saved(pairs, "pairs", made)
    asked, texts = _asked(members, _ends(pairs), made)
    if asked is None:
        return pairs

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((k, t.astype("<u8").tobytes()) for k, t in _first_sets(batches, n, texts, asked))
        yield from _rows(found, {"key": pa.int64(), "tokens": pa.binary()}, 256)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(s) + len(t) - len(np.union1d(s, t))
                keep.append((100 + percent) * both >= percent * (len(s) + len(t)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    sets = saved(rows.mapInArrow(chosen, "key long, tokens binary"), "sets", made).groupBy("key").agg(F.first("tokens").alias("tokens"))
    a, b = (sets.select(F.col("key").alias(c), F.col("tokens").alias(f"t_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "t_a", "t_b").mapInArrow(count, "a long, b long")


def _traversed(buckets: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int, partners: int, made: list[str]) -> DataFrame:
    """bucket, a, b, whole: pairs of classes in different components that neither the trees of their buckets nor their finer bitmaps rule out.

    whole: the group has given all its pairs; else it has given each class's
    likeliest ``partners``.
    """
    labelled = buckets.select("bucket", "key").join(labels, F.col("key") == F.col("node"), "left").select("bucket", "key", F.coalesce("component", "key").alias("label"))
    w = Window.partitionBy("bucket")
    many = labelled.withColumns({"_a": F.min("label").over(w), "_b": F.max("label").over(w), "size": F.count("*").over(w)}).where("_a != _b").drop("_a", "_b")
    many = saved(many, "many", made)
    parts = F.ceil(F.col("size") / CHUNK).cast("int")
    dealt = many.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    # a chunk meets itself and each other chunk in groups (x, y), x <= y
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = dealt.select("bucket", "key", "label", "part", other).select("bucket", "key", "label", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), (F.col("part") > F.col("other")).cast("int").alias("side"))
    light = nodes.select("key", "n", "bits")
    if partners > 1:  # few groups are left
        light = _chosen(light, many.select("key"), made)
    full = dealt.join(light, "key").select("bucket", "x", "y", "side", "key", "label", "n", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            side, key, label, n = (group.column(i).to_numpy() for i in (3, 4, 5, 6))
            short = tree_bitmaps(n, group.column(7))
            left = trees(key, label, n, short, side == 0)
            same = group.column(1)[0].as_py() == group.column(2)[0].as_py()
            right = left if same else trees(key, label, n, short, side == 1)
            found = finer(meet(left, right, percent), key, n, group.column(7), percent)
            a, b, whole = likeliest(found, partners, MANY * len(key))
            if len(a):
                bucket = np.full(len(a), group.column(0)[0].as_py())
                yield pa.RecordBatch.from_pydict({"bucket": bucket, "a": np.maximum(a, b), "b": np.minimum(a, b), "whole": np.full(len(a), whole)})
        give_back()

    return full.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y").mapInArrow(run, "bucket long, a long, b long, whole boolean")


def tree_bitmaps(n: np.ndarray, bitmaps: pa.Array) -> pa.Array:
    """The bitmaps at the length that the trees have for sets of n tokens."""
    out = []
    for size, x in zip(n.tolist(), bitmaps, strict=True):
        bits = np.frombuffer(x.as_buffer(), np.uint64)
        out.append(np.bitwise_or.reduce(bits.reshape(-1, min(len(bits), signature_bits(size) // 64)), axis=0).tobytes())
    return pa.array(out, pa.binary())


def finer(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], key: np.ndarray, n: np.ndarray, bitmaps: pa.Array, percent: int, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Those of the pairs found among the keys that these bitmaps don't rule out either, with the share of their tokens that may be common by them. at_once: words of bitmaps that are compared together."""
    order = np.argsort(key)
    words = pc.binary_length(bitmaps).to_numpy() // 8
    place = np.zeros(len(key), np.int64)  # of a key among those with bitmaps of its length
    tables = {}
    for size in np.unique(words).tolist():
        at = np.flatnonzero(words == size)
        place[at], tables[size] = np.arange(len(at)), _bits(bitmaps.take(pa.array(at)))
    for a, b, _ in found:
        i, j = (order[np.searchsorted(key, x, sorter=order)] for x in (a, b))
        for size_a, size_b in np.unique(np.stack([words[i], words[j]], axis=1), axis=0).tolist():
            here = np.flatnonzero((words[i] == size_a) & (words[j] == size_b))
            step = max(1, at_once // max(size_a, size_b))
            for k in range(0, len(here), step):
                pair = here[k : k + step]
                x, y = _folded(tables[size_a][place[i[pair]]], tables[size_b][place[j[pair]]])
                n_a, n_b = n[i[pair]], n[j[pair]]
                most = most_overlap(x, y, n_a - _count(x), n_b - _count(y))
                keep = most * (100 + percent) >= percent * (n_a + n_b)
                yield a[pair[keep]], b[pair[keep]], (most / (n_a + n_b))[keep]


def likeliest(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], partners: int, limit: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """All pairs if there are no more than ``limit``; else each key's ``partners`` likeliest, of which the running list is kept short."""
    a, b, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    whole = True

    def shortened() -> None:
        nonlocal a, b, score, whole
        n = len(a)
        a, b, score = _best(a, b, score, partners)
        whole = whole and len(a) == n

    for x, y, s in found:
        a, b, score = np.concatenate([a, x]), np.concatenate([b, y]), np.concatenate([score, s])
        if len(a) > max(limit, 1 << 18):
            shortened()
    if not whole or len(a) > limit:
        shortened()
    return a, b, whole


def _best(a: np.ndarray, b: np.ndarray, score: np.ndarray, partners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keep = np.zeros(len(a), bool)
    for key, other in ((a, b), (b, a)):
        order = np.lexsort((other, -score, key))
        k = key[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        rank = np.arange(len(k)) - np.repeat(first, np.diff(np.append(first, len(k))))
        keep[order[rank < partners]] = True
    return a[keep], b[keep], score[keep]


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Rows with equal first columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(n_keys)], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and tuple(keys[a]) != last:
                yield _one(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(keys[a])
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


class Tree:
    """Nodes level by level, members (level 0) sorted by size; a node covers a run of nodes of the level below."""

    def __init__(self, key: np.ndarray, label: np.ndarray, n: np.ndarray, bits: np.ndarray) -> None:
        order = np.lexsort((key, n))
        self.key, n, bits = key[order], n[order], bits[order]
        #: Of each level: OR of bitmaps, smallest and largest size, largest excess of tokens over bits, common component and whether there is one.
        self.levels = [(bits, n, n, n - _count(bits), label[order], np.ones(len(n), bool))]
        self.first: list[np.ndarray] = [np.arange(len(n) + 1)]
        width = LEAF
        while len(self.levels[-1][1]) > 1:
            bits, low, high, excess, label, same = self.levels[-1]
            at = np.arange(0, len(low), width)
            one = (np.maximum.reduceat(label, at) == np.minimum.reduceat(label, at)) & np.logical_and.reduceat(same, at)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at), label[at], one))
            self.first.append(np.append(at, len(low)))
            width = FANOUT

    @property
    def words(self) -> int:
        """Length of the bitmaps, in words of 64 bits."""
        return self.levels[0][0].shape[1]

    def folded(self, words: int) -> Tree:
        """The same members with bitmaps of a shorter length, as _folded() has them."""
        bits, n, _, _, label, _ = self.levels[0]
        return self if words == self.words else Tree(self.key, label, n, np.bitwise_or.reduce(bits.reshape(len(n), -1, words), axis=1))


def trees(key: np.ndarray, label: np.ndarray, n: np.ndarray, signatures: pa.Array, chosen: np.ndarray) -> list[Tree]:
    """A tree for each length of bitmaps among the chosen rows, the shortest first."""
    lengths = pc.binary_length(signatures).to_numpy()
    places = (np.flatnonzero(chosen & (lengths == x)) for x in np.unique(lengths[chosen]))
    return [Tree(key[at], label[at], n[at], _bits(signatures.take(pa.array(at)))) for at in places]


def meet(left: list[Tree], right: list[Tree], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """traverse() of all trees on the left with all on the right, or of one list with itself, each pair of trees once; those of two lengths at the shorter one."""
    for i, x in enumerate(left):
        for y in right[i if left is right else 0 :]:
            (low_x, high_x), (low_y, high_y) = ((t.levels[-1][1][0], t.levels[-1][2][0]) for t in (x, y))
            if 100 * min(high_x, high_y) >= percent * max(low_x, low_y):
                words = min(x.words, y.words)
                yield from traverse(x.folded(words), y.folded(words), percent)


def traverse(left: Tree, right: Tree, percent: int, at_once: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of the pairs that stay possible, and the share of their tokens that may be common; trees of unequal height are met by descending the higher one first. at_once: pairs of nodes that are compared together, by default as many as have 8 MB of bitmaps on a side."""
    if not len(left.key) or not len(right.key):
        return
    same, at_once = left is right, at_once or max(1, (1 << 20) // left.words)
    stack = [(len(left.levels) - 1, len(right.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        p, q, i, j = stack.pop()
        if len(i) > at_once:
            stack += [(p, q, i[k : k + at_once], j[k : k + at_once]) for k in range(0, len(i), at_once)]
            continue
        keep = _may_link(left.levels[p], right.levels[q], i, j, percent)
        i, j = i[keep], j[keep]
        if p == q == 0:
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                (bits_a, n_a, _, excess_a), (bits_b, n_b, _, excess_b) = ([x[k] for x in t.levels[0][:4]] for t, k in ((left, i), (right, j)))
                yield left.key[i], right.key[j], most_overlap(bits_a, bits_b, excess_a, excess_b) / (n_a + n_b)
            continue
        if p >= q:
            i, j = _below(left.first[p], i, j)
        if q >= p:
            j, i = _below(right.first[q], j, i)
        p, q = p - (p >= q), q - (q >= p)
        if same:
            i, j = i[i <= j], j[i <= j]
        if len(i):
            stack.append((p, q, i, j))


def _below(first: np.ndarray, nodes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = first[nodes + 1] - first[nodes]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first[nodes], n) + inside, np.repeat(others, n)


def _may_link(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    bits_a, low_a, high_a, excess_a, label_a, one_a = (x[i] for x in a)
    bits_b, low_b, high_b, excess_b, label_b, one_b = (x[j] for x in b)
    sizes = 100 * np.minimum(high_a, high_b) >= percent * np.maximum(low_a, low_b)
    apart = ~(one_a & one_b & (label_a == label_b))
    overlap = np.minimum(most_overlap(bits_a, bits_b, excess_a, excess_b), np.minimum(high_a, high_b))
    return sizes & apart & (overlap * (100 + percent) >= percent * (low_a + low_b))


def _rows(rows: Iterator[tuple], types: dict[str, pa.DataType], at_once: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield _batch(held, types)
            held = []
    if held:
        yield _batch(held, types)


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))
