"""Token ids in Arrow files of fixed-size-list batches.

A shard is an Arrow file ("stream-file": record batches with a footer) with
two columns, ``ids`` and ``mask``, both lists of one fixed length. Such a
column's values lie end to end in one buffer, so a sequence is found by
arithmetic alone and, on a local or mounted file system, read through a memory
map without a copy. A second
Arrow file beside it says where each document starts.

Documents are dealt out by ranges of their id, so that the shards in order
hold them in ascending order; each task writes one shard under a name of its
own and puts it in place at the end, so a repeated task harms nothing.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.base import fresh_dir, narrow_batches, saved, slices
from millrace.llm.tokens import default_tokenizer, encoder

MANIFEST = "shard int, path string, n_docs long, n_tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"
BATCH_ROWS = 256


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, length: int = 2048, end_id: int | None = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every text and write the shards below ``path``, a folder that all executors see.

    Returns the manifest, one row a shard: number, path, documents, ids. A
    null or empty text is the end id alone. Rows with the same id stand next
    to each other, in the order of their texts' hashes, and may reach over
    several shards; rows without one come first. An empty table gives no
    shards. Extra columns are not read.
    """
    tokens = tokenizer or default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encode = TaskContext.get().partitionId(), encoder(tokens)
        rows = ((d, i) for b in slices(batches, "text", 8 << 20) for d, i in zip(b.column(0).to_pylist(), encode.encode(b.column(1)), strict=True))
        first = next(rows, None)
        if first is None:
            return
        dtype = np.dtype("<u2") if max(encode.size, (end_id or 0) + 1) <= 1 << 16 else np.dtype("<u4")
        name = f"{path}/shard-{shard:06d}"
        with ShardWriter(name, length, dtype) as out:
            for doc_id, ids in _chain(first, rows):
                ids = np.frombuffer(ids, dtype="<u4").astype(dtype)
                out.add(doc_id, ids if end_id is None else np.append(ids, dtype.type(end_id)))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name], "n_docs": pa.array([out.docs], pa.int64()), "n_tokens": pa.array([out.tokens], pa.int64())})

    rows = narrow_batches(docs).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("place"))
    return saved(rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """A row for each document (see ``DOCUMENTS``), from the files alone; start counts the ids of all documents before it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with Shard(name) as shard:
                    for index in shard.documents():
                        starts, counts = (index.column(i).to_numpy() for i in (1, 2))
                        sums = [zlib.crc32(shard.ids(int(s), int(n)).astype("<u4").tobytes()) for s, n in zip(starts, counts, strict=True)]
                        yield pa.RecordBatch.from_arrays([index.column(0), pa.array(starts + base), index.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.select("path", before.alias("base")).repartition("path").mapInArrow(read, DOCUMENTS)


def token_file_digest(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` and read the files back."""
    return read_token_files(write_token_files(docs, fresh_dir(docs.sparkSession, "token-files"), **options))


class ShardWriter:
    """Writes one shard; its files get their names when all is written."""

    def __init__(self, name: str, length: int, dtype: np.dtype) -> None:
        self.fs, self.name = pafs.FileSystem.from_uri(name) if "://" in name else (pafs.LocalFileSystem(), name)
        self.fs.create_dir(self.name.rpartition("/")[0], recursive=True)
        self.length, self.dtype = length, dtype
        self.docs = self.tokens = 0
        self.temporary = f"{self.name}.{uuid.uuid4().hex}"
        item = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([pa.field("ids", pa.list_(pa.field("item", item, nullable=False), length), nullable=False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length), nullable=False)])
        self.files = [self.fs.open_output_stream(f"{self.temporary}.{kind}") for kind in ("ids", "docs")]
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = pa.ipc.new_file(self.files[0], self.schema)
        self.index = pa.ipc.new_file(self.files[1], self.index_schema)
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.rows: list[tuple] = []

    def __enter__(self) -> "ShardWriter":
        return self

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.tokens, len(ids)))
        self.docs, self.tokens = self.docs + 1, self.tokens + len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.length * BATCH_ROWS:
            self._sequences(False)
        if len(self.rows) >= 8192:
            self._documents()

    def _sequences(self, last: bool) -> None:
        flat, size = np.concatenate(self.held or [np.zeros(0, self.dtype)]), self.length * BATCH_ROWS
        at = 0
        while len(flat) - at >= size or last and at < len(flat):
            part = flat[at : at + size]
            rows = -(-len(part) // self.length)
            full = np.zeros(rows * self.length, dtype=self.dtype)
            full[: len(part)] = part
            bits = np.packbits(np.arange(len(full)) < len(part), bitorder="little")
            values = pa.Array.from_buffers(self.schema.field("ids").type.value_type, len(full), [None, pa.py_buffer(full)])
            mask = pa.Array.from_buffers(pa.bool_(), len(full), [None, pa.py_buffer(bits)])
            self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(v, type=f.type) for v, f in zip((values, mask), self.schema, strict=True)], schema=self.schema))
            at += len(part)
        self.held, self.n_held = [flat[at:]], len(flat) - at

    def _documents(self) -> None:
        if self.rows:
            self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True)], schema=self.index_schema))
            self.rows = []

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self._sequences(True)
            self._documents()
        for x in (self.out, self.index, *self.files):
            x.close()
        for end in ("ids", "docs"):
            if kind is None:
                self.fs.move(f"{self.temporary}.{end}", f"{self.name}.{end}.arrow")
            else:
                self.fs.delete_file(f"{self.temporary}.{end}")


class Shard:
    """Random access to a shard: a memory map where the file is local, else ranged reads."""

    def __init__(self, name: str) -> None:
        self.sources = [self._open(f"{name}.{end}.arrow") for end in ("ids", "docs")]
        self.reader, self.index = (pa.ipc.open_file(s) for s in self.sources)
        self.length = self.reader.schema.field("ids").type.list_size
        self.batch: tuple[int, np.ndarray] = (-1, np.zeros(0))

    @staticmethod
    def _open(uri: str):
        if urlparse(uri).scheme in ("", "file"):
            return pa.memory_map(urlparse(uri).path)
        fs, path = pafs.FileSystem.from_uri(uri)
        return fs.open_input_file(path)

    def __enter__(self) -> "Shard":
        return self

    def __exit__(self, *_) -> None:
        self.batch = (-1, np.zeros(0))
        for s in self.sources:
            s.close()

    def documents(self) -> Iterator[pa.RecordBatch]:
        """doc_id, start in this shard, n_tokens."""
        return (self.index.get_batch(i) for i in range(self.index.num_record_batches))

    def _flat(self, i: int) -> np.ndarray:
        if self.batch[0] != i:
            self.batch = (i, self.reader.get_batch(i).column(0).flatten().to_numpy(zero_copy_only=True))
        return self.batch[1]

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of one sequence."""
        i, at = divmod(row, BATCH_ROWS)
        mask = self.reader.get_batch(i).column(1).flatten().slice(at * self.length, self.length)
        return self._flat(i)[at * self.length : (at + 1) * self.length], mask.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n of the shard; a view where they lie in one batch."""
        size, parts = self.length * BATCH_ROWS, []
        while n > 0:
            i, at = divmod(start, size)
            part = self._flat(i)[at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, "<u4")])


def _chain(first: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
    yield first
    yield from rest
