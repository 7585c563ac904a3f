"""WARC archives: a PySpark data source for reading, and a writer.

Reading plans one partition for each group of files of about equal bytes,
takes filters on the record type and the headers into the scan, and parses a
record's headers before anything else: a record that the filters refuse, and a
payload that was not asked for, is passed over without being decoded or
copied. Files may be plain or gzip members, one member a record.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull

from millrace.llm.base import fresh_dir, narrow_batches, saved

SCHEMA = "record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_digest string, payload_bytes long, payload binary"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = {c.split()[0]: {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in SCHEMA.split(", ")}
#: Payload bytes of a batch of records, about.
_BATCH_BYTES = 4 << 20
_NAMESPACE = uuid.UUID("6f0f7b5c-2c57-4f0e-9a3b-0d3f6d1f2f10")
#: Payloads of fewer bytes are always stored in full.
LEAST_REVISIT = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 18


# --- writing -------------------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_REVISIT) -> DataFrame:
    """Pages (page_id, url, html; null of revisits) with payload_digest, payload_bytes, record_type and refers_to.

    Of the pages with equal payloads of ``least_bytes`` or more, the one with
    the largest page_id is the response and the others revisit it (rows that
    repeat that id are responses too). A null html is an empty payload. A null
    page_id is smaller than any other; where all are null, all are responses.
    The largest id of each digest is found by partial sums, and which pages
    revisit it by a join of ids and digests only. Payloads move once, to that
    result, by page and digest: a payload with many copies is spread over
    their pages. Rows without an id are spread by their url.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    rows = rows.withColumn("_place", F.coalesce("page_id", F.xxhash64("url"))).withColumn("_none", F.col("page_id").isNull())
    ids = rows.where(F.col("payload_bytes") >= least_bytes).select("page_id", "payload_digest", "_place", "_none")
    first = ids.groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null").drop("_n")
    again = ids.join(first, "payload_digest").where("_none or page_id != _first").select("payload_digest", "_place", "_none", "_first").distinct()
    joined = rows.join(again, ["payload_digest", "_place", "_none"], "left")
    visited = F.col("_first").isNotNull()
    return joined.select("page_id", "url", F.when(~visited, F.col("html")).alias("html"), "payload_digest", "payload_bytes", F.when(visited, "revisit").otherwise("response").alias("record_type"), F.col("_first").alias("refers_to"))


def write_warc(pages: DataFrame, path: str, compress: bool = True, date: datetime.datetime | None = None) -> DataFrame:
    """Write a record for each page below ``path``, a folder that all executors see; returns the manifest (path, records).

    Each task writes one file under a temporary name and puts it in place at
    its end, under the number of its partition: a repeated task replaces it.
    An empty table gives no files.
    """
    when = (date or datetime.datetime(2024, 1, 1)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in b.to_pylist())
        first = next(rows, None)
        if first is None:
            return
        name = f"{path}/part-{TaskContext.get().partitionId():06d}.warc" + ".gz" * compress
        fs, local = _filesystem(name)
        fs.create_dir(local.rpartition("/")[0], recursive=True)
        n, temporary = 0, f"{local}.{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary, compression=None) as out:
            for row in _chain(first, rows):
                record = _record(row, when)
                out.write(gzip.compress(record, 6, mtime=0) if compress else record)
                n += 1
        fs.move(temporary, local)
        yield pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([n], pa.int64())})

    return saved(narrow_batches(with_revisits(pages)).mapInArrow(write, "path string, records long"), "warc-manifest")


def _record(row: dict, when: str) -> bytes:
    revisit, payload = row["record_type"] == "revisit", (row["html"] or "").encode()
    size = row["payload_bytes"] if revisit else len(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_record_id(row['page_id'])}", f"WARC-Date: {when}"]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {_one_line(row['url'])}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['payload_digest'])).decode()}")
    if row["page_id"] is not None:
        head.append(f"Page-ID: {row['page_id']}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(row['refers_to'])}", f"Refers-To-Page-ID: {row['refers_to']}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(page_id)) if page_id is not None else uuid.uuid4()}>"


def _one_line(text: str) -> str:
    return "".join(c if c not in "\r\n" else "%0D" if c == "\r" else "%0A" for c in text)


# --- reading -------------------------------------------------------------------------------------------------


class Files(InputPartition):
    """Some whole files."""

    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)``; a file name or a folder, searched to any depth.

    Options: ``payload`` ("false" leaves payloads null and undecoded),
    ``partitionBytes`` (about how many bytes of files a partition takes).
    A folder without files gives no rows. page_id and refers_to are null
    where a record lacks those headers; payload_digest is lower-case hex where
    the header has base 32.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "WarcReader":
        return WarcReader(self.options, [f.name for f in schema.fields])


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.partition_bytes = int(options.get("partitionBytes", 64 << 20))
        self.columns = columns
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take what the headers can decide; give the rest back."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if column not in _COLUMNS or column in ("payload", "payload_bytes"):
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif isinstance(f, (IsNull, IsNotNull)):
                self.tests.append((column, "null", isinstance(f, IsNull)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, local = _filesystem(self.path)
        scheme = self.path[: len(self.path) - len(local)] if self.path.endswith(local) else ""
        found = fs.get_file_info(local)
        if found.type == pafs.FileType.Directory:
            infos = [i for i in fs.get_file_info(pafs.FileSelector(local, recursive=True)) if i.type == pafs.FileType.File and i.path.endswith((".warc", ".warc.gz"))]
        else:
            infos = [found] if found.type == pafs.FileType.File else []
        groups: list[list[str]] = []
        room = 0
        for i in sorted(infos, key=lambda i: -i.size):
            if not groups or i.size > room:
                groups.append([])
                room = self.partition_bytes
            groups[-1].append(scheme + i.path)
            room -= i.size
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for path in partition.paths:
            for head, block in records(path):
                row = _head_row(head)
                if all(_passes(row[c], how, what) for c, how, what in self.tests):
                    _block_row(row, head, block, self.payload)
                    held.append(row)
                    size += len(row["payload"] or b"")
                    if len(held) == 1024 or size >= _BATCH_BYTES:
                        yield self._batch(held)
                        held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _TYPES[c]) for c in self.columns], names=self.columns)


def _passes(value: object, how: str, what: object) -> bool:
    return (value is None) == what if how == "null" else value is not None and value in what


def _head_row(head: dict[str, str]) -> dict:
    number = lambda name: int(v) if (v := head.get(name, "")).lstrip("-").isdigit() else None
    digest = head.get("warc-payload-digest", "").rpartition(":")[2] or None
    if digest and len(digest) == 32:
        digest = base64.b32decode(digest.upper()).hex()
    return {"record_type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "target_uri": head.get("warc-target-uri"), "page_id": number("page-id"), "refers_to": number("refers-to-page-id"), "payload_digest": digest, "payload_bytes": None, "payload": None}


def _block_row(row: dict, head: dict[str, str], block: "Block", payload: bool) -> None:
    """payload_bytes from the inner headers where it has them, else from the block's length; the payload if asked for."""
    if head.get("content-type", "").startswith("application/http"):
        inner = block.headers()
        length = inner.get("content-length", "")
        row["payload_bytes"] = int(length) if length.isdigit() else block.left
    else:
        row["payload_bytes"] = block.left
    if payload and row["record_type"] != "revisit":
        row["payload"] = block.read()


class Block:
    """What follows a record's headers; read in part or not at all."""

    def __init__(self, stream: io.BufferedIOBase, left: int) -> None:
        self.stream, self.left = stream, left

    def headers(self) -> dict[str, str]:
        """The inner headers, up to the empty line."""
        out: dict[str, str] = {}
        self._line()
        while self.left and (line := self._line()).strip():
            name, _, value = line.partition(b":")
            out[name.strip().lower().decode("latin-1")] = value.strip().decode("latin-1")
        return out

    def _line(self) -> bytes:
        line = self.stream.readline(self.left)
        self.left = self.left - len(line) if line else 0
        return line

    def read(self) -> bytes:
        data = self.stream.read(self.left)
        self.left = 0
        return data

    def skip(self) -> None:
        while self.left > 0 and (data := self.stream.read(min(self.left, _CHUNK))):
            self.left -= len(data)


def records(path: str) -> Iterator[tuple[dict[str, str], Block]]:
    """Headers (names in lower case) and unread block of each record."""
    fs, local = _filesystem(path)
    with fs.open_input_stream(local, compression=None) as raw:
        stream = io.BufferedReader(_Members(raw) if path.endswith(".gz") else _Plain(raw), _CHUNK)
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{path}: not a WARC record: {line[:40]!r}")
            head: dict[str, str] = {}
            while (line := stream.readline()).strip():
                name, _, value = line.partition(b":")
                head[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
            block = Block(stream, int(head.get("content-length", 0)))
            yield head, block
            block.skip()


class _Plain(io.RawIOBase):
    def __init__(self, raw) -> None:
        self.raw = raw

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.raw.read(len(into))
        into[: len(data)] = data
        return len(data)


class _Members(io.RawIOBase):
    """The members of a gzip file one after another."""

    def __init__(self, raw) -> None:
        self.raw, self.inflate, self.held = raw, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            self.held = self.held or self.raw.read(_CHUNK)
            if not self.held:
                return 0
            data = self.inflate.decompress(self.held, len(into))
            if self.inflate.eof:
                self.held, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            else:
                self.held = self.inflate.unconsumed_tail
            if data:
                into[: len(data)] = data
                return len(data)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _chain(first: dict, rest: Iterator[dict]) -> Iterator[dict]:
    yield first
    yield from rest


def read_warc(spark: SparkSession, path: str, payload: bool = True, partition_bytes: int = 64 << 20) -> DataFrame:
    """The records below ``path``; registers the source and sets the session to let filters reach Python data sources, as plans are made later."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).option("partitionBytes", partition_bytes).load(path)


def warc_digest(pages: DataFrame, partition_bytes: int = 64 << 20) -> DataFrame:
    """Write the pages, read the archives back and check each stored payload against its header.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to for
    each record; a stored payload that does not have the digest of its header
    raises.
    """
    spark, path = pages.sparkSession, fresh_dir(pages.sparkSession, "warc")
    write_warc(pages, path)
    back = read_warc(spark, path, partition_bytes=partition_bytes)
    stored = F.col("record_type") == "response"
    damaged = stored & ((F.sha1("payload") != F.col("payload_digest")) | (F.octet_length("payload") != F.col("payload_bytes")))
    digest = F.when(damaged, F.raise_error(F.concat(F.lit("damaged record "), "record_id")).cast("string")).otherwise(F.col("payload_digest"))
    return back.where(F.col("record_type").isin("response", "revisit")).select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
