"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where nothing is set, a
    fresh temporary folder takes its place in local mode (tests on one
    machine); on a cluster that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; ``made`` gets its path, for discard().

    This cuts the lineage: later jobs read the table, and a lost executor
    costs no more than the tasks that ran on it.
    """
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, made: list[str]) -> None:
    """Delete tables that saved() wrote and that no later plan reads, and empty the list."""
    for path in made:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    made.clear()


#: Bytes of an Arrow batch that goes to a Python worker, about; Spark's own default is eight times that.
BATCH_BYTES = 8 << 20


def narrow_batches(df: DataFrame) -> DataFrame:
    """Ask for Arrow batches of BATCH_BYTES where the session allows larger ones: texts and sets are wide rows, and an executor holds several batches at once.

    The setting is the session's and stays: plans are lazy, so it must hold
    when the returned table is computed.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < in_bytes(str(conf.get(key, "64m"))) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def in_bytes(size: str) -> int:
    """Bytes of a size as Spark's settings have it: a number, and a unit from b to p, as in "64m" or "64mb"."""
    m = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", size.strip().lower())
    if not m:
        raise ValueError(f"not a size: {size!r}")
    return int(m[1]) << 10 * " kmgtp".index(m[2] or " ")


def give_back() -> None:
    """Return freed memory to the system; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def unused(columns: list[str], name: str) -> str:
    """``name``, behind as many underscores as set it apart from the columns (without regard to case)."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``most_bytes`` of ``column`` (one row at least)."""
    for batch in batches:
        rows, at = batch.num_rows, 0
        if rows == 0:
            continue
        sizes = text_column(batch, column).nbytes / rows
        step = max(1, int(most_bytes / max(sizes, 1)))
        while at < rows:
            part = batch.slice(at, min(step, rows - at))
            if part.num_rows > 1 and sliced_bytes(text_column(part, column)) > 4 * most_bytes:
                part = part.slice(0, max(1, part.num_rows // 8))
            yield part
            at += part.num_rows
        del batch, part
    give_back()


def text_column(batch: pa.RecordBatch, column: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(column))


def sliced_bytes(array: pa.Array) -> int:
    """Bytes of a string array's own slice."""
    if len(array) == 0:
        return 0
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int32)
    return int(offsets[array.offset + len(array)] - offsets[array.offset])
