"""Small JSON records in a folder that any Hadoop file system can hold."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class ConcurrentChange(RuntimeError):
    """A record was changed between reading it and writing it back."""


class JsonCatalog:
    """Records by kind and name; each revision of a record is a file of its own, and the highest one counts.

    A revision is written beside and renamed into its place, which fails if
    another writer was first. So readers see whole records, and a change that
    names the revision it comes from is made only if that is still the newest.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _fs(self):
        return self._at().getFileSystem(self._conf)

    def children(self, *parts: str) -> list[str]:
        fs, at = self._fs(), self._at(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _revisions(self, kind: str, name: str) -> list[int]:
        return sorted(int(n[:-5]) for n in self.children(kind, name) if n.endswith(".json") and not n.startswith("."))

    def put(self, kind: str, name: str, record: dict, expected: int | None = None) -> int:
        """Write a record and give its revision. expected: the revision that it replaces (0: none yet), else ConcurrentChange; None: whatever is there."""
        while True:
            found = (self._revisions(kind, name) or [0])[-1]
            if expected not in (None, found):
                raise ConcurrentChange(f"{kind} {name} was changed meanwhile: revision {found} is not {expected}")
            if self._write(kind, name, found + 1, record):
                for old in self._revisions(kind, name)[:-2]:  # the one before stays for readers on their way
                    self._fs().delete(self._at(kind, name, f"{old}.json"), False)
                return found + 1

    def _write(self, kind: str, name: str, revision: int, record: dict) -> bool:
        beside, hadoop = self._at(kind, name, f".{uuid.uuid4().hex}"), self._jvm.org.apache.hadoop.fs
        out = self._fs().create(beside, True)
        out.write(json.dumps(record, sort_keys=True).encode())
        out.close()
        try:
            never_over = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
            hadoop.FileContext.getFileContext(self._fs().getUri(), self._conf).rename(beside, self._at(kind, name, f"{revision}.json"), never_over)
        except Py4JJavaError as e:
            self._fs().delete(beside, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def get_revision(self, kind: str, name: str) -> tuple[dict | None, int]:
        """The record and its revision; (None, 0) if there is none."""
        found = self._revisions(kind, name)
        if not found:
            return None, 0
        stream = self._fs().open(self._at(kind, name, f"{found[-1]}.json"))
        text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text), found[-1]

    def get(self, kind: str, name: str) -> dict | None:
        return self.get_revision(kind, name)[0]

    def change(self, kind: str, name: str, made: Callable[[dict], dict]) -> dict:
        """Read, change and write a record; again if another writer was first."""
        while True:
            record, revision = self.get_revision(kind, name)
            if record is None:
                raise ValueError(f"no {kind} {name}")
            new = made(record)
            try:
                self.put(kind, name, new, revision)
                return new
            except ConcurrentChange:
                continue

    def names(self, kind: str) -> list[str]:
        return [n for n in self.children(kind) if not n.startswith(".") and self._revisions(kind, n)]

    def delete(self, kind: str, name: str) -> bool:
        return self._fs().delete(self._at(kind, name), True)

    def remove_tree(self, *parts: str) -> bool:
        return self._fs().delete(self._at(*parts), True)

    def exists(self, *parts: str) -> bool:
        return self._fs().exists(self._at(*parts))
