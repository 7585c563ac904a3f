"""Tables as a log of versions: each names the folders that were its data.

A version is made by writing new folders beside the old ones and then putting
one record in place, so a reader that has planned its read keeps its files
whatever is refreshed or overwritten meanwhile. Folders go once no version
that is young enough needs them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.intervals import from_seconds
from millrace.sources.catalog import ConcurrentChange, JsonCatalog

#: Column that tells the range of time that a row of a partitioned table is in.
RANGE = "_range"


@dataclass
class Snapshot:
    """Parts of a table by name, each a folder; the rows' schema; and what the table was made from."""

    parts: dict[str, str]
    schema: StructType
    about: dict = field(default_factory=dict)


class VersionedTables:
    """Tables below a root, whose records hold the list of versions; changes are compare-and-set."""

    def __init__(self, spark: SparkSession, catalog: JsonCatalog, root: str, kind: str = "view") -> None:
        self.spark, self.catalog, self.root, self.kind = spark, catalog, root, kind

    def fresh(self, name: str) -> str:
        return f"{name}/{uuid.uuid4().hex}"

    def write(self, rows: DataFrame, folder: str, order: Sequence[str] = (), width: int | None = None, start: str = "tile_start") -> dict[str, str]:
        """Write rows, sorted by ``order`` within their files, and give the parts: one, or with ``width`` one for each so many seconds of ``start``.

        A part that holds much is split over several tasks and files.
        """
        if width is None:
            (rows.sortWithinPartitions(*order) if order else rows).write.mode("overwrite").parquet(f"{self.root}/tables/{folder}")
            return {"all": folder}
        ranged = rows.withColumn(RANGE, F.floor(F.col(start) / width)).hint("rebalance", F.col(RANGE))
        ranged.sortWithinPartitions(RANGE, *order).write.mode("overwrite").partitionBy(RANGE).parquet(f"{self.root}/tables/{folder}")
        found = self.catalog.children("..", "tables", folder)
        return {f.split("=")[1]: f"{folder}/{f}" for f in found if f.startswith(f"{RANGE}=")}

    def read(self, s: Snapshot, names: Sequence[str] | None = None) -> DataFrame:
        """The rows of the snapshot, or of some of its parts; no other folder is listed."""
        paths = [f"{self.root}/tables/{p}" for n, p in sorted(s.parts.items()) if names is None or n in names]
        return self.spark.read.schema(s.schema).parquet(*paths) if paths else self.spark.createDataFrame([], s.schema)

    def between(self, s: Snapshot, width: int, low: int | None, high: int | None, start: str = "tile_start") -> DataFrame:
        """Rows with low <= start < high (None: no bound), from the parts that may hold some."""
        names = [n for n in s.parts if (low is None or (int(n) + 1) * width > low) and (high is None or int(n) * width < high)]
        rows = self.read(s, names)
        rows = rows if low is None else rows.where(F.col(start) >= low)
        return rows if high is None else rows.where(F.col(start) < high)

    def commit(self, name: str, record: dict, revision: int, snapshot: Snapshot, at: datetime, made: str, keep: timedelta) -> dict:
        """Add a version to the record and put it in place of the revision it was made from.

        If another writer was first, the new folder ``made`` goes and
        ConcurrentChange is raised.
        """
        manifest, held = uuid.uuid4().hex, record.get("versions", [])
        self.catalog.put("manifest", f"{name}.{manifest}", {"parts": snapshot.parts, "schema": snapshot.schema.json(), "about": snapshot.about}, expected=0)
        n = held[-1]["n"] + 1 if held else 0
        record = record | {"versions": [*held, {"n": n, "at": at.isoformat(), "manifest": manifest}]}
        try:
            self.catalog.put(self.kind, name, record, expected=revision)
        except ConcurrentChange:
            self.catalog.remove_tree("..", "tables", made)
            self.catalog.delete("manifest", f"{name}.{manifest}")
            raise
        self.expire(name, at - keep)
        return record

    def snapshot(self, name: str, version: int | None = None) -> Snapshot:
        """The newest version, or one by its number; a number that has expired raises."""
        record = self.catalog.get(self.kind, name)
        found = [v for v in (record or {}).get("versions", []) if version in (None, v["n"])]
        if not found:
            raise ValueError(f"{name} has no version {version} (any more)")
        d = self.catalog.get("manifest", f"{name}.{found[-1]['manifest']}")
        return Snapshot(d["parts"], StructType.fromJson(json.loads(d["schema"])), d["about"])

    def expire(self, name: str, before: datetime) -> list[int]:
        """Drop versions that a newer one replaced before a time, and the folders that no other version has; gives their numbers."""
        record, revision = self.catalog.get_revision(self.kind, name)
        held = record["versions"]
        gone = [v for v, next_one in zip(held, held[1:]) if datetime.fromisoformat(next_one["at"]) < before]
        if not gone:
            return []
        try:
            self.catalog.put(self.kind, name, record | {"versions": [v for v in held if v not in gone]}, expected=revision)
        except ConcurrentChange:  # whoever changed it will find them again
            return []
        folders = lambda vs: {p for v in vs for p in (self.catalog.get("manifest", f"{name}.{v['manifest']}") or {"parts": {}})["parts"].values()}
        for folder in folders(gone) - folders(v for v in held if v not in gone):
            self.catalog.remove_tree("..", "tables", folder)
        for v in gone:
            self.catalog.delete("manifest", f"{name}.{v['manifest']}")
        return [v["n"] for v in gone]

    def drop(self, name: str) -> None:
        for v in (self.catalog.get(self.kind, name) or {}).get("versions", []):
            self.catalog.delete("manifest", f"{name}.{v['manifest']}")
        self.catalog.remove_tree("..", "tables", name)


#: Most stretches of time that a filter names one by one.
STRETCHES = 32


def within_ranges(ts: str, kind: str, ranges: Sequence[int], width: int) -> Column:
    """A filter on a time column that any source can push down: the stretches that the ranges make up, or from the first to the last if they are many.

    Times with a zone get a day on each side, as the session's zone decides where they lie.
    """
    stretches: list[list[int]] = []
    for r in sorted(ranges):
        if stretches and stretches[-1][1] == r:
            stretches[-1][1] = r + 1
        else:
            stretches.append([r, r + 1])
    if len(stretches) > STRETCHES:
        stretches = [[stretches[0][0], stretches[-1][1]]]
    slack = 0 if kind == "timestamp_ntz" else 86400
    found = F.lit(False)
    for low, high in stretches:
        found = found | ((F.col(ts) >= from_seconds(F.lit(low * width - slack))) & (F.col(ts) < from_seconds(F.lit(high * width + slack))))
    return found
