"""A feature store: entities, feature views, groups, training sets, datasets.

Definitions are JSON records, data are Parquet folders, both below one root.
A view's query is SQL text or a function of the session; its physical name is
<NAME>$<VERSION>. Each refresh makes a version of the view's data; what was
read before keeps its rows until the version is older than the store keeps.
"""

from __future__ import annotations

import base64
import inspect
import pickle
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.intervals import parse_interval, seconds_of, slice_start
from millrace.operators.asof import asof_join, asof_join_many
from millrace.operators.tiles import MOST_SECONDARY, Feature, TileSpec, build_tiles, merge_tiles, read_at, rollup_tiles
from millrace.operators.windows import latest_per_key
from millrace.plans.versions import Snapshot, VersionedTables, within_ranges
from millrace.sources.catalog import JsonCatalog
from millrace.sources.connector import key_filter
from millrace.sources.dataset import Dataset, DatasetVersion, extend_schema
from millrace.streaming.stream import StreamSource, refresh_tiles


#: A refresh policy is an interval, "downstream" (when views built on it are), or a cron line of five fields and a time zone.
_CRON = re.compile(r"\S+( \S+){4} [A-Za-z_]+(/[A-Za-z_]+)*")


@dataclass(frozen=True)
class Entity:
    """A named set of join keys."""

    name: str
    join_keys: tuple[str, ...]
    desc: str = ""

    def __post_init__(self) -> None:
        object.__setattr__(self, "join_keys", tuple(self.join_keys))
        if len(self.name) > 32 or not self.join_keys or len(self.join_keys) > 300:
            raise ValueError("a name of up to 32 characters and 1 to 300 keys are needed")
        if len({k.lower() for k in self.join_keys}) != len(self.join_keys) or any("," in k or len(k) > 256 for k in self.join_keys):
            raise ValueError("keys must differ, have no commas and up to 256 characters")


@dataclass(frozen=True)
class Rollup:
    """Tiles of a parent view, brought to other keys by a mapping (SQL), optionally with validity columns."""

    parent: str
    parent_version: str
    mapping: str
    valid_from: str | None = None
    valid_to: str | None = None


@dataclass
class FeatureView:
    """A query with keys and optionally a time column; with features it is stored as tiles."""

    name: str
    entities: Sequence[Entity]
    query: str = ""
    timestamp_col: str | None = None
    version: str = "V1"
    refresh_freq: str | None = None
    features: Sequence[Feature] = ()
    feature_granularity: str | None = None
    aggregation_secondary_key: str | None = None
    append_only: bool = False
    rollup: Rollup | None = None
    desc: str = ""
    compute: Callable[[SparkSession], DataFrame] | None = field(default=None, repr=False)
    columns: Sequence[str] | None = None
    prefix: str | None = None
    stream: str | None = None
    cluster_by: Sequence[str] = ()
    most_secondary: int | None = MOST_SECONDARY

    def __post_init__(self) -> None:
        if self.refresh_freq and self.refresh_freq.upper() != "DOWNSTREAM" and not _CRON.fullmatch(self.refresh_freq) and parse_interval(self.refresh_freq) < 60:
            raise ValueError("views are refreshed once a minute at most")
        if self.features and not (self.timestamp_col and self.feature_granularity and self.refresh_freq):
            raise ValueError("tiled views need a time column, a granularity and a refresh frequency")
        if self.append_only and not (self.refresh_freq and self.timestamp_col):
            raise ValueError("append-only views need a time column and a refresh frequency")

    @property
    def keys(self) -> list[str]:
        return list(dict.fromkeys(k for e in self.entities for k in e.join_keys))

    @property
    def physical_name(self) -> str:
        return f"{self.name.upper()}${self.version}"

    @property
    def spec(self) -> TileSpec | None:
        return TileSpec(tuple(self.keys), self.timestamp_col, self.feature_granularity, tuple(self.features), self.aggregation_secondary_key, most_secondary=self.most_secondary) if self.features else None

    @property
    def order(self) -> list[str]:
        """Columns that the rows of a file are sorted by: cluster_by, else the keys and the time."""
        time = ["tile_start"] if self.features else [self.timestamp_col] if self.timestamp_col else []
        return [*(self.cluster_by or self.keys), *([] if self.cluster_by else time)]

    @property
    def width(self) -> int | None:
        """Seconds of time that a part of a tiled view's table holds: a day, or thirty tiles where those are days."""
        return None if not self.features else 86400 if self.spec_seconds < 86400 else 30 * self.spec_seconds

    @property
    def spec_seconds(self) -> int:
        return parse_interval(self.feature_granularity)

    def slice(self, names: Sequence[str]) -> "FeatureView":
        out = FeatureView(**{**self.__dict__, "columns": list(names)})
        known = {f.output.lower() for f in self.features}
        if known and (bad := [n for n in names if n.lower() not in known]):
            raise ValueError(f"no such features: {bad}")
        return out

    def with_name(self, prefix: str) -> "FeatureView":
        return FeatureView(**{**self.__dict__, "prefix": prefix})

    def to_dict(self) -> dict:
        d = {k: v for k, v in self.__dict__.items() if k not in ("entities", "features", "compute", "rollup", "columns", "prefix")}
        return d | {"cluster_by": list(self.cluster_by), "entities": [e.name for e in self.entities], "features": [f.to_dict() for f in self.features], "rollup": self.rollup.__dict__ if self.rollup else None, "columns": None, "prefix": None}


@dataclass
class FeatureGroup:
    name: str
    features: Sequence[FeatureView]
    auto_prefix: bool = False


class FeatureStore:
    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], datetime] = lambda: datetime.now(UTC).replace(tzinfo=None), keep: str = "1 day") -> None:
        """keep: how long a version of a view's data stays readable after a newer one replaced it."""
        self.spark, self.root, self.clock, self.keep = spark, root.rstrip("/"), clock, timedelta(seconds=parse_interval(keep))
        self.catalog = JsonCatalog(spark, f"{self.root}/_meta")
        self.tables = VersionedTables(spark, self.catalog, self.root)
        self._compute: dict[str, Callable[[SparkSession], DataFrame]] = {}

    # entities

    def register_entity(self, entity: Entity) -> Entity:
        if self.catalog.get("entity", entity.name.upper()):
            raise ValueError(f"entity {entity.name} exists")
        self.catalog.put("entity", entity.name.upper(), {"name": entity.name, "join_keys": list(entity.join_keys), "desc": entity.desc})
        return entity

    def update_entity(self, name: str, desc: str) -> Entity:
        e = self.get_entity(name)
        self.catalog.put("entity", name.upper(), {"name": e.name, "join_keys": list(e.join_keys), "desc": desc})
        return self.get_entity(name)

    def get_entity(self, name: str) -> Entity:
        if (d := self.catalog.get("entity", name.upper())) is None:
            raise ValueError(f"no entity {name}")
        return Entity(d["name"], tuple(d["join_keys"]), d["desc"])

    def list_entities(self) -> DataFrame:
        rows = [(d["name"], d["join_keys"], d["desc"]) for n in self.catalog.names("entity") if (d := self.catalog.get("entity", n))]
        return self.spark.createDataFrame(rows, "name string, join_keys array<string>, desc string")

    def delete_entity(self, name: str) -> None:
        self.get_entity(name)
        users = [n for n in self.catalog.names("view") if name.upper() in [e.upper() for e in self.catalog.get("view", n)["entities"]]]
        if users:
            raise ValueError(f"entity {name} is used by {users}")
        self.catalog.delete("entity", name.upper())

    # feature views

    def register_feature_view(self, view: FeatureView, version: str | None = None, overwrite: bool = False, seed: DataFrame | None = None) -> FeatureView:
        """Check, materialise, record; if anything fails, what was made is taken back and an older view stays as it was.

        An overwrite adds a version to the older view's: what was read from it
        stays readable. seed: a backfill table that becomes the first batch of
        an append-only view; its columns must begin the view's. A function is
        kept with the record if it can be pickled (one that holds on to
        DataFrames cannot); else it lives as long as this store object.
        """
        view = FeatureView(**{**view.__dict__, "version": version or view.version})
        name, held = view.physical_name, self._compute.get(view.physical_name)
        old, revision = self.catalog.get_revision("view", name)
        if old and not overwrite:
            raise ValueError(f"{name} exists")
        if seed is not None and not view.append_only:
            raise ValueError("only append-only views begin with a backfill table")
        for e in view.entities:
            self.get_entity(e.name)
        if view.stream:
            self.get_stream_source(view.stream)
        self._compute.pop(name, None)
        if view.compute:
            self._compute[name] = view.compute
        folder = self.tables.fresh(name)
        try:
            self._check(view)
            snapshot = self._materialise(view, folder, "0", seed)
            record = view.to_dict() | {"status": "ACTIVE", "history": [self.clock().isoformat()], "function": _pickled(view.compute), "computed": view.compute is not None, "versions": (old or {}).get("versions", [])}
            self.tables.commit(name, record, revision, snapshot, self.clock(), folder, self.keep)
        except Exception:
            self.catalog.remove_tree("..", "tables", folder)
            self._compute.pop(name, None)
            if held:
                self._compute[name] = held
            raise
        if not view.refresh_freq and not view.features:  # a view of the session too, by its physical name
            self._source(view).createOrReplaceTempView(f"`{name}`")
        return view

    def _check(self, view: FeatureView) -> None:
        columns = {c.lower() for c in self._source(view).columns} if not view.rollup else set()
        wanted = [] if view.rollup else [*view.keys, *([view.timestamp_col] if view.timestamp_col else []), *[f.column for f in view.features], *([view.aggregation_secondary_key] if view.aggregation_secondary_key else []), *([] if view.features else view.cluster_by)]
        if missing := [c for c in wanted if c.lower() not in columns]:
            raise ValueError(f"{view.name}: no such columns: {missing}")
        _ = view.spec

    def _source(self, view: FeatureView) -> DataFrame:
        compute = view.compute or self._compute.get(view.physical_name)
        if compute is None and not view.query:
            raise ValueError(f"{view.physical_name}: its function could not be kept with the record; register the view again")
        return compute(self.spark) if compute else self.spark.sql(view.query)

    def _parent_spec(self, view: FeatureView) -> tuple[FeatureView, TileSpec]:
        parent = self.get_feature_view(view.rollup.parent, view.rollup.parent_version)
        return parent, TileSpec(tuple(parent.keys), parent.timestamp_col, parent.feature_granularity, tuple(view.features), view.aggregation_secondary_key)

    def _built(self, view: FeatureView) -> DataFrame:
        if not view.rollup:
            return build_tiles(self._source(view), view.spec)
        parent, spec = self._parent_spec(view)
        return rollup_tiles(self.tiles(parent), self.spark.sql(view.rollup.mapping), spec, view.keys, view.rollup.valid_from, view.rollup.valid_to)

    def _materialise(self, view: FeatureView, folder: str, batch: str, seed: DataFrame | None = None) -> Snapshot:
        """The view's data anew, in parts below the folder; views without a refresh frequency have none."""
        if view.append_only:
            rows = self._source(view)
            schema = rows.schema if seed is None else extend_schema(seed, rows).schema
            parts = {} if seed is None else {"seed": self._batch(seed, f"{folder}/seed", view)}
            return Snapshot(parts | {batch: self._batch(rows, f"{folder}/{batch}", view)}, schema, view.to_dict())
        if not view.refresh_freq:
            return Snapshot({}, StructType([]), view.to_dict())
        rows = self._built(view) if view.features else self._source(view)
        return Snapshot(self.tables.write(rows, folder, view.order, view.width), rows.schema, view.to_dict())

    def _batch(self, rows: DataFrame, folder: str, view: FeatureView) -> str:
        return self.tables.write(rows, folder, view.order)["all"]

    def get_feature_view(self, name: str, version: str) -> FeatureView:
        if (d := self.catalog.get("view", f"{name.upper()}${version}")) is None:
            raise ValueError(f"no feature view {name} {version}")
        view = self._defined(d)
        if d["computed"] and view.physical_name not in self._compute and d["function"]:
            self._compute[view.physical_name] = pickle.loads(base64.b64decode(d["function"]))
        view.compute = self._compute.get(view.physical_name)
        return view

    def _defined(self, record: dict) -> FeatureView:
        d = {k: v for k, v in record.items() if k not in ("status", "history", "versions", "function", "computed")}
        d["entities"] = [self.get_entity(e) for e in d["entities"]]
        d["features"] = [Feature.from_dict(f) for f in d["features"]]
        d["rollup"] = Rollup(**d["rollup"]) if d["rollup"] else None
        return FeatureView(**d)

    def list_feature_views(self, entity: str | None = None, prefix: str = "") -> DataFrame:
        rows = []
        for n in self.catalog.names("view"):
            d = self.catalog.get("view", n)
            if n.startswith(prefix.upper()) and (entity is None or entity.upper() in [e.upper() for e in d["entities"]]):
                rows.append((d["name"], d["version"], d["entities"], d["refresh_freq"], d["status"], d["desc"]))
        return self.spark.createDataFrame(rows, "name string, version string, entities array<string>, refresh_freq string, status string, desc string")

    def update_feature_view(self, name: str, version: str, refresh_freq: str | None = None, desc: str | None = None, query: str | None = None, compute: Callable[[SparkSession], DataFrame] | None = None) -> FeatureView:
        """Change a view's record, or (append-only views) where its rows come from from now on.

        A new query or function must give the columns so far, with those that
        are new at the end. Rows that are there already have nulls in them; no
        data are written.
        """
        view = self.get_feature_view(name, version)
        given = {k: v for k, v in (("refresh_freq", refresh_freq), ("desc", desc)) if v is not None}
        if query is None and compute is None:
            self.catalog.change("view", view.physical_name, lambda d: d | given)
            return self.get_feature_view(name, version)
        if not view.append_only:
            raise ValueError("only append-only views take a new query; register others again with overwrite")
        d, revision = self.catalog.get_revision("view", view.physical_name)
        new = FeatureView(**{**view.__dict__, "query": query or "", "compute": compute, **given})
        held = self._compute.pop(view.physical_name, None)
        try:
            self._check(new)
            snapshot = self.tables.snapshot(view.physical_name)
            wide = extend_schema(self.tables.read(snapshot), self._source(new)).schema
            record = d | new.to_dict() | {"function": _pickled(compute), "computed": compute is not None}
            self.tables.commit(view.physical_name, record, revision, Snapshot(snapshot.parts, wide, new.to_dict()), self.clock(), self.tables.fresh(view.physical_name), self.keep)
        except Exception:
            if held:
                self._compute[view.physical_name] = held
            raise
        if compute:
            self._compute[view.physical_name] = compute
        return self.get_feature_view(name, version)

    def refresh_feature_view(self, view: FeatureView, changed: DataFrame | None = None, batch: str | None = None) -> None:
        """Bring a view's data up to date; suspended views raise.

        A tiled view with ``changed`` (new or late events, already in its
        source) reads, computes and writes only the parts of its table that
        they fall in; the other parts stay where they are. Append-only views
        add a batch, by default under the number of refreshes so far; a batch
        given again replaces itself. Columns may be added at the end only. All
        else is computed anew. Whichever way, the result is a new version; if
        the view was changed meanwhile, ConcurrentChange is raised. Without a
        refresh frequency there are no data.
        """
        name = view.physical_name
        d, revision = self.catalog.get_revision("view", name)
        if d["status"] != "ACTIVE":
            raise ValueError(f"{name} is suspended")
        folder, snapshot = self.tables.fresh(name), self.tables.snapshot(name)
        try:
            if view.append_only:
                rows, number = self._source(view), batch or str(len(d["history"]))
                schema = extend_schema(self.tables.read(snapshot), rows).schema
                new = Snapshot(snapshot.parts | {number: self._batch(rows, f"{folder}/{number}", view)}, schema, view.to_dict())
            elif view.features and not view.rollup and changed is not None:
                new = self._refreshed(view, snapshot, changed, folder)
            else:
                new = self._materialise(view, folder, "0")
        except Exception:
            self.catalog.remove_tree("..", "tables", folder)
            raise
        self.tables.commit(name, d | {"history": [*d["history"], self.clock().isoformat()]}, revision, new, self.clock(), folder, self.keep)

    def _refreshed(self, view: FeatureView, snapshot: Snapshot, changed: DataFrame, folder: str) -> Snapshot:
        ranges = self._touched(view, changed)
        if not ranges:
            return snapshot
        rows = self.refreshed_tiles(view, snapshot, changed, ranges)
        untouched = {n: p for n, p in snapshot.parts.items() if int(n) not in set(ranges)}
        return Snapshot(untouched | self.tables.write(rows, folder, view.order, view.width), snapshot.schema, view.to_dict())

    def _touched(self, view: FeatureView, changed: DataFrame) -> list[int]:
        """The ranges of time that changed events fall in; as many as there are ranges at most."""
        place = F.floor(slice_start(F.col(view.timestamp_col), view.spec.seconds) / view.width)
        return sorted(r[0] for r in changed.where(F.col(view.timestamp_col).isNotNull()).select(place.alias("r")).distinct().collect())

    def refreshed_tiles(self, view: FeatureView, snapshot: Snapshot, changed: DataFrame, ranges: Sequence[int]) -> DataFrame:
        """New tiles of some ranges: the parts of the table and of the source that hold them are all that is read."""
        source = self._source(view)
        near = source.where(within_ranges(view.timestamp_col, source.schema[view.timestamp_col].dataType.simpleString(), ranges, view.width))
        tiles = refresh_tiles(near, self.tables.read(snapshot, [str(r) for r in ranges]), view.spec, changed)
        return tiles.select(*snapshot.schema.fieldNames())

    def get_refresh_history(self, view: FeatureView) -> DataFrame:
        times = self.catalog.get("view", view.physical_name)["history"]
        return self.spark.createDataFrame([(view.physical_name, i, t) for i, t in enumerate(times)], "name string, refresh long, at string")

    def list_versions(self, view: FeatureView) -> DataFrame:
        """number and time of the versions of a view's data that can be read."""
        rows = [(v["n"], v["at"]) for v in self.catalog.get("view", view.physical_name)["versions"]]
        return self.spark.createDataFrame(rows, "number long, at string")

    def expire_versions(self, view: FeatureView, older_than: str) -> list[int]:
        """Let go of versions that were replaced longer ago than an interval, before the store would do so."""
        return self.tables.expire(view.physical_name, self.clock() - timedelta(seconds=parse_interval(older_than)))

    def _status(self, view: FeatureView, status: str) -> None:
        self.catalog.change("view", view.physical_name, lambda d: d | {"status": status})

    def suspend_feature_view(self, view: FeatureView) -> None:
        self._status(view, "SUSPENDED")

    def resume_feature_view(self, view: FeatureView) -> None:
        self._status(view, "ACTIVE")

    def delete_feature_view(self, name: str, version: str) -> None:
        view = self.get_feature_view(name, version)
        users = [n for n in self.catalog.names("view") if (r := self.catalog.get("view", n)["rollup"]) and (r["parent"].upper(), r["parent_version"]) == (name.upper(), version)]
        if users:
            raise ValueError(f"{view.physical_name} is the parent of {users}")
        self.tables.drop(view.physical_name)
        self.catalog.delete("view", view.physical_name)
        self._compute.pop(view.physical_name, None)

    def tiles(self, view: FeatureView, low: int | None = None, high: int | None = None, version: int | None = None) -> DataFrame:
        """The tiles of a view as of its newest version or another; with bounds (seconds since 1970) only parts that may hold tiles in between are read."""
        return self.tables.between(self.tables.snapshot(view.physical_name, version), view.width, low, high)

    def read_feature_view(self, view: FeatureView, keys: Sequence[Sequence] | None = None, feature_names: Sequence[str] | None = None, version: int | None = None) -> DataFrame:
        """Rows of the view; of a tiled one the values at the clock's time.

        version: the number of a refresh (list_versions) whose data are read,
        by the definition of that time. The rows stay the same if the view is
        refreshed or overwritten before they are used.
        """
        if version is not None:
            columns, prefix = view.columns, view.prefix
            view = self._defined(self.tables.snapshot(view.physical_name, version).about)
            view.columns, view.prefix = columns, prefix
        if view.features:
            df = read_at(self.tiles(view, version=version), view.spec, F.lit(self.clock()), False).drop("as_of")
        else:
            df = self._rows(view, version)
        if keys is not None:
            df = key_filter(df, view.keys, keys)
        if feature_names is not None:
            if bad := [n for n in feature_names if n.lower() not in [c.lower() for c in df.columns]]:
                raise ValueError(f"no such features: {bad}")
            df = df.select(*view.keys, *feature_names)
        return df

    def _rows(self, view: FeatureView, version: int | None = None) -> DataFrame:
        if not view.refresh_freq:
            return self._source(view)
        return self.tables.read(self.tables.snapshot(view.physical_name, version))

    # stream sources

    def register_stream_source(self, name: str, schema: StructType, desc: str = "") -> StreamSource:
        if self.catalog.get("stream", name.upper()):
            raise ValueError(f"stream source {name} exists")
        self.catalog.put("stream", name.upper(), {"name": name, "schema": schema.jsonValue(), "desc": desc})
        return self.get_stream_source(name)

    def get_stream_source(self, name: str) -> StreamSource:
        if (d := self.catalog.get("stream", name.upper())) is None:
            raise ValueError(f"no stream source {name}")
        return StreamSource(d["name"], StructType.fromJson(d["schema"]), f"{self.root}/landing/{name.upper()}")

    def list_stream_sources(self) -> DataFrame:
        rows = [(d["name"], d["desc"]) for n in self.catalog.names("stream") if (d := self.catalog.get("stream", n))]
        return self.spark.createDataFrame(rows, "name string, desc string")

    def update_stream_source(self, name: str, desc: str) -> None:
        self.catalog.change("stream", name.upper(), lambda d: d | {"desc": desc})

    def delete_stream_source(self, name: str) -> None:
        self.get_stream_source(name)
        if users := [n for n in self.catalog.names("view") if (self.catalog.get("view", n)["stream"] or "").upper() == name.upper()]:
            raise ValueError(f"stream source {name} is used by {users}")
        self.catalog.delete("stream", name.upper())
        self.catalog.remove_tree("..", "landing", name.upper())

    def stream_ingest(self, name: str, records: Sequence[dict]) -> int:
        return self.get_stream_source(name).ingest(self.spark, records)

    def backfill_state(self, view: str, state: str | None = None) -> str | None:
        """RUNNING, COMPLETED or FAILED of a view's backfill; sets it if given."""
        if state is not None:
            if state not in ("RUNNING", "COMPLETED", "FAILED"):
                raise ValueError(f"state: {state!r}")
            self.catalog.put("backfill", view.upper(), {"state": state, "at": self.clock().isoformat()})
        return (self.catalog.get("backfill", view.upper()) or {}).get("state")

    def run_backfill(self, view: str, rows: DataFrame) -> None:
        """Write history to the view's landing table, with the state kept around the job."""
        self.backfill_state(view, "RUNNING")
        try:
            rows.write.mode("overwrite").parquet(f"{self.root}/backfill/{view.upper()}")
        except Exception:
            self.backfill_state(view, "FAILED")
            raise
        self.backfill_state(view, "COMPLETED")

    # groups

    def register_feature_group(self, group: FeatureGroup) -> FeatureGroup:
        if self.catalog.get("group", group.name.upper()):
            raise ValueError(f"feature group {group.name} exists")
        self.catalog.put("group", group.name.upper(), {"name": group.name, "auto_prefix": group.auto_prefix, "views": [[v.name, v.version, list(v.columns) if v.columns else None, v.prefix] for v in group.features]})
        return group

    def get_feature_group(self, name: str) -> FeatureGroup:
        if (d := self.catalog.get("group", name.upper())) is None:
            raise ValueError(f"no feature group {name}")
        views = []
        for n, version, columns, prefix in d["views"]:
            v = self.get_feature_view(n, version)
            views.append(FeatureView(**{**v.__dict__, "columns": columns, "prefix": prefix}))
        return FeatureGroup(d["name"], views, d["auto_prefix"])

    def list_feature_groups(self) -> DataFrame:
        rows = [(d["name"], len(d["views"])) for n in self.catalog.names("group") if (d := self.catalog.get("group", n))]
        return self.spark.createDataFrame(rows, "name string, views long")

    def delete_feature_group(self, name: str) -> None:
        self.get_feature_group(name)
        self.catalog.delete("group", name.upper())

    def read_feature_group(self, name: str, spine: DataFrame) -> DataFrame:
        group = self.get_feature_group(name)
        return self.retrieve_feature_values(spine, group.features, auto_prefix=group.auto_prefix)

    # training sets

    def retrieve_feature_values(self, spine: DataFrame, features: Sequence[FeatureView], spine_timestamp_col: str | None = None, exclude_columns: Sequence[str] = (), auto_prefix: bool = False) -> DataFrame:
        """The spine with every view's features: as of the spine's time, or the current ones without a time.

        Views with a time column and the same keys are joined together, in one
        sort of the spine and their rows. Append-only views have no current
        rows, so without a time they raise.
        """
        if missing := [k for v in features for k in v.keys if k not in spine.columns]:
            raise ValueError(f"join keys not in the spine: {sorted(set(missing))}")
        if spine_timestamp_col is None and (bad := [v.physical_name for v in features if v.append_only]):
            raise ValueError(f"append-only views need the spine's time: {bad}")
        out, groups, names, bounds = spine, {}, [*spine.columns], None
        for v in features:
            prefix = f"{v.prefix}_" if v.prefix else f"{v.name.upper()}_{v.version}_" if auto_prefix and v.prefix != "" else ""
            wanted = [c.lower() for c in v.columns] if v.columns else None
            if v.features:
                names = _added(names, [prefix + c for c in _tiled_names(v) if wanted is None or c.lower() in wanted])
                if spine_timestamp_col:
                    bounds = bounds or self._bounds(spine, spine_timestamp_col)
                out = self._tiled(out, v, spine_timestamp_col, prefix, wanted, bounds)
                continue
            rows = self._rows(v)
            columns = [c for c in rows.columns if c not in v.keys and c != v.timestamp_col and (wanted is None or c.lower() in wanted)]
            names = _added(names, [prefix + c for c in columns])
            if v.timestamp_col and spine_timestamp_col:
                groups.setdefault(tuple(sorted(v.keys)), []).append((rows, v.timestamp_col, columns, prefix))
                continue
            current = latest_per_key(rows, v.keys, v.timestamp_col) if v.timestamp_col else rows
            out = out.join(current.select(*v.keys, *[F.col(c).alias(prefix + c) for c in columns]), v.keys, "left").select(*out.columns, *[prefix + c for c in columns])
        for keys, views in groups.items():
            out = asof_join_many(out, views, list(keys), spine_timestamp_col)
        return out.select(*names).drop(*exclude_columns)

    def _bounds(self, spine: DataFrame, ts: str) -> tuple:
        """The spine's first and last time, in seconds since 1970; nulls of an empty spine."""
        return tuple(spine.agg(F.min(seconds_of(F.col(ts))), F.max(seconds_of(F.col(ts)))).first())

    def _tiled(self, spine: DataFrame, v: FeatureView, ts: str | None, prefix: str, wanted: list[str] | None, bounds: tuple | None) -> DataFrame:
        if ts:
            low, high = self._reach(v, bounds)
            met = merge_tiles(spine, self.tiles(v, low, high), v.spec, ts)
        else:
            met = spine.join(self.read_feature_view(v), v.keys, "left")
        return met.select(*spine.columns, *[F.col(c).alias(prefix + c) for c in _tiled_names(v) if wanted is None or c.lower() in wanted])

    def _reach(self, v: FeatureView, bounds: tuple) -> tuple[int | None, int | None]:
        """Tiles that a spine between two times may need: no other parts of the table are read."""
        if bounds[0] is None:
            return 0, 0
        first, last = (t - t % v.spec.unit_seconds for t in bounds)
        return None if any(f.lifetime for f in v.features) else first - max(v.spec.reach, v.spec.seconds), last

    def generate_training_set(self, spine: DataFrame, features: Sequence[FeatureView] | None = None, feature_group: str | None = None, spine_timestamp_col: str | None = None, exclude_columns: Sequence[str] = (), save_as: str | None = None, auto_prefix: bool = False) -> DataFrame:
        """As retrieve_feature_values; with save_as written as a table that must not exist."""
        if (features is None) == (feature_group is None):
            raise ValueError("give either features or a feature group")
        if feature_group is not None:
            group = self.get_feature_group(feature_group)
            features, auto_prefix = group.features, group.auto_prefix
        out = self.retrieve_feature_values(spine, features, spine_timestamp_col, exclude_columns, auto_prefix)
        if save_as:
            out.write.mode("errorifexists").saveAsTable(save_as)
            return self.spark.table(save_as)
        return out

    def generate_dataset(self, name: str, version: str, spine: DataFrame, features: Sequence[FeatureView], spine_timestamp_col: str | None = None, spine_label_cols: Sequence[str] = (), exclude_columns: Sequence[str] = (), **options) -> DatasetVersion:
        rows = self.generate_training_set(spine, features, None, spine_timestamp_col, exclude_columns, None, options.pop("auto_prefix", False))
        properties = {"views": [[v.name, v.version] for v in features]}
        return Dataset(self.spark, f"{self.root}/datasets", name).create_version(version, rows, label_cols=spine_label_cols, exclude_cols=[spine_timestamp_col] if spine_timestamp_col else [], properties=properties, **options)

    def load_feature_views_from_dataset(self, dataset: DatasetVersion) -> list[FeatureView]:
        return [self.get_feature_view(n, v) for n, v in dataset.manifest["properties"]["views"]]

    def lineage(self) -> DataFrame:
        """Edges from entities, parent views and views to what is built on them."""
        rows = []
        for n in self.catalog.names("view"):
            d = self.catalog.get("view", n)
            rows += [(f"entity:{e.upper()}", f"view:{n}") for e in d["entities"]]
            if d["rollup"]:
                rows.append((f"view:{d['rollup']['parent'].upper()}${d['rollup']['parent_version']}", f"view:{n}"))
        for n in self.catalog.names("group"):
            rows += [(f"view:{v.upper()}${version}", f"group:{n}") for v, version, *_ in self.catalog.get("group", n)["views"]]
        return self.spark.createDataFrame(rows, "source string, target string")

    def clear(self) -> None:
        self.catalog.remove_tree("..")


def _added(names: list[str], more: list[str]) -> list[str]:
    if clash := sorted({n for n in more if n in names or more.count(n) > 1}):
        raise ValueError(f"columns on both sides: {clash}; give a prefix")
    return names + more


def _tiled_names(v: FeatureView) -> list[str]:
    return [*(["secondary_keys"] if v.aggregation_secondary_key else []), *[f.output for f in v.features]]


def _pickled(function: Callable | None) -> str | None:
    """A function as text, or None if it holds something that belongs to this session."""
    if function is None:
        return None
    try:
        return base64.b64encode(cloudpickle.dumps(function)).decode()
    except Exception:  # whatever it holds refuses in its own way
        return None


def check_compute(compute: Callable, allowed: Sequence[str] = ("pd", "np", "pandas", "numpy", "math")) -> None:
    """Raise unless ``compute`` is a plain function that needs nothing but its argument, builtins and the allowed modules.

    Coroutines, generators, lambdas without source, closures over values, and
    names from around the function would not be the same where it runs later.
    """
    if not inspect.isfunction(compute):
        raise ValueError("a plain function is needed")
    if inspect.iscoroutinefunction(compute) or inspect.isgeneratorfunction(compute):
        raise ValueError("the function must return its frame at once")
    if compute.__code__.co_argcount != 1 or compute.__code__.co_kwonlyargcount or compute.__code__.co_flags & (inspect.CO_VARARGS | inspect.CO_VARKEYWORDS):
        raise ValueError("the function must have one argument")
    found = inspect.getclosurevars(compute)
    if found.nonlocals:
        raise ValueError(f"the function closes over {sorted(found.nonlocals)}")
    if bad := sorted(n for n, v in found.globals.items() if not (inspect.ismodule(v) and v.__name__.split(".")[0] in allowed)):
        raise ValueError(f"the function uses names from around it: {bad}")


def realtime_features(df: DataFrame, compute: Callable[[pd.DataFrame], pd.DataFrame], schema: str, views: Sequence[tuple[DataFrame, Sequence[str], str, Sequence[str]]] = (), ts: str | None = None, strict: bool = False) -> DataFrame:
    """Request rows and upstream features through a pandas function, evaluated in batches; its columns follow the others.

    views: (rows, keys, time column, columns) that are joined as of the
    request's time ``ts`` for the function only and are not in the result.
    Requests that repeat each get their row. strict: check_compute first.
    """
    if strict:
        check_compute(compute)
    elif not inspect.isfunction(compute):
        raise ValueError("a plain function is needed")
    wide = df
    for rows, keys, at, columns in views:
        wide = asof_join(wide, rows, keys, ts, at, columns)
    given, extra = wide.columns, df.sparkSession.createDataFrame([], schema).schema

    def run(frames):
        for frame in frames:
            out = compute(frame[given])
            if len(out) != len(frame):
                raise ValueError("the function must return a row for each row")
            yield pd.concat([frame[df_columns].reset_index(drop=True), out.reset_index(drop=True)], axis=1)

    df_columns = df.columns
    joined = type(df.schema)(list(df.schema.fields))
    for f in extra.fields:
        joined = joined.add(f)
    return wide.mapInPandas(run, joined)
