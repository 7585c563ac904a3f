"""Tiled time-window features.

Events are reduced to partial aggregates by key and tile (a slice of time);
every window over whole tiles is then a merge of partials. Tiles are built
once and serve all features, windows and offsets on the same columns.

Boundary of a spine row: its time cut to the unit of the granularity. A tile
counts if it is complete at the boundary B (start + g <= B) and lies in the
window: B - W - O <= start < B - O. With no tile in the window sums and counts
(distinct ones too) are 0, other results null, arrays of secondary keys empty.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.intervals import LIFETIME, UNITS, from_seconds, guarded_ratio, parse_interval, micros_of, slice_start, split_interval
from millrace.operators.asof import asof_join, range_join_binned, running_by_key, validity_join

SIMPLE = ("sum", "count", "avg", "min", "max", "stddev", "var")
SKETCHES = ("approx_count_distinct", "approx_percentile")
LISTS = ("last_n", "first_n", "last_distinct_n", "first_distinct_n")
#: Most values of a list feature, and secondary keys of an array feature.
MOST_LISTED, MOST_SECONDARY = 100, 5000
#: Tiles of a window from which on it is taken as a difference of running sums, where those are exact.
LONG_WINDOW = 64
_START = "tile_start"


@dataclass(frozen=True)
class Feature:
    """An aggregate of a column over a window that ends ``offset`` before the boundary."""

    function: str
    column: str
    window: str
    offset: str = "0s"
    n: int = 0
    percentile: float = 0.5
    precision: int = 12
    name: str | None = None

    def __post_init__(self) -> None:
        if self.function not in SIMPLE + SKETCHES + LISTS:
            raise ValueError(f"unknown function {self.function!r}")
        if self.function in LISTS and not 1 <= self.n <= MOST_LISTED:
            raise ValueError(f"n must be 1 to {MOST_LISTED}")
        if self.lifetime and (self.function not in SIMPLE or self.offset_seconds):
            raise ValueError("lifetime windows have no offset and only " + ", ".join(SIMPLE))
        if not 0 <= self.percentile <= 1 or not 4 <= self.precision <= 21:
            raise ValueError("percentile must be 0 to 1, precision 4 to 21")

    @property
    def window_seconds(self) -> int:
        return parse_interval(self.window)

    @property
    def offset_seconds(self) -> int:
        return parse_interval(self.offset)

    @property
    def lifetime(self) -> bool:
        return self.window_seconds == LIFETIME

    @property
    def output(self) -> str:
        if self.name:
            return self.name
        tail = f"_OFFSET_{self.offset}" if self.offset_seconds else ""
        return re.sub(r"\s+", "", f"{self.column}_{self.function}_{self.window}{tail}").upper()

    def alias(self, name: str) -> "Feature":
        return replace(self, name=name)

    def to_dict(self) -> dict:
        return {k: v for k, v in self.__dict__.items()}

    @classmethod
    def from_dict(cls, d: dict) -> "Feature":
        return cls(**d)

    sum = classmethod(lambda cls, column, window, offset="0s": cls("sum", column, window, offset))
    count = classmethod(lambda cls, column, window, offset="0s": cls("count", column, window, offset))
    avg = classmethod(lambda cls, column, window, offset="0s": cls("avg", column, window, offset))
    min = classmethod(lambda cls, column, window, offset="0s": cls("min", column, window, offset))
    max = classmethod(lambda cls, column, window, offset="0s": cls("max", column, window, offset))
    stddev = classmethod(lambda cls, column, window, offset="0s": cls("stddev", column, window, offset))
    var = classmethod(lambda cls, column, window, offset="0s": cls("var", column, window, offset))
    approx_count_distinct = classmethod(lambda cls, column, window, offset="0s", precision=12: cls("approx_count_distinct", column, window, offset, precision=precision))
    approx_percentile = classmethod(lambda cls, column, window, offset="0s", percentile=0.5: cls("approx_percentile", column, window, offset, percentile=percentile))
    last_n = classmethod(lambda cls, column, window, offset="0s", n=10: cls("last_n", column, window, offset, n=n))
    first_n = classmethod(lambda cls, column, window, offset="0s", n=10: cls("first_n", column, window, offset, n=n))
    last_distinct_n = classmethod(lambda cls, column, window, offset="0s", n=10: cls("last_distinct_n", column, window, offset, n=n))
    first_distinct_n = classmethod(lambda cls, column, window, offset="0s", n=10: cls("first_distinct_n", column, window, offset, n=n))


@dataclass(frozen=True)
class TileSpec:
    """How events become tiles: keys, time column, granularity, features, and optionally a secondary key, of which most_secondary at most are given (None: all)."""

    keys: tuple[str, ...]
    ts: str
    granularity: str
    features: tuple[Feature, ...] = field(default=())
    secondary_key: str | None = None
    continuous: bool = False
    most_secondary: int | None = MOST_SECONDARY

    def __post_init__(self) -> None:
        object.__setattr__(self, "keys", tuple(self.keys))
        object.__setattr__(self, "features", tuple(self.features))
        names = [f.output.lower() for f in self.features]
        if len(set(names)) != len(names):
            raise ValueError(f"features share a name: {sorted(names)}")
        if self.seconds < 60:
            raise ValueError("granularity must be a minute or more")
        if self.continuous and (bad := [f.output for f in self.features if f.function in LISTS or f.lifetime]):
            raise ValueError(f"not with continuous windows: {bad}")
        for f in self.features:
            if not f.lifetime and not self.continuous and (f.window_seconds % self.seconds or f.offset_seconds % self.seconds):
                raise ValueError(f"window and offset of {f.output} must be multiples of {self.granularity}")
        if self.secondary_key:
            if self.secondary_key in self.keys:
                raise ValueError("the secondary key is a join key")
            if bad := [f.output for f in self.features if f.function not in SIMPLE + SKETCHES or f.lifetime]:
                raise ValueError(f"not with a secondary key: {bad}")

    @property
    def seconds(self) -> int:
        return parse_interval(self.granularity)

    @property
    def unit_seconds(self) -> int:
        return UNITS[split_interval(self.granularity)[1]][0]

    @property
    def reach(self) -> int:
        """Seconds that the longest window looks back."""
        return max((_up(f.window_seconds, self.seconds) + f.offset_seconds for f in self.features if not f.lifetime), default=0)


def _up(a: int, g: int) -> int:
    return -(-a // g) * g


def _partials(f: Feature) -> dict[str, Column]:
    """Partial columns of a feature, by name; shared by features on the same column."""
    c, name = F.col(f.column), f.column
    match f.function:
        case "sum":
            return {f"_sum_{name}": F.sum(c)}
        case "count":
            return {f"_count_{name}": F.count(c)}
        case "avg":
            return {f"_sum_{name}": F.sum(c), f"_count_{name}": F.count(c)}
        case "min":
            return {f"_min_{name}": F.min(c)}
        case "max":
            return {f"_max_{name}": F.max(c)}
        case "stddev" | "var":
            x = c.cast("double")
            return {f"_sum_{name}": F.sum(c), f"_count_{name}": F.count(c), f"_squares_{name}": F.sum(x * x), f"_spread_{name}": F.var_pop(x) * F.count(c)}
        case "approx_count_distinct":
            return {f"_hll{f.precision}_{name}": F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), f.precision)}
        case "approx_percentile":
            return {f"_kll_{name}": F.kll_sketch_agg_double(c.cast("double")), f"_count_{name}": F.count(c)}
    return {}


def _list_name(f: Feature) -> str:
    return f"_{f.function}_{f.column}"


def _lists(spec: TileSpec) -> dict[str, tuple[Feature, int]]:
    """List partials by name, with the largest n that any feature asks for."""
    out: dict[str, tuple[Feature, int]] = {}
    for f in spec.features:
        if f.function in LISTS:
            name = _list_name(f)
            out[name] = (f, max(f.n, out[name][1] if name in out else 0))
    return out


def build_tiles(events: DataFrame, spec: TileSpec) -> DataFrame:
    """Partial aggregates by keys (and secondary key) and tile_start (seconds since 1970).

    Events without a time are left out. List partials keep the n newest or
    oldest values of a tile (null values never), cut by a ranked window before
    anything is gathered; ties of time go by value.
    """
    group = [*spec.keys, *([spec.secondary_key] if spec.secondary_key else []), _START]
    rows = events.where(F.col(spec.ts).isNotNull()).withColumn(_START, slice_start(F.col(spec.ts), spec.seconds))
    partials: dict[str, Column] = {}
    for f in spec.features:
        partials |= _partials(f)
    tiles = rows.groupBy(*group).agg(*[c.alias(n) for n, c in (partials or {"_count": F.count("*")}).items()])
    if lists := _lists(spec):
        kinds = dict(events.dtypes)
        one = {name: F.when(F.col(f.column).isNotNull(), F.array(F.struct(F.col(spec.ts).alias("at"), F.col(f.column).alias("value")))) for name, (f, _) in lists.items()}
        for found in _gathered(rows, group, [(name, f, n, one[name], kinds[f.column]) for name, (f, n) in lists.items()], kinds[spec.ts]):
            tiles = _join_null_safe(tiles, found, group)
    return tiles


def _gathered(rows: DataFrame, group: list[str], lists: Sequence[tuple[str, Feature, int, Column, str]], at: str) -> list[DataFrame]:
    """The n newest or oldest (at, value) of each group and list as arrays, a table for each type of values; of equal values one, where they are to be distinct.

    lists: name, feature, n, the row's own items as an array, and the values'
    type. The items of all lists of one type are laid out once with the list's
    number, ranked by one window of two orders, cut, and only then gathered.
    """
    out = []
    for kind in sorted({k for *_, k in lists}):
        mine = [x for x in lists if x[4] == kind]
        newest = [i for i, (_, f, *_) in enumerate(mine) if f.function.startswith("last")]
        once = [i for i, (_, f, *_) in enumerate(mine) if "distinct" in f.function]
        none = F.array().cast(f"array<struct<at:{at},value:{kind}>>")
        tagged = [_with_tag(F.coalesce(items, none), i) for i, (*_, items, _) in enumerate(mine)]
        laid = rows.select(*group, F.explode(F.flatten(F.array(*tagged))).alias("_e")).select(*group, F.col("_e.tag").alias("_tag"), F.col("_e.at").alias("_at"), F.col("_e.value").alias("_value"))
        if once:
            latest = F.when(F.col("_tag").isin(newest), F.max("_at")).otherwise(F.min("_at")).alias("_at")
            distinct = laid.where(F.col("_tag").isin(once)).groupBy(*group, "_tag", "_value").agg(latest).select(*laid.columns)
            laid = distinct.unionByName(laid.where(~F.col("_tag").isin(once))) if len(once) < len(mine) else distinct
        by = Window.partitionBy(*group, "_tag")
        most = reduce(lambda c, x: F.when(F.col("_tag") == x[0], x[1][2]).otherwise(c), enumerate(mine), F.lit(0))
        rank = lambda way: F.row_number().over(by.orderBy(way("_at"), way("_value")))
        place = rank(F.desc) if len(newest) == len(mine) else F.when(F.col("_tag").isin(newest), rank(F.desc)).otherwise(rank(F.asc)) if newest else rank(F.asc)
        ranked = laid.withColumn("_r", place).where(F.col("_r") <= most)
        item = F.struct(F.col("_at").alias("at"), F.col("_value").alias("value"))
        held = [F.collect_list(F.when(F.col("_tag") == i, item)) for i in range(len(mine))]
        out.append(ranked.groupBy(*group).agg(*[F.when(F.size(h) > 0, h).alias(name) for h, (name, *_) in zip(held, mine, strict=True)]))
    return out


def _with_tag(items: Column, tag: int) -> Column:
    return F.transform(items, lambda x: F.struct(F.lit(tag).alias("tag"), x["at"].alias("at"), x["value"].alias("value")))


def _join_null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    renamed = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return a.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def boundary(ts: Column, spec: TileSpec, aligned: bool = False) -> Column:
    """Boundary in seconds since 1970: the time cut to the granularity's unit; aligned: to the granularity itself."""
    return slice_start(ts, spec.seconds if aligned else spec.unit_seconds)


def merge_tiles(spine: DataFrame, tiles: DataFrame, spec: TileSpec, spine_ts: str, aligned: bool = False) -> DataFrame:
    """The spine with one column for each feature; repeated spine rows stay.

    Windows are computed once for each distinct (keys, boundary). Spine rows
    with a null key or time get the result of an empty window.
    """
    spine = spine.withColumn("_boundary", boundary(F.col(spine_ts), spec, aligned))
    points = spine.select(*spec.keys, "_boundary").distinct().dropna()
    out = spine
    windowed = [f for f in spec.features if not f.lifetime]
    forever = [f for f in spec.features if f.lifetime]
    if windowed:
        for merged in [_secondary(points, tiles, spec)] if spec.secondary_key else _windowed(points, tiles, spec, windowed):
            out = out.join(merged, [*spec.keys, "_boundary"], "left")
    if forever:
        out = _lifetime(out, tiles, spec, forever)
    blanks = {"sum": F.lit(0), "count": F.lit(0), "approx_count_distinct": F.lit(0)}
    for f in windowed:
        if spec.secondary_key:
            out = out.withColumn(f.output, F.coalesce(f.output, F.array().cast(dict(out.dtypes)[f.output])))
        elif f.function in blanks:
            out = out.withColumn(f.output, F.coalesce(f.output, blanks[f.function].cast(dict(out.dtypes)[f.output])))
    if spec.secondary_key:
        out = out.withColumn("secondary_keys", F.coalesce("secondary_keys", F.array().cast(dict(out.dtypes)["secondary_keys"])))
    names = [c for c in spine.columns if c != "_boundary"]
    return out.select(*names, *(["secondary_keys"] if spec.secondary_key else []), *[f.output for f in spec.features])


def _in_window(f: Feature, g: int) -> Column:
    start, b = F.col(_START), F.col("_boundary")
    return (start >= b - _up(f.window_seconds, g) - f.offset_seconds) & (start < b - f.offset_seconds)


def _met(points: DataFrame, tiles: DataFrame, spec: TileSpec) -> DataFrame:
    """Each point with the complete tiles that any window may need."""
    reach = max(spec.reach, spec.seconds)
    points = points.withColumn("_low", F.col("_boundary") - reach).withColumn("_high", F.col("_boundary") - spec.seconds + 1)
    return range_join_binned(points, tiles, spec.keys, _START, "_low", "_high", reach)


def _windowed(points: DataFrame, tiles: DataFrame, spec: TileSpec, features: list[Feature]) -> list[DataFrame]:
    """Values by (keys, boundary), in tables to be joined to the spine: long windows of exact sums meet no tiles but two, all other aggregates are one aggregation, lists are ranked together and cut before anything is gathered."""
    long = [f for f in features if _by_difference(f, tiles, spec)]
    features = [f for f in features if f not in long]
    point = [*spec.keys, "_boundary"]
    out = [_differences(points, tiles, spec, long)] if long else []
    if not features:
        return out
    met = _met(points, tiles, replace(spec, features=tuple(features)))
    inside = {f: _in_window(f, spec.seconds) for f in features}
    if plain := [f for f in features if f.function not in LISTS]:
        spreads = {f: f"_ref{i}" for i, f in enumerate(plain) if f.function in ("stddev", "var")}
        rows = met
        for f, name in spreads.items():
            rows = rows.withColumn(name, F.min(F.when(inside[f], _tile_mean(f.column))).over(Window.partitionBy(*point)))
        out.append(rows.groupBy(*point).agg(*[_merged(f, inside[f], ref=spreads.get(f)).alias(f.output) for f in plain]))
    if lists := [f for f in features if f.function in LISTS]:
        items = {f: tiles.schema[_list_name(f)].dataType.elementType for f in lists}
        asked = [(f.output, f, f.n, F.when(inside[f], F.col(_list_name(f))), items[f]["value"].dataType.simpleString()) for f in lists]
        for found in _gathered(met, point, asked, items[lists[0]]["at"].dataType.simpleString()):
            out.append(found.select(*point, *[F.transform(F.sort_array(c), lambda x: x["value"]).alias(c) for c in found.columns if c not in point]))  # oldest first
    return out


def _by_difference(f: Feature, tiles: DataFrame, spec: TileSpec) -> bool:
    """Whether a window is long and its sums are exact, so that it is the difference of two running sums."""
    if f.function not in ("sum", "count", "avg") or f.window_seconds // spec.seconds < LONG_WINDOW:
        return False
    kinds = dict(tiles.dtypes)
    return all(kinds[n] == "bigint" or kinds[n].startswith("decimal") for n in _partials(f))


def _differences(points: DataFrame, tiles: DataFrame, spec: TileSpec, features: list[Feature]) -> DataFrame:
    """Sums over the tiles of a window: up to its end less those up to its start, two as-of lookups for each point and window. Running sums have 38 digits, so only a window's own sum can be too large."""
    names, kinds = sorted({n for f in features for n in _partials(f)}), dict(tiles.dtypes)
    wide = {n: "decimal(38,0)" if kinds[n] == "bigint" else re.sub(r"\(\d+", "(38", kinds[n]) for n in names}
    sums = {f"_run{n}": (F.sum, F.col(n).cast(wide[n])) for n in names}
    running = running_by_key(tiles, spec.keys, _START, sums)
    # the last tile that starts before the window's end and is complete, and the last one before its start
    edges, b = {}, F.col("_boundary")
    for f in features:
        edges[f.offset_seconds, 0] = F.least(b - f.offset_seconds, b - spec.seconds + 1)
        edges[f.offset_seconds, _up(f.window_seconds, spec.seconds)] = b - _up(f.window_seconds, spec.seconds) - f.offset_seconds
    places = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(back).alias("w"), t.cast("long").alias("t")) for (o, back), t in edges.items()])).alias("_e")
    asked = points.select(*spec.keys, "_boundary", places).select(*spec.keys, "_boundary", F.col("_e.o").alias("_o"), F.col("_e.w").alias("_w"), F.col("_e.t").alias("_at"))
    found = asof_join(asked, running, spec.keys, "_at", _START, [f"_run{n}" for n in names], strict=True)

    def total(f: Feature, kind: str) -> Column:
        name = f"_{kind}_{f.column}"
        at = lambda back: F.coalesce(F.max(F.when((F.col("_o") == f.offset_seconds) & (F.col("_w") == back), F.col(f"_run{name}"))), F.lit(0).cast(wide[name]))
        return (at(0) - at(_up(f.window_seconds, spec.seconds))).cast(kinds[name] if kind == "count" or kinds[name] == "bigint" else wide[name])

    value = {"sum": lambda f: total(f, "sum"), "count": lambda f: total(f, "count"), "avg": lambda f: guarded_ratio(total(f, "sum"), total(f, "count"))}
    return found.groupBy(*spec.keys, "_boundary").agg(*[value[f.function](f).alias(f.output) for f in features])


def _tile_mean(column: str) -> Column:
    return guarded_ratio(F.col(f"_sum_{column}"), F.col(f"_count_{column}"))


def _shifted(column: str, ref: str) -> tuple[Column, Column]:
    """A tile's share of the sums of (x - ref) and (x - ref) squared."""
    off = _tile_mean(column) - F.col(ref)
    return F.col(f"_count_{column}") * off, F.col(f"_spread_{column}") + F.col(f"_count_{column}") * off * off


def _merged(f: Feature, inside: Column | None, zero: bool = True, ref: str | None = None) -> Column:
    """A feature's value from partials; ``inside`` says which tiles count (None: all). ref: a column near the values, from which spreads are taken."""
    pick = lambda name: F.col(name) if inside is None else F.when(inside, F.col(name))
    total = lambda kind: F.sum(pick(f"_{kind}_{f.column}"))
    match f.function:
        case "sum":
            return F.coalesce(total("sum"), F.lit(0)) if zero else total("sum")
        case "count":
            return F.coalesce(total("count"), F.lit(0))
        case "min":
            return F.min(pick(f"_min_{f.column}"))
        case "max":
            return F.max(pick(f"_max_{f.column}"))
        case "avg":
            return guarded_ratio(total("sum"), total("count"))
        case "stddev" | "var":
            near = [F.sum(x if inside is None else F.when(inside, x)) for x in _shifted(f.column, ref)]
            return _spread(f.function, total("sum"), total("count"), total("squares"), *near)
        case "approx_count_distinct":
            return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(pick(f"_hll{f.precision}_{f.column}"))), F.lit(0).cast("long"))
        case "approx_percentile":
            some = total("count") > 0
            return F.when(some, F.kll_sketch_get_quantile_double(F.kll_merge_agg_double(pick(f"_kll_{f.column}")), F.lit(f.percentile)))
    raise ValueError(f"{f.function} is not merged by an aggregate")


def _spread(function: str, s: Column, n: Column, squares: Column, off: Column, off_squares: Column) -> Column:
    """Variance or its root from sums. The sums of whole numbers are exact in any order and are taken where they lose few digits; else those of what is left after a value nearby was taken off."""
    mean = guarded_ratio(s, n)
    plain, near = guarded_ratio(squares, n) - mean * mean, guarded_ratio(off_squares - guarded_ratio(off * off, n), n)
    variance = F.when(n > 0, F.when(plain > mean * mean / 1000, plain).otherwise(F.greatest(near, F.lit(0.0))))
    return F.sqrt(variance) if function == "stddev" else variance


def _secondary(points: DataFrame, tiles: DataFrame, spec: TileSpec) -> DataFrame:
    """Aligned arrays of secondary keys and values: keys ascending, null last, the first most_secondary of them."""
    met = _met(points, tiles, spec)
    sk = spec.secondary_key
    inside = [_in_window(f, spec.seconds) for f in spec.features]
    some = inside[0]
    for c in inside[1:]:
        some = some | c
    rows, refs = met.where(some), {}
    for i, (f, c) in enumerate(zip(spec.features, inside, strict=True)):
        if f.function in ("stddev", "var"):
            refs[i] = f"_ref{i}"
            rows = rows.withColumn(refs[i], F.min(F.when(c, _tile_mean(f.column))).over(Window.partitionBy(*spec.keys, "_boundary", sk)))
    per_key = rows.groupBy(*spec.keys, "_boundary", sk).agg(*[_merged(f, c, zero=False, ref=refs.get(i)).alias(f.output) for i, (f, c) in enumerate(zip(spec.features, inside, strict=True))])
    w = Window.partitionBy(*spec.keys, "_boundary").orderBy(F.asc_nulls_last(sk))
    ranked = per_key.withColumn("_r", F.row_number().over(w))
    ranked = ranked if spec.most_secondary is None else ranked.where(F.col("_r") <= spec.most_secondary)
    rows = F.sort_array(F.collect_list(F.struct("_r", F.col(sk).alias("key"), *[f.output for f in spec.features])))
    gathered = ranked.groupBy(*spec.keys, "_boundary").agg(rows.alias("_rows"))
    pick = lambda name: F.transform("_rows", lambda r: r[name])
    return gathered.select(*spec.keys, "_boundary", pick("key").alias("secondary_keys"), *[pick(f.output).alias(f.output) for f in spec.features])


def accumulate(tiles: DataFrame, spec: TileSpec) -> DataFrame:
    """Tiles with running sums, minima and maxima over all tiles of a key so far, for lifetime features; spreads as running sums around a value of the key."""
    forever = [f for f in spec.features if f.lifetime]
    names = sorted({n for f in forever for n in _partials(f) if not n.startswith("_spread_")})
    kinds = {"_min_": F.min, "_max_": F.max}
    columns = {n: (kinds.get(n[:5], F.sum), F.col(n)) for n in names}
    if spreads := sorted({f.column for f in forever if f.function in ("stddev", "var")}):
        near = tiles.groupBy(*spec.keys).agg(*[F.min(_tile_mean(c)).alias(f"_ref_{c}") for c in spreads])
        tiles = _join_null_safe(tiles, near, spec.keys)
        for c in spreads:
            columns[f"_off_{c}"], columns[f"_offsq_{c}"] = ((F.sum, x) for x in _shifted(c, f"_ref_{c}"))
    return running_by_key(tiles, spec.keys, _START, columns)


def _lifetime(spine: DataFrame, tiles: DataFrame, spec: TileSpec, features: list[Feature]) -> DataFrame:
    """As-of lookup of the last complete tile: start + g <= boundary."""
    running = accumulate(tiles, spec).withColumn("_ready", F.col(_START) + spec.seconds)
    names = [c for c in running.columns if c.startswith("_") and c != "_ready"]
    met = asof_join(spine, running, spec.keys, "_boundary", "_ready", names, prefix="_life")
    for f in features:
        col = lambda kind: F.col(f"_life_{kind}_{f.column}")  # noqa: B023, E731
        match f.function:
            case "avg":
                value = guarded_ratio(col("sum"), col("count"))
            case "stddev" | "var":
                value = _spread(f.function, *[col(k) for k in ("sum", "count", "squares", "off", "offsq")])
            case kind:
                value = col(kind)
        met = met.withColumn(f.output, value)
    return met.drop(*["_life" + n for n in names])


def rollup_tiles(tiles: DataFrame, mapping: DataFrame, spec: TileSpec, keys: Sequence[str], valid_from: str | None = None, valid_to: str | None = None) -> DataFrame:
    """Tiles of a coarser entity: each tile goes to the mapped keys, partials are merged.

    With validity columns a tile goes to the mapping rows valid at its start
    (from <= start < to, a null end is open). Rows without a target key are
    left out. A list keeps the newest or oldest values over all children.
    """
    if valid_from:
        joined = validity_join(tiles.withColumn("_start_at", from_seconds(F.col(_START))), mapping, list(spec.keys), "_start_at", valid_from, valid_to)
    else:
        joined = tiles.join(mapping, list(spec.keys))
    for k in keys:
        joined = joined.where(F.col(k).isNotNull())
    group = [*keys, *([spec.secondary_key] if spec.secondary_key else []), _START]
    merged: dict[str, Column] = {}
    for c in sorted({f.column for f in spec.features if f.function in ("stddev", "var")}):
        joined = joined.withColumn(f"_ref_{c}", F.min(_tile_mean(c)).over(Window.partitionBy(*group)))
        off, squares = (F.sum(x) for x in _shifted(c, f"_ref_{c}"))
        merged[f"_spread_{c}"] = F.greatest(squares - F.coalesce(guarded_ratio(off * off, F.sum(f"_count_{c}")), F.lit(0.0)), F.lit(0.0))
    for f in spec.features:
        for name in _partials(f):
            if name.startswith("_hll"):
                merged[name] = F.hll_union_agg(name)
            elif name.startswith("_kll_"):
                merged[name] = F.kll_merge_agg_double(name)
            elif not name.startswith("_spread_"):
                merged[name] = {"_min_": F.min, "_max_": F.max}.get(name[:5], F.sum)(name)
    rolled = joined.groupBy(*group).agg(*[c.alias(n) for n, c in (merged or {"_count": F.count("*")}).items()])
    if lists := _lists(spec):
        items = {name: tiles.schema[name].dataType.elementType for name in lists}
        asked = [(name, f, n, F.col(name), items[name]["value"].dataType.simpleString()) for name, (f, n) in lists.items()]
        for found in _gathered(joined, group, asked, next(iter(items.values()))["at"].dataType.simpleString()):
            rolled = _join_null_safe(rolled, found, group)
    return rolled


def read_at(tiles: DataFrame, spec: TileSpec, now: Column, aligned: bool = False) -> DataFrame:
    """Current values: every key of the tiles at one time."""
    spine = tiles.select(*spec.keys).distinct().withColumn("as_of", now.cast("timestamp_ntz"))
    return merge_tiles(spine, tiles, spec, "as_of", aligned)


def tiled_features(events: DataFrame, spine: DataFrame, spec: TileSpec, spine_ts: str, aligned: bool = False) -> DataFrame:
    """Build tiles and merge them in one plan."""
    return merge_tiles(spine, build_tiles(events, spec), spec, spine_ts, aligned)


def continuous_features(events: DataFrame, spine: DataFrame, spec: TileSpec, spine_ts: str) -> DataFrame:
    """Exact windows at the spine's own time, (t - W - O, t - O], to the microsecond; for all functions but lists.

    Spine rows with a null key or time, or without events, get 0 for sums and
    counts and null for the rest. Repeated spine rows stay.
    """
    base = spine.withColumn("_t", micros_of(F.col(spine_ts)))
    points = base.select(*spec.keys, "_t").distinct().dropna()
    reach = max(spec.reach, 1) * 1_000_000
    rows = events.where(F.col(spec.ts).isNotNull()).withColumn("_at", micros_of(F.col(spec.ts)))
    met = range_join_binned(points.withColumn("_low", F.col("_t") - reach + 1).withColumn("_high", F.col("_t") + 1), rows, spec.keys, "_at", "_low", "_high", reach)
    out = []
    for f in spec.features:
        end = F.col("_t") - f.offset_seconds * 1_000_000
        inside = (F.col("_at") > end - f.window_seconds * 1_000_000) & (F.col("_at") <= end)
        out.append(_value(f, F.when(inside, F.col(f.column))).alias(f.output))
    merged = met.groupBy(*spec.keys, "_t").agg(*out)
    joined = base.join(merged, [*spec.keys, "_t"], "left")
    for f in spec.features:
        if f.function in ("sum", "count", "approx_count_distinct"):
            joined = joined.withColumn(f.output, F.coalesce(f.output, F.lit(0).cast(dict(joined.dtypes)[f.output])))
    return joined.select(*spine.columns, *[f.output for f in spec.features])


def _value(f: Feature, c: Column) -> Column:
    """A feature's value from single events."""
    match f.function:
        case "sum":
            return F.coalesce(F.sum(c), F.lit(0))
        case "count":
            return F.count(c)
        case "approx_count_distinct":
            return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), f.precision)), F.lit(0).cast("long"))
        case "approx_percentile":
            return F.when(F.count(c) > 0, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(c.cast("double")), F.lit(f.percentile)))
    return {"avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_pop, "var": F.var_pop}[f.function](c)
