"""Conversations repaired to the grammar (s?(ua)+)? at the least cost.

Each turn is kept (0), given the role user or assistant (3) or deleted (4);
empty turns of either role are inserted anywhere (3). Blank turns and turns
whose role and text came before must be deleted; a truncated turn that is not
costs 3 more. Of the cheapest ways the one with the least audit, a string of
the edits' initials, is taken.

A conversation is cut by turn numbers into stretches, which are hash-partitioned
and sorted. In a task, a batch of stretches goes through one recursive DuckDB
query: each recursion advances one turn of all of them and keeps, by grammar
state, the least cost and audit. A stretch that is a whole conversation begins
before any turn; others are worked out from every state, and the best ways
through neighbouring stretches are joined state by state. So a conversation of
any length is spread over tasks, up to the hash of its text, which has an order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice, product

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.base import give_back, narrow_batches, saved

#: What counts as a blank around and in texts.
BLANKS = " \t\n\x0b\x0c\r"
#: Turn numbers of a stretch; turns of one that are worked out together; turns of a batch.
STRETCH, MOST_TURNS, BATCH_TURNS = 256, 512, 8192
#: Stretches of a conversation that are joined in one go.
FAN = 1024
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: States: nothing yet, after system, after user, after assistant. What a state takes, and what a forced role leads to.
TAKES = {"n": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
FORCED = {"n": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}


def _steps() -> list[tuple[str, str, str, int, str]]:
    """(kind of turn, state before, state after, cost, audit), the best for each: kinds are the initials s, u, a, x (any other), behind t if truncated, or d for a turn that must go."""
    best: dict[tuple[str, str, str], tuple[int, str]] = {}
    for cut, initial, before, inserted in product(("", "t"), "suaxd", "nsua", (False, True)):
        state, paid, said = (FORCED[before], INSERT, "I") if inserted else (before, 0, "")
        more = TRUNCATED if cut else 0
        ways = [(state, DELETE, "D")]
        if initial != "d":
            ways.append((FORCED[state], REROLE + more, "R"))
            if initial in TAKES[state]:
                ways.append((TAKES[state][initial], more, "K"))
        for after, cost, letter in ways:
            key, way = ("d" if initial == "d" else cut + initial, before, after), (paid + cost, said + letter)
            best[key] = min(best.get(key, way), way)
    return [(*k, *v) for k, v in sorted(best.items())]


STEPS = _steps()

_RECURSION = """
    WITH RECURSIVE r AS (
        SELECT p, 0 AS i, f, f AS t, {'cost': 0::BIGINT, 'audit': ''} AS best FROM starts
        UNION ALL
        SELECT r.p, r.i + 1 AS i, r.f, s.t, min({'cost': r.best.cost + s.cost, 'audit': r.best.audit || s.audit}) AS best
        FROM r JOIN step s ON s.p = r.p AND s.i = r.i + 1 AND s.f = r.t GROUP BY r.p, r.i, r.f, s.t
    )
    SELECT r.p, r.f, r.t, r.best.cost AS cost, r.best.audit AS audit FROM r JOIN (SELECT p, max(i) AS i FROM starts GROUP BY p) e ON e.p = r.p AND e.i = r.i ORDER BY ALL"""

_PATHS = pa.list_(pa.struct([("f", pa.string()), ("t", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
_PATHS_SQL = "array<struct<f:string,t:string,cost:bigint,audit:string>>"
_COUNTS = ("turns", "blank", "duplicate", "truncated", "illegal")


class Recursion:
    """The recursive query over in-memory tables of one DuckDB connection with one thread."""

    def __init__(self) -> None:
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        self.con.execute("CREATE TABLE steps (kind VARCHAR, f VARCHAR, t VARCHAR, cost BIGINT, audit VARCHAR)")
        self.con.executemany("INSERT INTO steps VALUES (?, ?, ?, ?, ?)", STEPS)

    def of_turns(self, kinds: list[tuple[int, int, str]], starts: list[tuple[int, int, str]]) -> dict[int, list[tuple]]:
        """Best ways by piece. kinds: (piece, turn from 1, kind); starts: (piece, its turns, state)."""
        turns = _columns(kinds, ("p", "i", "kind"), (pa.int64(), pa.int64(), pa.string()))
        self.con.register("turns", turns)
        self.con.execute("CREATE OR REPLACE TEMP TABLE step AS SELECT p, i, f, t, cost, audit FROM turns JOIN steps USING (kind)")
        self.con.register("begun", _columns(starts, ("p", "i", "f"), (pa.int64(), pa.int64(), pa.string())))
        self.con.execute("CREATE OR REPLACE TEMP TABLE starts AS SELECT * FROM begun")
        out: dict[int, list[tuple]] = {}
        for p, *way in self.con.execute(_RECURSION).fetchall():
            out.setdefault(p, []).append(tuple(way))
        for name in ("turns", "begun"):
            self.con.unregister(name)
        return out


def _columns(rows: list[tuple], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=list(names))


def finished(ways: Iterable[tuple]) -> tuple[int, str]:
    """The best of the ways from nothing, with an assistant's turn inserted where one is due."""
    ends = [(cost, audit) if t in "na" else (cost + INSERT, audit + "I") for f, t, cost, audit in ways if f == "n" and t != "s"]
    return min(ends)


def repaired_turns(turns: Iterable[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what an audit leaves and adds, one at a time."""
    state, turns = "n", iter(turns)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(turns)
        if letter == "D":
            continue
        state = TAKES[state][role[:1]] if letter == "K" else FORCED[state]
        yield letter, role if letter == "K" else ROLES[state], text


def digest(turns: Iterable[tuple[str, str, str]]) -> str:
    h = hashlib.sha256()
    for n, (_, role, text) in enumerate(turns):
        h.update(("\n" * (n > 0) + role + ":" + text).encode())
    return h.hexdigest()


# --- rows of a table


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(" "))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, with one space for a null role or text; _here tells that a turn is still there."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"), F.lit(True).alias("_here"), F.lit(0).alias("_copy"))


def damaged(conversations: DataFrame) -> DataFrame:
    """turns_of after damage by crc32 of conv_id:turn modulo 20: 0 drops a turn, 1 empties its text, 2 takes out its stops, 3 repeats it, 4 makes it the user's. Dropped turns stay as rows that are not _here."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns_of(conversations).withColumn("_h", F.crc32(key) % 20)
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_h") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_h") != 0).alias("_here"), copies)


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation in ``turns`` (turns_of or damaged).

    Turns go by number, null first; turns of one number by role and text. A
    null conv_id is a conversation like any other. A conversation with no turn
    _here has zeros, an empty audit and the hash of the empty string. gaps are
    the numbers missing between the least and the largest one.
    """
    rows = narrow_batches(turns).withColumn("_stretch", F.floor(F.col("turn") / STRETCH)).withColumn("_mark", F.lit(None).cast("binary"))
    number, here = F.when(F.col("_here"), F.col("turn")), F.col("_here").cast("long")
    spans = saved(rows.groupBy("conv_id", "_stretch").agg(F.countDistinct(number).alias("n"), F.min(number).alias("low"), F.max(number).alias("high"), F.sum(here).alias("rows")), "repair-stretches")
    long = spans.where("rows > 0").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("rows").alias("rows")).where((F.col("n") > 1) | (F.col("rows") > MOST_TURNS)).select("conv_id")
    several, kind, rows = bool(long.head(1)), rows.schema["conv_id"].dataType.simpleString(), rows.where("_here")
    met = rows.unionByName(_marks(rows, spans, long)) if several else rows
    dealt = met.repartition("conv_id", "_stretch").sortWithinPartitions("conv_id", "_stretch", F.desc_nulls_last("_mark"), *_order())
    counts = ", ".join(f"{c} bigint" for c in _COUNTS)
    pieces = saved(dealt.select("conv_id", "_stretch", "role", "text", "_mark").mapInArrow(_worked_out(_arrow(rows)), f"conv_id {kind}, stretch bigint, part int, whole boolean, {counts}, first string, last string, paths {_PATHS_SQL}, sha string"), "repair-pieces")
    done = pieces.where("whole")
    if several:
        joined = saved(_joined(pieces.where("not whole")), "repair-joined")
        marks = joined.select("conv_id", F.col("paths")[0]["audit"].alias("audit"))
        hashes = _walked(_of(rows, long), marks, _hashes, f"conv_id {kind}, sha string")
        done = done.unionByName(_null_safe(joined.drop("sha"), hashes, "left"))
    way = F.col("paths")[0]
    blank = lambda c, v: F.coalesce(c, F.lit(v))
    gaps = spans.groupBy("conv_id").agg(F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("n"), F.lit(0)).cast("long").alias("gaps"))
    out = _null_safe(gaps, done.select("conv_id", *_COUNTS[1:], way["cost"].alias("cost"), way["audit"].alias("audit"), F.col("sha").alias("repaired_sha256")), "left")
    return out.select("conv_id", "gaps", *[blank(F.col(c), 0).cast("long").alias(c) for c in (*_COUNTS[1:], "cost")], blank(F.col("audit"), "").alias("audit"), blank(F.col("repaired_sha256"), hashlib.sha256().hexdigest()).alias("repaired_sha256"))


def apply_repair(turns: DataFrame, repaired: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv_id, place (from 0), edit, role, text; ``repaired`` is what repair gave for the same turns."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    return _walked(narrow_batches(turns).where("_here"), repaired.select("conv_id", "audit"), _turn_rows, f"conv_id {kind}, place bigint, edit string, role string, text string")


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("_copy")]


def _null_safe(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    right = b.withColumnRenamed("conv_id", "_conv")
    return a.join(right, F.col("conv_id").eqNullSafe(F.col("_conv")), how).drop("_conv")


def _of(rows: DataFrame, long: DataFrame) -> DataFrame:
    return _null_safe(rows, long, "left_semi")


def _digest_of() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))


def _marks(rows: DataFrame, spans: DataFrame, long: DataFrame) -> DataFrame:
    """Rows for the stretches of long conversations: one to say so, and one for each turn that an earlier stretch had already."""
    said = _of(spans.where("rows > 0"), long).select("conv_id", "_stretch", F.unhex(F.lit("")).alias("_mark"))
    order = F.coalesce("_stretch", F.lit(-(1 << 62)))  # null comes first
    turns = _of(rows, long).select("conv_id", "_stretch", _digest_of().alias("_mark")).distinct().withColumn("_o", order)
    first = turns.groupBy("conv_id", "_mark").agg(F.min("_o").alias("_first"), F.max("_o").alias("_last")).where("_first < _last").select(F.col("conv_id").alias("_c"), F.col("_mark").alias("_m"), "_first")
    again = turns.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_mark") == F.col("_m"))).where("_o > _first").select("conv_id", "_stretch", "_mark")
    marks = said.unionByName(again)
    return marks.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(True).alias("_here"), F.lit(0).alias("_copy"), "_stretch", "_mark")


# --- in tasks


class _Piece:
    """Turns of one stretch, and what is wrong with them."""

    def __init__(self, conv, stretch, part: int, marked: bool) -> None:
        self.conv, self.stretch, self.part, self.whole = conv, stretch, part, not marked
        self.turns: list[tuple[str, str]] = []
        self.kinds: list[str] = []
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.bytes = 0

    def add(self, role: str, text: str, repeated: bool) -> None:
        body, initial = text.rstrip(BLANKS), role[:1]
        kind = initial if initial and initial in "sua" else "x"
        fault = "blank" if not body else "duplicate" if repeated else "truncated" if body[-1] not in ".!?" else ""
        if fault:
            self.counts[fault] += 1
            kind = "t" + kind if fault == "truncated" else "d"
        self.counts["illegal"] += bool(self.turns) and not _legal(self.turns[-1][0], role)
        self.counts["turns"] += 1
        self.kinds.append(kind)
        self.turns.append((role, text if self.whole else ""))
        self.bytes += len(text)

    def row(self, ways: list[tuple]) -> tuple:
        sha = None
        if self.whole:
            cost, audit = finished(ways)
            ways, sha = [("n", "", cost, audit)], digest(repaired_turns(self.turns, audit))
        return (self.conv, self.stretch, self.part, self.whole, *self.counts.values(), self.turns[0][0][:1], self.turns[-1][0][:1], [dict(zip("f t cost audit".split(), w, strict=True)) for w in ways], sha)


def _legal(before: str, after: str) -> bool:
    return (before[:1], after[:1]) in (("s", "u"), ("u", "a"), ("a", "u"))


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[_Piece]:
    place, piece, marks, seen, number = None, None, set(), set(), 0
    for conv, stretch, role, text, mark in _rows_of(batches):
        if place != (conv, stretch):
            if piece:
                yield piece
            place, piece, marks, seen, number = (conv, stretch), None, set(), set(), 0
        if mark is not None:
            marks.add(bytes(mark))
            continue
        if piece and len(piece.turns) >= MOST_TURNS:
            yield piece
            piece, number = None, number + 1
        piece = piece or _Piece(conv, stretch, number, bool(marks))
        key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
        piece.add(role, text, key in seen or key in marks)
        seen.add(key)
    if piece:
        yield piece


def _worked_out(conv_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces from sorted turns: a batch of them at a time through the recursive query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recursion, held, turns, size = Recursion(), [], 0, 0
        for piece in _pieces(batches):
            held.append(piece)
            turns, size = turns + len(piece.turns), size + piece.bytes
            if turns >= BATCH_TURNS or size > 16 << 20:
                yield _batch(_solved(recursion, held), conv_type)
                held, turns, size = [], 0, 0
        if held:
            yield _batch(_solved(recursion, held), conv_type)
        give_back()

    return run


def _arrow(df: DataFrame) -> pa.DataType:
    return to_arrow_type(df.schema["conv_id"].dataType)


def _solved(recursion: Recursion, held: list[_Piece]) -> list[tuple]:
    kinds = [(p, i, kind) for p, piece in enumerate(held) for i, kind in enumerate(piece.kinds, 1)]
    starts = [(p, len(piece.kinds), f) for p, piece in enumerate(held) for f in ("n" if piece.whole else "nsua")]
    ways = recursion.of_turns(kinds, starts)
    return [piece.row(ways[p]) for p, piece in enumerate(held)]


def _batch(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "stretch", "part", "whole", *_COUNTS, "first", "last", "paths", "sha"]
    kinds = [conv_type, pa.int64(), pa.int32(), pa.bool_(), *[pa.int64()] * len(_COUNTS), pa.string(), pa.string(), _PATHS, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


# --- long conversations


def _joined(pieces: DataFrame) -> DataFrame:
    """One row for each long conversation, its pieces joined in order, FAN at a time and then those."""
    kind, conv_type = pieces.schema, _arrow(pieces)
    while True:
        most = pieces.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
        last = most <= FAN
        blocks = pieces.withColumn("_block", F.lit(0)) if last else _blocks(pieces)
        dealt = blocks.repartition("conv_id", "_block").sortWithinPartitions("conv_id", "_block", F.asc_nulls_first("stretch"), "part")
        pieces = dealt.select("_block", *kind.fieldNames()).mapInArrow(_folded(conv_type, last), kind)
        if last:
            return pieces
        pieces = saved(pieces, "repair-blocks")


def _blocks(pieces: DataFrame) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("stretch"), "part")
    places = pieces.select("conv_id", "stretch", "part", F.floor((F.row_number().over(w) - 1) / FAN).cast("int").alias("_block"))
    right = places.select(F.col("conv_id").alias("_c"), F.col("stretch").alias("_s"), F.col("part").alias("_p"), "_block")
    return pieces.join(right, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("stretch").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p"))).drop("_c", "_s", "_p")


def _folded(conv_type: pa.DataType, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out = None, None
        for block, conv, stretch, part, _, *rest in _rows_of(batches):
            counts, first, end, paths = rest[: len(_COUNTS)], *rest[len(_COUNTS) :][:3]
            ways = {(w["f"], w["t"]): (w["cost"], w["audit"]) for w in paths}
            if place != (conv, block):
                if place:
                    yield _batch([_block_row(out, last)], conv_type)
                place, out = (conv, block), [conv, stretch, part, counts, first, end, ways]
                continue
            out[3] = [a + b for a, b in zip(out[3], counts, strict=True)]
            out[3][_COUNTS.index("illegal")] += not _legal(out[5], first)
            out[5], out[6] = end, _product(out[6], ways, "n" if last else "nsua")
        if place:
            yield _batch([_block_row(out, last)], conv_type)

    return run


def _product(a: dict, b: dict, starts: str) -> dict:
    """The best way from state to state through two neighbouring pieces; audits are put together only where costs tie."""
    out = {}
    for f, t in product(starts, "nsua"):
        through = [(a[f, m][0] + b[m, t][0], m) for m in "nsua" if (f, m) in a and (m, t) in b]
        if through:
            least = min(through)[0]
            out[f, t] = least, min(a[f, m][1] + b[m, t][1] for cost, m in through if cost == least)
    return out


def _block_row(out: list, last: bool) -> tuple:
    conv, stretch, part, counts, first, end, ways = out
    ways = [(*k, *v) for k, v in ways.items()]
    if last:
        ways = [("n", "", *finished(ways))]
    return (conv, stretch, part, last, *counts, first, end, [dict(zip("f t cost audit".split(), w, strict=True)) for w in ways], None)


def _walked(rows: DataFrame, audits: DataFrame, out: Callable, schema: str) -> DataFrame:
    """Audits and the turns they are about, in order through ``out``: one conversation is a sorted stream in one task, a turn in memory at a time."""
    marks = audits.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("_copy"), F.col("audit").alias("_audit"))
    both = rows.select("conv_id", "turn", "role", "text", "_copy", F.lit(None).cast("string").alias("_audit")).unionByName(marks)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", F.desc_nulls_last("_audit"), *_order())
    conv_type = _arrow(rows)
    return dealt.select("conv_id", "role", "text", "_audit").mapInArrow(lambda batches: out(batches, conv_type), schema)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, its repaired turns one at a time)."""
    for (conv, audit), group in groupby(_with_audit(batches), key=lambda x: x[:2]):
        next(group)  # the audit's own row
        yield conv, repaired_turns(((role, text) for _, _, role, text in group), audit)


def _with_audit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    audit = ""
    for conv, role, text, mark in _rows_of(batches):
        audit = audit if mark is None else mark
        yield conv, audit, role, text


def _hashes(batches: Iterator[pa.RecordBatch], conv_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for conv, turns in _audited(batches):
        yield pa.RecordBatch.from_arrays([pa.array([conv], conv_type), pa.array([digest(turns)])], names=["conv_id", "sha"])


def _turn_rows(batches: Iterator[pa.RecordBatch], conv_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    rows = ((conv, place, *turn) for conv, turns in _audited(batches) for place, turn in enumerate(turns))
    kinds = (conv_type, pa.int64(), pa.string(), pa.string(), pa.string())
    while part := list(islice(rows, 1000)):
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in enumerate(kinds)], names=["conv_id", "place", "edit", "role", "text"])
