"""Secret scans with a randomness test battery, in DataFrame functions only.

Base patterns find assignments, access keys and long hexadecimal runs. Beyond
them, every long run of key characters is a candidate. Its encoding is
inferred from its alphabet, and three tests ask whether it could be drawn
uniformly from that alphabet: chi-squared uniformity of the counts, runs above
and below the alphabet's middle, and lag-1 serial correlation, combined into
one p-value by Bonferroni. Against that stands the hypothesis that it is
ordinary text: how likely text of this length is to look as even and to stay
inside the alphabet. Both hypotheses go through Benjamini-Hochberg's procedure
within classes of length and encoding. Discoveries are candidates for which it
rejects ordinary text and does not reject randomness.

The procedure needs how many candidates reach each level of evidence against
either hypothesis: a table of counts by class and level, of bounded size
whatever the input. Everything else happens within a document's row. Running
sums over a row's m matches take about m times the root of m steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import saved

#: Base patterns (Java syntax): fixed values. Letters of the assignment's keyword are matched in either case.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
#: Candidates: runs of key characters from LEAST_LENGTH on, with padding.
LEAST_LENGTH = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_LENGTH},}}={{0,2}}"

#: Encodings, the narrowest first: name, pattern of the run without padding, alphabet, chance that a character of ordinary text lies in it.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$|^[0-9A-F]+$", "0123456789abcdef", 0.35),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.0),
    ("base64", "^.*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 1.0),
)
#: Sums of squares and cubes of letter frequencies in ordinary text.
TEXT_SQUARES, TEXT_CUBES = 0.065, 0.0058
#: Levels of evidence: tenths of a decimal order, up to 40 orders.
LEVELS = 400
_CANDIDATE_TYPE = "struct<start:int,end:int,encoding:int,length_class:int,level:int,battery:int>"


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, within two per cent over its whole range."""
    a = F.abs(z)
    tail = F.exp(-a * a / 2) / (1.64 * a + F.sqrt(0.76 * a * a + 4))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """Matches of a pattern, and what lies between them (one more)."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _let(value: Column, body) -> Column:
    """The body with the value in a variable, so that it is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, plus, zero: Column) -> Column:
    """Running sums (by an associative ``plus``) of an array, in blocks of about the root of its size."""
    total = lambda a: F.aggregate(a, zero, plus)

    def blocked(v: Column, size: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda b: total(F.slice(v, b * size + 1, size)))
        before = lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))
        inside = lambda offsets: F.transform(v, lambda _, i: plus(F.get(offsets, F.floor(i / size).cast("int")), total(F.slice(v, i - i % size + 1, i % size + 1))))
        return _let(_let(blocks, before), inside)

    return F.when(F.size(values) > 0, _let(values, lambda v: _let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda size: blocked(v, size)))).otherwise(values)


def _placed(found: Column, gaps: Column) -> Column:
    """Structs of start, end (code points) and text of the matches."""

    def place(both: Column) -> Column:
        # a match starts where the last one did, behind its length and the gap between
        steps = F.transform(both["f"], lambda s, i: F.length(F.get(both["g"], i)) + F.when(i > 0, F.length(F.get(both["f"], i - 1))).otherwise(0))
        starts = _running(steps, lambda x, y: x + y, F.lit(0))
        return F.zip_with(starts, both["f"], lambda a, s: F.struct(a.alias("start"), (a + F.length(s)).alias("end"), s.alias("s")))

    return _let(F.struct(found.alias("f"), gaps.alias("g")), place)


def _spans(df: DataFrame, name: str, pattern: str, keep=None) -> DataFrame:
    """Add an array of spans. The gaps are only cut where something matched."""
    found, gaps = _matches(F.col("_text"), pattern)
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")
    df = df.withColumn("_found", found)
    df = df.withColumn("_gaps", F.when(F.size("_found") > 0, gaps))
    placed = F.when(F.size("_found") > 0, _placed(F.col("_found"), F.col("_gaps"))).otherwise(none)
    return df.withColumn(name, placed if keep is None else F.filter(placed, keep)).drop("_found", "_gaps")


def _outside(base: Column, candidates: Column) -> Column:
    """The candidates (sorted by start) that lie inside no base span: none that starts before reaches as far."""

    def merge(both: Column) -> Column:
        one = lambda tag: lambda x: F.struct(x["start"].alias("start"), F.lit(tag).alias("tag"), x["end"].alias("end"), (x if tag else F.lit(None).cast(_CANDIDATE_TYPE)).alias("c"))
        every = F.array_sort(F.concat(F.transform(both["b"], one(0)), F.transform(both["c"], one(1))))

        def cover(merged: Column) -> Column:
            reach = _running(F.transform(merged, lambda x: F.when(x["tag"] == 0, x["end"]).otherwise(-1)), lambda x, y: F.greatest(x, y), F.lit(-1))
            kept = F.filter(F.zip_with(merged, reach, lambda x, r: F.struct(x.alias("x"), r.alias("r"))), lambda p: (p["x"]["tag"] == 1) & (p["r"] < p["x"]["end"]))
            return F.transform(kept, lambda p: p["x"]["c"])

        return _let(every, cover)

    return F.when((F.size(base) > 0) & (F.size(candidates) > 0), _let(F.struct(base.alias("b"), candidates.alias("c")), merge)).otherwise(candidates)


def _tested(candidates: Column) -> Column:
    """Candidates with encoding, length, and levels of evidence against ordinary text and against randomness (the battery's)."""
    bare = F.transform(candidates, lambda c: F.struct(c["start"], c["end"], F.rtrim(c["s"], F.lit("=")).alias("s")))

    def encode(c: Column) -> Column:
        number = F.lit(len(ENCODINGS) - 1)
        for i in range(len(ENCODINGS) - 2, -1, -1):
            number = F.when(c["s"].rlike(ENCODINGS[i][1]), i).otherwise(number)
        return F.struct(c["start"], c["end"], c["s"], number.alias("e"))

    def measure(c: Column) -> Column:
        pick = lambda at: F.element_at(F.array(*[F.lit(e[at]) for e in ENCODINGS]), c["e"] + 1)
        s = F.when(c["e"] == 0, F.lower(c["s"])).otherwise(F.translate(c["s"], "-_", "+/"))
        chars = F.filter(F.split(s, ""), lambda x: x != "")
        return F.struct(c["start"], c["end"], c["e"], s.alias("s"), pick(2).alias("alphabet"), pick(3).alias("inside"), chars.alias("chars"))

    def count(c: Column) -> Column:
        n = F.length(c["s"]).cast("double")
        squares = F.aggregate(F.array_distinct(c["chars"]), F.lit(0.0), lambda a, ch: a + F.pow(F.length(c["s"]) - F.length(F.replace(c["s"], ch, F.lit(""))), F.lit(2)))
        places = F.transform(c["chars"], lambda ch: F.instr(c["alphabet"], ch).cast("double"))
        return F.struct(c["start"], c["end"], c["e"], c["inside"], F.length(c["alphabet"]).cast("double").alias("k"), n.alias("n"), squares.alias("squares"), places.alias("x"))

    def sums(c: Column) -> Column:
        x, k = c["x"], c["k"]
        plus = lambda a, b: a + b
        size = F.size(x)
        pairs = F.zip_with(F.slice(x, F.lit(1), size - 1), F.slice(x, F.lit(2), size - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        high = F.aggregate(x, F.lit(0.0), lambda a, b: a + F.when(b > k / 2, 1.0).otherwise(0.0))
        runs = F.aggregate(pairs, F.lit(1.0), lambda a, p: a + F.when((p["a"] > k / 2) != (p["b"] > k / 2), 1.0).otherwise(0.0))
        lagged = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["a"] * p["b"])
        fields = {"mean": F.aggregate(x, F.lit(0.0), plus) / c["n"], "square": F.aggregate(x, F.lit(0.0), lambda a, b: a + b * b), "ends": F.element_at(x, 1) + F.element_at(x, -1), "high": high, "runs": runs, "lagged": lagged}
        return F.struct(c["start"], c["end"], c["e"], c["inside"], k.alias("k"), c["n"].alias("n"), c["squares"].alias("squares"), *[v.alias(f) for f, v in fields.items()])

    def test(c: Column) -> Column:
        k, n = c["k"], c["n"]
        chi = k * c["squares"] / n - n
        # Wilson and Hilferty: the cube root of chi-squared over its degrees of freedom is nearly normal
        z_chi = (F.cbrt(F.greatest(chi, F.lit(0.0)) / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1)))
        low = n - c["high"]
        middle = 2 * c["high"] * low / n + 1
        spread = (middle - 1) * (middle - 2) / (n - 1)
        z_runs = F.when(spread > 0, (c["runs"] - middle) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(F.lit(99.0))
        around = c["square"] - n * c["mean"] * c["mean"]
        together = c["lagged"] - c["mean"] * (2 * n * c["mean"] - c["ends"]) + (n - 1) * c["mean"] * c["mean"]
        z_serial = F.when(around > 1e-9, (together / F.greatest(around, F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
        least = F.least(*[_upper_tail(F.abs(z)) for z in (z_chi, z_runs, z_serial)])
        text_mean = k * (1 + (n - 1) * TEXT_SQUARES) - n
        text_var = F.pow(k / n, F.lit(2)) * (2 * n * (n - 1) * (TEXT_SQUARES - TEXT_SQUARES**2) + 4 * n * (n - 1) * (n - 2) * (TEXT_CUBES - TEXT_SQUARES**2))
        p_text = _upper_tail((text_mean - chi) / F.sqrt(text_var))
        of = lambda evidence: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(LEVELS / 10), evidence)) * 10).cast("int")
        level = of(-F.log10(F.greatest(p_text, F.lit(1e-40))) - n * F.log10(c["inside"]))
        battery = of(-F.log10(F.greatest(F.least(F.lit(1.0), 6 * least), F.lit(1e-40))))
        length_class = F.least(F.floor(F.log2(n / LEAST_LENGTH) * 2), F.lit(7)).cast("int")
        return F.struct(c["start"], c["end"], c["e"].alias("encoding"), length_class.alias("length_class"), level.alias("level"), battery.alias("battery"))

    out = bare
    for step in (encode, measure, count, sums, test):
        out = F.transform(F.filter(out, lambda c: F.length(c["s"]) >= LEAST_LENGTH) if step is encode else out, step)
    return out


def _thresholds(scanned: DataFrame, rate: float) -> dict[tuple[str, int, int], int]:
    """For each hypothesis and class of encoding and length the least level that Benjamini-Hochberg rejects; at most 48 classes of 401 levels."""
    both = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"c.{kind}").alias("level")) for kind in ("level", "battery")])).alias("e")
    one = scanned.select(F.explode("candidates").alias("c")).select("c.encoding", "c.length_class", both).groupBy("e.kind", "encoding", "length_class", "e.level").count()
    counts: dict[tuple[str, int, int], dict[int, int]] = {}
    for r in one.collect():
        counts.setdefault((r["kind"], r["encoding"], r["length_class"]), {})[r["level"]] = r["count"]
    return {key: least for key, levels in counts.items() if (least := rejected(levels, rate)) is not None}


def rejected(levels: dict[int, int], rate: float) -> int | None:
    """The least level at which the expected share of false rejections is at most ``rate``, from the numbers at each level."""
    total, reached, out = sum(levels.values()), 0, None
    for level in sorted(levels, reverse=True):
        reached += levels[level]
        if 10 ** (-level / 10) * total <= rate * reached:
            out = level
    return out


def scan_secrets(docs: DataFrame, rate: float = 0.01, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random and found.

    found is the array of all spans (start, kind number, kind, end) by start,
    then kind; spans joins them as kind:start:end. Positions count code
    points. Random spans that lie inside a base span are left out. rate: the
    false-discovery rate of both hypotheses. A null or empty text has no
    spans. Repeated rows stay, null ids stay null; other columns are
    not read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    return _scanned(rows, "doc_id", rate)


def redact(docs: DataFrame, mark: str = "[secret]", rate: float = 0.01, text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """All rows and columns, with each found span (overlapping ones as one) replaced by ``mark``.

    Where the text changes, the length column follows if there is one; all
    else stays as it is, null texts included.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    rows = _scanned(rows, "_row", rate)
    text = F.coalesce(F.col("_row")[text_column], F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        """Copy what lies before the span; a span that begins inside the last one adds nothing but its end."""
        fresh = s["start"] >= acc["at"]
        piece = F.when(fresh, F.concat(text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    new = F.aggregate("found", start, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    changed = F.size("found") > 0
    rows = rows.withColumn("_new", F.when(changed, new))
    columns = []
    for name, kind in docs.dtypes:
        value = F.col("_row")[name]
        if name == text_column:
            value = F.when(changed, F.col("_new")).otherwise(value)
        elif name == length_column:
            value = F.when(changed, F.length("_new")).otherwise(value).cast(kind)
        columns.append(value.alias(name))
    return rows.select(*columns)


def _scanned(rows: DataFrame, carry: str, rate: float) -> DataFrame:
    """Scan the column _text; the carried column comes first in the result."""
    rows = _spans(rows, "assign", ASSIGN, lambda s: F.length(F.regexp_extract(s["s"], f"^{ASSIGN}$", 1)) >= 8)
    rows = _spans(rows, "access", ACCESS, lambda s: s["end"] - s["start"] >= 16)
    rows = _spans(rows, "hex", HEX)
    rows = _spans(rows, "_runs", CANDIDATE)
    base = F.concat(*[_named(F.col(kind), k) for k, kind in enumerate(KINDS[:3])])
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    rows = rows.select(carry, *counts, F.array_sort(base).alias("base"), _tested(F.col("_runs")).cast(f"array<{_CANDIDATE_TYPE}>").alias("candidates"))
    rows = saved(rows, "secrets")
    return _with_found(rows, _rule(rows, rate), carry)


def _named(spans: Column, k: int) -> Column:
    """Spans as structs of start, kind number, kind and end."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), F.lit(KINDS[k]).alias("kind"), s["end"].alias("end")))


def _rule(rows: DataFrame, rate: float):
    limits = _thresholds(rows, rate)

    def passed(c: Column) -> Column:
        def reaches(kind: str) -> Column:
            out = F.lit(False)
            for (k, encoding, length_class), level in sorted(limits.items()):
                if k == kind:
                    out = F.when((c["encoding"] == encoding) & (c["length_class"] == length_class), c[kind] >= level).otherwise(out)
            return out

        return reaches("level") & ~reaches("battery")

    return passed


def _with_found(rows: DataFrame, passed, carry: str) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    rows = rows.withColumn("_kept", _outside(F.col("base"), F.filter("candidates", passed))).withColumn("found", F.array_sort(F.concat("base", _named(F.col("_kept"), 3))))
    return rows.select(carry, *[f"n_{kind}" for kind in KINDS[:3]], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), F.size("_kept").cast("long").alias("n_random"), "found")
