"""Spelling variants, conversation repair and sharding against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest

from millrace.llm import repair, sharding, spelling

SF = "/root/testdata/sf0.001"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# --- spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(a[:i] == b[:i] and (a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]) for i in range(len(b)))


def expected_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in map(lower, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    return {w: c for w, c in n.items() if c >= 2}


def expected_variants(n, ratio=10):
    by_cut = defaultdict(set)
    for w in n:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_cut[v].add(w)
    near = defaultdict(set)
    for ws in by_cut.values():
        for a in ws:
            near[a] |= {b for b in ws if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(((-n[b], b) for b in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= ratio * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), None if form[w] is None else n[form[w]]) for w in n}


def test_variants_of_documents(spark):
    from millrace.llm.registry import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op11_spelling_variants"](spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = expected_variants(expected_words(rows))
    assert len(got) == len(want) and set(got) == want and any(g[1] for g in got)


@pytest.mark.parametrize("most", [4, 4096])
def test_variants_of_made_up_words(spark, most):
    rng = random.Random(most)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(0, 9))) for _ in range(700)} | {"a" * 40, "a" * 41, "b" + "a" * 40, "x" * 3000, "x" * 2999 + "y"}
    n = {w: rng.choice([2, 3, 20, 25, 200, 2500]) for w in sorted(words)}
    df = spark.createDataFrame([(w, c, "k") for w, c in n.items()] + [(None, 5, "k")], "word string, n long, key string")
    got = [tuple(r) for r in spelling.variants(df, spelling.Settings(shard_words=most)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(n) and set(got) == expected_variants(n)


def test_variants_of_odd_texts(spark):
    long = "q" * 5000
    rows = [(1, None), (2, ""), (None, "ABCDEFG abcdefg"), (3, "abcdefg"), (3, "abcdefg"), (4, f"{long} {long} {long}r"), (5, "short \U0001f600abcdefgh7abcdefgh"), (6, "Ünïcödé ünïcödé × ÷÷÷÷÷÷÷ ÷÷÷÷÷÷÷")]
    df = spark.createDataFrame([(i, t, "w", 0) for i, t in rows], "doc_id long, text string, word string, n int")
    got = spelling.variants(spelling.vocabulary(spelling.misspelt(spelling.runs(df))))
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == expected_variants(expected_words(rows))
    assert spelling.variants(spelling.vocabulary(spelling.misspelt(spelling.runs(df.limit(0))))).count() == 0


# --- conversations


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out[conv] += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return {c: sorted(v, key=lambda t: (t[0] is not None, t[0] or 0, *t[1:])) for c, v in out.items()}


def expected_repair(turns):
    """By trying all edits, memoised by place and the roles so far (nothing, s, u, a)."""
    blanks, seen, counts, faults = " \t\n\x0b\x0c\r", set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0), []
    for _, role, text in turns:
        body = text.strip(blanks)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        if fault:
            counts[fault] += 1
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, last, inserts):
        ways = []
        for r in "ua":
            if inserts and r in follows[last]:
                cost, audit, out = best(i, r, inserts - 1)
                ways.append((cost + 3, "I" + audit, (({"u": "user", "a": "assistant"}[r], ""), *out)))
        if i == len(turns):
            if last in ("", "a"):
                ways.append((0, "", ()))
        else:
            _, role, text = turns[i]
            cost, audit, out = best(i + 1, last, 2)
            ways.append((cost + 4, "D" + audit, out))
            if faults[i] in (None, "truncated"):
                more = 3 * (faults[i] == "truncated")
                for letter, new, paid in [("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)]:
                    if new[:1] and new[:1] in follows[last]:
                        cost, audit, out = best(i + 1, new[:1], 2)
                        ways.append((cost + paid + more, letter + audit, ((new, text), *out)))
        return min(ways, default=(10**9, "~", ()))

    cost, audit, out = best(0, "", 2)
    numbers = {t for t, *_ in turns if t is not None}
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()), out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check_repair(spark, rows, monkeypatch=None, **small):
    for k, v in small.items():
        monkeypatch.setattr(repair, k, v)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, stretch int, audit string")
    got = repair.repair(repair.damaged(df))
    want = {c: expected_repair(t) for c, t in damage(rows).items()}
    found = [tuple(r) for r in got.select(*COLUMNS).collect()]
    assert len(found) == len(want)
    assert {r[0]: r[1:] for r in found} == {c: w[0] for c, w in want.items()}
    turns = defaultdict(list)
    for r in repair.apply_repair(repair.damaged(df), got).orderBy("conv_id", "place").collect():
        turns[r["conv_id"]].append((r["role"], r["text"]))
    assert {c: tuple(t) for c, t in turns.items()} == {c: w[1] for c, w in want.items() if w[1]}


def test_repair_of_conversations(spark):
    from millrace.llm.registry import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, SF).select(*COLUMNS).collect()}
    assert got == {c: expected_repair(t)[0] for c, t in damage(rows).items()}


def made_up(rng, conv, n, gap=1):
    out, turn = [], rng.choice([0, -300, 5])
    for _ in range(n):
        turn += rng.choice([0, 1, 1, 1, gap])
        out.append((conv, None if rng.random() < 0.05 else turn, rng.choice(["user", "assistant", "assistant", "system", "tool", "", None, "User", "sam"]), rng.choice(["Yes.", "No!", "Why?", "so", "a b. \n", " \t", "", None, "é…", f"n{rng.random()}."])))
    return out


def test_repair_of_odd_conversations(spark):
    rng = random.Random(5)
    rows = [r for c in range(150) for r in made_up(rng, c if c else None, rng.randint(1, 9))]
    check_repair(spark, rows)


def test_repair_of_long_conversations(spark, monkeypatch):
    rng = random.Random(6)
    rows = [r for c in range(6) for r in made_up(rng, c, 60, gap=900)] + [(9, 3, "user", f"{i}.") for i in range(40)] + [(10, 1, "user", "z" * 200_000 + ".")] + made_up(rng, 11, 700)
    import sys

    sys.setrecursionlimit(20_000)
    check_repair(spark, rows, monkeypatch, MOST_TURNS=16, FAN=4)


def test_repair_of_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(repair.damaged(none)).count() == 0
    gone = next(t for t in range(100) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    check_repair(spark, [(1, gone, "user", "Hi."), (2, None, None, None)])


# --- shards


def check_shards(rows, got, shards, slack):
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((i is not None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, held = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        held[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(held.values()) - min([held[s] for s in range(shards)]) <= slack


def test_shards_of_documents(spark):
    from millrace.llm.registry import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_sharding"](spark, SF).collect()
    check_shards(rows, got, 24, max(len(t.encode()) for _, t in rows if t) + 8)


def test_shards_of_uneven_texts(spark):
    rng = random.Random(3)
    rows = [(i, "same text" * 20) for i in range(3000)] + [(7, "again" * 30)] * 900 + [(None, None)] * 50 + [(None, "")] * 50
    rows += [(i, "".join(rng.choice("abcä") for _ in range(rng.randint(0, 300)))) for i in range(4000, 6000)] + [(9999, "w" * 20_000)]
    df = spark.createDataFrame([(i, t, 5, "s", 1) for i, t in rows], "doc_id long, text string, size int, shard string, piece int").repartition(7)
    for settings in (sharding.Settings(shards=5), sharding.Settings(shards=24), sharding.Settings(shards=3, pieces_a_shard=2, draws=4)):
        got = sharding.shard_documents(df, settings).collect()
        total = sum(len((t or "").encode()) + 8 for _, t in rows)
        check_shards(rows, got, settings.shards, max(20_008, 0.05 * total / settings.shards) if settings.pieces_a_shard > 2 else total / 3)
        homes = defaultdict(set)
        for r in got:
            homes[r["text_crc32"]].add(r["shard"])
        whole = Counter(t or "" for _, t in rows)
        assert all(len(homes[zlib.crc32(t.encode())]) == 1 for t, n in whole.items() if n * (len(t.encode()) + 8) <= total / settings.shards / 2)


def test_shards_of_few_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    got = sharding.shard_documents(df).collect()
    check_shards([(1, "a"), (1, "a"), (None, None)], got, 24, 18)
    assert sharding.shard_documents(df.limit(0)).count() == 0
