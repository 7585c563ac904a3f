"""License scans: one Aho-Corasick pass for tags and phrases, and licence expressions.

A text is brought to its words (one pass over its bytes), and an automaton
over them finds all notice phrases and the identifier tag at once. Where there
is a tag, an automaton over the bytes gives its places. Behind a tag, a
shunting-yard parser reads the expression with AND, OR, WITH and brackets;
operators bind as WITH, then AND, then OR. Only identifiers of the public list
are operands, and only its exceptions stand behind WITH. An expression is evaluated to the terms it sets: of both sides of
AND the stricter, of OR the milder ones.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import narrow_batches, slices

SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, terms string"

#: Base phrases and their labels: fixed values.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Opening, closing and naming phrases of common licence texts, with label and weight: fixed values, more telling ones weigh more.
NOTICE_PHRASES = {
    "affero general public license": ("agpl", 0.8),
    "all rights reserved": ("proprietary", 0.3),
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": ("zlib", 0.95),
    "anyone is free to copy modify publish use compile sell or distribute this software": ("unlicense", 0.9),
    "artistic license 2 0": ("artistic", 0.9),
    "boost software license version 1 0": ("bsl", 0.95),
    "bsd license": ("bsd", 0.6),
    "bsd 2 clause": ("bsd", 0.8),
    "bsd 3 clause": ("bsd", 0.8),
    "cc0 1 0 universal": ("cc", 0.95),
    "common development and distribution license": ("cddl", 0.9),
    "creative commons": ("cc", 0.5),
    "creative commons attribution": ("cc", 0.8),
    "do what the fuck you want to public license": ("wtfpl", 0.95),
    "eclipse public license": ("epl", 0.7),
    "european union public licence": ("eupl", 0.9),
    "everyone is permitted to copy and distribute verbatim copies of this license document": ("gpl", 0.8),
    "gnu free documentation license": ("gfdl", 0.9),
    "gnu general public license": ("gpl", 0.8),
    "lesser general public license": ("lgpl", 0.8),
    "licensed under the apache license version 2 0": ("apache", 0.95),
    "licensed under the mit license": ("mit", 0.9),
    "mozilla public license": ("mpl", 0.7),
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": ("bsd", 0.95),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "permission to use copy modify and or distribute this software": ("isc", 0.9),
    "python software foundation license": ("psf", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "redistributions of source code must retain the above copyright notice": ("bsd", 0.7),
    "server side public license": ("sspl", 0.9),
    "sil open font license": ("ofl", 0.9),
    "terms and conditions for use reproduction and distribution": ("apache", 0.7),
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": ("mit", 0.9),
    "the postgresql license": ("postgresql", 0.9),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.95),
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": ("lgpl", 0.95),
    "this program and the accompanying materials are made available under the terms of the eclipse public license": ("epl", 0.95),
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": ("gpl", 0.95),
    "this source code form is subject to the terms of the mozilla public license": ("mpl", 0.95),
    "this work is licensed under a creative commons": ("cc", 0.9),
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": ("apache", 0.8),
}
BASE_WEIGHT, TAG_WEIGHT = 0.6, 1.0
TAG = "spdx license identifier"
_TAG_BYTES = "spdx-license-identifier:"

#: What the names of a family begin with on the public list of identifiers (without regard to case), by label: fixed values. Which names there are is for the list to say.
FAMILIES = {
    "afl": "AFL", "agpl": "AGPL", "apache": "Apache", "apsl": "APSL", "artistic": "Artistic", "blueoak": "BlueOak", "bsd": "0BSD BSD", "bsl": "BSL", "cc": "CC CC0", "cddl": "CDDL", "cecill": "CECILL", "cpl": "CPL", "curl": "curl",
    "ecl": "ECL", "epl": "EPL", "eupl": "EUPL", "gfdl": "GFDL", "gpl": "GPL", "ijg": "IJG", "ipl": "IPL", "isc": "ISC", "lgpl": "LGPL", "libpng": "Libpng", "lppl": "LPPL", "mit": "MIT", "mpl": "MPL", "ms": "MS", "ncsa": "NCSA", "odbl": "ODbL",
    "ofl": "OFL", "openssl": "OpenSSL", "osl": "OSL", "php": "PHP", "postgresql": "PostgreSQL", "psf": "PSF Python", "qpl": "QPL", "ruby": "Ruby", "sleepycat": "Sleepycat", "sspl": "SSPL", "unicode": "Unicode", "unlicense": "Unlicense", "upl": "UPL",
    "vim": "Vim", "w3c": "W3C", "wtfpl": "WTFPL", "x11": "X11", "zlib": "Zlib", "zpl": "ZPL", "custom": "LicenseRef",
}
#: Terms from the mildest to the strictest, and the labels that set them; all other labels are unknown.
TERMS = ("permissive", "weak copyleft", "strong copyleft", "restricted", "unknown")
LABEL_TERMS = {
    **dict.fromkeys("afl apache artistic blueoak bsd bsl curl ecl ijg isc libpng lppl mit ncsa openssl php postgresql psf ruby unicode unlicense upl vim w3c wtfpl x11 zlib zpl ofl".split(), 0),
    **dict.fromkeys("apsl cddl cpl epl eupl ipl lgpl mpl ms".split(), 1),
    **dict.fromkeys("agpl cecill gfdl gpl odbl osl qpl sleepycat".split(), 2),
    **dict.fromkeys("sspl proprietary".split(), 3),
}

_LABELS = {name.lower(): label for label, names in FAMILIES.items() for name in names.split()}
_PART = re.compile(r"\(|\)|[A-Za-z0-9.+_:-]+")

#: Bytes of words keep, with A-Z lowered; all others become a space.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


@functools.lru_cache(maxsize=1)
def automaton():
    """All phrases with a space at either end, so that only whole words match."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICE_PHRASES, TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


@functools.lru_cache(maxsize=1)
def tags():
    """The tag as it stands in a text, A-Z lowered."""
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word(_TAG_BYTES, 0)
    a.make_automaton()
    return a


def tagged_lines(text: str) -> Iterator[str]:
    """What follows each tag on its line."""
    data = text.encode("utf-8", "surrogatepass")
    for end, _ in tags().iter(data.lower().decode("latin-1")):  # bytes.lower() touches A-Z only
        stop = min((at for at in (data.find(b"\n", end), data.find(b"\r", end)) if at >= 0), default=len(data))
        yield data[end + 1 : stop].decode("utf-8", "replace")


@dataclass
class Scan:
    """What one text shows."""

    n_words: int = 0
    base: list[tuple[int, str]] = field(default_factory=list)
    labels: set[str] = field(default_factory=set)
    expressions: list[str] = field(default_factory=list)
    doubt: float = 1.0
    strictest: int = -1

    @property
    def score(self) -> float:
        return round(1 - self.doubt, 6)

    @property
    def terms(self) -> str:
        return TERMS[self.strictest] if self.strictest >= 0 else ""

    def see(self, label: str, weight: float) -> None:
        self.labels.add(label)
        self.doubt *= 1 - weight
        self.strictest = max(self.strictest, LABEL_TERMS.get(label, len(TERMS) - 1))


def scan_text(text: str | None) -> Scan:
    """Phrases by words, then expressions behind tags."""
    found = words(text)
    out = Scan(len(found))
    if not found:
        return out
    line = (b" " + b" ".join(found) + b" ").decode("latin-1")
    tagged, seen = False, set()
    last_end = last_words = 0
    for end, phrase in automaton().iter(line):
        start = end - len(phrase) - 1
        if phrase == TAG:
            tagged = True
        if phrase in BASE_PHRASES:
            last_words += line.count(" ", last_end, start)  # spaces before the phrase's first word, less its own
            last_end = start
            out.base.append((last_words, phrase))
        seen.add(phrase)
    for phrase in sorted(seen):
        if phrase in BASE_PHRASES:
            out.see(BASE_PHRASES[phrase], BASE_WEIGHT)
        if phrase in NOTICE_PHRASES:
            out.see(*NOTICE_PHRASES[phrase])
    strictest = out.strictest
    if tagged:
        for line in tagged_lines(text):
            tree = parse_expression(line)
            if tree is not None:
                out.expressions.append(show(tree))
                for label in families(tree):
                    out.see(label, TAG_WEIGHT)
                strictest = max(strictest, evaluated(tree))  # an expression sets its own terms, not those of each label
    out.strictest = strictest
    return out


# --- licence expressions ------------------------------------------------------------------------------------

_BINDS = {"OR": 1, "AND": 2, "WITH": 3}


@functools.lru_cache(maxsize=1 << 14)
def _listed(expression: str) -> str | None:
    """An identifier, or one WITH an exception, as the public list writes it; None if it is not on that list. The list is that of the packaging library; names of one's own begin with LicenseRef-."""
    from packaging.licenses import InvalidLicenseExpression, canonicalize_license_expression

    try:
        return canonicalize_license_expression(expression)
    except InvalidLicenseExpression:
        return None


def label_of(identifier: str) -> str | None:
    """The label of a listed identifier: that of its family, else its own name in lower case. None for any other word."""
    if identifier.upper() in _BINDS or not identifier.strip("()"):
        return None
    name = _listed(identifier)
    return None if name is None else _LABELS.get(name.rstrip("+").split("-")[0].lower(), name.lower())


def is_exception(name: str) -> bool:
    """Whether a word is a listed exception."""
    return name.upper() not in _BINDS and _listed(f"GPL-2.0-only WITH {name}") is not None


def parse_expression(text: str):
    """The longest well-formed expression at the start of ``text``, as nested (operator, left, right) or an identifier; None if there is none.

    Shunting yard: identifiers go to the output, operators wait on a stack
    until one that binds less or a bracket comes. A word that is no known
    identifier (behind WITH: no exception) ends the expression.
    """
    parts, depth, whole, operand_next, last = _PART.findall(text), 0, 0, True, ""
    for i, part in enumerate(parts):  # one pass finds where the last complete expression ends
        joins, closes = part.upper() in _BINDS, part == ")"
        if operand_next == (joins or closes) or closes and not depth:
            break
        if part.upper() == "WITH" and not label_of(parts[i - 1]):  # it stands behind an identifier only
            break
        if last == "WITH" and not is_exception(part) or last != "WITH" and not joins and part not in "()" and not label_of(part):
            break
        depth += (part == "(") - closes
        operand_next = joins or part == "("
        last = part.upper()
        if not operand_next and not depth:
            whole = i + 1
    return _yard(parts[:whole]) if whole else None


def _yard(parts: list[str]):
    output: list = []
    waiting: list[str] = []
    operand_next = True

    def reduce() -> None:
        right, left = output.pop(), output.pop()
        output.append((waiting.pop(), left, right))

    for part in parts:
        upper = part.upper()
        if upper in _BINDS:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[upper]:
                reduce()
            waiting.append(upper)
            operand_next = True
        elif part == "(":
            if not operand_next:
                return None
            waiting.append(part)
        elif part == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(":
                reduce()
            if not waiting:
                return None
            waiting.pop()
        else:
            if not operand_next:
                return None
            output.append(part)
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    while waiting:
        reduce()
    return output[0] if len(output) == 1 else None


def show(tree) -> str:
    if isinstance(tree, str):
        return tree
    return f"({show(tree[1])} {tree[0]} {show(tree[2])})"


def families(tree) -> set[str]:
    """Labels of the known licences in an expression; an exception behind WITH is none."""
    if isinstance(tree, str):
        return {label} if (label := label_of(tree)) else set()
    return families(tree[1]) | (set() if tree[0] == "WITH" else families(tree[2]))


def evaluated(tree) -> int:
    """The terms that an expression sets, as a place in TERMS: of AND the stricter, of OR the milder side; an exception weakens strong copyleft."""
    if isinstance(tree, str):
        return LABEL_TERMS.get(label_of(tree), len(TERMS) - 1)
    if tree[0] == "WITH":
        left = evaluated(tree[1])
        return 1 if left == 2 else left
    return (max if tree[0] == "AND" else min)(evaluated(tree[1]), evaluated(tree[2]))


def allowed(tree, accepted: set[str]) -> bool:
    """Whether the expression can be met with the accepted labels: both sides of AND, either side of OR."""
    if isinstance(tree, str):
        return label_of(tree) in accepted
    if tree[0] == "WITH":
        return allowed(tree[1], accepted)
    sides = (allowed(tree[1], accepted), allowed(tree[2], accepted))
    return all(sides) if tree[0] == "AND" else any(sides)


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document (see ``SCAN``).

    n_base counts the places of base phrases, first_word and last_word are
    their smallest and largest start; labels holds base_labels and what
    notices and expressions add; score is 1 less the product of the doubts
    that the findings leave; terms are the strictest that a phrase or an
    expression sets (empty without any). A null or empty text has no words, no labels
    (empty strings) and score 0. An empty table gives no rows. Repeated rows stay, a null id stays null,
    other columns are not read. Nothing is shuffled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = scan_text(text)
                at = [w for w, _ in s.base]
                rows.append((doc_id, s.n_words, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({BASE_PHRASES[p] for _, p in s.base})), ",".join(sorted(s.labels)), s.score, "; ".join(s.expressions), s.terms))
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.string()]
            names = [c.split()[0] for c in SCAN.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return narrow_batches(docs).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(scan, SCAN)
