"""Token ids of whole texts, with a bounded cache of units."""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units in a generation of a Python worker's cache (two take up to 250 MB), and the longest unit that is kept.
CACHE_UNITS, CACHE_CHARS = 500_000, 64
#: Characters of a text that are encoded at once; longer texts are cut between units.
SEGMENT = 1 << 22

#: Before a blank that stands before anything but white space.
_CUT = re.compile(r"(?= \S)")
_MARKS = ",.;:!?\n"
#: Below this character, letters are letters to any version of Unicode.
_LATIN = "\u0250"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def encoder(path: str, units: int = CACHE_UNITS) -> "UnitEncoder":
    """One encoder for each Python worker, vocabulary file and size of the cache."""
    return UnitEncoder(path, units)


class Kept(dict):
    """A dict whose oldest entries go: what is asked for moves from the old generation to the young one, which turns old when it is full."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.old = most, {}

    def missing(self, keys: set[str]) -> set[str]:
        """The keys that neither generation has."""
        away = keys - self.keys()
        known = away & self.old.keys()
        self.update((k, self.old[k]) for k in known)
        return away - known

    def age(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class UnitEncoder:
    """Ids of texts by the tokenizers library, each distinct unit encoded once while the cache holds it.

    A byte-level BPE splits a text by a fixed pattern and merges within the
    pieces only. A piece ends before each blank that is followed by something
    else than white space, whatever stands before it. So a text is cut there
    into units, each distinct unit of a batch is looked up once, and only
    unknown ones go to the library: Latin words, which are one piece, straight
    to its model, others through all its steps. Texts that hold the string of
    an added token go to the library whole, and so do all texts where the file
    asks for anything but this splitter.
    """

    def __init__(self, path: str, units: int = CACHE_UNITS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model, by_byte = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {c: by_byte.pre_tokenize_str(chr(c))[0][0] for c in range(ord(_LATIN))}  # each character as the model's vocabulary has its bytes
        splitter = self.tokenizer.pre_tokenizer
        plain = isinstance(splitter, pre_tokenizers.ByteLevel) and splitter.use_regex and not splitter.add_prefix_space
        self.by_units = plain and self.tokenizer.normalizer is None and isinstance(self.model, models.BPE)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.marks = dict(zip(_MARKS, self._library(list(_MARKS)), strict=True))
        self.units, self.long = Kept(units), []

    def encode(self, texts: Iterable[str | None] | pa.Array) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; null counts as empty."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string())).fill_null("")
        if not self.by_units:
            return self._library(texts.to_pylist())
        apart = np.zeros(len(texts), bool)
        for token in self.added:
            apart |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        long = ~apart & (pc.utf8_length(texts).to_numpy() > SEGMENT)
        found: list[bytes | None] = [None] * len(texts)
        for i in np.flatnonzero(apart).tolist():
            found[i] = self._library([texts[i].as_py()])[0]
        for i in np.flatnonzero(long).tolist():
            found[i] = b"".join(b for part in _segments(texts[i].as_py()) for b in self._batch(pa.array([part], pa.string())))
        rest = np.flatnonzero(~apart & ~long)
        for i, ids in zip(rest.tolist(), self._batch(texts.take(pa.array(rest)) if len(rest) < len(texts) else texts), strict=True):
            found[i] = ids
        return found

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _batch(self, texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        fields = pc.split_pattern(texts, " ")
        at = fields.offsets.to_numpy().astype(np.int64)
        at, values = at - at[0], fields.flatten()
        coded = values.dictionary_encode()
        place = coded.indices.to_numpy().copy()
        # a unit is kept without its blank, a text's first unit behind one
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = [" " + h for h in values.take(pa.array(at[:-1])).to_pylist()]
        place[at[:-1]] = np.arange(len(keys), len(keys) + len(heads))
        # a field that is empty or starts with white space belongs to the unit before it: cut those texts with care
        loose = np.array([k[:1].isspace() or not k for k in keys] + [False] * len(heads))
        merged = np.unique(np.searchsorted(at, np.flatnonzero(loose[place]), side="right") - 1)
        careful = {i: _units(texts[i].as_py()) for i in merged.tolist()}
        keys = [k if k else " " for k in keys] + heads  # fields that are empty have no place any more
        self._look_up({*keys, *(k for units in careful.values() for k in units)})
        ids = [self.units[k] for k in keys]
        out = _gathered(ids, place, at)
        for i, units in careful.items():
            out[i] = b"".join(map(self.units.__getitem__, units))
        self._age()
        return out

    def _look_up(self, keys: set[str]) -> None:
        """Have the ids of these units in the young generation."""
        units, others = self.units, []
        missing = units.missing(keys)
        for k in missing:
            ids = self._tokenized(k, True) if k.isalpha() and k.isascii() else self._of_parts(k)
            if ids is None:
                others.append(k)
            else:
                units[k] = ids
        units.update(zip(others, self._library([k[1:] if k[0] == " " else " " + k for k in others]), strict=True))
        self.long = [k for k in missing if len(k) > CACHE_CHARS]

    def _tokenized(self, word: str, blank: bool) -> bytes:
        """Ids of a Latin word, which is one piece with its blank, by the model alone."""
        written = word if word.isascii() else word.translate(self.written)
        return array("I", [t.id for t in self.model.tokenize(self.written[32] + written if blank else written)]).tobytes()

    def _part(self, k: str) -> bytes | None:
        """Ids of a unit that stands in another one; it is kept too."""
        ids = self.units.get(k)
        if ids is None:
            ids = self.units.old.get(k)
            if ids is None:
                ids = self._of_parts(k)
            if ids is not None:
                self.units[k] = ids
        return ids

    def _of_parts(self, k: str) -> bytes | None:
        """Ids of an unknown unit of Latin words, single marks behind them and line ends; None for all others."""
        if k[-1] in self.marks and k[-2:-1].isalpha() and k[-2] < _LATIN:
            left = self._part(k[:-1])
            return left and left + self.marks[k[-1]]
        if "\n" in k:
            first, rest = k.split("\n", 1)
            if not first or not rest or any(e[0].isspace() or e[-1].isspace() for e in (first, rest)):
                return None
            left, right = self._part(first), self._part(" " + rest)
            return left and right and left + self.marks["\n"] + right
        blank = k[0] != " "
        word = k if blank else k[1:]
        return self._tokenized(word, blank) if word.isalpha() and (word.isascii() or max(word) < _LATIN) else None

    def _age(self) -> None:
        for k in self.long:
            self.units.pop(k, None)
        self.units.age()


def _units(text: str) -> list[str]:
    first, *others = _CUT.split(text)
    return [" " + first, *(u[1:] for u in others)]


def _segments(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SEGMENT and (cut := _CUT.search(text, at + SEGMENT)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _gathered(ids: list[bytes], place: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For each text the ids of its units, one after another: units ``place[at[i]:at[i + 1]]`` for text i."""
    size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
    start = np.cumsum(size, dtype=np.int32) - size
    n = size[place]
    end = np.cumsum(n, dtype=np.int64)
    flat = np.frombuffer(b"".join(ids), "<u4")
    # where a unit's ids are in flat, less where they go; a batch holds far less than 2**31 ids
    shift = start[place] - (end - n).astype(np.int32)
    raw = flat[np.arange(end[-1], dtype=np.int32) + np.repeat(shift, n)].tobytes()
    edge = (4 * np.concatenate([[0], end])[at]).tolist()
    return [raw[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
