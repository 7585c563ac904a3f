"""64-bit hashes of words and word n-grams, computed over whole record batches.

A batch's texts are one buffer of bytes. A prefix sum of byte codes times
powers of an odd multiplier gives the hash of any stretch of it as a
difference of two sums, so no Python code runs for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Hashed at once; longer texts are cut between words.
SEGMENT = 1 << 19

_RNG = np.random.default_rng(20240229)
_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1
_GRAM = np.uint64(0xD6E8FEB86659FD93)


def byte_table(keep) -> np.ndarray:
    """For each byte 0 if it parts words, else the byte that stands for it, with A-Z lowered."""
    table = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        if keep(b):
            table[b] = b + 32 if 0x41 <= b <= 0x5A else b
    return table


#: Words are runs of anything but space and the controls 9 to 13.
BLANK_WORDS = byte_table(lambda b: b != 0x20 and not 9 <= b <= 13)
#: Words are runs of ASCII letters and digits and of all that is not ASCII.
LETTER_WORDS = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)


class _Powers:
    """Powers of an odd number modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: int) -> None:
        self.base, self.values = base, np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            steps = np.full(n, self.base & _M, dtype=np.uint64)
            steps[0] = 1
            self.values = np.multiply.accumulate(steps)
        return self.values


_POW, _INVERSE = _Powers(_R), _Powers(pow(_R, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all others (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array end to end, and where each text starts (one more entry at the end). Null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_hashes(texts: pa.Array, table: np.ndarray = BLANK_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string array in order, and where each text's words start (one more entry at the end). Null is empty."""
    return word_and_stem_hashes(texts, table, 0)[::2]


def word_and_stem_hashes(texts: pa.Array, table: np.ndarray, stem: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, hashes of their first ``stem`` bytes, and where each text's words start."""
    data, offsets = text_bytes(texts)
    hashes, stems, places, at = [], [], [], 0
    while at < len(data):
        end = _between_words(data, at, offsets, table)
        h, p, s = _segment(data[at:end], np.unique(np.clip(offsets, at, end)) - at, table, stem)
        hashes.append(h)
        stems.append(p)
        places.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.concatenate(stems), np.searchsorted(np.concatenate(places), offsets)


def _between_words(data: np.ndarray, at: int, offsets: np.ndarray, table: np.ndarray) -> int:
    """The end of a segment: the first place behind SEGMENT bytes that is no word's inside."""
    end = at + SEGMENT
    while end < len(data):
        gaps = np.flatnonzero(table[data[end : end + 65536]] == 0)
        if len(gaps):
            end += int(gaps[0])
            break
        end += 65536
    edge = offsets[np.searchsorted(offsets, min(at + SEGMENT, len(data)))]
    return min(end, int(edge), len(data))


def _segment(data: np.ndarray, edges: np.ndarray, table: np.ndarray, stem: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = table[data]
    inside = low != 0
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[edges[edges < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODES[low] * _POW(len(data))[: len(data)], out=sums[1:])
    inverse = _INVERSE(len(data))[starts]
    h = mix((sums[ends] - sums[starts]) * inverse + (ends - starts).astype(np.uint64))
    if not stem:
        return h, h, starts
    ends = np.minimum(ends, starts + stem)
    return h, mix((sums[ends] - sums[starts]) * inverse + (ends - starts).astype(np.uint64)), starts


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; those of the last n - 1 places are left out."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = words[:m].copy()
    for k in range(1, n):
        h *= _GRAM
        h += words[k : m + k]
    return mix(h + np.uint64(n))


def shingle_sets(texts: pa.Array, n: int = 5, table: np.ndarray = BLANK_WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct n-word shingles of each text; with fewer words, the whole sequence as one; without words, none."""
    words, at = word_hashes(texts, table)
    grams = ngram_hashes(words, n)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield ngram_hashes(words[a:b], b - a)
        else:
            yield grams[:0]
