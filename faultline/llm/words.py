"""Words of many texts at once, as 64-bit hashes, by array operations over code points.

A text is lower-cased and each code point has a class: 0 separates, 1 joins its
neighbours of class 1 to a word, 2 is a word of its own.  A word's hash is a sum
over its code points, to which separators add nothing, so cutting and hashing take
a fixed number of passes over the characters and no step for each word.  Texts are
taken in slices of about ``SLICE`` characters, so that the arrays follow the slice
and not the batch; one longer text is a slice of its own.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator

import numpy as np

SLICE = 1 << 17
_BASE, _CODE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_FINAL = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_SHIFT = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of MurmurHash3, a permutation of 64-bit values."""
    for by in _FINAL:
        x = (x ^ (x >> _SHIFT)) * by
    return x ^ (x >> _SHIFT)


@functools.lru_cache(maxsize=4)
def classes(joined: str, alone: str = "") -> tuple[np.ndarray, np.ndarray]:
    """The class of each code point, from patterns of one character, and its hash, which is 0 for separators."""
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    table = np.zeros(len(every), np.uint8)
    for pattern, kind in ((alone, 2), (joined, 1)):
        if pattern:
            table[[m.start() for m in re.finditer(pattern, every)]] = kind
    return table, np.where(table > 0, mix(np.arange(len(every), dtype=np.uint64) + _CODE), np.uint64(0))


_power = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        each = np.full(1 << n.bit_length(), _BASE)
        each[0] = 1
        _power = np.multiply.accumulate(each)
    return _power


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if held and size + len(text or "") > SLICE:
            yield first, held
            first, held, size = i, [], 0
        held.append((text or "").lower())
        size += len(held[-1])
    if held:
        yield first, held


def portions(lengths: list[int | None], rows: int, chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of so many rows and characters at most; one longer text is a range of its own."""
    first, held = 0, 0
    for i, n in enumerate(lengths):
        n = n or 0
        if i > first and (i - first >= rows or held + n > chars):
            yield first, i
            first, held = i, 0
        held += n
    if len(lengths) > first:
        yield first, len(lengths)


def cut(texts: list[str | None], table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, hash) of every word of every text, in the order of the texts."""
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for first, held in _slices(texts):
        codes = np.frombuffer("\n".join(held).encode("utf-32-le", "surrogatepass"), "<u4")
        kind = table[0][codes]
        begins = kind > 0
        begins[1:] &= (kind[1:] == 2) | (kind[:-1] != 1)
        start = np.flatnonzero(begins)
        if not len(start):
            continue
        codes = codes[start[0] :]
        begin = start - start[0]
        length = np.diff(np.append(begin, len(codes)))
        place = np.arange(len(codes)) - np.repeat(begin, length)
        each = table[1][codes] * _powers(int(length.max()))[place]
        hashes.append(mix(np.add.reduceat(each, begin)))
        ends = np.cumsum([len(h) + 1 for h in held])
        rows.append(first + np.searchsorted(ends, start, side="right"))
    return np.concatenate(rows), np.concatenate(hashes)
