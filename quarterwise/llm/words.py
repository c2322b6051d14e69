"""Words of many texts at once, as positions and hashes in numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from quarterwise.llm.frames import text_buffers

_ALL = np.arange(256)
#: [^\x20\x09-\x0D]+
UNSPACED = (_ALL != 0x20) & ~((_ALL >= 0x09) & (_ALL <= 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case; bytes of other code points are all from 0x80 on
ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
_LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)

_BLOCK = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_U = np.uint64


@dataclass(frozen=True)
class Words:
    """`starts`, `ends`: byte positions in `data`; `rows[i]:rows[i + 1]`: the words of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    texts: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def joined(self, ids: np.ndarray) -> bytes:
        return b" ".join([self.word(i) for i in ids])

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)


def split_words(column: pa.Array, kind: np.ndarray = UNSPACED, lower: bool = False) -> Words:
    """The words of every text of a column; NULL and empty texts have none."""
    texts, data = text_buffers(column)
    if lower:
        data = _LOWER[data]
    inside = kind[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(texts), np.int64), texts)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = texts[1:-1][(texts[1:-1] > 0) & (texts[1:-1] < len(data))]  # a word ends with its text
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return Words(data, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, texts), texts)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, kept for the next call."""
    size = max(_BLOCK, 1 << (n - 1).bit_length())
    if (base, size) not in _POWERS:
        step = np.full(size, base, _U)
        step[0] = 1
        _POWERS[base, size] = np.multiply.accumulate(step)
    return _POWERS[base, size][:n]


def hash_words(words: Words, which: int = 0) -> np.ndarray:
    """A 64-bit hash per word: a polynomial in its bytes, from running sums over whole blocks of text."""
    base = _BASES[which]
    inverse = pow(base, -1, 1 << 64)
    letters = mixed(np.arange(1, 257, dtype=_U) * _U(base))
    out = np.empty(len(words.starts), _U)
    i, n = 0, len(out)
    while i < n:
        at = int(words.starts[i])
        j = max(i + 1, int(np.searchsorted(words.ends, at + _BLOCK, side="right")))
        size = int(words.ends[j - 1]) - at
        sums = np.zeros(size + 1, _U)
        np.cumsum(letters[words.data[at : at + size]] * _powers(base, size), out=sums[1:])
        lo, hi = words.starts[i:j] - at, words.ends[i:j] - at
        out[i:j] = (sums[hi] - sums[lo]) * _powers(inverse, size)[lo]
        i = j
    return mixed(out)


def hash_windows(hashes: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A hash per run of `length` neighbouring words, across all texts; len(hashes) - length + 1 of them."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, _U)
    factor = _U(_BASES[1] ^ (seed * 2 + 2))  # odd
    out = hashes[:n].copy()
    for k in range(1, length):
        out *= factor
        out += hashes[k : k + n]
    return mixed(out)


def window_rows(rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of every run of `length` words that lies within one text."""
    counts = np.maximum(np.diff(rows) - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    before = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return np.arange(int(counts.sum())) - before[text] + rows[:-1][text], text
