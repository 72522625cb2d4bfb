"""Vectorised handling of UTF-8 text inside Arrow tasks.

A batch of texts is one byte array with offsets. Everything here works on such
arrays with numpy, so the cost for each byte is a few nanoseconds and no Python
code runs for each word. Batches are cut into pieces of about `PIECE` bytes
first, so a task's memory doesn't depend on its share of the input; a single
longer text makes a longer piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 19

#: What a Python worker keeps from task to task. Workers live on and do other work, which clears this first.
KEPT: dict = {}


def forget() -> None:
    """Clears what this worker keeps. A function by its name, so that a task's code finds the worker's own."""
    KEPT.clear()


#: Separators of words of the class [^\x20\x09-\x0D]+.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of words of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (text in lower case).
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: A-Z to a-z; all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_A = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _P)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        x = np.full(max(n, 2 * PIECE), _P if kind == "up" else _P_INV)
        x[0] = 1
        _powers[kind] = np.cumprod(x, dtype=np.uint64)
    return _powers[kind][:n]


def column(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, most: int = PIECE):
    """Ranges of rows with about `most` bytes."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


class Texts:
    """A piece: `buf` with the bytes, row k at off[k]:off[k+1]."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off - off[0]
        self._sums = None

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of buf[start:end], equal for equal strings wherever they stand."""
        if self._sums is None:
            n = len(self.buf)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[self.buf] * _power("up", n), out=self._sums[1:])
        h = self._sums[end] - self._sums[start]
        h *= _power("down", len(self.buf) + 1)[start]
        return mix(h + (end - start).astype(np.uint64) * _A)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of True that don't cross rows: starts, ends, offsets of runs by row."""
        n = len(self.buf)
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last[:-1] &= ~inside[1:] | edge[1:n]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return start, end, np.searchsorted(start, self.off)

    def words(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(~separator[self.buf])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""\n-split lines, one at least for each row: starts, ends, offsets by row."""
        nl = np.flatnonzero(self.buf == 10)
        row = np.searchsorted(self.off, nl, "right") - 1
        count = np.bincount(row, minlength=len(self.off) - 1) + 1
        at = np.concatenate([[0], np.cumsum(count)])
        start, end = np.empty(at[-1], np.int64), np.empty(at[-1], np.int64)
        first = np.zeros(at[-1], bool)
        first[at[:-1]] = True
        start[first], start[~first] = self.off[:-1], nl + 1
        last = np.zeros(at[-1], bool)
        last[at[1:] - 1] = True
        end[last], end[~last] = self.off[1:], nl
        return start, end, at

    def per_row(self, flag: np.ndarray) -> np.ndarray:
        """Sum of a flag for each byte, by row."""
        return sums(flag, self.off)


def sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of x[off[k]:off[k+1]] for each k."""
    total = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def grams(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of a row: hashes, place of the first word, offsets by row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= _A
        g += h[j : j + n]
    whole = np.ones(n, bool)
    for j in range(1, k):
        cut = off - j
        whole[cut[(cut >= 0) & (cut < n)]] = False
    # a row shorter than k has no place of its own left: its starts are cut by its own end
    at = np.flatnonzero(whole)
    return mix(g[at]), at, np.searchsorted(at, off)


def shingle_sequence(t: Texts, separator: np.ndarray = BLANK, k: int = 5, words: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words in order, and their offsets by row; fewer words make one of all of them. `words` gets the words' hashes, and the first and end word of each shingle."""
    start, end, off = t.words(separator)
    h = t.hashes(start, end)
    g, first, at = grams(h, off, k)
    few = np.flatnonzero((np.diff(off) > 0) & (np.diff(off) < k))
    if words is not None:
        words += [h, np.insert(first, at[few], off[few]), np.insert(first + k, at[few], off[few + 1])]
    if not len(few):
        return g, at
    short = np.empty(len(few), np.uint64)
    for i, r in enumerate(few.tolist()):
        x = np.array([off[r + 1] - off[r]], np.uint64)
        for w in h[off[r] : off[r + 1]]:
            x = x * _A + w
        short[i] = mix(x)[0]
    count = np.diff(at)
    count[few] = 1
    return np.insert(g, at[few], short), np.concatenate([[0], np.cumsum(count)])


def shingles(t: Texts, separator: np.ndarray = BLANK, k: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles; none without words."""
    g, at = shingle_sequence(t, separator, k)
    return [np.unique(g[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def weighed_shingles(t: Texts, value, separator: np.ndarray = BLANK, k: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """As shingles, each with the sum of `value` (of word hashes, whole numbers) over its words."""
    words: list[np.ndarray] = []
    g, at = shingle_sequence(t, separator, k, words)
    h, first, end = words
    total = np.zeros(len(h) + 1, np.int64)
    np.cumsum(value(h), out=total[1:])
    weight = total[end] - total[first]
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        s, i = np.unique(g[a:b], return_index=True)
        out.append((s, weight[a + i]))
    return out
