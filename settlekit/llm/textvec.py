"""Word hashes of many texts at once, with numpy, inside Spark tasks.

Words are runs of bytes other than ASCII white space (\\x09-\\x0D, \\x20) of the
UTF-8 text; A-Z count as a-z. A word's hash is a polynomial over a fixed random
value for each byte, modulo 2^64, finished by a mixer.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_MULT = U(0x9E3779B97F4A7C15)  # odd, so powers can be divided out
_INV = U(pow(int(_MULT), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (splitmix64's finalizer)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _table(fold: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
    if fold:
        t[65:91] = t[97:123]
    return t


_FOLDED, _EXACT = _table(True), _table(False)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(n, 1 << 16)
    up, down = np.full(size, _MULT, U), np.full(size, _INV, U)
    up[0] = down[0] = U(1)
    tables = np.multiply.accumulate(up, out=up), np.multiply.accumulate(down, out=down)
    if size <= BLOCK + 1:  # those of a longer word go with it
        _powers[:] = tables
    return tables


BLOCK = 1 << 18


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """Hash of data[start:end] for many spans of a byte array, in ascending
    order and not overlapping. Works in blocks, so memory follows the block
    (or the longest span), not the data."""
    values, out, i = (_FOLDED if fold else _EXACT), np.empty(len(start), U), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, side="right")))
        base, block = start[i], data[start[i]:end[j - 1]]
        up, down = _power_tables(len(block) + 1)
        sums = np.zeros(len(block) + 1, U)
        np.cumsum(values[block] * up[:len(block)], out=sums[1:])
        b, e = start[i:j] - base, end[i:j] - base
        # a span's sum, moved to position 0; the length keeps apart spans that differ in end only
        out[i:j] = mix((sums[e] - sums[b]) * down[b] + (e - b).astype(U) * U(0xA24BAED4963EE407))
        i = j
    return out


class Words:
    """The words of a batch of texts: ``hash``, byte places ``start``/``end`` in
    the joined bytes ``data``, and ``offset`` (first word of each text, and the
    number of words at last). ``hash`` is left out where not asked for."""

    def __init__(self, texts, fold: bool = True, hashed: bool = True):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        joined = b"\n".join(parts) + b"\n"
        self.data = np.frombuffer(joined, np.uint8)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.byte0 = np.concatenate(([0], np.cumsum(lengths + 1)))  # of each text
        space = _SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = span_hashes(self.data, self.start, self.end, fold) if hashed else None
        self.offset = np.searchsorted(self.start, self.byte0)
        self.n = np.diff(self.offset)

    def text_of(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.n)), self.n)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k hashes of one sequence."""
    if len(words) < k:
        return np.empty(0, U)
    out = np.zeros(len(words) - k + 1, U)
    for i in range(k):
        out *= _MULT
        out += words[i:len(words) - k + 1 + i]
    return mix(out)


def shingles_of(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each run of k words that lies within one text. A
    shorter text, if it has words, is one shingle of all its words."""
    runs = shingles(w.hash, k)
    owner = w.text_of()
    if len(runs):
        inside = owner[:len(runs)] == owner[k - 1:]
        runs, at = runs[inside], owner[:len(inside)][inside]
    else:
        at = np.empty(0, np.int64)
    short = np.flatnonzero((w.n > 0) & (w.n < k))
    if len(short):
        whole = np.array([mix(shingle_sum(w.hash[w.offset[i]:w.offset[i + 1]]))[0] for i in short], U)
        runs, at = np.concatenate((runs, whole)), np.concatenate((at, short))
        order = np.argsort(at, kind="stable")
        runs, at = runs[order], at[order]
    return runs, at


def shingle_sum(words: np.ndarray) -> np.ndarray:
    out = np.zeros(1, U)
    for h in words:
        out = out * _MULT + h
    return out


def batches(texts: list, limit: int = 1 << 21):
    """Index ranges of ``texts`` with about ``limit`` characters each (one text at least)."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)
