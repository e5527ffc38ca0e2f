"""Vectorised word hashing for Arrow batches.

A slice of documents becomes one byte buffer; words are runs of bytes that a 256-entry table
does not call a separator.  A word's 64-bit hash is a polynomial over table values of its bytes,
taken from prefix sums modulo 2**64 and mixed, so no Python loop runs over bytes or words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
        done += step
    return out


class Alphabet:
    """Which bytes separate words, and which bytes count as the same."""

    def __init__(self, fold: bool = False, alnum: bool = False, seed: int = 1):
        codes = np.arange(256, dtype=np.int64)
        self.sep = np.zeros(256, bool)
        self.sep[list(SPACES)] = True
        if alnum:
            self.sep[:128] = True
            self.sep[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
        if fold:
            codes[65:91] += 32
        self.values = mix(codes.astype(U64) * U64(0xD1342543DE82EF95) + U64(seed))


PLAIN = Alphabet()
FOLDED = Alphabet(fold=True)
ALNUM = Alphabet(fold=True, alnum=True)
_POW: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    if base not in _POW or len(_POW[base]) < n:
        _POW[base] = _powers(base, max(n, SLICE_BYTES + 1))
    return _POW[base][:n]


_INVERSE = pow(_BASE, -1, 1 << 64)


def _hash_buffer(buf: np.ndarray, a: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sep = a.sep[buf]
    edge = np.empty(len(buf) + 1, bool)
    edge[0] = not sep[0]
    edge[-1] = not sep[-1]
    np.not_equal(sep[1:], sep[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    start, end = at[::2], at[1::2]
    sums = np.empty(len(buf) + 1, U64)
    sums[0] = 0
    np.cumsum(a.values[buf] * _table(_BASE, len(buf)), out=sums[1:])
    h = (sums[end] - sums[start]) * _table(_INVERSE, len(buf) + 1)[start]
    return mix(h), start, end


def word_hashes(data: bytes, a: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (byte offsets) of each word of ``data``; long data goes piece by piece."""
    if not data:
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    buf = np.frombuffer(data, np.uint8)
    if len(buf) <= SLICE_BYTES:
        return _hash_buffer(buf, a)
    parts, lo = [], 0
    while lo < len(buf):
        hi, window = min(len(buf), lo + SLICE_BYTES), SLICE_BYTES
        while hi < len(buf):  # cut at the last separator; a longer word makes the piece longer
            back = np.flatnonzero(a.sep[buf[lo:hi]])
            if len(back):
                hi = lo + int(back[-1]) + 1
                break
            window *= 2
            hi = min(len(buf), lo + window)
        h, s, e = _hash_buffer(buf[lo:hi], a)
        parts.append((h, s + lo, e + lo))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def slices(texts: list[bytes | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of documents of about ``limit`` bytes each (a longer document stands alone)."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"") + 1
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


class Words:
    """The words of several documents: hashes, and where each document's words begin."""

    def __init__(self, texts: list[bytes | None], a: Alphabet):
        data = b"\x20".join(t or b"" for t in texts)
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        self.doc_start = np.concatenate(([0], np.cumsum(sizes)))
        self.hash, self.start, self.end = word_hashes(data, a)
        self.first = np.searchsorted(self.start, self.doc_start[:-1])
        self.bounds = np.append(self.first, len(self.hash))
        self.counts = np.diff(self.bounds)
        self.data = data

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


_WBASE = 0xA0761D6478BD642F | 1
_WINVERSE = pow(_WBASE, -1, 1 << 64)


def rolling(h: np.ndarray, width: int, base: int = _WBASE) -> np.ndarray:
    """Hash of every window of ``width`` consecutive values (length ``len(h) - width + 1``)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    inverse = pow(base, -1, 1 << 64)
    sums = np.empty(len(h) + 1, U64)
    sums[0] = 0
    np.cumsum(h * _table(base, len(h)), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * _table(inverse, n))


def trim_memory() -> None:
    """Give freed memory back to the system: workers live on between tasks, and an executor's memory is shared by all of them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def windows(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words inside documents, and the document of each."""
    h = rolling(w.hash, width)
    room = np.maximum(w.counts - width + 1, 0)
    before = np.concatenate(([0], np.cumsum(room)[:-1]))
    at = np.repeat(w.bounds[:-1] - before, room) + np.arange(int(room.sum()))
    return h[at], np.repeat(np.arange(len(room)), room)
