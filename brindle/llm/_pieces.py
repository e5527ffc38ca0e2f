"""Texts cut at certain pre-token edges, vectorised: pieces of a buffer of texts, with their hashes.

Bytes have classes as far as a byte (with its neighbour) tells them; a place is an edge only where the classes on both sides are
known and every pre-token pattern of the two tokenizer formats ends there.  Beside characters of unknown class nothing is cut.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np

from ._words import _BASE, _INVERSE, FOLDED, PLAIN, SLICE_BYTES, U64, _table, mix, slices

BLANK, SPACE, LETTER, DIGIT, MARK, QUOTE, UNKNOWN = range(7)


def _classes() -> np.ndarray:
    out = np.full(256, UNKNOWN, np.uint8)
    out[:28] = MARK
    out[32:127] = MARK
    out[9:14], out[32], out[39] = BLANK, SPACE, QUOTE
    out[48:58] = DIGIT
    out[65:91] = out[97:123] = LETTER
    return out


CLASSES = _classes()
#: First bytes of two-byte characters that are letters throughout (U+00C0 to U+017F but for two signs, U+0400 to U+047F).
_LEADS = np.zeros(256, bool)
_LEADS[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = True
#: Whether a pre-token certainly ends between two neighbours of these classes; a quotation mark may begin a contraction.
_ENDS = np.zeros((8, 8), bool)
for _a, _bs in {
    LETTER: (DIGIT, MARK, QUOTE, BLANK, SPACE), DIGIT: (LETTER, MARK, QUOTE, BLANK, SPACE), MARK: (LETTER, DIGIT, BLANK, SPACE),
    QUOTE: (DIGIT, BLANK, SPACE), BLANK: (LETTER, DIGIT, MARK, QUOTE),
}.items():
    _ENDS[_a, list(_bs)] = True
#: The same where white space is dropped.
_DROPPED = _ENDS.copy()
_DROPPED[SPACE] = _ENDS[BLANK]
_ENDS, _DROPPED = _ENDS.ravel(), _DROPPED.ravel()
_BLANKS = np.zeros((8, 8), bool)
_BLANKS[:2, :2] = True
_BLANKS = _BLANKS.ravel()
_SURE = re.compile(rb"[A-Za-z](?= [A-Za-z])")


def classes(buf: np.ndarray) -> np.ndarray:
    c = CLASSES[buf]
    lead = np.flatnonzero(_LEADS[buf[:-1]])
    if len(lead):
        a, b = buf[lead], buf[lead + 1]  # two signs, and a capital that lower case makes two characters of
        sign = (a == 0xC3) & ((b == 0x97) | (b == 0xB7)) | (a == 0xC4) & (b == 0xB0)
        lead = lead[~sign]
        c[lead] = c[lead + 1] = LETTER
    dash = np.flatnonzero(buf[:-2] == 0xE2) if len(buf) > 2 else np.empty(0, np.int64)
    if len(dash):
        third = buf[dash + 2]
        dash = dash[(buf[dash + 1] == 0x80) & (third >= 0x90) & (third <= 0xA7)]
        c[dash] = c[dash + 1] = c[dash + 2] = MARK
    return c


class Pieces:
    """Pieces of several texts: hashes, places in ``data``, and the first piece of each text and the one behind its last.

    With ``words`` white space is dropped, and A-Z count as a-z; else a single space belongs to what follows it.
    """

    def __init__(self, texts: list[bytes], words: bool = False):
        self.data = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(self.data, np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        stop = np.cumsum(size + 1) - 1
        c = classes(buf)
        pair = c[:-1] * np.uint8(8) + c[1:]
        cut = np.empty(len(buf) + 1, bool)
        cut[1:-1] = (_DROPPED if words else _ENDS)[pair]
        run = np.empty(0, np.int64) if words else np.flatnonzero(_BLANKS[pair][:-1]) + 1  # the last of several blanks goes with what follows
        if len(run):
            after = c[run + 1]
            cut[run] = (after >= LETTER) & (after <= QUOTE)
        cut[0] = cut[-1] = True
        cut[stop] = cut[stop - size] = True
        at = np.flatnonzero(cut)
        self.start, self.end = at[:-1], at[1:]
        if words:
            held = (c[self.start] > SPACE) | (self.end - self.start > 1)
            self.start, self.end = self.start[held], self.end[held]
        sums = np.empty(len(buf) + 1, U64)
        sums[0] = 0
        np.cumsum((FOLDED if words else PLAIN).values[buf] * _table(_BASE, len(buf)), out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * _table(_INVERSE, len(buf) + 1)[self.start] + (self.end - self.start).astype(U64))
        self.first, self.behind = np.searchsorted(self.start, stop - size), np.searchsorted(self.start, stop)

    def texts(self, at: np.ndarray) -> list[bytes]:
        data = self.data
        return [data[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)]


def parts(text: bytes) -> list[bytes]:
    """A long text in parts of about ``SLICE_BYTES``, cut between two words."""
    out, lo = [], 0
    while len(text) - lo > 2 * SLICE_BYTES and (m := _SURE.search(text, lo + SLICE_BYTES)):
        out.append(text[lo : m.end()])
        lo = m.end()
    out.append(text[lo:])
    return out


def buffers(texts: list[bytes], words: bool = False) -> Iterator[tuple[list[int], Pieces]]:
    """Pieces of about ``SLICE_BYTES`` of texts at a time, and which text each part belongs to."""
    owner, cut = [], []
    for i, t in enumerate(texts):
        for p in parts(t) if len(t) > 2 * SLICE_BYTES else (t,):
            owner.append(i)
            cut.append(p)
    for lo, hi in slices(cut):
        yield owner[lo:hi], Pieces(cut[lo:hi], words)


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the cycle collector: millions of small objects and no cycles among them."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
