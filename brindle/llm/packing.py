"""Best-fit packing of token sequences with a swap-based local search.

Each document becomes its tokens and an end token; only documents longer than the capacity are cut, into
capacity-sized pieces and a rest.  Full pieces are sequences of their own.  The others are packed by
groups of about ``group_pieces`` random pieces: best-fit decreasing, then a local search that moves a piece, exchanges
one for one or two for one between underfull bins whenever that increases the sum of squared fills, so
that fill gathers in few bins and the rest empty.  Bins that stay well below the capacity are broken up
once more and packed in a second round with those of other groups.

A group holds a bounded number of lengths, never texts or tokens; the number of groups follows the input.  Groups come
from a hash of the piece's position in its document and its id, so one source or id can't fill a group.

Defined results: a null or empty text is one piece of one token (the end token); repeated ids are told apart by their
text and equal rows by an ordinal, so each row is packed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import groupby, repeat
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import WordEnds, encoded, shared, special_strings
from ._common import pick, written
from ._pieces import Pieces, buffers, uncollected
from ._words import trim_memory

CACHE_ENTRIES = 400_000
PIECES = "start long, length long, piece int, ids_crc32 long"


class _Known:
    """A worker's cache: hashes of pieces to numbers, and the ids of the numbered pieces one after another in one array."""

    def __init__(self, path: str):
        self.path, self.encoder, self.special = path, shared(WordEnds, path), special_strings(path)
        self.clear()

    def clear(self) -> None:
        self.at: dict[int, int] = {}
        self.ids, self.bounds = np.empty(1 << 20, "<u4"), np.zeros(1 << 18, np.int64)

    def places(self, p: Pieces, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Numbers of the distinct ``hashes`` of ``p``, which begin at ``first``; new ones are encoded and kept."""
        if len(self.at) > CACHE_ENTRIES:
            self.clear()
        found = np.array(list(map(self.at.get, hashes.tolist(), repeat(-1))), np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            order, size, ids = self.encoder.ids(p.texts(first[new]))
            new, n = new[order], len(self.at)
            used = int(self.bounds[n])
            if used + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids[:used], np.empty(used + len(ids), "<u4")))
            if n + len(new) >= len(self.bounds):
                self.bounds = np.concatenate((self.bounds[: n + 1], np.empty(n + len(new), np.int64)))
            self.ids[used : used + len(ids)] = ids
            self.bounds[n + 1 : n + 1 + len(new)] = used + np.cumsum(size)
            found[new] = np.arange(n, n + len(new))
            self.at.update(zip(hashes[new].tolist(), range(n, n + len(new)), strict=True))
        return found


def token_ids(texts: list[bytes | None], known: _Known) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's number and its ids, in parts one after another for long texts."""
    texts = [t or b"" for t in texts]
    whole = [i for i, t in enumerate(texts) if not known.encoder.cuts or any(s in t for s in known.special)]
    for i, ids in zip(whole, encoded(known.path, [texts[i].decode("utf-8", "replace") for i in whole]), strict=True):
        texts[i] = None
        yield i, np.array(ids, "<u4")
    cut = [i for i, t in enumerate(texts) if t is not None]
    for owner, p in buffers([texts[i] for i in cut], words=True):
        u, first, inv = np.unique(p.hash, return_index=True, return_inverse=True)
        at = known.places(p, u, first)
        begin, size = known.bounds[at], known.bounds[at + 1] - known.bounds[at]
        bounds = np.append(p.first, len(inv))
        for a, z in spans(bounds, size[inv]):
            part = inv[bounds[a] : bounds[z]]
            n = size[part]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            ids = known.ids[np.repeat(begin[part] - (ends - n), n) + np.arange(total)]
            edge = np.concatenate(([0], ends))[bounds[a : z + 1] - bounds[a]].tolist()
            for i in range(a, z):
                yield cut[owner[i]], ids[edge[i - a] : edge[i - a + 1]]


def spans(bounds: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` ids each (a longer text stands alone), so that ids of a buffer stay few at a time."""
    total = np.concatenate(([0], np.cumsum(size)))[bounds]
    a, n = 0, len(bounds) - 1
    while a < n:
        z = max(a + 1, int(np.searchsorted(total, total[a] + most, side="right")) - 1)
        yield a, min(z, n)
        a = min(z, n)


_KNOWN: dict[str, _Known] = {}


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    if path not in _KNOWN:  # a worker keeps its cache from task to task
        _KNOWN[path] = _Known(path)
    end = np.array([end_id], "<u4")
    for b in batches:
        rows: tuple[list, ...] = ([], [], [], [], [])
        with uncollected():
            for i, found in groupby(token_ids(b.column(1).to_pylist(), _KNOWN[path]), key=itemgetter(0)):
                ids = np.concatenate([*(x for _, x in found), end])
                for k, s in enumerate(range(0, len(ids), capacity)):
                    piece = ids[s : s + capacity]
                    for out, x in zip(rows, (i, s, len(piece), k, zlib.crc32(piece)), strict=True):
                        out.append(x)
        at, start, length, piece, crc = rows
        yield pa.record_batch(
            {
                "id": b.column(0).take(pa.array(at, pa.int64())),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "piece": pa.array(piece, pa.int32()),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
        )
    trim_memory()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the bin that it leaves fullest."""
    order = np.argsort(-lengths, kind="stable")
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in order.tolist():
        n = int(lengths[i])
        k = bisect_left(room, (n, -1))
        if k == len(room):
            bins.append([i])
            left, b = capacity - n, len(bins) - 1
        else:
            left, b = room.pop(k)
            bins[b].append(i)
            left -= n
        if left:
            insort(room, (left, b))
    return bins


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Increase the sum of squared fills by moves, one-for-one and two-for-one exchanges; empty bins go.

    Underfull bins are taken from the emptiest: what it holds is offered to all bins no emptier.  A bin with room r takes a piece
    p outright if p <= r, else gives back one piece q (or two) with p - r <= q < p: its fill grows, the donor's
    shrinks, and as the donor was no fuller the sum of squares grows.  So the search ends, when no such step is left.

    Pieces stand in order of size, so those that may come back are one range; sums of two pieces are counted for each bin.
    """
    order = np.argsort(lengths, kind="stable")
    size = np.asarray(lengths, np.int64)[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    held = [set(place[b].tolist()) for b in bins]
    home = np.empty(len(order), np.int64)
    for b, own in enumerate(held):
        home[list(own)] = b
    room = capacity - np.bincount(home, weights=size, minlength=len(bins)).astype(np.int64)
    # For each bin and length, how many sums of two of its pieces are less; made anew for changed bins where it is needed.
    sums = np.zeros((len(bins), capacity + 2), np.int16 if capacity < 1 << 15 else np.int32)
    stale = set(range(len(bins)))

    def pair_sums(b: int) -> None:
        own, n = np.unique(size[list(held[b])], return_counts=True)
        seen = np.zeros(capacity + 1, bool)
        i, j = np.triu_indices(len(own), 1)
        seen[own[i] + own[j]] = True
        seen[2 * own[n > 1]] = True
        np.cumsum(seen, out=sums[b, 1:], dtype=sums.dtype)

    def pair(b: int, least: int, below: int) -> list[int]:
        small = sorted(held[b])
        for x, q in enumerate(small):
            k = bisect_left(small, least - size[q], lo=x + 1, key=lambda i: size[i])
            if k < len(small) and size[q] + size[small[k]] < below:
                return [q, small[k]]
        raise AssertionError("a counted pair must be there")

    def step(donor: int) -> bool:
        free = room[donor]
        taker = np.flatnonzero((room > 0) & (room <= free))
        taker = taker[taker != donor]
        if not len(taker):
            return False
        mine = sorted(held[donor], reverse=True)
        for p in mine:
            n, fits = size[p], taker[room[taker] >= size[p]]
            if len(fits):
                return swap(donor, int(fits[room[fits].argmin()]), p, [])
            lo, hi = np.searchsorted(size, (n - free, n))
            left = room[home[lo:hi]]
            at = np.flatnonzero((left <= free) & (left + size[lo:hi] >= n) & (home[lo:hi] != donor))
            if len(at):
                more = n - size[lo + at]
                q = int(lo + at[(more * (free - left[at] + more)).argmax()])
                return swap(donor, int(home[q]), p, [q])
        for b in [b for b in stale if 0 < room[b] < capacity]:
            pair_sums(b)
            stale.discard(b)
        for p in mine:
            n = size[p]
            fits = taker[sums[taker, n] > sums[taker, n - room[taker]]]
            if len(fits):
                r = int(fits[room[fits].argmax()])
                return swap(donor, r, p, pair(r, int(n - room[r]), int(n)))
        return False

    def swap(donor: int, r: int, p: int, give: list[int]) -> bool:
        held[donor].remove(p)
        held[donor].update(give)
        held[r].difference_update(give)
        held[r].add(p)
        home[p], home[give] = r, donor
        more = size[p] - size[give].sum()
        room[donor] += more
        room[r] -= more
        stale.update((donor, r))
        return True

    changed = True
    while changed:
        changed = False
        for donor in np.argsort(-room, kind="stable").tolist():
            while 0 < room[donor] < capacity and step(donor):
                changed = True
    return [sorted(order[list(own)].tolist()) for own in held if own]


def _pack_group(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bin and offset of each piece of a group; order within the group is made definite first."""
    pdf = pdf.sort_values(["length", "key", "nth"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    lengths = pdf["length"].to_numpy()
    bins = local_search(lengths, best_fit_decreasing(lengths, capacity), capacity)
    b, off, fill = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
    for k, members in enumerate(bins):
        at = 0
        for i in members:
            b[i], off[i] = k, at
            at += int(lengths[i])
        for i in members:
            fill[i] = at
    return pdf.assign(bin=b, offset=off, fill=fill)


def pack(
    docs: DataFrame,
    path: str,
    text_col: str = "text",
    id_col: str = "doc_id",
    capacity: int = 4096,
    end_id: int = 1,
    group_pieces: int = 8192,
) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    base = pick(docs, id=id_col, text=text_col)
    kind = dict(base.dtypes)["id"]
    cut = base.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(
        lambda it: _cut(it, path, capacity, end_id), f"id {kind}, {PIECES}"
    )
    # An ordinal tells equal pieces apart; written once, so that nothing is tokenised again.
    cut = written(cut.withColumn("key", F.xxhash64("id", "piece", "start", "ids_crc32")).withColumn("nth", F.monotonically_increasing_id()))
    n = cut.where(F.col("length") < capacity).count()
    full = cut.where(F.col("length") == capacity).select(
        "*", (F.col("nth") * 4).alias("seq"), F.lit(0).cast("long").alias("offset")
    )
    schema = f"id {kind}, {PIECES}, key long, nth long, grp long, bin long, offset long, fill long"

    def packed(df: DataFrame, groups: int, salt: int) -> DataFrame:
        grp = F.pmod(F.xxhash64("key", "nth", F.lit(salt)), F.lit(groups))
        return df.withColumn("grp", grp).groupBy("grp").applyInPandas(lambda g: _pack_group(g, capacity), schema)

    first = written(packed(cut.where(F.col("length") < capacity), max(1, math.ceil(n / group_pieces)), 1))
    # Second round: bins filled to less than 31/32 of the capacity are broken up and packed across groups.
    low = F.col("fill") < capacity - capacity // 32
    rest = first.where(low).drop("grp", "bin", "offset", "fill")
    m = first.where(low).count()
    second = packed(rest, max(1, math.ceil(m / group_pieces)), 2) if m else first.limit(0)
    # Numbers that can't meet: full pieces have multiples of 4, each round its own remainder; a group has far fewer than 2**24 bins.
    seq = lambda tag: ((F.col("grp") * (1 << 24) + F.col("bin")) * 4 + tag).alias("seq")
    cols = ["id", "piece", "start", "length", "ids_crc32", "seq", "offset"]
    out = full.select(*cols)
    for part, tag in ((first.where(~low), 1), (second, 2)):
        out = out.unionByName(part.select("*", seq(tag)).select(*cols))
    return out.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), "offset"
    )
