"""Benchmark decontamination by greedy string tiling.

Tokens are A-Z lower-cased runs of letters and digits.  A document meets a benchmark item when both share a seed of ``SEED`` tokens
(a rolling Karp-Rabin hash).  On such pairs the longest common run of unmarked tokens is marked again and again, as
a tile, until no run of ``SEED`` tokens is left; of equally long runs the one that begins first in the document goes first, then the one that
begins first in the item.  An item's coverage is the share of its tokens in tiles, whatever
their order in the document, so reordered passages count.  A document is contaminated by an item covered to ``threshold`` or more.

The longest run is found by bisection over its length with rolling hashes, never by pairs of places, so repetitive texts cost no more than
others.  A pair is passed over where even all shared seeds together can't cover more of the item than another item has, nor ``threshold``.

The benchmark is a stated query set: it is taken in blocks of about ``BLOCK_BYTES`` of text, one after another, each broadcast at that
size and held against all documents without a shuffle; coverages from several blocks are put together by row.

Defined results: null or empty texts and an empty benchmark give no contamination; an item of fewer than ``SEED`` tokens is covered where a document
holds it whole, and else not at all; an item without tokens never is; null and repeated item ids and texts are items as they come; repeated rows stay
repeated; an empty table gives no rows; other columns are ignored.  Tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pick, text_batches, written
from ._words import _WBASE, _WINVERSE, ALNUM, U64, Words, _table, rolling, slices

SEED = 5
BLOCK_BYTES = 8 << 20


@dataclass(frozen=True)
class Block:
    """A part of the benchmark: tokens of its items one after another, and the index of their seeds."""

    ids: list
    tokens: np.ndarray
    bounds: np.ndarray
    seeds: np.ndarray  # distinct hashes, sorted
    first: np.ndarray  # where each seed's places begin in ``places``
    places: np.ndarray  # of the seeds, in ``tokens``
    item: np.ndarray  # of each of ``places``
    flags: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # for each width below SEED: hashes of whole items, sorted, and the items


def make_block(ids: list, texts: list[bytes | None]) -> Block:
    w = Words(texts, ALNUM)
    h = rolling(w.hash, SEED)
    item = np.searchsorted(w.bounds, np.arange(len(h)), side="right") - 1
    at = np.flatnonzero(np.arange(len(h)) + SEED <= w.bounds[item + 1])  # seeds don't reach over the end of an item
    at = at[np.argsort(h[at], kind="stable")]
    seeds, first = np.unique(h[at], return_index=True)
    flags = np.zeros(1 << 20, bool)
    flags[(seeds >> U64(44)).astype(np.int64)] = True
    short = {}
    for width in range(1, SEED):
        whole = np.flatnonzero(w.counts == width)
        if len(whole):
            keys = rolling(w.hash, width)[w.bounds[whole]]
            order = np.argsort(keys, kind="stable")
            short[width] = keys[order], whole[order]
    return Block(ids, w.hash, w.bounds, seeds, np.append(first, len(at)), at, item[at], flags, short)


def ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one range after another."""
    n = stop - start
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Side:
    """Tokens of one side of a tiling, and how many unmarked ones follow each place."""

    def __init__(self, tokens: np.ndarray):
        self.sums = np.concatenate((np.zeros(1, U64), np.cumsum(tokens * _table(_WBASE, len(tokens)), dtype=U64)))
        self.inverse = _table(_WINVERSE, len(tokens) + 1)
        self.marked = np.zeros(len(tokens), bool)

    def count(self) -> int:
        n = len(self.marked)
        stop = np.where(self.marked, np.arange(n), n)
        self.free = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)
        return int(self.free.max(initial=0))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places of the unmarked windows."""
        at = np.flatnonzero(self.free >= width)
        return (self.sums[at + width] - self.sums[at]) * self.inverse[at], at


def tile(a: np.ndarray, b: np.ndarray, shortest: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of ``a`` and ``b``: tiles (start in a, start in b, length), longest first, then by start in a and in b."""
    x, y = _Side(a), _Side(b)
    tiles, most = [], min(len(a), len(b))
    while True:
        low, high = shortest - 1, min(most, x.count(), y.count())
        while low < high:  # a common run holds common runs of every lesser length
            middle = shortest if low < shortest else (low + high + 1) // 2
            if np.isin(x.windows(middle)[0], y.windows(middle)[0]).any():
                low = middle
            else:
                high = middle - 1
        if low < shortest:
            return tiles
        (ha, at_a), (hb, at_b) = x.windows(low), y.windows(low)
        order = np.argsort(hb, kind="stable")
        hb, at_b = hb[order], at_b[order]
        begin, end = np.searchsorted(hb, ha, side="left"), np.searchsorted(hb, ha, side="right")
        met = np.flatnonzero(begin < end)
        next_free: dict[int, int] = {}  # places in b are given up for good once they overlap a tile
        behind = 0
        for i, lo, hi in zip(at_a[met].tolist(), begin[met].tolist(), end[met].tolist(), strict=True):
            if i < behind:
                continue
            k = next_free.get(lo, lo)
            while k < hi and (y.marked[at_b[k]] or y.marked[at_b[k] + low - 1]):
                k += 1
            next_free[lo] = k
            if k < hi:
                j = int(at_b[k])
                x.marked[i : i + low] = y.marked[j : j + low] = True
                tiles.append((i, j, low))
                behind = i + low
        most = low - 1


def _pieces(tokens: np.ndarray, at: np.ndarray, odd: int) -> np.ndarray:
    """The tokens within seeds that begin at ``at`` (ascending), with a token that stands nowhere else between separate stretches."""
    edge = np.zeros(len(tokens) + 1, np.int64)
    edge[at] += 1
    np.add.at(edge, at + SEED, -1)
    held = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
    gap = np.concatenate(([0], np.cumsum(np.diff(held) > 1)))
    out = np.arange(int(len(held) + gap[-1]), dtype=U64) * U64(2) + U64(odd)
    out[np.arange(len(held)) + gap] = tokens[held]
    return out


def _coverage(a: np.ndarray, at_a: np.ndarray, k_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, k_b: np.ndarray) -> int:
    """Tokens of ``b`` in tiles, given where both hold their common seeds (places ascending, and which seeds)."""
    if len(at_a) == len(at_b) and at_a[-1] - at_a[0] == at_b[-1] - at_b[0] == len(at_a) - 1 and (k_a == k_b).all():
        return len(at_a) + SEED - 1  # one run on both sides
    return sum(n for *_, n in tile(_pieces(a, at_a, 0), _pieces(b, at_b, 1)))


def _match(w: Words, block: Block, threshold: float) -> list[tuple[int, int, float]]:
    """(document, item, coverage): for each document the most covered item and all that are covered to ``threshold``."""
    out: list[tuple[int, int, float]] = []
    for width, (keys, items) in block.short.items():
        h = rolling(w.hash, width)
        lo, hi = np.searchsorted(keys, h, side="left"), np.searchsorted(keys, h, side="right")
        at = np.flatnonzero(lo < hi)
        doc = np.searchsorted(w.bounds, at, side="right") - 1
        ok = at + width <= w.bounds[doc + 1]
        at, doc = at[ok], doc[ok]
        pairs = np.unique(np.column_stack((doc, lo[at], hi[at])), axis=0)
        out += [(d, int(items[i]), 1.0) for d, a, z in pairs.tolist() for i in range(a, z)]
    if not len(block.seeds):
        return out
    h = rolling(w.hash, SEED)
    at = np.flatnonzero(block.flags[(h >> U64(44)).astype(np.int64)])
    k = np.minimum(np.searchsorted(block.seeds, h[at]), len(block.seeds) - 1)
    doc = np.searchsorted(w.bounds, at, side="right") - 1
    ok = (block.seeds[k] == h[at]) & (at + SEED <= w.bounds[doc + 1])
    at, k, doc = at[ok], k[ok], doc[ok]
    cuts = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        d = int(doc[lo])
        own = w.hash[w.bounds[d] : w.bounds[d + 1]]
        out += [(d, item, share) for item, share in _against(own, at[lo:hi] - w.bounds[d], k[lo:hi], block, threshold)]
    return out


def _against(own: np.ndarray, at: np.ndarray, k: np.ndarray, block: Block, threshold: float) -> Iterator[tuple[int, float]]:
    distinct = np.unique(k)
    where = ranges(block.first[distinct], block.first[distinct + 1])
    seed = np.repeat(distinct, block.first[distinct + 1] - block.first[distinct])
    order = np.argsort(block.places[where], kind="stable")
    where, seed = where[order], seed[order]
    place, item = block.places[where], block.item[where]
    # What the shared seeds of an item cover together bounds what tiles can cover.
    size = np.minimum(np.where(np.diff(item, append=-1) == 0, np.diff(place, append=0), SEED), SEED)
    starts = np.flatnonzero(np.diff(item, prepend=-1))
    stops = np.append(starts[1:], len(item))
    items = item[starts]
    length = block.bounds[items + 1] - block.bounds[items]
    bound = np.add.reduceat(size, starts) / length
    best = 0.0
    for i in np.argsort(-bound, kind="stable").tolist():
        if bound[i] <= best and bound[i] < threshold:
            return
        lo, hi, t = starts[i], stops[i], int(items[i])
        mine = np.isin(k, seed[lo:hi])
        b = block.tokens[block.bounds[t] : block.bounds[t + 1]]
        share = _coverage(own, at[mine], k[mine], b, place[lo:hi] - block.bounds[t], seed[lo:hi]) / len(b)
        best = max(best, share)
        yield t, share


def _check(batches: Iterator[pa.RecordBatch], block: Block, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        rest = batch.columns[2:]
        for lo, hi in slices(texts):
            cover, items = np.zeros(hi - lo), [[] for _ in range(hi - lo)]
            for d, item, share in _match(Words(texts[lo:hi], ALNUM), block, threshold):
                cover[d] = max(cover[d], share)
                if share >= threshold:
                    items[d].append(block.ids[item])
            hit = [sorted(x, key=lambda v: (v is None, v)) for x in items]
            yield pa.record_batch(
                [
                    ids.slice(lo, hi - lo),
                    pa.array(np.round(cover, 9), pa.float64()),
                    pa.array(hit, pa.list_(pa.int64())),
                    pa.array([bool(x) for x in hit], pa.bool_()),
                    *[c.slice(lo, hi - lo) for c in rest],
                ],
                names=["id", "coverage", "items", "contaminated", *batch.schema.names[2:]],
            )


def _blocks(benchmark: DataFrame, text_col: str, id_col: str) -> Iterator[tuple[Block, bool]]:
    """Blocks of the query set and whether each is the last, read item by item: the driver holds one block at a time."""
    ids, texts, size = [], [], 0
    rows = pick(benchmark, id=id_col, text=text_col).select(F.col("id").cast("long"), F.col("text").cast("binary")).toLocalIterator()
    for key, text in rows:
        n = len(text or b"") + 1
        if ids and size + n > BLOCK_BYTES:
            yield make_block(ids, texts), False
            ids, texts, size = [], [], 0
        ids.append(key)
        texts.append(bytes(text) if text is not None else None)
        size += n
    yield make_block(ids, texts), True


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id",
    item_text_col: str = "text", item_id_col: str = "item_id", threshold: float = 0.5,
) -> DataFrame:
    """id, largest coverage of an item, ids of the items covered to ``threshold`` and whether there are any, for each row."""
    sc = docs.sparkSession.sparkContext
    base = pick(docs, id=id_col, text=text_col).select("id", F.col("text").cast("binary").alias("text"))
    kind = dict(base.dtypes)["id"]
    schema = f"id {kind}, coverage double, items array<long>, contaminated boolean"

    def against(df: DataFrame, b, more: str = "") -> DataFrame:
        return df.mapInArrow(lambda it: _check(it, b.value, threshold), schema + more)

    keyed = out = None
    for block, last in _blocks(benchmark, item_text_col, item_id_col):
        held = sc.broadcast(block)
        if last and out is None:
            return against(base, held).withColumnRenamed("id", id_col)
        if keyed is None:  # a row number keeps repeated rows apart while the blocks' results meet
            keyed = written(base.withColumn("row", F.monotonically_increasing_id()))
        part = written(against(keyed, held, ", row long").where("coverage > 0"))
        held.destroy()
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("row").agg(
        F.max("coverage").alias("coverage"), F.array_sort(F.flatten(F.collect_list("items"))).alias("items"), F.max("contaminated").alias("contaminated")
    )
    none = F.array().cast("array<long>")
    return keyed.select("id", "row").join(best, "row", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
    )


def _keep_clean(batches: Iterator[pa.RecordBatch], block: Block, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
        for lo, hi in slices(texts):
            clean = np.ones(hi - lo, bool)
            for d, _, share in _match(Words(texts[lo:hi], ALNUM), block, threshold):
                clean[d] &= share < threshold
            yield batch.slice(lo, hi - lo).filter(pa.array(clean))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, item_text_col: str = "text", item_id_col: str = "item_id", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (column ``text``) that no benchmark item contaminates, with all their columns."""
    text_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    for block, last in _blocks(benchmark, item_text_col, item_id_col):
        held = sc.broadcast(block)
        docs = docs.mapInArrow(lambda it, held=held: _keep_clean(it, held.value, threshold), docs.schema)
        if not last:  # one block at a time: what is left is written before the next one comes
            docs = written(docs)
            held.destroy()
    return docs
