"""Ranked lexical search over inverted treaps.

Queries come in blocks of a bounded number of terms; a block reads the documents once.  Each document is cut into terms and leaves one row: its number of terms and which of the block's
terms it holds how often.  Document frequencies and lengths are counted over all rows, then each task takes its rows in chunks and inverts them: a term's postings form a treap, in doc_id order as a
search tree and in impact order as a heap (equal impacts by a hash, so that it stays shallow), where an impact is what the term adds to the document's score.

All queries of a batch go down their terms' treaps together.  A query's frontier is a list of ranges of documents, each with one subtree for every term that occurs in it; the sum of the subtrees' top impacts
bounds every score in the range.  A range whose bound is below the k-th best score so far is dropped.  From the others the document of the largest impact is scored exactly, by a search in each treap,
which at the same time splits the subtrees for the ranges on both sides.  The best k and their bound go on from chunk to chunk within a task; tasks' best meet in one ranking.

``search`` scores as follows.  Terms are maximal runs of ASCII letters and digits and characters from U+0080 on, only A-Z lower-cased.  N documents have a term, L terms in all, n in a document; df documents hold a term, which
occurs tf times in one.  w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 25 + (75 n N) div L, and a document's score is the sum of w * ((10^9 tf) div (1000 tf + 8 m)) over the query's terms, repeats
included.  Everything after w is 64-bit integer arithmetic.

Defined results: null texts have no terms; a query without terms, or whose terms are in no document, has no rows; only scores above 0 count; equal scores rank by ascending doc_id, null ids last; a row of a repeated doc_id is a document of
its own, a row of a repeated item_id a query of its own (with ranks of its own); an empty table on either side gives no rows; other columns are ignored.  Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StructField, StructType

from ._common import discard, pick, written
from ._words import ALNUM, U64, Words, mix, slices, trim_memory

BEST = 10
#: Terms of the queries in a block; a longer query stands alone.
BLOCK_TERMS = 500_000
#: Postings of a chunk of documents, and entries of the frontier that a batch of queries begins with.
CHUNK_POSTINGS = 1 << 18
BATCH_TERMS = 2048
_NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Block:
    """Some queries: their ids, the distinct terms of all, and each query's terms as (query, term, repeats) in query order."""

    items: list
    terms: np.ndarray
    query: np.ndarray
    term: np.ndarray
    repeats: np.ndarray


def _block(items: list, hashes: list[np.ndarray]) -> Block:
    terms = np.unique(np.concatenate(hashes))
    own = [np.unique(h, return_counts=True) for h in hashes]
    query = np.repeat(np.arange(len(own)), [len(h) for h, _ in own])
    return Block(items, terms, query, np.searchsorted(terms, np.concatenate([h for h, _ in own])), np.concatenate([n for _, n in own]).astype(np.int64))


def blocks(queries: DataFrame) -> Iterator[Block]:
    """Queries (item, text) as blocks; one at a time is on the driver."""
    items, hashes, size = [], [], 0
    for row in queries.toLocalIterator():
        h = Words([(row["text"] or "").encode("utf-8", "surrogatepass")], ALNUM).hash
        if not len(h):
            continue
        if items and size + len(h) > BLOCK_TERMS:
            yield _block(items, hashes)
            items, hashes, size = [], [], 0
        items.append(row["item"])
        hashes.append(h)
        size += len(h)
    if items:
        yield _block(items, hashes)


def _indexed(terms: np.ndarray):
    """Documents (id, text) as rows (id, n, terms, tfs) of the block's terms; a document without any term has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in slices(texts):
                w = Words(texts[lo:hi], ALNUM)
                at = np.minimum(np.searchsorted(terms, w.hash), len(terms) - 1)
                hit = terms[at] == w.hash
                key, tf = np.unique(w.doc_of()[hit] * len(terms) + at[hit], return_counts=True)
                doc = key // len(terms)
                bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (key % len(terms), tf)]
                rows = pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(w.counts, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])
                yield rows.filter(pa.array(w.counts > 0))
            trim_memory()

    return run


class Treaps:
    """The treaps of a chunk's terms over its documents, which are numbered by ascending id."""

    def __init__(self, ids: np.ndarray, n_terms: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        order = np.lexsort((doc, term))
        self.ids, self.doc, self.impact = ids, doc[order], impact[order]
        bounds = np.searchsorted(term[order], np.arange(n_terms + 1))
        # Impacts are below 2^42 (w < 2^16 and a quotient below 2^20, with room); the low bits only part equal ones.
        heap = ((self.impact << 20) | (mix(self.doc.astype(U64) + U64(1)) >> U64(44)).astype(np.int64)).tolist()
        left, right, root = [-1] * len(heap), [-1] * len(heap), np.full(n_terms, -1)
        for t in np.flatnonzero(np.diff(bounds)).tolist():
            path: list[int] = []
            for p in range(int(bounds[t]), int(bounds[t + 1])):
                under, mine = -1, heap[p]
                while path and heap[path[-1]] < mine:
                    under = path.pop()
                left[p] = under
                if path:
                    right[path[-1]] = p
                path.append(p)
            root[t] = path[0]
        self.left, self.right, self.root = np.array(left, np.int64), np.array(right, np.int64), root

    def _onward(self, node: np.ndarray, child: np.ndarray, outside) -> np.ndarray:
        """From each node down by ``child`` until it is no longer ``outside`` its range."""
        node = node.copy()
        at = np.flatnonzero(node >= 0)
        while len(at):
            at = at[outside(self.doc[node[at]], at)]
            node[at] = child[node[at]]
            at = at[node[at] >= 0]
        return node

    def split(self, node: np.ndarray, pivot: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each subtree the posting of ``pivot``, and the tops of what lies in [lo, pivot) and (pivot, hi); -1 for none.

        In heap order the top of a range is the first node of it on the way to its border.
        """
        same, below, above = (np.full(len(node), -1) for _ in range(3))
        now, at = node.copy(), np.arange(len(node))
        while len(at):
            p = now[at]
            d, to = self.doc[p], pivot[at]
            less, more = d < to, d > to
            first = less & (below[at] < 0) & (d >= lo[at])
            below[at[first]] = p[first]
            first = more & (above[at] < 0) & (d < hi[at])
            above[at[first]] = p[first]
            found = ~less & ~more
            same[at[found]] = p[found]
            now[at] = np.where(less, self.right[p], self.left[p])
            at = at[~found & (now[at] >= 0)]
        f = np.flatnonzero((same >= 0) & (below < 0))
        below[f] = self._onward(self.left[same[f]], self.right, lambda d, i: d < lo[f[i]])
        f = np.flatnonzero((same >= 0) & (above < 0))
        above[f] = self._onward(self.right[same[f]], self.left, lambda d, i: d >= hi[f[i]])
        return same, below, above


class Best:
    """The best ``k`` (score, id) of each query so far, best first; a score of 0 is an empty place."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.zeros((n, k), np.int64), np.full((n, k), _NONE)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        fits = score >= np.maximum(self.score[query, -1], 1)
        if not fits.any():
            return
        query, score, ids = query[fits], score[fits], ids[fits]
        touched, k = np.unique(query), self.score.shape[1]
        q = np.concatenate((query, np.repeat(touched, k)))
        s, i = np.concatenate((score, self.score[touched].ravel())), np.concatenate((ids, self.id[touched].ravel()))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < k
        self.score[touched], self.id[touched] = s[top].reshape(-1, k), i[top].reshape(-1, k)


def traverse(treaps: Treaps, query: np.ndarray, term: np.ndarray, repeats: np.ndarray, best: Best) -> int:
    """Add the best documents of a chunk for all queries (query, term, repeats); returns how many documents were scored."""
    node = treaps.root[term]
    some = node >= 0
    node, times = node[some], repeats[some]
    owners, owner = np.unique(query[some], return_inverse=True)
    lo, hi, scored = np.zeros(len(owners), np.int64), np.full(len(owners), len(treaps.ids), np.int64), 0
    while len(node):
        # Entries stand in order of their range; each range has one at least.
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        value = times * treaps.impact[node]
        bound = np.add.reduceat(value, first)
        go = bound >= np.maximum(best.score[owners, -1], 1)
        keep = go[owner]
        node, times, value, owner = node[keep], times[keep], value[keep], (np.cumsum(go) - 1)[owner[keep]]
        owners, lo, hi = owners[go], lo[go], hi[go]
        if not len(node):
            break
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        top = np.flatnonzero(value == np.maximum.reduceat(value, first)[owner])
        pivot = treaps.doc[node[top[np.flatnonzero(np.append(True, owner[top][1:] != owner[top][:-1]))]]]
        same, below, above = treaps.split(node, pivot[owner], lo[owner], hi[owner])
        score = np.add.reduceat(np.where(same >= 0, times * treaps.impact[same], 0), first)
        best.add(owners, score, treaps.ids[pivot])
        scored += len(pivot)
        b, a = np.flatnonzero(below >= 0), np.flatnonzero(above >= 0)
        place = np.concatenate((2 * owner[b], 2 * owner[a] + 1))
        order = np.argsort(place, kind="stable")
        ranges, owner = np.unique(place[order], return_inverse=True)
        node, times = np.concatenate((below[b], above[a]))[order], np.concatenate((times[b], times[a]))[order]
        was, right = ranges // 2, ranges % 2 == 1
        owners, lo, hi = owners[was], np.where(right, pivot[was] + 1, lo[was]), np.where(right, hi[was], pivot[was])
    return scored


def _batches_of(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The block's (query, term, repeats) in runs of whole queries."""
    starts = np.flatnonzero(np.append(True, block.query[1:] != block.query[:-1]))
    cuts, lo = [0], 0
    for s in starts.tolist()[1:]:
        if s - lo >= BATCH_TERMS:
            cuts.append(s)
            lo = s
    for a, b in zip(cuts, [*cuts[1:], len(block.query)], strict=True):
        yield block.query[a:b], block.term[a:b], block.repeats[a:b]


def _searched(block: Block, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """Rows (id, n, terms, tfs) as a task's best (query, id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, size = Best(len(block.items), k), [], 0

        def chunk() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = rows["id"].fill_null(_NONE).to_numpy()
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            lists = rows["terms"].combine_chunks()
            doc = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            term, tf = lists.flatten().to_numpy().astype(np.int64), rows["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
            m = 25 + (75 * rows["n"].to_numpy() * n_docs) // n_terms
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            treaps = Treaps(ids[order], len(block.terms), place[doc], term, impact)
            for some in _batches_of(block):
                traverse(treaps, *some, best)

        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= CHUNK_POSTINGS:
                chunk()
                held, size = [], 0
        if held:
            chunk()
        query, at = np.nonzero(best.score)
        found = best.id[query, at]
        yield pa.record_batch([pa.array(query, pa.int64()), pa.array(found, pa.int64(), mask=found == _NONE), pa.array(best.score[query, at], pa.int64())], names=["query", "id", "score"])

    return run


def _block_results(base: DataFrame, block: Block, item_type: DataType, k: int) -> DataFrame | None:
    """(item, rank, id, score) of one block, written."""
    spark = base.sparkSession
    index = written(base.mapInArrow(_indexed(block.terms), "id long, n long, terms array<int>, tfs array<int>"))
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        discard(index)
        return None
    # One row for each of the block's terms.
    held = index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toPandas()
    df = np.zeros(len(block.terms), np.int64)
    df[held["t"].to_numpy()] = held["df"].to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    found = index.mapInArrow(_searched(block, weights, n_docs, n_terms, k), "query long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    names = spark.createDataFrame(list(enumerate(block.items)), StructType([StructField("query", LongType()), StructField("item", item_type)]))
    # As many names as the block has queries.
    out = written(found.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "query").select("item", "rank", "id", "score"))
    discard(index)
    return out


def search(
    docs: DataFrame, queries: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(item, rank, doc, score): the ``k`` best documents of each query, all with a score above 0 if fewer, under the given id columns' names."""
    spark = docs.sparkSession
    base = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = pick(queries, item=item_col, text=item_text_col)
    item_type, out = asked.schema["item"].dataType, None
    for block in blocks(asked):
        found = _block_results(base, block, item_type, k)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], StructType([StructField("item", item_type), StructField("rank", IntegerType()), StructField("id", LongType()), StructField("score", LongType())]))
    return out.withColumnsRenamed({"item": item_col, "id": id_col})
