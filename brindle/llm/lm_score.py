"""Language-model scoring by cross-entropy difference.

A target model (texts with a label ``quality = 1``) and a background model (all texts) are word bigram models over one
shared vocabulary, smoothed alike: P(w | p) = (n(p, w) + MU * P(w)) / (n(p) + MU), P(w) = (n(w) + 1) / (n + V + 1); the vocabulary
is every word of all texts, and each text begins after a start mark.  A token's loss is -ln P; a document's score is
the mean over its tokens of target loss minus background loss, so lower is closer to the target.

Every word and every bigram counts, however rare, and no model is gathered or broadcast.  Texts are dealt into chunks of some
megabytes, written once as compressed rows.  A chunk counts its distinct words and bigrams and sends them to shards, which are ranges of the keys' hashes; a shard sums
what it gets and answers each chunk with the whole table's counts of the keys it asked for; the chunk's texts meet the answers and
are scored.  Sums are exact, so scores don't depend on the number of partitions.  A frequent word is one entry for each chunk, so no shard is larger than others, and the number of shards follows the
input.  Only four totals and the number of distinct words reach the driver.

Defined results: null and empty texts have 0 tokens, losses and score 0; without target texts both models are
the background, so scores are 0; a document with several labels is a target if one of them says so; repeated rows count and are
scored as often as they come; other columns are ignored.  Words and bigrams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import parallelism, pick, small, written
from ._words import FOLDED, U64, Words, mix, trim_memory

MU = 20.0
#: Bytes of text in a chunk (a longer text stands alone), and of the whole input for each shard.
CHUNK_BYTES = 8 << 20
SHARD_BYTES = 8 << 20
_START = U64(0x5851F42D4C957F2D)
_ODD = U64(0xD1342543DE82EF95)


class _Chunk:
    """Distinct words and bigrams of several texts, sorted, and which of them each token is."""

    def __init__(self, texts: list[bytes | None]):
        self.words = w = Words(texts, FOLDED)
        before = np.empty_like(w.hash)
        before[1:] = w.hash[:-1]
        self.starts = w.bounds[:-1][w.counts > 0]
        before[self.starts] = _START
        self.word_keys, self.word = np.unique(w.hash, return_inverse=True)
        self.bigram_keys, self.bigram = np.unique(mix(before * _ODD + w.hash), return_inverse=True)


def _packed(x: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers with their bytes in planes, the low ones first, compressed: of small numbers most planes are zeros."""
    data = x.astype(kind).view(np.uint8).reshape(len(x), -1).T.tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def _planes(data: bytes, kind: str) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _unpacked(data: bytes, kind: str = "<u4") -> np.ndarray:
    return _planes(data, kind).astype(np.int64)


def _steps(words: np.ndarray, bigrams: np.ndarray) -> bytes:
    """Two sorted runs of keys as the steps between neighbours (modulo 2**64), which are smaller."""
    both = np.concatenate((words, bigrams))
    return _packed(np.diff(both, prepend=U64(0)), "<u8")


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(_planes(data, "<u8"), dtype=U64)


_TOTALS = ("tokens", "target_tokens", "starts", "target_starts")
_CHUNK = "chunk long, docs binary"
_ASKED = "chunk long, shard long, words long, keys binary, t binary, b binary, " + ", ".join(f"{c} long" for c in _TOTALS)


def _dealt(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Texts in chunks of about ``most`` bytes: a row for each, with its ids, texts and target marks as a compressed Arrow stream."""
    number = TaskContext.get().partitionId() << 33
    waiting, size = [], 0

    def done() -> pa.RecordBatch:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, waiting[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(pa.Table.from_batches(waiting).combine_chunks())
        return pa.record_batch({"chunk": pa.array([number], pa.int64()), "docs": pa.array([out.getvalue().to_pybytes()], pa.binary())})

    for batch in batches:
        ends = np.cumsum(np.array([len(x or b"") + 1 for x in batch.column(1).to_pylist()], np.int64))
        lo = 0
        while lo < batch.num_rows:
            past = int(ends[lo - 1]) if lo else 0
            hi = max(lo + (not waiting), int(np.searchsorted(ends, past + most - size, side="right")))
            if hi > lo:
                waiting.append(batch.slice(lo, hi - lo))
                size += int(ends[hi - 1]) - past
            if hi < batch.num_rows:
                yield done()
                waiting, size, number = [], 0, number + 1
            lo = hi
    if waiting:
        yield done()
    trim_memory()


def _opened(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _asked(chunk: int, docs: pa.Table, bits: int) -> pa.RecordBatch:
    """A row for each shard: the chunk's word and bigram keys there and the counts of both; the first row has the chunk's totals."""
    texts, target = docs.column(1).to_pylist(), docs.column(2).to_numpy()
    c = _Chunk(texts)
    n = c.words.counts
    one = np.repeat(target.astype(np.float64), n)
    edges = np.arange(1, 1 << bits, dtype=U64) << U64(64 - bits)
    sides = []
    for keys, inv in ((c.word_keys, c.word), (c.bigram_keys, c.bigram)):
        t, b = np.bincount(inv, weights=one, minlength=len(keys)), np.bincount(inv, minlength=len(keys))
        sides.append((keys, t, b, np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))))
    (wk, wt, wb, wc), (bk, bt, bb, bc) = sides
    used = np.flatnonzero((wc[:-1] < wc[1:]) | (bc[:-1] < bc[1:])).tolist()
    joined = lambda x, y, i: np.concatenate((x[wc[i] : wc[i + 1]], y[bc[i] : bc[i + 1]]))
    totals = (n.sum(), n[target].sum(), (n > 0).sum(), (n[target] > 0).sum())
    return pa.record_batch(
        {
            "chunk": pa.array([chunk] * len(used), pa.int64()),
            "shard": pa.array(used, pa.int64()),
            "words": pa.array([int(wc[i + 1] - wc[i]) for i in used], pa.int64()),
            "keys": pa.array([_steps(wk[wc[i] : wc[i + 1]], bk[bc[i] : bc[i + 1]]) for i in used], pa.binary()),
            "t": pa.array([_packed(joined(wt, bt, i)) for i in used], pa.binary()),
            "b": pa.array([_packed(joined(wb, bb, i)) for i in used], pa.binary()),
            **{k: pa.array([int(x)][: len(used)] + [0] * (len(used) - 1), pa.int64()) for k, x in zip(_TOTALS, totals, strict=True)},
        }
    )


def _ask(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield _asked(chunk, _opened(data.as_buffer()), bits)
    trim_memory()


def _answered(rows: pa.Table) -> pa.Table:
    """A shard's answers: each chunk's keys counted over all chunks; and a row with the number of distinct words and the totals of chunks."""
    words = rows.column("words").to_numpy()
    keys = [_keys(k) for k in rows.column("keys").to_pylist()]
    t, b = ([_unpacked(x) for x in rows.column(c).to_pylist()] for c in ("t", "b"))
    size = np.array([len(k) for k in keys])
    first = np.concatenate(([0], np.cumsum(size)))
    is_word = np.arange(first[-1]) - np.repeat(first[:-1], size) < np.repeat(words, size)
    keys, t, b = np.concatenate(keys), np.concatenate(t), np.concatenate(b)
    all_t, all_b, distinct = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64), 0
    for kind in (True, False):
        at = np.flatnonzero(is_word == kind)
        own, inv = np.unique(keys[at], return_inverse=True)
        for x, out in ((t, all_t), (b, all_b)):
            out[at] = np.bincount(inv, weights=x[at], minlength=len(own)).astype(np.int64)[inv]
        if kind:
            distinct = len(own)
    wide = bool(all_b.max() >= 1 << 32)
    cuts = list(zip(first[:-1], first[1:], strict=True))
    pack = lambda x: pa.array([_packed(x[lo:hi], "<u8" if wide else "<u4") for lo, hi in cuts] + [None], pa.binary())
    none = pa.nulls(len(cuts), pa.int64()).to_pylist()
    shard = rows.column("shard").to_pylist()
    out = pa.table(
        {
            "chunk": pa.array(rows.column("chunk").to_pylist() + [None], pa.int64()),
            "shard": pa.array(shard + shard[:1], pa.int64()),
            "words": pa.array(words.tolist() + [distinct], pa.int64()),
            "wide": pa.array([wide] * (len(cuts) + 1), pa.bool_()),
            "t": pack(all_t),
            "b": pack(all_b),
            **{k: pa.array(none + [pc.sum(rows.column(k)).as_py()], pa.int64()) for k in _TOTALS},
        }
    )
    del keys, t, b, all_t, all_b
    trim_memory()
    return out


_ANSWER = "chunk long, shard long, words long, wide boolean, t binary, b binary, " + ", ".join(f"{c} long" for c in _TOTALS)


@dataclass(frozen=True)
class Totals:
    """Over the whole table: distinct words, tokens and non-empty texts, the last two for target and background."""

    words: int
    tokens: tuple[int, int]
    starts: tuple[int, int]


def _scored(held: pa.Table, answers: pa.Table, totals: Totals) -> pa.Table:
    docs = _opened(held.column("docs").chunk(0)[0].as_buffer())
    texts = docs.column("text").to_pylist()
    c = _Chunk(texts)
    n = c.words.counts
    answers = answers.sort_by("shard")
    words, wide = answers.column("words").to_pylist(), answers.column("wide").to_pylist()
    losses = []
    for col, tokens, starts in zip(("t", "b"), totals.tokens, totals.starts, strict=True):
        if col == "t" and tokens == 0:
            continue
        got = [_unpacked(x, "<u8" if big else "<u4") for x, big in zip(answers.column(col).to_pylist(), wide, strict=True)]
        none = [np.empty(0, np.int64)]
        word = np.concatenate([g[:k] for g, k in zip(got, words, strict=True)] + none)[c.word].astype(float)
        bigram = np.concatenate([g[k:] for g, k in zip(got, words, strict=True)] + none)[c.bigram]
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[c.starts] = starts
        losses.append(-np.log((bigram + MU * (word + 1) / (tokens + totals.words + 1)) / (before + MU)))
    lt, lb = losses[0], losses[-1]
    doc = c.words.doc_of()
    mean = lambda x: np.round(np.bincount(doc, weights=x, minlength=len(n)) / np.maximum(n, 1), 9)
    out = pa.table(
        {
            "id": docs.column("id"),
            "n_tokens": pa.array(n, pa.int64()),
            "target_loss": pa.array(mean(lt), pa.float64()),
            "background_loss": pa.array(mean(lb), pa.float64()),
            "score": pa.array(mean(lt - lb), pa.float64()),
        }
    )
    del c, texts, losses, lt, lb, doc
    trim_memory()
    return out


def score_language(docs: DataFrame, targets: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, tokens, mean losses and their difference for each row; ``targets`` holds the ids of target documents."""
    spark = docs.sparkSession
    base = pick(docs, id=id_col, text=text_col).select("id", F.col("text").cast("binary").alias("text"))
    ids = written(pick(targets, id=id_col).where("id is not null").distinct().withColumn("target", F.lit(True)))
    texts = base.join(small(ids), "id", "left").select("id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    kind = dict(base.dtypes)["id"]
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most, bits = CHUNK_BYTES, max(6, (size // SHARD_BYTES).bit_length())
    # Written once: what was asked for a chunk and its texts must come from the same dealing.
    held = written(texts.mapInArrow(lambda it: _dealt(it, most), _CHUNK))
    parts = lambda groups: max(parallelism(spark), groups)  # a task for each: its size stays that of a shard or chunk
    asked = held.mapInArrow(lambda it: _ask(it, bits), _ASKED).repartition(parts(1 << bits), "shard")
    answers = written(asked.groupBy("shard").applyInArrow(_answered, _ANSWER))
    s = answers.where("chunk is null").agg(F.sum("words"), *[F.sum(c) for c in _TOTALS]).first()
    words, tokens, target_tokens, starts, target_starts = (x or 0 for x in s)
    totals = Totals(words, (target_tokens, tokens), (target_starts, starts))
    n = parts(held.count())
    left = held.repartition(n, "chunk").groupBy("chunk")
    right = answers.where("chunk is not null").select("chunk", "shard", "words", "wide", "t", "b").repartition(n, "chunk").groupBy("chunk")
    out = f"id {kind}, n_tokens long, target_loss double, background_loss double, score double"
    return left.cogroup(right).applyInArrow(lambda d, a: _scored(d, a, totals), out).withColumnRenamed("id", id_col)
