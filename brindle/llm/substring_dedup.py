"""Exact substring dedup by fixed-block anchors.

A window is ``width`` consecutive words.  Any window holds a whole aligned block of ``(width + 1) // 2`` words of its own document.
So the non-overlapping blocks of all documents are indexed, and every rolling block-sized window of every document probes
the index: where two equal windows stand, the block in one meets a rolling window in the other.

1. Each group of documents sends the distinct hashes of its rolling windows and of its blocks, cut into buckets by hash, as
   sorted differences (about four bytes each).  A bucket answers with the hashes that are a block somewhere and stand in two places.
2. A group extends its hits: every ``width``-word window around a hit is a candidate and is sent by a 96-bit hash;
   buckets answer with those that start in two places: the maximal exact repeats are their union.
3. A group marks the words of repeated windows and keeps the others.

Groups hold about ``group_bytes`` of text and buckets about a million hashes, so both follow the input.  A passage with a
million copies is one hash for each group, never a group of copies in one place.  What short hashes of step 1 take
for equal only costs candidates; step 2 decides.

Defined results: null and empty texts have no words, nothing removed and the digest of the empty string; documents shorter than a window keep all
words; repeated rows count as two places each; an empty table gives no rows; other columns are ignored.  Words and windows are told
apart by hashes of 64 and 96 bits.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pick, written
from ._words import PLAIN, U64, Words, mix, rolling, slices

BUCKET_WORDS = 1 << 20
REST_BITS = 40
_SKIP = (1 << 32) - 1
_SECOND = 0xE7037ED1A0B428DB | 1


def pack(values: np.ndarray) -> bytes:
    """Ascending distinct integers below 2**REST_BITS as 32-bit differences; ``_SKIP`` steps on without a value."""
    steps = np.diff(values, prepend=U64(0)) if len(values) else values
    skips = (steps // U64(_SKIP)).astype(np.int64)
    out = np.full(len(values) + int(skips.sum()), _SKIP, "<u4")
    out[np.cumsum(skips + 1) - 1] = steps % U64(_SKIP)
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, "<u4")
    return np.cumsum(steps.astype(U64))[steps != _SKIP]


def _windows(w: Words, width: int, base: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows inside documents, and where they start in ``w``."""
    h = rolling(w.hash, width) if base is None else rolling(w.hash, width, base)
    room = np.maximum(w.counts - width + 1, 0)
    at = np.repeat(w.bounds[:-1] - np.concatenate(([0], np.cumsum(room)[:-1])), room) + np.arange(int(room.sum()))
    return h[at], at


def _short(h: np.ndarray, buckets: int) -> np.ndarray:
    return h >> U64(64 - REST_BITS - (buckets.bit_length() - 1))


def _probe(table: pa.Table, block: int, buckets: int) -> pa.Table:
    """A group's rolling windows and blocks, by bucket."""
    texts = table.column("text").to_pylist()
    probes, blocks = [], []
    for lo, hi in slices(texts, 8 << 20):
        w = Words(texts[lo:hi], PLAIN)
        h, at = _windows(w, block)
        h = _short(h, buckets)
        doc = np.searchsorted(w.bounds, at, side="right") - 1
        probes.append(h)
        blocks.append(h[(at - w.bounds[doc]) % block == 0])
    values, counts = np.unique(np.concatenate(probes), return_counts=True)
    index = np.unique(np.concatenate(blocks))
    many = values[counts > 1]
    edges = np.arange(buckets + 1, dtype=U64) << U64(REST_BITS)
    mask = U64((1 << REST_BITS) - 1)
    cut = [np.searchsorted(x, edges[:-1]).tolist() + [len(x)] for x in (values, index, many)]
    used = [b for b in range(buckets) if cut[0][b] < cut[0][b + 1]]
    col = lambda x, c: pa.array([pack(x[c[b] : c[b + 1]] & mask) for b in used], pa.binary())
    grp = table.column("grp")[0].as_py()
    return pa.table(
        {"bucket": pa.array(used, pa.int64()), "grp": pa.array([grp] * len(used), pa.int64()), "probes": col(values, cut[0]), "blocks": col(index, cut[1]), "many": col(many, cut[2])}
    )


def _meet(table: pa.Table) -> pa.Table:
    """Of a bucket: the probes of each group that are a block of some document and stand in two places."""
    parts = [unpack(x) for x in table.column("probes").to_pylist()]
    who = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    values = np.concatenate(parts)
    order = np.argsort(values, kind="stable")
    values, who = values[order], who[order]
    first = np.append(True, values[1:] != values[:-1])
    at = np.flatnonzero(first)
    distinct = values[at]
    twice = np.diff(np.append(at, len(values))) > 1
    many, index = (np.unique(np.concatenate([unpack(x) for x in table.column(c).to_pylist()])) for c in ("many", "blocks"))
    twice[np.searchsorted(distinct, many)] = True
    indexed = np.zeros(len(distinct), bool)
    indexed[np.searchsorted(distinct, index)] = True
    hit = (twice & indexed)[np.cumsum(first) - 1]
    values, who = values[hit], who[hit]
    order = np.argsort(who, kind="stable")
    values, who = values[order], who[order]
    cuts = np.searchsorted(who, np.arange(len(parts) + 1))
    used = [i for i in range(len(parts)) if cuts[i] < cuts[i + 1]]
    bucket = table.column("bucket")[0].as_py()
    return pa.table(
        {
            "grp": pa.array([table.column("grp")[i].as_py() for i in used], pa.int64()),
            "bucket": pa.array([bucket] * len(used), pa.int64()),
            "hits": pa.array([pack(values[cuts[i] : cuts[i + 1]]) for i in used], pa.binary()),
        }
    )


_KEY = np.dtype([("a", "<u8"), ("b", "<u4")])


def _keys(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The 96-bit hashes of all windows (as records) and their starts."""
    a, at = _windows(w, width)
    b, _ = _windows(w, width, _SECOND)
    out = np.empty(len(a), _KEY)
    out["a"], out["b"] = a, b >> U64(32)
    return out, at


def _member(h: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(h), bool)
    k = np.minimum(np.searchsorted(sorted_values, h), len(sorted_values) - 1)
    return sorted_values[k] == h


def _covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie within ``width`` from one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge)[:n] > 0


def _extend(docs: pa.Table, hits: pa.Table, width: int, block: int, buckets: int) -> pa.Table:
    """Candidate windows of a group: all that hold a hit, by bucket, distinct, with a mark for those in two places of the group."""
    found = [unpack(x) | (U64(b) << U64(REST_BITS)) for x, b in zip(hits.column("hits").to_pylist(), hits.column("bucket").to_pylist(), strict=True)]
    empty = {"bucket": pa.int64(), "grp": pa.int64(), "keys": pa.binary(), "many": pa.binary()}
    if not found or not docs.num_rows:
        return pa.table({k: pa.array([], t) for k, t in empty.items()})
    known, texts, parts = np.sort(np.concatenate(found)), docs.column("text").to_pylist(), []
    for lo, hi in slices(texts, 8 << 20):
        w = Words(texts[lo:hi], PLAIN)
        h, at = _windows(w, block)
        hit = at[_member(_short(h, buckets), known)]
        if not len(hit):
            continue
        keys, start = _keys(w, width)
        near = np.zeros(len(w.hash) + 1, np.int64)  # a window starting in [hit - (width - block), hit] holds the hit
        np.add.at(near, np.maximum(hit - (width - block), 0), 1)
        np.add.at(near, hit + 1, -1)
        parts.append(keys[(np.cumsum(near) > 0)[start]])
    keys = np.concatenate(parts) if parts else np.empty(0, _KEY)
    order = np.lexsort((keys["b"], keys["a"]))
    keys = keys[order]
    first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    at = np.flatnonzero(first)
    many = np.diff(np.append(at, len(keys))) > 1
    keys = keys[at]
    bucket = (mix(keys["a"]) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    keys, many = keys[order], many[order]
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
    used = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    return pa.table(
        {
            "bucket": pa.array(used, pa.int64()),
            "grp": pa.array([docs.column("grp")[0].as_py()] * len(used), pa.int64()),
            "keys": pa.array([keys[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary()),
            "many": pa.array([np.packbits(many[cuts[b] : cuts[b + 1]]).tobytes() for b in used], pa.binary()),
        }
    )


def _repeated(table: pa.Table) -> pa.Table:
    """Of a bucket: the candidate windows of each group that start in two places."""
    parts = [np.frombuffer(x, _KEY) for x in table.column("keys").to_pylist()]
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(table.column("many").to_pylist(), parts, strict=True)]).astype(bool)
    who = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    keys = np.concatenate(parts)
    order = np.lexsort((keys["b"], keys["a"]))
    keys, who, many = keys[order], who[order], many[order]
    first = np.append(True, keys[1:] != keys[:-1])
    at = np.flatnonzero(first)
    twice = (np.diff(np.append(at, len(keys))) > 1) | np.logical_or.reduceat(many, at)
    hit = twice[np.cumsum(first) - 1]
    keys, who = keys[hit], who[hit]
    order = np.argsort(who, kind="stable")
    keys, who = keys[order], who[order]
    cuts = np.searchsorted(who, np.arange(len(parts) + 1))
    used = [i for i in range(len(parts)) if cuts[i] < cuts[i + 1]]
    return pa.table(
        {
            "grp": pa.array([table.column("grp")[i].as_py() for i in used], pa.int64()),
            "keys": pa.array([keys[cuts[i] : cuts[i + 1]].tobytes() for i in used], pa.binary()),
        }
    )


def _remove(docs: pa.Table, repeats: pa.Table, width: int) -> pa.Table:
    """Words of each document, those removed, and the kept words."""
    texts, ids = docs.column("text").to_pylist(), docs.column("id")
    found = repeats.column("keys").to_pylist()
    known = np.sort(np.concatenate([np.frombuffer(x, _KEY) for x in found])) if found else np.empty(0, _KEY)
    total, removed, kept = [], [], []
    for lo, hi in slices(texts, 8 << 20):
        part = texts[lo:hi]
        if len(known):
            w = Words(part, PLAIN)
            keys, at = _keys(w, width)
            k = np.minimum(np.searchsorted(known["a"], keys["a"]), len(known) - 1)
            maybe = np.flatnonzero(known["a"][k] == keys["a"])
            ok = np.isin(keys[maybe].view("V12"), known.view("V12")) if len(maybe) else maybe.astype(bool)
            gone = _covered(at[maybe[ok]], width, len(w.hash))
        for i, t in enumerate(part):
            words = (t or b"").split()
            n = 0
            if len(known):
                a, z = int(w.bounds[i]), int(w.bounds[i + 1])
                n = int(gone[a:z].sum())
                if n:
                    words = [words[j] for j in np.flatnonzero(~gone[a:z]).tolist()]
            total.append(len(words) + n)
            removed.append(n)
            kept.append(b" ".join(words))
    return pa.table({"id": ids, "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary())})


def dedup_substrings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 35, group_bytes: int = 6 << 20, digest: bool = False) -> DataFrame:
    """id, words, removed words and the kept text (``kept_text``, or its SHA-256 ``kept_sha256`` with ``digest``) of each row."""
    block = (width + 1) // 2
    base = pick(docs, id=id_col, text=text_col).withColumn("text", F.col("text").cast("binary"))
    kind = dict(base.dtypes)["id"]
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(size / group_bytes))
    buckets = 1 << max(0, math.ceil(math.log2(max(1, size / 6 / BUCKET_WORDS))) + 1)
    # Written once: the number that deals a row must stay the same in all three steps, and rows equal in id and text must part.
    own = written(base.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))))
    # Step 1 needs no text by group: a group's parts in several tasks are several senders, whose hits come back together.
    sent = own.groupBy("grp").applyInArrow(lambda t: _probe(t, block, buckets), "bucket long, grp long, probes binary, blocks binary, many binary")
    hits = written(sent.groupBy("bucket").applyInArrow(_meet, "grp long, bucket long, hits binary"))
    more = own.groupBy("grp").cogroup(hits.groupBy("grp")).applyInArrow(
        lambda d, h: _extend(d, h, width, block, buckets), "bucket long, grp long, keys binary, many binary"
    )
    repeats = written(more.groupBy("bucket").applyInArrow(_repeated, "grp long, keys binary"))

    def final(d: pa.Table, r: pa.Table) -> pa.Table:
        t = _remove(d, r, width)
        if not digest:
            return t
        sha = [hashlib.sha256(x).hexdigest() for x in t.column("kept").to_pylist()]
        return t.set_column(3, "kept", pa.array(sha, pa.string()))

    name, what = ("kept_sha256", "string") if digest else ("kept_text", "binary")
    out = own.groupBy("grp").cogroup(repeats.groupBy("grp")).applyInArrow(final, f"id {kind}, n_words long, n_removed long, kept {what}")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias(name))
