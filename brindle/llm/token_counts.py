"""Token counts by a map-side two-tier lookup over a byte-level BPE.

Texts are cut into pieces at places where the tokenizer's pre-token pattern certainly begins a new pre-token: before and after white
space, and between letters, digits and marks, as far as a byte's class is known (``_pieces.CLASSES``); nothing is cut beside characters of
unknown class, so a piece is one pre-token as a rule, sometimes several, and is encoded alone as within its text.  Pieces are hashed
from a buffer of about 1 MB of texts at once.  Tier one is a broadcast table of the most frequent pieces' token counts, two
sorted arrays; tier two is a bounded cache in each worker; what both miss is encoded, each distinct piece of a buffer once.

The table holds at most ``table_size`` entries (a stated bound, whatever the input).  It is found from all rows: each
task counts its pieces in bounded memory and sends its ``per_task`` most frequent, and only those few rows are summed;
pieces themselves are never shuffled.  What the table holds affects speed alone, never a count.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows stay repeated; an empty table gives no rows; other columns are
ignored; texts with a special string of the tokenizer, and all texts under a tokenizer of another kind, are encoded whole.  Pieces are told
apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import ByteLevel, encoded, shared, special_strings
from ._common import pick
from ._pieces import buffers, uncollected
from ._words import U64, trim_memory

CACHE_ENTRIES = 400_000


def _frequent(batches: Iterator[pa.RecordBatch], path: str, per_task: int) -> Iterator[pa.RecordBatch]:
    encoder = shared(ByteLevel, path)
    seen: dict[int, int] = {}
    text: dict[int, bytes] = {}
    for b in batches if encoder.cuts else ():
        for _, p in buffers([t or b"" for t in b.column(0).to_pylist()]):
            u, first, n = np.unique(p.hash, return_index=True, return_counts=True)
            keys = u.tolist()
            fresh = [i for i, k in enumerate(keys) if k not in text]
            text.update(zip([keys[i] for i in fresh], p.texts(first[fresh]), strict=True))
            for k, x in zip(keys, n.tolist(), strict=True):
                seen[k] = seen.get(k, 0) + x
            if len(seen) > CACHE_ENTRIES:  # bounded memory: only the frequent half goes on
                top = sorted(seen, key=seen.get, reverse=True)[: CACHE_ENTRIES // 2]
                seen, text = {k: seen[k] for k in top}, {k: text[k] for k in top}
    top = sorted(seen, key=lambda k: (-seen[k], k))[:per_task]
    tokens = encoder.lengths([text[k] for k in top])
    yield pa.record_batch(
        {"piece": pa.array(np.array(top, U64).view(np.int64)), "n": pa.array([seen[k] for k in top], pa.int64()), "tokens": pa.array(tokens, pa.int64())}
    )
    trim_memory()


def frequent_table(docs: DataFrame, path: str, table_size: int, per_task: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and token counts of the most frequent pieces: at most ``table_size`` entries reach the driver."""
    rows = (
        docs.select("text")
        .mapInArrow(lambda it: _frequent(it, path, per_task), "piece long, n long, tokens long")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"), F.max("tokens").alias("tokens"))
        .orderBy(F.desc("n"), "piece")
        .limit(table_size)
        .select("piece", "tokens")
        .toArrow()
    )
    keys = rows.column("piece").to_numpy().view(U64)
    order = np.argsort(keys)
    return keys[order], rows.column("tokens").to_numpy()[order]


def _counted(texts: list[bytes], encoder: ByteLevel, table: tuple[np.ndarray, np.ndarray], cache: dict[int, int]) -> np.ndarray:
    """Tokens of each text, through the table, then the cache, then the encoder."""
    keys, tokens = table
    out = np.zeros(len(texts), np.int64)
    for owner, p in buffers(texts):
        u, first, inv = np.unique(p.hash, return_index=True, return_inverse=True)
        n = np.zeros(len(u), np.int64)
        miss = np.arange(len(u))
        if len(keys):
            k = np.minimum(np.searchsorted(keys, u), len(keys) - 1)
            hit = keys[k] == u
            n[hit] = tokens[k[hit]]
            miss = np.flatnonzero(~hit)
        found = list(map(cache.get, u[miss].tolist()))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            at = miss[new]
            fresh = encoder.lengths(p.texts(first[at]))
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
            cache.update(zip(u[at].tolist(), fresh, strict=True))
            for i, x in zip(new, fresh, strict=True):
                found[i] = x
        n[miss] = found
        total = np.concatenate(([0], np.cumsum(n[inv])))
        np.add.at(out, owner, total[p.behind] - total[p.first])
    return out


_CACHES: dict[str, tuple[object, dict[int, int]]] = {}


def _count(batches: Iterator[pa.RecordBatch], table: Broadcast, path: str, limit: int) -> Iterator[pa.RecordBatch]:
    encoder, special, known = shared(ByteLevel, path), special_strings(path), table.value
    if path not in _CACHES or _CACHES[path][0] is not known:  # a worker keeps its cache from task to task
        _CACHES[path] = (known, {})
    cache = _CACHES[path][1]
    for b in batches:
        texts = [t or b"" for t in b.column(1).to_pylist()]
        whole = [i for i, t in enumerate(texts) if not encoder.cuts or any(s in t for s in special)]
        cut = list(texts)
        for i in whole:
            cut[i] = b""
        with uncollected():
            n = _counted(cut, encoder, known, cache)
        for i, ids in zip(whole, encoded(path, [texts[i].decode("utf-8", "replace") for i in whole]), strict=True):
            n[i] = len(ids)
        yield pa.record_batch(
            {
                "id": b.column(0),
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "n_tokens": pa.array(n, pa.int64()),
                "over_limit": pa.array(n > limit, pa.bool_()),
            }
        )
    trim_memory()


def count_tokens(
    docs: DataFrame,
    path: str,
    text_col: str = "text",
    id_col: str = "doc_id",
    limit: int = 512,
    table_size: int = 65_536,
    per_task: int = 8_192,
) -> DataFrame:
    """``id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of each row's text.

    ``path`` is the tokenizer's file on every machine; no begin, end or added special tokens are counted, special
    strings within texts are handled as the tokenizer does by default.
    """
    base = pick(docs, id=id_col, text=text_col)
    kind = dict(base.dtypes)["id"]
    base = base.select("id", F.col("text").cast("binary").alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(base, path, table_size, per_task))
    out = base.mapInArrow(
        lambda it: _count(it, table, path, limit), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
    return out.withColumnRenamed("id", id_col)
