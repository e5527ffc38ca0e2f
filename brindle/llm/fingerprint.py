"""Lempel-Ziv phrase fingerprints: LZ78 phrases, hashed, and the smallest distinct hashes kept.

A text is parsed from left to right into the shortest phrases not seen before in it; the phrase set says what a
dictionary compressor would learn from the text.  A fingerprint is the ``SIZE`` smallest distinct 32-bit phrase hashes
in ascending order as hexadecimal text.  The likeness of two fingerprints is the share of the ``SIZE`` smallest hashes
of their union that both hold: an estimate of the phrase sets' Jaccard similarity, exact for small sets.

``edited_fingerprints`` also replaces the last quarter of each text by the beginning of the next document's.
Documents are dealt into ranges of ids; the first document of a range is dealt to the range before as well, so every
pair of neighbours meets in one task and each text is shuffled once.

Defined results: a null text counts as empty; an empty text has the empty fingerprint, with likeness 1 to another empty
one and 0 to others; equal ids follow one another by text; null ids come first; a single document is followed by itself;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import parallelism, pick
from ._words import U64, _table, mix, trim_memory

SIZE = 64
RANGE_BYTES = 1 << 20
MOST_RANGES = 1024
_BASE = 0xD6E8FEB86659FD93 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _parse(text: str, seen: set[str], at: int = 0) -> tuple[list[int], bool]:
    """Ends of the phrases of ``text`` from ``at`` on, and whether the last one is old.

    ``seen`` grows by them; it holds the empty phrase, and with a phrase all its prefixes, so a search for the
    shortest new phrase may begin at the last one's length and go up or down.
    """
    ends: list[int] = []
    add, put = seen.add, ends.append
    n, step, old = len(text), 1, False
    while at < n:
        end = at + step
        phrase = text[at:end]
        if phrase in seen:
            while True:
                end += 1
                if end > n:
                    end, old = n, True
                    break
                phrase = text[at:end]
                if phrase not in seen:
                    add(phrase)
                    break
        else:
            if end > n:
                end = n
            while (shorter := text[at : end - 1]) not in seen:
                phrase = shorter
                end -= 1
            add(phrase)
        put(end)
        step = end - at
        at = end
    return ends, old


def _hashes(text: str, cuts: np.ndarray) -> np.ndarray:
    """Distinct 32-bit hashes of the phrases between neighbouring ``cuts``, ascending."""
    if len(cuts) < 2:
        return np.empty(0, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64) + U64(1)
    sums = np.empty(len(points) + 1, U64)
    sums[0] = 0
    np.cumsum(mix(points) * _table(_BASE, len(points)), out=sums[1:])
    start, end = cuts[:-1], cuts[1:]
    h = mix((sums[end] - sums[start]) * _table(_INVERSE, len(points) + 1)[start])
    h = np.sort((h >> U64(32)).astype(np.uint32))
    return h[np.append(True, h[1:] != h[:-1])]


def fingerprint(text: str) -> np.ndarray:
    return _hashes(text, np.array([0, *_parse(text, {""})[0]]))[:SIZE]


def _with_edit(text: str, tail: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Fingerprints of a text and of its edited form; the beginning that both share is parsed once."""
    keep = len(text) - len(text) // 4
    edited = text[:keep] + tail
    seen = {""}
    ends, old = _parse(text[:keep], seen)
    if old:  # it goes on behind the cut
        ends.pop()
    at = ends[-1] if ends else 0
    whole = ends + _parse(text, set(seen), at)[0]
    other = ends + _parse(edited, seen, at)[0]
    return _hashes(text, np.array([0, *whole]))[:SIZE], _hashes(edited, np.array([0, *other]))[:SIZE], edited


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the ``SIZE`` smallest hashes of the union that both fingerprints hold."""
    x, y = set(a.tolist()), set(b.tolist())
    both = x & y
    least = sorted(x | y)[:SIZE]
    return sum(h in both for h in least) / len(least) if least else 1.0


def to_text(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


_NAMES = ("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    types = (id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.record_batch({n: pa.array(c, t) for n, c, t in zip(_NAMES, cols, types, strict=True)})


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, id, head, text) come in order, each range ended by the head of the next one.

    A row needs the text of the next for its edited form, and the next one's fingerprint, which in turn comes when that
    one's own next text is there; so at most two rows wait.
    """
    out: list[tuple] = []
    row = waiting = id_type = None

    def put(digest: tuple, next_print: np.ndarray) -> None:
        key, n, sha, own, edited = digest
        out.append((key, n, sha, to_text(own), to_text(edited), likeness(own, edited), likeness(own, next_print)))

    for b in batches:
        id_type = b.column(1).type
        for nxt in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if row is not None:
                own, edited, s = _with_edit(row[3], nxt[3][: len(row[3]) // 4])
                sha = hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                if waiting is not None:
                    put(waiting, own)
                waiting = (row[1], len(row[3]), sha, own, edited)
            row = nxt
            if nxt[2]:
                put(waiting, fingerprint(nxt[3]))
                row = waiting = None
            if len(out) >= 256:
                yield _batch(out, id_type)
                out.clear()
        trim_memory()
    if id_type is not None:
        yield _batch(out, id_type)


def edited_fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and its edited form, and their likeness to each other and to the next document's."""
    spark = docs.sparkSession
    base = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    kind = dict(base.dtypes)["id"]
    schema = (
        f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    # Ranges of about RANGE_BYTES; beyond MOST_RANGES (or what the cluster runs at once) they grow, and their sort spills.
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(max(MOST_RANGES, parallelism(spark)), 1 + size // RANGE_BYTES)
    keys = base.select("id")
    # Ends of the ranges: a bounded number of quantiles reaches the driver.
    cuts = sorted(set(keys.where("id is not null").approxQuantile("id", [i / n for i in range(1, n)], 1 / (20 * n)))) if n > 1 else []
    grp = F.lit(0)
    if cuts:
        # A bisection over the sorted bounds, unrolled: a dozen comparisons a row.
        def place(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(key < F.lit(float(cuts[mid])), place(lo, mid)).otherwise(place(mid + 1, hi))

        key = F.col("id").cast("double")
        grp = F.when(F.col("id").isNull(), F.lit(0)).otherwise(place(0, len(cuts)))
    dealt = base.withColumn("grp", grp.cast("int"))
    groups = sorted(r["grp"] for r in dealt.select("grp").distinct().collect())
    if not groups:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    before = {g: groups[i - 1] for i, g in enumerate(groups)}  # the first range is followed by nothing: it heads the last
    # The least row by id and text heads its range and also ends the range before.
    first = F.struct(F.col("id").isNotNull().alias("o"), F.col("id").alias("id"), F.col("text").alias("text"))
    heads = dealt.groupBy("grp").agg(F.min(first).alias("m"))
    mapping = F.create_map(*[F.lit(x) for g in groups for x in (g, before[g])])
    to = F.element_at(mapping, F.col("grp")).alias("grp")
    heads = heads.select(F.col("m.id").alias("id"), F.col("m.text").alias("text"), to, F.lit(True).alias("head"))
    both = dealt.withColumn("head", F.lit(False)).unionByName(heads)
    return (
        both.repartition(max(n, parallelism(spark)), "grp")
        .sortWithinPartitions("grp", "head", F.col("id").asc_nulls_first(), "text")
        .select("grp", "id", "head", "text")
        .mapInArrow(_pairs, schema)
        .withColumnRenamed("id", id_col)
    )
