"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification and union-find.

Each document becomes the set of its distinct word shingles (A-Z lower-cased).  Equal sets are one node.  A SuperMinHash signature
gives each shingle a random permutation of the registers and ascending ranks along it: in round j every shingle may lower one register to
j plus a fraction; once all registers of a document are below j + 1, later rounds can't change it and it stops early.  Signatures are cut
into bands; nodes that share a band hang on the least node of that bucket.  In buckets of two the pair's signatures must agree in
``GUARD`` of the registers (seven standard deviations below the threshold).  What hangs together is a cluster of candidates.

Clusters are verified on full sets.  A cluster is cut into blocks of bounded size, and every two blocks of a cluster meet in one
group, which counts all intersections by matrix products over shared shingles and puts out a spanning forest of true links,
not the pairs.  So large groups of copies are split over many tasks, and every pair of a cluster is compared, however many partners a document has.  Union-find
by hooking and pointer jumping over the verified links gives the components.

With ``bands`` = 25 and ``rows`` = 5 a pair at similarity 0.8 is missed with probability 5e-5, one at 0.9 with 1e-10.

Defined results: a document with fewer words than a shingle has its whole sequence as its one shingle; without words or text the set is empty, linked with
nothing; rows of one id are told apart by their sets; component ids are the least non-null id; a null id in a component without other ids
stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, pick, small, written
from ._words import FOLDED, U64, Words, mix, rolling, slices, trim_memory, windows

GUARD = 0.55
BLOCK_SHINGLES = 250_000
BLOCK_NODES = 800


def shingle_sets(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after another, and the bounds of the texts."""
    w = Words(texts, FOLDED)
    h, doc = windows(w, width)
    room = np.bincount(doc, minlength=len(texts))
    at = np.concatenate(([0], np.cumsum(room)))
    out = []
    for i, n in enumerate(w.counts.tolist()):
        if n >= width:
            out.append(np.unique(h[at[i] : at[i + 1]]))
        elif n:
            out.append(mix(rolling(w.hash[w.bounds[i] : w.bounds[i + 1]], n) + U64(n)))
        else:
            out.append(np.empty(0, U64))
    return (np.concatenate(out) if out else np.empty(0, U64)), np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64)


def set_keys(h: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """A 128-bit hash of each set (the same in any order); None for an empty one."""
    n = np.diff(bounds)
    sums = []
    for salt in (0x8CB92BA72F3D8DD7, 0x2545F4914F6CDD1D):
        total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(h ^ U64(salt)))))
        sums.append(mix((total[bounds[1:]] - total[bounds[:-1]]) + n.astype(U64)))
    both = np.column_stack(sums).astype(">u8")
    return [row.tobytes() if k else None for row, k in zip(both, n.tolist(), strict=True)]


def super_min_hash(h: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """Signatures (documents x m): round in the upper, fraction in the lower 32 bits; all ones for an empty set."""
    docs = len(bounds) - 1
    sig = np.full(docs * m, np.iinfo(np.uint64).max, U64)
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    picks: list[np.ndarray] = []
    for j in range(m):
        if not len(h):
            break
        fraction = mix(h + U64((2 * j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U64(32)
        draw = mix(h + U64((2 * j + 2) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U64(32)
        at = (U64(j) + (draw * U64(m - j) >> U64(32))).astype(np.int16)
        picks.append(at)
        for i in range(j - 1, -1, -1):  # what earlier swaps of this shingle's permutation left at that place
            at = np.where(picks[i] == at, np.int16(i), at)
        np.minimum.at(sig, doc * m + at, (U64(j) << U64(32)) | fraction)
        done = (sig.reshape(docs, m) < (U64(j + 1) << U64(32))).all(axis=1)
        going = ~done[doc]
        if not going.all():
            h, doc = h[going], doc[going]
            picks = [p[going] for p in picks]
    return sig.reshape(docs, m)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    docs, m = sig.shape
    parts = sig.reshape(docs, m // rows, rows)
    out = np.tile(mix(np.arange(1, m // rows + 1, dtype=U64)), (docs, 1))
    for r in range(rows):
        out = mix(out * U64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out


def _signatures(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for lo, hi in slices(texts):
            h, bounds = shingle_sets(texts[lo:hi], width)
            sig = super_min_hash(h, bounds, bands * rows)
            keys, marks = band_keys(sig, rows).view(np.int64), (mix(sig) >> U64(48)).astype("<u2")
            yield pa.record_batch(
                {
                    "id": ids.slice(lo, hi - lo),
                    "n": pa.array(np.diff(bounds), pa.int64()),
                    "node": pa.array(set_keys(h, bounds), pa.binary()),
                    "bands": pa.array(list(keys), pa.list_(pa.int64())),
                    "sig": pa.array([x.tobytes() for x in marks], pa.binary()),
                }
            )
    trim_memory()


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each element's component: hooking to the smaller root and pointer jumping, on whole arrays."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: products of 0/1 matrices for frequent shingles, expansion for rare ones."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    all_h = np.concatenate(sets)
    order = np.argsort(all_h, kind="stable")
    all_h, doc = all_h[order], doc[order]
    first = np.flatnonzero(np.append(True, all_h[1:] != all_h[:-1]))
    size = np.diff(np.append(first, len(all_h)))
    few = (size >= 2) & (size <= 12)
    for d in range(2, 13):  # every pair within the shingles of d documents
        at = first[few & (size == d)]
        if len(at):
            rows = doc[at[:, None] + np.arange(d)]
            x, y = np.triu_indices(d, 1)
            np.add.at(out, (rows[:, x].ravel(), rows[:, y].ravel()), 1)
    out += out.T
    many = np.flatnonzero(size > 12)
    for lo in range(0, len(many), 2048):
        part = many[lo : lo + 2048]
        dense = np.zeros((n, len(part)), np.float32)
        for k, g in enumerate(part.tolist()):
            dense[doc[first[g] : first[g] + size[g]], k] = 1
        out += dense @ dense.T
    return out


def _verify(table: pa.Table, percent: int) -> pa.Table:
    """Links between the nodes of each cluster in this group, as a spanning forest."""
    cluster = table.column("cluster").to_pylist()
    nodes = table.column("node").to_pylist()
    sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
    side = np.asarray(table.column("side"))
    by: dict[bytes, list[int]] = {}
    for i, c in enumerate(cluster):
        by.setdefault(c, []).append(i)
    left, right = [], []
    for rows in by.values():
        if len(rows) < 2:
            continue
        sizes = np.array([len(sets[i]) for i in rows], np.int64)
        shared, s = intersections([sets[i] for i in rows]), side[rows]
        two = s.min() != s.max()
        found = []
        for lo in range(0, len(rows), 128):  # a few rows at a time: no matrix of the whole block beside the counts
            hi = min(lo + 128, len(rows))
            linked = shared[lo:hi].astype(np.int64) * (100 + percent) >= percent * (sizes[lo:hi, None] + sizes[None, :])
            linked &= np.arange(lo, hi)[:, None] < np.arange(len(rows))[None, :]
            if two:  # pairs inside either block meet elsewhere
                linked &= s[lo:hi, None] != s[None, :]
            a, b = np.nonzero(linked)
            found.append((a + lo, b))
        root = union_find(len(rows), *(np.concatenate(x) for x in zip(*found, strict=True)))
        for i in np.flatnonzero(root != np.arange(len(rows))).tolist():
            left.append(nodes[rows[i]])
            right.append(nodes[rows[root[i]]])
    del sets, by
    trim_memory()
    return pa.table({"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())})


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for lo, hi in slices(texts):
            h, bounds = shingle_sets(texts[lo:hi], width)
            data = [h[a:z].astype("<u8").tobytes() for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.record_batch({"node": pa.array(set_keys(h, bounds), pa.binary()), "shingles": pa.array(data, pa.binary())})
    trim_memory()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b): the least node of each component.

    Every round takes the least label among the neighbours (a minimum that is combined before the shuffle), then the
    label's own label; rounds grow with the logarithm of a path's length and each is written to the shared folder.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = table = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        top = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = written(hooked.join(top, "label", "left").select("node", "old", F.least("label", "up").alias("label")))
        moved = new.where("label <> old").limit(1).count()
        discard(table)
        table, labels = new, new.select("node", "label")
        if not moved:
            discard(both)
            return labels


def near_duplicates(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 5, percent: int = 80, bands: int = 25, rows: int = 5
) -> DataFrame:
    """id, n_shingles, component_id and kept (id = component_id) of each row; links have Jaccard >= ``percent`` / 100."""
    base = pick(docs, id=id_col, text=text_col).select("id", F.col("text").cast("binary").alias("text"))
    kind = dict(base.dtypes)["id"]
    signed = written(base.mapInArrow(lambda it: _signatures(it, width, bands, rows), f"id {kind}, n long, node binary, bands array<long>, sig binary"))
    nodes = written(
        signed.where("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.min("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    )
    exploded = nodes.select("node", F.explode("bands").alias("band"))
    buckets = exploded.groupBy("band").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    stars = exploded.join(buckets, "band").where("node <> pivot").groupBy("node", "pivot").agg(F.max("size").alias("size"))
    m = bands * rows
    sig = nodes.select("node", "sig")
    pairs = stars.where("size = 2").join(sig, "node").join(sig.select(F.col("node").alias("pivot"), F.col("sig").alias("other")), "pivot")
    agree = F.expr(f"size(filter(sequence(0, {m - 1}), i -> substring(sig, 2 * i + 1, 2) = substring(other, 2 * i + 1, 2)))")
    hung = stars.where("size > 2").select("node", "pivot").union(pairs.where(agree >= math.floor(GUARD * m)).select("node", "pivot"))
    clusters = written(components(hung.select(F.col("node").alias("a"), F.col("pivot").alias("b"))))

    # Blocks: a cluster's share of nodes and shingles decides how many; small clusters are gathered into common groups.
    member = clusters.join(nodes.select("node", "n", "least"), "node").withColumnRenamed("label", "cluster")
    sizes = member.groupBy("cluster").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("members"))
    cut = F.greatest(F.ceil(F.col("total") / BLOCK_SHINGLES), F.ceil(F.col("members") / BLOCK_NODES)).cast("int")
    member = written(member.join(sizes.select("cluster", cut.alias("blocks")), "cluster"))
    total = member.where("blocks = 1").agg(F.sum("n")).first()[0] or 0
    common = max(1, math.ceil(total / BLOCK_SHINGLES))
    wanted = small(written(member.select(F.col("least").alias("id")).distinct()))
    texts = base.join(wanted.withColumnRenamed("id", "want"), F.col("id").eqNullSafe(F.col("want")), "left_semi").select("text")
    sets = texts.mapInArrow(lambda it: _sets(it, width), "node binary, shingles binary")
    # Ids may repeat, so sets are matched by their own hash; equal ones are one row.
    held = member.join(sets, "node").dropDuplicates(["node"])
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    few = held.where("blocks = 1").select(
        "cluster", "node", "shingles", F.lit(0).alias("side"), F.pmod(F.xxhash64("cluster"), F.lit(common)).alias("unit"), F.lit(0).alias("i"), F.lit(0).alias("j")
    )
    large = held.where("blocks > 1").withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    large = large.select(
        "cluster", "node", "shingles", F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
        F.xxhash64("cluster").alias("unit"), (F.least("own", "other") + 1).alias("i"), (F.greatest("own", "other") + 1).alias("j"),
    )
    links = few.unionByName(large).groupBy("unit", "i", "j").applyInArrow(lambda t: _verify(t, percent), "a binary, b binary")
    found = components(written(links))

    named = nodes.select("node", "least").join(found, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    # Written before it is joined: a label with very many nodes is then one side's large partition, which Spark can split.
    tops = written(named.groupBy("label").agg(F.min("least").alias("component_id")))
    answer = named.join(tops, "label").select("node", "component_id")
    out = signed.select("id", "n", "node").join(answer, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
