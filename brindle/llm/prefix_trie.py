"""Prefix trie of conversations, built as a Patricia tree.

A conversation is the sequence of its turns' digests (128 bits of role and text).  A trie node is a distinct beginning of such sequences; a Patricia tree holds only points, the nodes where
sequences branch, end or stop, with the runs of unary nodes between two points as one edge.

How it is built: turns are numbered by a sort into ranges, so a conversation of very many turns is spread over tasks.  Sequences are cut into segments of ``SEGMENT`` turns at fixed depths; a
segment hangs on the node where the one before ends, so rows stay small whatever a conversation's length.  Equal segments of one node are counted before they are sorted: copies are one row.
The distinct segments are sorted by node and digests in ranges; each task goes over its range once, with the length of the common beginning of neighbours and a stack of open points, and puts out its
points with edges, members and, where all members are in the range, subtree sums.  Only nodes on the paths of a range's first and last sequence can be shared with other ranges: they are put out one by one and added up by key, with the ends of full segments
that may go on.  Subtree sums over these few open points come by pointer doubling, in rounds that follow the logarithm of the depth.  At last each edge is expanded into its unary nodes: they share the lower point's members and
leaves, and its savings grow by the edge's suffix sums.

``rebuilt`` gives each conversation c the first h turns of conversation c - c % 100 (all if fewer, none if absent) before its own turns after the first h, with h = crc32 of c in decimals, modulo 6.

Defined results: a null role or text counts as empty; null turns come first; turns of one number follow one another by their digests; rows without a conversation id are left out; repeated rows are turns of their own; a conversation
without turns left is a member of the root alone; an empty table gives no rows, not even a root; other columns are ignored.  Nodes are told apart by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, parallelism, pick, small, written
from ._words import U64, mix

SEGMENT = 128
#: Conversations of one block share the beginning of its first.
BLOCK = 100
FORKS = 6
#: Ids in one row on the way to a node's digest.
CHUNK_IDS = 8192
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS = np.array([[pow(b, i + 1, 1 << 64) for i in range(SEGMENT)] for b in _BASES], U64)
_ODD = U64(0xD1342543DE82EF95)


def numbered(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(c, place, a, b, length): turns with their place from 1; written, and no task holds all turns of a conversation."""
    spark = conversations.sparkSession
    base = pick(conversations, c=id_col, turn=turn_col, role=role_col, text=text_col).where("c is not null")
    said = [F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    digests = written(base.select(F.col("c").cast("long").alias("c"), "turn", F.xxhash64(*said).alias("a"), F.xxhash64(F.lit(1), *said).alias("b"), F.length(said[1]).cast("long").alias("length")))
    order = [F.col("turn").asc_nulls_first(), "a", "b", "row"]  # the row number only parts equal turns
    dealt = digests.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parallelism(spark), "c", *order)
    dealt = written(dealt.withColumn("range", F.spark_partition_id()))
    parts = dealt.groupBy("c", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("c", "range", before.alias("before"))
    local = F.row_number().over(Window.partitionBy("c", "range").orderBy(*order))
    out = written(dealt.withColumn("local", local).join(parts, ["c", "range"]).select("c", (F.col("before") + F.col("local")).alias("place"), "a", "b", "length"))
    discard(digests, dealt)
    return out


def rebuilt(turns: DataFrame) -> DataFrame:
    """``turns`` (c, place, a, b, length) with each conversation's beginning taken from the first of its block."""
    first = F.col("c") - F.col("c") % BLOCK
    fork = F.crc32(F.col("c").cast("string").cast("binary")) % FORKS
    sizes = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n"))  # counted in each task before they are dealt
    convs = sizes.select("c", first.alias("first"), fork.alias("h"))
    convs = convs.join(sizes.select(F.col("c").alias("first"), "n"), "first", "left").select("c", "first", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("k"))
    # A conversation's own turns need its two numbers: one row a conversation, so Spark can split a large one's side.
    own = turns.join(convs.select("c", "h", "k"), "c").where("place > h").select("c", (F.col("place") - F.col("h") + F.col("k")).alias("place"), "a", "b", "length")
    heads = turns.where((F.col("c") % BLOCK == 0) & (F.col("place") < FORKS)).withColumnRenamed("c", "first")
    return own.unionByName(heads.join(convs, "first").where("place <= k").select("c", "place", "a", "b", "length"))


def _keys(a: np.ndarray, b: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each beginning of a segment, 128 bits in two arrays; xored with the node's that it hangs on they are nodes."""
    salt = U64(s + 1) * _ODD
    return tuple(mix(np.cumsum(x * p[: len(x)]) + salt) for x, p in zip((a, b), _POWERS, strict=True))


def _signed(x) -> int:
    return int(np.uint64(x).astype(np.int64))


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (c, s, turns) of sorted turns as (c, s, m, seq, lengths, y1, y2): ``seq`` sorts as the digests do."""
    for batch in batches:
        turns = batch.column(2)
        flat, at = turns.flatten(), turns.offsets.to_numpy() - turns.offsets[0].as_py()
        a, b = (flat.field(n).to_numpy(zero_copy_only=False).view(U64) for n in ("a", "b"))
        both = np.stack((a, b), 1).astype(">u8")
        seq, y1, y2 = [], [], []
        for s, lo, hi in zip(batch.column(1).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            k1, k2 = _keys(a[lo:hi], b[lo:hi], s)
            seq.append(both[lo:hi].tobytes())
            y1.append(k1[-1])
            y2.append(k2[-1])
        lengths = pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat.field("length"))
        sums = [pa.array(np.array(y, U64).view(np.int64), pa.int64()) for y in (y1, y2)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.diff(at), pa.int64()), pa.array(seq, pa.binary()), lengths, *sums], names=["c", "s", "m", "seq", "lengths", "y1", "y2"])


def segments(turns: DataFrame) -> DataFrame:
    """(c, s, m, seq, lengths, y1, y2, x1, x2): rows of at most ``SEGMENT`` turns, each with the node (x1, x2) that it hangs on."""
    cut = turns.withColumn("s", F.floor((F.col("place") - 1) / SEGMENT)).groupBy("c", "s")
    rows = cut.agg(F.sort_array(F.collect_list(F.struct("place", "a", "b", "length"))).alias("turns"))
    out = rows.mapInArrow(_segment_rows, "c long, s long, m long, seq binary, lengths array<long>, y1 long, y2 long")
    before = Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumns({f"x{i}": F.coalesce(F.bit_xor(f"y{i}").over(before), F.lit(0)) for i in (1, 2)})


class _Point:
    """A point on the path of the last sequence: members, and sums over what is closed below it."""

    __slots__ = ("depth", "n", "lo", "leaves", "saved", "kids", "open")

    def __init__(self, depth: int, n: int = 0, lo: int | None = None, open: bool = False):
        self.depth, self.n, self.lo, self.open = depth, n, lo, open
        self.leaves = self.saved = self.kids = 0


_POINT = pa.schema([*((c, pa.int64()) for c in ("depth", "k1", "k2", "p1", "p2", "n", "lo", "leaves", "saved", "kids")), ("suffix", pa.list_(pa.int64())), ("open", pa.bool_())])
_POINT_SQL = "depth long, k1 long, k2 long, p1 long, p2 long, n long, lo long, leaves long, saved long, kids long, suffix array<long>, open boolean"


class _Range:
    """One task's range of sorted segments: a stack of points, closed as the sort leaves them."""

    def __init__(self) -> None:
        self.node: tuple | None = None
        self.out: list[tuple] = []
        self.stack: list[_Point] = []

    def _close(self, t: _Point, up: _Point) -> None:
        lo, hi = up.depth, t.depth
        suffix = (self.sums[hi] - self.sums[lo:hi]).tolist()
        if not t.open and not t.kids:
            t.leaves = 1
        at = self.node[0] * SEGMENT
        self.out.append((at + hi, _signed(self.k1[hi]), _signed(self.k2[hi]), _signed(self.k1[lo]), _signed(self.k2[lo]), t.n, t.lo, t.leaves, t.saved, t.kids, suffix, t.open))
        up.n += t.n
        up.lo = t.lo if up.lo is None else min(up.lo, t.lo)
        if t.open:
            up.open = True
        else:
            up.leaves += t.leaves
            up.saved += t.saved + (t.n - 1) * suffix[0]
            up.kids += 1

    def _end_node(self, last: bool) -> None:
        """Close what is open of a node; the last sequence of a range is put out node by node."""
        if self.node is None:
            return
        while len(self.stack) > 1:
            t = self.stack.pop()
            if last:
                t.open = True
                if t.depth - self.stack[-1].depth > 1:
                    self.stack.append(_Point(t.depth - 1))
            self._close(t, self.stack[-1])
        s, x1, x2 = self.node
        top = self.stack.pop()
        # Beyond the first segment the members are counted where the segment before ends.
        self.out.append((s * SEGMENT, x1, x2, None, None, 0 if s else top.n, top.lo, top.leaves, top.saved, top.kids, None, True))

    def add(self, s: int, x1: int, x2: int, n: int, lo: int, seq: bytes, lengths: list[int]) -> None:
        node, first = (s, x1, x2), self.node is None
        digests = np.frombuffer(seq, ">u8").reshape(-1, 2).astype(U64)
        m = len(digests)
        if node != self.node:
            self._end_node(False)
            self.node, self.stack = node, [_Point(0)]
            if first:
                self.stack += [_Point(d, open=True) for d in range(1, m)]
        else:
            both = min(m, len(self.digests))
            differ = np.flatnonzero((digests[:both] != self.digests[:both]).any(1))
            shared = int(differ[0]) if len(differ) else both
            while self.stack[-1].depth > shared:
                t = self.stack.pop()
                if self.stack[-1].depth < shared:
                    self.stack.append(_Point(shared))
                self._close(t, self.stack[-1])
        self.stack.append(_Point(m, n, lo, open=first or m == SEGMENT))
        self.digests, self.sums = digests, np.concatenate(([0], np.cumsum(lengths)))
        k1, k2 = _keys(digests[:, 0], digests[:, 1], s)
        self.k1, self.k2 = (np.concatenate(([U64(0)], k)) ^ U64(x & 0xFFFFFFFFFFFFFFFF) for k, x in ((k1, x1), (k2, x2)))

    def taken(self) -> pa.RecordBatch:
        cols = list(zip(*self.out, strict=True)) if self.out else [[]] * len(_POINT)
        self.out = []
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _POINT, strict=True)], schema=_POINT)


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = _Range()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            task.add(*row)
        yield task.taken()
    task._end_node(True)
    yield task.taken()


def _doubled(points: DataFrame) -> DataFrame:
    """(k1, k2, leaves, gain): sums over the subtrees of ``points`` (k1, k2, p1, p2, leaves, gain); each round doubles how far down they reach."""
    now = written(points)
    while not now.where("p1 is not null").isEmpty():
        below = now.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("leaves").alias("more"), F.sum("gain").alias("gained"))
        over = small(now).select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
        step = now.join(below, ["k1", "k2"], "left").join(over, ["p1", "p2"], "left")
        total = [(F.col(x) + F.coalesce(y, F.lit(0))).alias(x) for x, y in (("leaves", "more"), ("gain", "gained"))]
        after = written(step.select("k1", "k2", F.col("q1").alias("p1"), F.col("q2").alias("p2"), *total))
        discard(now)
        now = after
    return now


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, c), sorted, as rows (k1, k2, first, ids) of up to ``CHUNK_IDS`` ids."""
    key, ids, out = None, [], []

    def put() -> None:
        if ids:
            out.append((*key, ids[0], pa.compress(np.array(ids, "<i8").tobytes(), "zstd", asbytes=True), len(ids)))
            ids.clear()

    def taken() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        out.clear()
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["k1", "k2", "first", "ids", "size"])

    for batch in batches:
        for k1, k2, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if key != (k1, k2) or len(ids) == CHUNK_IDS:
                put()
                key = (k1, k2)
            ids.append(c)
        yield taken()
    put()
    yield taken()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, first, ids, size), sorted, as rows (k1, k2, sha256); only the digest's state is held."""
    key, state, out = None, None, []

    def taken() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 3
        out.clear()
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["k1", "k2", "ends"])

    for batch in batches:
        for k1, k2, _, ids, size in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            said = ",".join(map(str, np.frombuffer(pa.decompress(ids, 8 * size, "zstd", asbytes=True), "<i8").tolist())).encode()
            if key == (k1, k2):
                state.update(b"," + said)
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(said)
        yield taken()
    if key is not None:
        out.append((*key, state.hexdigest()))
    yield taken()


def ends_of(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends): the digest of each node's ids (c) in ascending order.

    Ids are dealt into ranges first, so a node's ids come as few rows in order: a digest has to read them one after another, but nothing of them is held.
    """
    n = parallelism(ends.sparkSession)
    ranged = ends.select("k1", "k2", "c").repartitionByRange(n, "c").sortWithinPartitions("k1", "k2", "c")
    chunks = ranged.mapInArrow(_chunks, "k1 long, k2 long, first long, ids binary, size long")
    return chunks.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_hashed, "k1 long, k2 long, ends string")


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of ``turns`` (c, place, a, b, length), which are numbered from 1 without gaps, for all conversations ``ids`` (c); see ``conversation_trie`` for the columns."""
    spark = turns.sparkSession
    segs = written(segments(turns))
    same = segs.groupBy("s", "x1", "x2", "y1", "y2").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.first("seq").alias("seq"), F.first("lengths").alias("lengths"))
    same = written(same.select("s", "x1", "x2", "n", "lo", "seq", "lengths"))
    by = ("s", "x1", "x2", "seq")
    points = written(same.repartitionByRange(parallelism(spark), *by).sortWithinPartitions(*by).mapInArrow(_points, _POINT_SQL))

    final = segs.groupBy("c").agg(F.bit_xor("y1").alias("k1"), F.bit_xor("y2").alias("k2"))
    ends = ids.join(final, "c", "left").fillna(0, ["k1", "k2"])
    bare = ids.join(segs.select("c").distinct(), "c", "left_anti").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo")).where("n > 0")
    zeros = [F.lit(0).cast("long").alias(x) for x in ("depth", "k1", "k2")], [F.lit(0).cast("long").alias(x) for x in ("leaves", "saved", "kids")]
    bare = bare.select(*zeros[0], F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), "n", "lo", *zeros[1], F.lit(None).cast("array<long>").alias("suffix"))

    shared = points.where("open").drop("open").unionByName(bare)
    sums = [F.sum(x).alias(x) for x in ("n", "leaves", "saved", "kids")]
    shared = shared.groupBy("k1", "k2").agg(F.max("depth").alias("depth"), F.max(F.when(F.col("p1").isNotNull(), F.struct("p1", "p2"))).alias("p"), F.min("lo").alias("lo"), F.max("suffix").alias("suffix"), *sums)
    shared = written(shared.select("depth", "k1", "k2", "p.p1", "p.p2", "n", "lo", "leaves", "saved", "kids", "suffix"))
    kids = shared.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("more"))
    shared = shared.join(kids, ["k1", "k2"], "left").withColumn("kids", F.col("kids") + F.coalesce("more", F.lit(0))).drop("more")
    edge = F.coalesce((F.col("n") - 1) * F.get("suffix", F.lit(0)), F.lit(0))
    shared = written(shared.withColumns({"leaves": F.when(F.col("kids") == 0, 1).otherwise(F.col("leaves")), "edge": edge}))
    sums = _doubled(shared.select("k1", "k2", "p1", "p2", "leaves", (F.col("saved") + F.col("edge")).alias("gain")))
    whole = shared.drop("leaves", "saved").join(sums.select("k1", "k2", "leaves", "gain"), ["k1", "k2"]).withColumn("saved", F.col("gain") - F.col("edge")).drop("gain", "edge")
    whole = points.where("not open").drop("open").unionByName(whole)

    over = whole.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("lo").alias("over"))
    out = whole.join(over, ["p1", "p2"], "left").join(ends_of(ends), ["k1", "k2"], "left")
    out = out.select("*", F.posexplode_outer("suffix").alias("i", "rest"))
    size, i = F.coalesce(F.size("suffix"), F.lit(0)), F.coalesce("i", F.lit(0))
    size = F.when(F.col("suffix").isNull(), F.lit(1)).otherwise(size)
    point = i == size - 1
    return out.select(
        F.col("lo").alias("conv_id"), (F.col("depth") - size + 1 + i).alias("depth"), F.when(i == 0, F.col("over")).otherwise(F.col("lo")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(point, F.col("kids")).otherwise(F.lit(1).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") + F.coalesce((F.col("n") - 1) * F.col("rest"), F.lit(0))).alias("saved_tokens"),
        F.coalesce(F.when(point, F.col("ends")), F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", forked: bool = True) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 (of the ids of members that end here).

    ``forked``: beginnings are shared within blocks of conversations, as in ``rebuilt``; otherwise conversations stand as they are.
    """
    turns = numbered(conversations, id_col, turn_col, role_col, text_col)
    return trie(rebuilt(turns) if forked else turns, turns.select("c").distinct())
