"""Property-graph operators: a holder of node and edge tables, template traversals, trees, neighbourhoods, upserts.

Parameters come as DataFrames, so a batch of questions is one join and a single question is a one-row table.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import cut
from .scan import running

MAX_TREE_DEPTH = 3


@dataclass(frozen=True)
class Graph:
    """Node tables by label and edge tables by type; edge tables begin with (src, dst)."""

    nodes: Mapping[str, DataFrame] = field(default_factory=dict)
    edges: Mapping[str, DataFrame] = field(default_factory=dict)

    def stats(self) -> DataFrame:
        """(kind, name, n), largest first."""
        out = None
        for kind, tables in (("node", self.nodes), ("edge", self.edges)):
            for name, df in tables.items():
                one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "n")
                out = one if out is None else out.unionByName(one)
        return out.orderBy(F.desc("n"), "kind", "name")


def collect_structs(key: str, *cols: str) -> Column:
    """A sorted array of distinct structs; what a missed left join leaves (a null key) is left out."""
    entry = F.when(F.col(key).isNotNull(), F.struct(key, *cols))
    return F.sort_array(F.collect_set(entry))


def descendants(rules: DataFrame, depth: int = MAX_TREE_DEPTH) -> DataFrame:
    """(root, number, distance) for 1..depth steps down a parent column: one self-join a level, no recursion needed."""
    if not 1 <= depth <= MAX_TREE_DEPTH:
        raise ValueError(f"depth must be between 1 and {MAX_TREE_DEPTH}")
    child = rules.where("parent is not null").select("parent", "number")
    step = child.select(F.col("parent").alias("root"), "number", F.lit(1).alias("distance"))
    out = step
    for d in range(2, depth + 1):
        step = step.select("root", F.col("number").alias("parent")).join(child, "parent").select("root", "number", F.lit(d).alias("distance"))
        out = out.unionByName(step)
    return out


def _to_the_top(nodes: DataFrame, up: str, sums: tuple[str, ...], below: bool) -> DataFrame:
    """``nodes`` (number, up, values) with values summed over what is below each node, or over the way up, itself included: pointers double in each round, so rounds follow the logarithm of the depth."""
    now, seen = cut(nodes), 0
    rounds = now.count().bit_length() + 1
    while not now.where(F.col(up).isNotNull()).isEmpty():
        seen += 1
        if seen > rounds:
            raise ValueError("the tree has a cycle")
        above = now.select(F.col("number").alias(up), F.col(up).alias("_next"), *[F.col(c).alias(f"_a_{c}") for c in sums])
        step = now.join(above, up, "left")
        if below:
            more = now.where(F.col(up).isNotNull()).groupBy(F.col(up).alias("number")).agg(*[F.sum(c).alias(f"_m_{c}") for c in sums])
            step = step.join(more, "number", "left")
        add = "_m_" if below else "_a_"
        values = [(F.col(c) + F.coalesce(f"{add}{c}", F.lit(0))).alias(c) for c in sums]
        kept = [c for c in nodes.columns if c not in (up, *sums)]
        now = cut(step.select(*kept, F.col("_next").alias(up), *values))
    return now


def interval_labels(rules: DataFrame) -> DataFrame:
    """(number, enter, leave, depth) of a forest (number, parent, pos): places in document order, a parent before what is below it and siblings by ``pos``, then number.

    The nodes from ``enter`` to ``leave`` are a node's subtree, itself first.  A parent that is no node makes a root; a cycle fails.  Sizes of subtrees come from below, places from above, both by pointer doubling; what stands before a node
    among its siblings is a running sum in ranges, so neither depth nor many children of one node are held by a task.
    """
    known = rules.select(F.col("number").alias("parent")).distinct().withColumn("_known", F.lit(True))
    nodes = rules.select("number", "parent", "pos").join(known, "parent", "left").select("number", F.when(F.col("_known"), F.col("parent")).alias("parent"), "pos")
    nodes = cut(assert_unique(nodes, "number"))
    sizes = _to_the_top(nodes.select("number", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size")), "up", ("size",), below=True).select("number", "size")
    placed = running(nodes.join(sizes, "number"), ["parent"], ["pos", "number"], sums={"upto": F.col("size")})
    own = placed.select("number", F.col("parent").alias("up"), "size", (F.col("upto") - F.col("size") + F.col("parent").isNotNull().cast("long")).alias("enter"), F.lit(1).cast("long").alias("depth"))
    out = _to_the_top(own, "up", ("enter", "depth"), below=False)
    return out.select("number", "enter", (F.col("enter") + F.col("size") - 1).alias("leave"), "depth")


def subtrees_by_label(labels: DataFrame, roots: DataFrame, width: int = 4096) -> DataFrame:
    """(root, number, distance, place) of the asked roots (number): all below each, itself first, ``place`` in document order.

    A range join without comparing all with all: both sides meet on stretches of ``width`` labels, of which a root has as many as its subtree fills.
    """
    asked = labels.join(roots.select("number").distinct(), "number", "left_semi").select(F.col("number").alias("root"), F.col("enter").alias("_from"), "leave", F.col("depth").alias("_depth"))
    asked = asked.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor(F.col("leave") / width))))
    rows = labels.select("number", "enter", "depth", F.floor(F.col("enter") / width).alias("_b"))
    met = asked.join(rows, "_b").where(F.col("enter").between(F.col("_from"), F.col("leave")))
    return met.select("root", "number", (F.col("depth") - F.col("_depth")).alias("distance"), (F.col("enter") - F.col("_from")).alias("place"))


def undirected(*edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) in both directions, without loops."""
    out = None
    for e in edges:
        both = e.select("src", "dst").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        out = both if out is None else out.union(both)
    return out.where("src <> dst").distinct()


def ball(seeds: DataFrame, adjacency: DataFrame, hops: int) -> DataFrame:
    """(seed, node, distance): all nodes within ``hops`` of each seed, seeds included, at their least distance; ``seeds`` may name the nodes (seed, node) that each begins at.

    A step goes on from the nodes that the one before reached first, and what is reached already is taken out, so no walk is gone twice.  Each frontier is kept (a job of its own); where it is empty the ball ends early.
    """
    start = F.col("node") if "node" in seeds.columns else F.col("seed")
    step = seen = cut(seeds.select(F.col("seed"), start.alias("node"), F.lit(0).alias("distance")).distinct())
    for d in range(1, hops + 1):
        near = step.select("seed", F.col("node").alias("src")).join(adjacency, "src").select("seed", F.col("dst").alias("node")).distinct()
        step = cut(near.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("distance", F.lit(d)))
        if step.isEmpty():
            break
        seen = seen.unionByName(step)
    return seen


# --- upserts: built-in file sources have no merge, so each returns the next snapshot ------------------------------------


def merge_last(old: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Nodes after an upsert: of the rows with a key the last by ``order`` wins over others and over the old node."""
    cols = old.columns
    new = rows.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select("r.*")
    return old.join(new, key, "left_anti").unionByName(new)


def merge_first(old: DataFrame, rows: DataFrame, key: str, order: str, prop: str) -> DataFrame:
    """Keeps a property that is set; else takes the first non-null value by ``order``."""
    new = rows.groupBy(key).agg(F.min_by(prop, F.when(F.col(prop).isNotNull(), F.col(order))).alias("new"))
    both = old.select(key, prop).join(new, key, "full_outer")
    return both.select(key, F.coalesce(prop, "new").alias(prop))


def insert_only(old: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Existing edges stay as they are; of new ones with the same ends the first by ``order`` is added."""
    cols = old.columns
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("r")).select("r.*")
    return old.unionByName(first.join(old, keys, "left_anti"))


def valid_edges(edges: DataFrame, src: DataFrame, src_key: str, dst: DataFrame, dst_key: str) -> DataFrame:
    """Distinct edges whose both ends exist; others are dropped, as matching the ends would."""
    out = edges.join(src.select(F.col(src_key).alias("src")), "src", "left_semi").join(dst.select(F.col(dst_key).alias("dst")), "dst", "left_semi")
    return out.dropDuplicates(["src", "dst"])


def prune(nodes: DataFrame, current_hash: str, column: str = "source_sha256") -> DataFrame:
    """Nodes without those of another source version; an unknown version is kept."""
    return nodes.where(F.coalesce(F.col(column) == F.lit(current_hash), F.lit(True)))


def version_diff(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """(key, change): withdrawn, added or reworded between two versions."""
    a, b = old.select(key, F.col(text).alias("was")), new.select(key, F.col(text).alias("now"))
    both = a.withColumn("o", F.lit(1)).join(b.withColumn("n", F.lit(1)), key, "full_outer")
    change = F.when(F.col("n").isNull(), "withdrawn").when(F.col("o").isNull(), "added").when(~F.col("was").eqNullSafe(F.col("now")), "reworded")
    return both.select(key, change.alias("change")).where("change is not null")


def assert_unique(nodes: DataFrame, key: str) -> DataFrame:
    """``nodes``, checked to hold each non-null key once (a job of its own)."""
    bad = nodes.groupBy(key).count().where(f"`{key}` is null or count > 1").limit(5).collect()
    if bad:
        raise ValueError(f"{key} is null or repeated: {[r[key] for r in bad]}")
    return nodes


def numbered(df: DataFrame, partition: list[str], order: list, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
