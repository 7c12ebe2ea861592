"""Merkle manifest of a dataset: an associative forest of hash-tree nodes, merged as a tree.

A row's leaf is the SHA-256 of its fields. The leaves of a language, in ascending doc_id, are the nodes of level 0 of its tree;
every ``ARITY`` nodes in a row (the last run may be shorter) become the node above them, until one is left. The
languages' roots are the leaves of one more tree (the top), whose root stands for the dataset.

``Forest`` is a sparse part of all trees: nodes by (tree, level, index) whose run isn't complete. How many nodes a level has is known from
the number of leaves, so a run is complete as soon as its last member comes in; then its nodes go and the node
above takes their place, perhaps completing the next run. Merging two forests is the union of their nodes with the same
step, so it is associative and commutative and any split of the leaves gives the same nodes. A range of the sorted leaves
leaves at most ARITY - 1 nodes on a level at either end of each tree.

``grown`` builds a forest for each range of the sorted leaves and merges neighbouring ranges, ``FANOUT`` at a time, in rounds until
one is left; each round is a job over written tables, so a lost executor costs a reread, and the nodes made in
all rounds are kept: they are what proofs need. ``root`` does the same by treeReduce, without proofs; it brings only what is
unresolved to the driver, in the end the root alone.

``proofs`` goes down the trees, a level at a time: each run gets the siblings of its ancestors from the run above it, and
each row's root is folded again from its leaf, natively.

Nulls: a null field is '-'; a null lang is a tree of its own, before all others; a null doc_id comes before all others of
its language. Rows with equal doc_id are leaves of their own, in the order of their leaves' hashes. An empty table has no tree and gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import placed
from . import base

ARITY, FANOUT = 8, 16
#: The number of the top tree; languages count from 0.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "part long, tree long, leaves long, level int, index long, hash string, made boolean"
_KINDS = pa.schema([("part", pa.int64()), ("tree", pa.int64()), ("leaves", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("hash", pa.string()), ("made", pa.bool_())])


def height(leaves: int, arity: int = ARITY) -> int:
    """The level at which one node is left."""
    level = 0
    while leaves > 1:
        leaves, level = -(-leaves // arity), level + 1
    return level


class Forest:
    """Unresolved nodes; add and merge resolve each run that is complete. trees is the number of leaves of the top tree."""

    def __init__(self, trees: int, arity: int = ARITY):
        self.trees, self.arity = trees, arity
        self.runs: dict[tuple[int, int, int], dict[int, str]] = {}
        self.leaves = {TOP: trees}
        #: Nodes that were made since the list was last emptied.
        self.made: list[tuple[int, int, int, int, str]] = []

    def add(self, tree: int, leaves: int, level: int, index: int, node: str) -> "Forest":
        """Take in a node of a tree of so many leaves."""
        self.leaves[tree] = leaves
        while True:
            width, step = self.leaves[tree], 0
            while step < level:
                width, step = -(-width // self.arity), step + 1
            if width == 1:
                if tree == TOP:
                    self.runs[TOP, level, 0] = {0: node}
                    return self
                tree, level, index = TOP, 0, tree  # a language's root is a leaf of the top tree
                self.made.append((TOP, self.trees, 0, index, node))
                continue
            key = tree, level, index // self.arity
            run = self.runs.setdefault(key, {})
            run[index] = node
            if len(run) < min(self.arity, width - key[2] * self.arity):
                return self
            del self.runs[key]
            node = hashlib.sha256("".join(run[i] for i in sorted(run)).encode()).hexdigest()
            level, index = level + 1, key[2]
            self.made.append((tree, self.leaves[tree], level, index, node))

    def merge(self, other: "Forest") -> "Forest":
        for node in other.nodes():
            self.add(*node)
        self.made += other.made
        return self

    def nodes(self):
        """(tree, leaves, level, index, hash) of what is unresolved."""
        for (tree, level, _), run in self.runs.items():
            for index, node in run.items():
                yield tree, self.leaves[tree], level, index, node

    def root(self) -> str | None:
        """The dataset's root, once all is resolved."""
        found = [next(iter(run.values())) for (tree, level, _), run in self.runs.items() if tree == TOP and level == height(self.trees, self.arity)]
        return found[0] if found and len(self.runs) == 1 else None


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column | None = None) -> Column:
    """The leaf of a row, perhaps with another text."""
    return F.sha2(F.concat(*[_field(F.col(c) if c != "text" or text is None else text) for c in FIELDS]), 256)


def placed_leaves(rows: DataFrame, work: base.Scratch) -> tuple[DataFrame, int]:
    """rows (doc_id, lang, leaf, ...) with part, tree, leaves (of the tree) and index, and the number of trees."""
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The place in its range is the low half of a row's number.
    number = F.monotonically_increasing_id()
    ranges = work.keep(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long")).withColumn("place", number.bitwiseAND(F.lit((1 << 33) - 1))), "leaves")
    cells = work.keep(ranges.groupBy("lang", "part").agg(F.count("*").alias("n"), F.min("place").alias("least")), "cells")
    trees = work.keep(cells.groupBy("lang").agg(F.sum("n").alias("leaves")), "trees")
    trees = work.keep(placed(trees, F.col("lang").asc_nulls_first()).select("lang", "leaves", (F.col("place") - 1).alias("tree")), "numbered")
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("lang", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("start"))
    same = F.col("lang").eqNullSafe(F.col("__lang"))
    starts = starts.withColumnRenamed("lang", "__lang").join(trees, same).select("__lang", F.col("part").alias("__part"), "start", "tree", "leaves")
    joined = ranges.join(work.keep(starts, "starts"), same & (F.col("part") == F.col("__part")))
    return joined.withColumn("index", F.col("place") + F.col("start")).drop("__lang", "__part", "start", "place"), trees.count()


def _rows(part: int, forest: Forest, left: bool):
    """The nodes made so far and, with left, those unresolved, as an Arrow batch."""
    rows = [(part, *node, True) for node in forest.made] + ([(part, *node, False) for node in forest.nodes()] if left else [])
    forest.made = []
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows) if rows else [()] * len(_KINDS), _KINDS)], schema=_KINDS)


def _folded(trees: int):
    """Forests of the parts of a task's rows; rows of a part stand together where the table is read in order, and any order is right."""

    def run(batches):
        forests: dict[int, Forest] = {}
        for batch in batches:
            for part, *node in zip(*(c.to_pylist() for c in batch.columns)):
                if part not in forests:
                    forests[part] = Forest(trees)
                forests[part].add(*node)
            for part, forest in forests.items():
                if forest.made:
                    yield _rows(part, forest, False)
        for part, forest in forests.items():
            yield _rows(part, forest, True)

    return run


def grown(leaves: DataFrame, trees: int, work: base.Scratch) -> DataFrame:
    """(tree, leaves, level, index, hash) of all nodes above the leaves, the top tree's leaves included."""
    base.python_ready(leaves.sparkSession)
    fold = _folded(trees)
    level = F.lit(0).alias("level")
    made = work.keep(leaves.select("part", "tree", "leaves", level, "index", F.col("leaf").alias("hash")).mapInArrow(fold, _NODES), "nodes-0")
    rounds = [made]

    def merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(trees)
        for node in zip(rows["tree"].tolist(), rows["leaves"].tolist(), rows["level"].tolist(), rows["index"].tolist(), rows["hash"]):
            forest.add(*node)
        return _rows(int(key[0]), forest, True).to_pandas()

    while True:
        left = rounds[-1].filter("NOT made")
        if left.count() <= 1:  # the root
            break
        rounds.append(work.keep(left.groupBy(F.floor(F.col("part") / FANOUT).alias("wide")).applyInPandas(merged, _NODES), f"nodes-{len(rounds)}"))
    nodes = rounds[0].filter("made")
    for more in rounds[1:]:
        nodes = nodes.unionByName(more.filter("made"))
    return nodes.select("tree", "leaves", "level", "index", "hash")


def _runs(nodes: DataFrame) -> DataFrame:
    """One row for each run of siblings: tree, level, run and its members in order."""
    return nodes.groupBy("tree", "level", F.floor(F.col("index") / ARITY).alias("run")).agg(F.max("leaves").alias("leaves"), F.sort_array(F.collect_list(F.struct("index", "hash"))).alias("members"))


def _around(members: str, index: Column) -> Column:
    """What stands left and right of a member, its hash left out."""
    joined = lambda keep: F.array_join(F.transform(F.filter(members, keep), lambda m: m["hash"]), "")
    return F.struct(joined(lambda m: m["index"] < index).alias("left"), joined(lambda m: m["index"] > index).alias("right"))


def _longer() -> Column:
    """The path of a member m of a run: what is around it, then the run's own path."""
    return F.concat(F.array(_around("members", F.col("m.index"))), F.col("path")).alias("path")


def _height(leaves: Column) -> Column:
    return sum(((leaves > F.lit(ARITY**k)).cast("int") for k in range(1, 21)), (leaves > F.lit(1)).cast("int"))


def paths(leaves: DataFrame, nodes: DataFrame, work: base.Scratch) -> DataFrame:
    """Each row of leaves with subroot, root and path: (left, right) of each run from its own upwards."""
    all_nodes = nodes.withColumn("high", _height(F.col("leaves")))
    tops = all_nodes.filter(F.col("level") == F.col("high"))
    root = tops.filter(F.col("tree") == TOP).select(F.col("hash").alias("root"))
    runs = work.keep(_runs(all_nodes.filter(F.col("level") < F.col("high"))), "runs")
    high = {r.top: r.high for r in runs.groupBy((F.col("tree") == TOP).alias("top")).agg((F.max("level") + 1).alias("high")).collect()}
    shared = ["path", "root", "subroot"]

    def down(at: DataFrame, level: int, tree: Column) -> DataFrame:
        """The members of a level's runs with their paths; at: (tree, index) of the nodes that the runs make, with theirs."""
        own = runs.filter(tree & (F.col("level") == level)).select("tree", F.col("run").alias("index"), "members")
        found = own.join(at, ["tree", "index"]).select("tree", *shared, "members", F.explode("members").alias("m"))
        return found.select("tree", F.col("m.index").alias("index"), _longer(), "root", "subroot")

    none = F.array().cast("array<struct<left:string,right:string>>")
    above = root.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).cast("long").alias("index"), none.alias("path"), "root", F.lit(None).cast("string").alias("subroot"))
    for level in range(high.get(True, 0) - 1, -1, -1):
        above = work.keep(down(above, level, F.col("tree") == TOP), f"top-{level}")
    # The members of the top tree's lowest runs, or its one leaf, are the languages' roots.
    roots = tops.filter(F.col("tree") != TOP).select("tree", "high", F.col("hash").alias("subroot"))
    alone = leaves.filter("leaves = 1").select("tree", F.lit(0).alias("high"), F.col("leaf").alias("subroot"))
    roots = roots.unionByName(alone).join(above.select(F.col("index").alias("tree"), "path", "root"), "tree")
    roots = work.keep(roots.withColumn("index", F.lit(0).cast("long")), "roots")
    at = roots.filter(F.col("high") == high.get(False, 1)).drop("high")
    for level in range(high.get(False, 1) - 1, 0, -1):
        at = work.keep(down(at, level, F.col("tree") != TOP), f"level-{level}")
        at = at.unionByName(roots.filter(F.col("high") == level).drop("high"))
    # Level 0: the runs of the rows themselves, which share the path above them.
    names = [c for c in leaves.columns if c not in ("part", "leaves", "index", "tree")]
    kept = F.struct(F.col("index"), F.col("leaf").alias("hash"), *names)
    own = leaves.filter("leaves > 1").groupBy("tree", F.floor(F.col("index") / ARITY).alias("index")).agg(F.sort_array(F.collect_list(kept)).alias("members"))
    many = own.join(at, ["tree", "index"]).select(*shared, "members", F.explode("members").alias("m"))
    many = many.select(*[F.col(f"m.{c}").alias(c) for c in names], _longer(), "root", "subroot")
    one = leaves.filter("leaves = 1").join(roots.select("tree", *shared), "tree").select(*names, *shared)
    return many.unionByName(one)


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, node, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def proof(path: Column) -> Column:
    """The SHA-256 of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def proofs(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row; text: what each row's text has become since."""
    work = base.Scratch(docs.sparkSession, "merkle")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf().alias("leaf"), leaf(text).alias("now"))
    leaves, trees = placed_leaves(slim, work)
    leaves = work.keep(leaves, "placed")
    found = paths(leaves, grown(leaves, trees, work), work)
    return found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.col("now"), F.col("path")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def root(docs: DataFrame) -> str | None:
    """The dataset's root alone, by treeReduce; None of an empty table."""
    base.python_ready(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf().alias("leaf"))
    with base.released():
        leaves, trees = placed_leaves(slim, base.Scratch(docs.sparkSession, "merkle-root"))

        def grow(rows):
            forest = Forest(trees)
            for tree, n, index, node in rows:
                forest.add(tree, n, 0, index, node)
                forest.made = []
            yield forest

        def merge(a: Forest, b: Forest) -> Forest:
            a.merge(b).made = []
            return a

        return leaves.select("tree", "leaves", "index", "leaf").rdd.mapPartitions(grow).treeReduce(merge, depth=3).root() if trees else None
