"""Merkle manifest of a dataset with octopus multiproofs (operator 13).

Every row is a leaf, the hash of its fields. The leaves of a group, in the order of the key, are the
bottom of the group's tree: while it has several nodes, every ``ARITY`` consecutive ones (the last run:
fewer, even one) become their hash. The groups' roots, in the order of the group (null first, bytewise),
are the bottom of one more tree, whose root stands for the dataset.

Leaves are numbered by ranges of (group, key, leaf), so a hot group spreads over many partitions, and one
shuffle a level builds the trees. For the proofs each partition of leaves works on its own part as a
whole (an octopus multiproof): it computes the minimal union of the nodes that the proofs of all its
leaves need and that cannot be derived from these leaves, fetches them once by a join, derives the shared
interior nodes and expands the proof of every leaf locally.

Defined results: a null field is hashed as ``-``; rows with a null key come first in their group; rows
that repeat a key are ordered by their leaf (equal rows: by their place in the input, which changes no
digest); a null group is a group of its own; empty texts are fields of no bytes; an empty table gives an
empty table. Only the named columns are read, so others of any name have no effect.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ARITY = 16
PART_LEAVES = 32_768  # leaves of a partition, about
TOP = -1  # number of the tree over the groups
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(column: Column) -> Column:
    """A value with its UTF-8 length before it, ``-`` for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def numbered(df: DataFrame, order: list[str], rows: int, kind: str) -> DataFrame:
    """``df`` in ranges of ``order``: ``_part``, the row's place in it (``_slot``) and in all (``_place``)."""
    parts = max(1, -(-rows // PART_LEAVES))
    keys = [F.col(c).asc_nulls_first() for c in order]
    sorted_rows = written(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                          .withColumn("_id", F.monotonically_increasing_id()), kind)
    placed = sorted_rows.select(*df.columns, F.shiftright("_id", 33).cast("int").alias("_part"),
                                F.col("_id").bitwiseAND((1 << 33) - 1).alias("_slot"))
    # one row for each range partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").count().select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_part").withColumn("_place", F.col("_slot") + F.col("_offset")).drop("_offset")


def tree_levels(nodes: DataFrame, kind: str) -> list[DataFrame]:
    """The levels above ``nodes`` (tree, total, index, digest); ``total`` is the number of nodes of the tree's level."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    levels = []
    while most > 1:
        runs = (nodes.where("total > 1")
                .select("tree", "total", F.expr(f"index div {ARITY}").alias("run"), "index", "digest")
                .groupBy("tree", "total", "run").agg(F.array_sort(F.collect_list(F.struct("index", "digest"))).alias("nodes")))
        nodes = written(runs.select("tree", F.expr(f"(total + {ARITY - 1}) div {ARITY}").alias("total"),
                                    F.col("run").alias("index"),
                                    F.sha2(F.concat_ws("", "nodes.digest"), 256).alias("digest")), kind)
        levels.append(nodes)
        most = -(-most // ARITY)
    return levels


def missing_nodes(index: np.ndarray, total: int) -> Iterator[tuple[int, np.ndarray]]:
    """Level and indices of the nodes that proofs of the leaves ``index`` (sorted) need and that these don't give.

    Going up, a node is known if a leaf below it is there or if it has been fetched: so only
    the siblings of known nodes are fetched, and no node below or above another fetched one."""
    level = 0
    while total > 1:
        parents = np.unique(index // ARITY)
        children = (parents[:, None] * ARITY + np.arange(ARITY)).ravel()
        found = np.setdiff1d(children[children < total], index, assume_unique=True)
        if len(found):
            yield level, found
        index, total, level = parents, -(-total // ARITY), level + 1


class PartialTree:
    """What a partition knows of one tree: its own leaves, fetched nodes and all that follows from them."""

    def __init__(self, index: np.ndarray, digests: list[str], total: int, fetched: dict[tuple[int, int], str]):
        own = dict(zip(index.tolist(), digests, strict=True))
        self.levels: list[dict[int, tuple[str, str]]] = []  # for each derived node: its siblings left and right
        level = 0
        while total > 1:
            sides, above = {}, {}
            for run in dict.fromkeys(i // ARITY for i in own):
                start, end = run * ARITY, min(run * ARITY + ARITY, total)
                nodes = [own[i] if i in own else fetched[level, i] for i in range(start, end)]
                for i in range(start, end):
                    if i in own:
                        sides[i] = "".join(nodes[:i - start]), "".join(nodes[i - start + 1:])
                above[run] = sha256("".join(nodes))
            self.levels.append(sides)
            own, total, level = above, -(-total // ARITY), level + 1
        self.root = own[0]
        self.folded: dict[tuple[int, int, str], str] = {}

    def siblings(self, rest: str = "") -> dict[int, str]:
        """For each leaf the siblings on its way to the root, with ``rest`` behind them."""
        found = {0: rest}
        for sides in reversed(self.levels):
            found = {i: left + right + found[i // ARITY] for i, (left, right) in sides.items()}
        return found

    def fold(self, index: int, digest: str, level: int = 0) -> str:
        """The root that follows from a leaf's digest and the siblings on its way (interior steps are remembered)."""
        if level == len(self.levels):
            return digest
        left, right = self.levels[level][index]
        above = sha256(left + digest + right)
        key = level, index // ARITY, above
        if key not in self.folded:
            self.folded[key] = self.fold(index // ARITY, above, level + 1)
        return self.folded[key]


PROVED = "part int, tree long, index long, leaf string, claimed string, subroot string, root string, proof_sha256 string, " \
         "folded_root string"


def missing_of_part(spans: pa.Table) -> pa.Table:
    """Coordinates of the missing nodes of a partition's leaves (``spans``: its runs of leaves by tree)."""
    part = spans.column("part")[0].as_py()
    parts, trees, levels, indices = [], [], [], []

    def add(tree: int, index: np.ndarray, total: int) -> None:
        for level, found in missing_nodes(index, total):
            parts.append(np.full(len(found), part, np.int32))
            trees.append(np.full(len(found), tree, np.int64))
            levels.append(np.full(len(found), level, np.int32))
            indices.append(found)

    own = spans.column("tree").to_numpy()
    for tree, first, n, total in zip(own.tolist(), *(spans.column(c).to_pylist() for c in ("first", "n", "total")), strict=True):
        add(tree, np.arange(first, first + n), total)
    add(TOP, np.sort(own), spans.column("trees")[0].as_py())
    kinds = (np.int32, np.int64, np.int32, np.int64)
    flat = [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip((parts, trees, levels, indices), kinds, strict=True)]
    return pa.table(flat, names=["part", "tree", "level", "index"])


def prove_part(leaves: pa.Table, nodes: pa.Table) -> pa.Table:
    """Proofs of a partition's leaves, from these and the fetched nodes."""
    fetched: dict[int, dict[tuple[int, int], str]] = {}
    for tree, level, index, digest in zip(*(nodes.column(c).to_pylist() for c in ("tree", "level", "index", "digest")), strict=True):
        fetched.setdefault(tree, {})[level, index] = digest
    leaves = leaves.sort_by([("tree", "ascending"), ("index", "ascending")]).combine_chunks()
    tree, index = leaves.column("tree").to_numpy(), leaves.column("index").to_numpy()
    total = leaves.column("total").to_numpy()
    leaf, claimed = leaves.column("leaf").to_pylist(), leaves.column("claimed").to_pylist()
    cuts = [0, *(np.flatnonzero(np.diff(tree)) + 1).tolist(), len(tree)]
    runs = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    own = [PartialTree(index[a:b], leaf[a:b], int(total[a]), fetched.get(int(tree[a]), {})) for a, b in runs]
    top_index = tree[[a for a, _ in runs]]
    top = PartialTree(top_index, [t.root for t in own], leaves.column("trees")[0].as_py(), fetched.get(TOP, {}))
    ahead = top.siblings()
    subroot, proof, folded = [], [], []
    for (a, b), part, number in zip(runs, own, top_index.tolist(), strict=True):
        subroot += [part.root] * (b - a)
        way = part.siblings(ahead[number])
        places = index[a:b].tolist()
        proof += [sha256(way[i]) for i in places]
        folded += [top.fold(number, part.fold(i, d)) for i, d in zip(places, claimed[a:b], strict=True)]
    columns = {c: leaves.column(c) for c in ("part", "tree", "index", "key", "leaf", "claimed")}
    return pa.table({**columns, "subroot": subroot, "root": [top.root] * len(tree), "proof_sha256": proof, "folded_root": folded})


def prove(leaves: DataFrame) -> DataFrame:
    """Roots and proofs of ``leaves``: columns group, key, leaf and claimed (the digest to be checked).

    Returns part, tree (number of the group), index (of the leaf in its tree), key, leaf, claimed, subroot,
    root, proof_sha256 (of the siblings on the way to the root) and folded_root (from claimed and the
    siblings); a leaf is verified if folded_root is the root."""
    rows = leaves.count()
    order = ["group", "key", "leaf", "_row"]
    ranged = numbered(leaves.withColumn("_row", F.monotonically_increasing_id()), order, rows, "leaves").drop("_row")
    spans = ranged.groupBy("_part", "group").agg(F.min("_slot").alias("_low"), F.count("*").alias("n"))
    whole = Window.partitionBy("group")
    ahead = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = written(spans.select("*", F.sum("n").over(whole).alias("total"),
                                 F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first")), "spans")
    groups = spans.where("first = 0").select("group", "total")
    trees = groups.count()
    groups = numbered(groups, ["group"], trees, "groups").select("group", F.col("_place").alias("tree"))
    spans = written(spans.withColumnRenamed("group", "g").join(groups, F.col("g").eqNullSafe(F.col("group")))
                    .select(F.col("_part").alias("part"), "group", "tree", "_low", "first", "n", "total",
                            F.lit(trees).cast("long").alias("trees")), "trees")

    side = spans.withColumnRenamed("group", "g")
    placed = ranged.join(side, (F.col("_part") == F.col("part")) & F.col("group").eqNullSafe(F.col("g")))
    placed = written(placed.select("part", "tree", (F.col("_slot") - F.col("_low") + F.col("first")).alias("index"), "total",
                                   "trees", "first", "n", "key", "leaf", "claimed"), "placed")
    bottom = placed.select("tree", "total", "index", F.col("leaf").alias("digest"))
    levels = [bottom, *tree_levels(bottom, "level")]
    roots = levels[0].where("total = 1")
    for above in levels[1:]:
        roots = roots.union(above.where("total = 1"))
    roots = written(roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(trees).cast("long").alias("total"),
                                 F.col("tree").alias("index"), "digest"), "roots")
    # of the leaves only those whose run goes on in another partition are ever fetched
    run = F.expr(f"index div {ARITY}") * ARITY
    cut = placed.where((run < F.col("first")) | (F.least(run + ARITY, "total") > F.col("first") + F.col("n")))
    nodes = cut.select("tree", F.lit(0).alias("level"), "index", F.col("leaf").alias("digest"))
    for tier in (levels, [roots, *tree_levels(roots, "top")]):
        for number, found in enumerate(tier):
            if found is not bottom:
                nodes = nodes.union(found.select("tree", F.lit(number).alias("level"), "index", "digest"))

    needed = spans.groupBy("part").applyInArrow(missing_of_part, "part int, tree long, level int, index long")
    fetched = needed.join(nodes, ["tree", "level", "index"])
    key = placed.schema["key"].dataType.simpleString()
    return (placed.groupBy("part").cogroup(fetched.groupBy("part"))
            .applyInArrow(prove_part, PROVED.replace("leaf string", f"key {key}, leaf string")))


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = (
        "doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None,
        where: Column | None = None) -> DataFrame:
    """Manifest and proofs of all rows of ``docs``.

    ``tampered`` replaces fields, in the rows ``where`` holds, before the digest that is checked
    against the proof is taken; without it every row is checked against itself."""
    columns = {c: F.col(f"`{c}`") for c in fields}
    leaf = leaf_digest(list(columns.values()))
    claimed = leaf
    if tampered:
        changed = leaf_digest([tampered.get(c, column) for c, column in columns.items()])
        claimed = F.when(F.coalesce(where if where is not None else F.lit(True), F.lit(False)), changed).otherwise(leaf)
    leaves = docs.select(F.col(f"`{group}`").alias("group"), F.col(f"`{key}`").alias("key"), leaf.alias("leaf"),
                         claimed.alias("claimed"))
    proved = prove(written(leaves, "digests"))
    return proved.select(F.col("key").alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)
