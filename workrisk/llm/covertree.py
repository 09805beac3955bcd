"""Exact top-k search by inner product with two cover trees (operator 6).

Vectors become integers (the floor of ``scale`` times each component), so scores are exact.
Candidates are put into blocks of bounded size that are compact in space (by the nearest of
a fixed number of pivots, split evenly by a hash of the id), queries into groups likewise.
Every pair of a query group and a block is one task's unit: it indexes the queries and the
data in a cover tree each and walks both trees at once. A pair of nodes is pruned if

    centre . centre + |q centre| * r + |r centre| * q + q * r

(q, r the covering radii) is below the worst kth score among the node's queries. What is
left is compared leaf by leaf, one matrix product for a pair of leaves. Each unit returns the best k of every query; a window merges
them. The pivots only shape the blocks: every row is searched, results are exact.

A block's equal vectors are one point of its tree with their k + 1 smallest ids, which is all
that a result can hold of them.

Defined results: null vectors and vectors with null or non-finite components take no part;
neither do rows with a null id or with another number of components than most rows have;
equal scores go to the smaller id; rows that repeat an id are one candidate for each
different vector and never a match of their own id; fewer candidates than k give them all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = 10
SCALE = 1024
PIVOTS = 64           # vectors that shape the blocks, chosen by a hash of the id
BLOCK = 4096          # candidates in a block, about
GROUP = 512           # queries in a group, about
LEAF = 256            # points below which a node is not split further: one product for each pair of leaves
CHILDREN = 32         # children of a node at most


class CoverTree:
    """Nodes with a centre (a point of the node), its covering radius, and children or points.

    Centres of children are taken farthest first until every point is within half the radius
    or the node has ``CHILDREN`` of them, so siblings are at least as far apart as the largest
    of their radii; every point belongs to the nearest centre (a batch-built cover tree)."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.norms = np.sqrt((points * points).sum(axis=1))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        if len(points):
            self._node(np.arange(len(points)), 0)

    def _distance(self, centre: int, rows: np.ndarray) -> np.ndarray:
        d = self.points[rows] - self.points[centre]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _node(self, rows: np.ndarray, at: int) -> int:
        stack = [(rows, int(rows[at]), -1)]
        first = len(self.centre)
        while stack:
            rows, centre, parent = stack.pop()
            node = len(self.centre)
            distance = self._distance(centre, rows)
            radius = float(distance.max())
            self.centre.append(centre)
            self.radius.append(radius)
            self.children.append([])
            self.members.append(rows)
            if parent >= 0:
                self.children[parent].append(node)
            if len(rows) <= LEAF or radius == 0:
                continue
            reach, parts = radius / 2, []
            near, owner = distance.copy(), np.zeros(len(rows), dtype=np.int64)
            centres = [centre]
            while True:  # the farthest point becomes a centre until all are within reach
                far = int(near.argmax())
                if near[far] <= reach or len(centres) == CHILDREN:
                    break
                d = self._distance(int(rows[far]), rows)
                closer = d < near
                owner[closer], near[closer] = len(centres), d[closer]
                centres.append(int(rows[far]))
            for i, c in enumerate(centres):
                part = rows[owner == i]
                if len(part):
                    parts.append((part, c, node))
            stack.extend(parts)
        return first


class Best:
    """The best k (score, id) of every query so far, distinct ids, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.zeros((queries, k), dtype=np.int64)
        self.worst = np.full(queries, -np.inf)  # the kth score

    def merge(self, rows: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Take in candidates of the queries ``rows``; ``row`` is the place in ``rows`` of each."""
        held, place = np.nonzero(self.score[rows] > -np.inf)
        row = np.append(row, held)
        score = np.append(score, self.score[rows[held], place])
        ids = np.append(ids, self.id[rows[held], place])
        order = np.lexsort((-score, ids, row))  # of an id's several vectors the best one stays
        row, score, ids = row[order], score[order], ids[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
        row, score, ids = row[new], score[new], ids[new]
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        kept = nth < self.k
        row, score, ids, nth = row[kept], score[kept], ids[kept], nth[kept]
        self.score[rows] = -np.inf
        self.score[rows[row], nth], self.id[rows[row], nth] = score, ids
        self.worst[rows] = self.score[rows, self.k - 1]


def dual_search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: list[np.ndarray], k: int) -> Best:
    """Best k (score, id) of every query; ``ids``: ascending ids of each data point."""
    best = Best(len(queries), k)
    if not len(queries) or not len(data):
        return best
    qt, rt = CoverTree(queries), CoverTree(data)
    flat, counts = np.concatenate(ids), np.array([len(x) for x in ids])
    first = np.concatenate([[0], np.cumsum(counts)])
    repeats = int(np.unique(flat, return_counts=True)[1].max())  # vectors that share an id
    bound_cache: dict[int, float] = {}

    def bounds(q: int, nodes: list[int]) -> np.ndarray:
        c = np.array([rt.centre[n] for n in nodes])
        r = np.array([rt.radius[n] for n in nodes])
        qc, qr = qt.centre[q], qt.radius[q]
        dots = data[c] @ queries[qc]
        return dots + qt.norms[qc] * r + rt.norms[c] * qr + qr * r + 1e-6 * (1 + np.abs(dots))

    def leaves(q: int, r: int) -> None:
        """One product of two leaves; only scores that can be among the best of a query are merged."""
        qs, rs = qt.members[q], rt.members[r]
        size = counts[rs]
        where = np.repeat(first[rs] - np.cumsum(size) + size, size) + np.arange(size.sum())
        own = flat[where]
        scores = np.repeat(queries[qs] @ data[rs].T, size, axis=1)
        scores[own == query_ids[qs, None]] = -np.inf
        least, enough = best.worst[qs], k * repeats  # so many columns hold k ids at least
        if len(own) > enough:
            least = np.maximum(least, np.partition(scores, len(own) - enough, axis=1)[:, len(own) - enough])
        row, column = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if len(row):
            best.merge(qs, row, scores[row, column], own[column])
            bound_cache.clear()

    stack = [(math.inf, 0, 0)]
    while stack:
        bound, q, r = stack.pop()
        low = bound_cache.get(q)
        if low is None:
            low = bound_cache[q] = float(best.worst[qt.members[q]].min())
        if bound < low:
            continue
        q_kids, r_kids = qt.children[q], rt.children[r]
        if not q_kids and not r_kids:
            leaves(q, r)
            continue
        pairs = []
        split_query = q_kids and (not r_kids or qt.radius[q] > rt.radius[r])
        for own in (q_kids if split_query else [q]):
            nodes = [r] if split_query else r_kids
            pairs.extend((float(b), own, n) for b, n in zip(bounds(own, nodes), nodes, strict=True))
        pairs.sort()  # the most promising pair is taken first
        stack.extend(pairs)
    return best


def as_matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def usable(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v) of the rows that take part, v the integers as doubles."""
    x = F.transform(F.col(vec_col), lambda e: F.floor(e.cast("double") * scale).cast("double"))
    finite = F.forall(F.col(vec_col), lambda e: e.isNotNull() & ~F.isnan(e.cast("double"))
                      & (F.abs(e.cast("double")) < float("inf")))
    rows = (df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias(vec_col))
            .where(F.col("id").isNotNull() & F.col(vec_col).isNotNull()).where(finite))
    return rows.select("id", x.alias("v")).where(F.size("v") > 0)


def top_k(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
          scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``df`` for each row of ``queries``, itself excluded."""
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col, scale)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = sizes[0]["d"]
    rows = rows.where(F.size("v") == dims)
    pivots = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()])
    bc = spark.sparkContext.broadcast(pivots)  # PIVOTS vectors

    def nearest(batches):
        p = bc.value
        for batch in batches:
            v = as_matrix(batch.column(1))
            d = (p * p).sum(axis=1) - 2 * v @ p.T if len(v) else np.zeros((0, len(p)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(axis=1).astype(np.int32), pa.int32())],
                                             ["id", "v", "cell"])

    def in_blocks(part: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        """Rows with the number of their block of about ``size`` rows, and the number of blocks.

        Small cells share a block, a cell of several blocks is split by a hash of the id."""
        celled = written(part.distinct().mapInArrow(nearest, "id long, v array<double>, cell int"), name)
        first, pieces, filled, block = {}, {}, 0, -1
        for c in celled.groupBy("cell").count().orderBy("cell").collect():  # PIVOTS rows
            need = math.ceil(c["count"] / size)
            if block < 0 or filled + c["count"] > size:
                block, filled = block + 1, 0
            first[c["cell"]], pieces[c["cell"]] = block, need
            filled += c["count"]
            block += need - 1

        def lookup(values: dict):
            return F.element_at(F.create_map([F.lit(int(x)) for kv in values.items() for x in kv] or
                                             [F.lit(0), F.lit(0)]), F.col("cell"))

        number = lookup(first) + F.pmod(F.xxhash64("id"), lookup(pieces)).cast("int")
        return celled.withColumn(name, number).drop("cell"), block + 1

    data, blocks = in_blocks(rows, BLOCK, "block")
    asked = usable(queries, id_col, vec_col, scale).where(F.size("v") == dims)
    asked, groups = in_blocks(asked, GROUP, "part")
    # the query set meets all rows block by block: a copy of each group for every block, of each block for every group
    left = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))))
    right = data.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(groups, 1) - 1))))

    def search(q: pa.Table, r: pa.Table) -> pa.Table:
        q_ids, r_ids = (t.column("id").to_numpy() for t in (q, r))
        out: list = [[], [], []]
        if len(q_ids) and len(r_ids):
            vectors = as_matrix(r.column("v"))
            order = np.lexsort((r_ids, *vectors.T))
            vectors, r_ids = vectors[order], r_ids[order]
            new = np.ones(len(r_ids), dtype=bool)
            new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
            start = np.flatnonzero(new)
            ids = [np.unique(x)[:k + 1] for x in np.split(r_ids, start[1:])]
            found = dual_search(as_matrix(q.column("v")), q_ids, vectors[start], ids, k)
            row, place = np.nonzero(found.score > -np.inf)
            out = [q_ids[row], found.id[row, place], found.score[row, place].astype(np.int64)]
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    best = (left.groupBy("part", "block").cogroup(right.groupBy("part", "block"))
            .applyInArrow(search, "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
