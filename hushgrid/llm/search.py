"""Exact top-k search by inner product with a dual-tree cover-tree traversal.

Candidates are dealt into blocks and a cover tree is built over each; queries are dealt into smaller blocks, each with a
tree of its own. A block of queries meets each block of candidates, and both trees are descended together: a pair of
nodes is dropped if no point within the covering radii can reach the worst kth score of the node's queries. A node's
children are bounded together with the other's, and leaves are multiplied best bound first, for as long as one may still
count. A task carries a block of queries, with its tree and its kth scores, over all blocks of candidates that it gets.
Blocks meet by Spark's Cartesian product of partitions: none is repeated in a shuffle, and none goes to the driver. What
the tasks find, k of each query at most, is merged by rank.

Components are integers, so products are exact in doubles, and ties are by id. Of equal vectors only the least k + 1 ids
are candidates: more of them can't be among the best k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import block_of, frugal, partitions

CANDIDATES, QUERIES = 1024, 256  # vectors of a block
LEAF = 8  # candidates of a leaf, unless they are equal; a query is a leaf by itself
TOGETHER = 8  # points of leaves that a query is multiplied with at first
ONCE = 2048  # points whose distances are computed together
CARRIED = 200  # blocks of queries that a task keeps


@dataclass
class Node:
    """center and covering radius of the points in rows, which are in children, or all in the node itself; of the children
    also their centers, radii and norms as arrays."""

    rows: np.ndarray
    center: np.ndarray
    radius: float
    norm: float
    children: list["Node"] = field(default_factory=list)
    centers: np.ndarray | None = None
    radii: np.ndarray | None = None
    norms: np.ndarray | None = None


def squared_distances(own: np.ndarray) -> np.ndarray | None:
    """Of all pairs of few points by one product, if that is exact for whole numbers and safe from loss for others."""
    if len(own) > ONCE:
        return None
    norms = (own * own).sum(axis=1)
    if not norms.max() < 2.0**50 or not (own == np.floor(own)).all():
        return None
    return norms[:, None] + norms - 2 * (own @ own.T)


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, scale: float | None = None, leaf: int = LEAF) -> Node:
    """A cover tree: the children's centers are further apart than their scale, half of their parent's, and each point
    is within the scale of its center. Nodes of few, or of equal, points are leaves."""
    rows = np.arange(len(points)) if rows is None else rows
    own = points[rows]
    center = own[0]
    away = np.sqrt(((own - center) ** 2).sum(axis=1))
    radius = float(away.max())
    node = Node(rows, center, radius, float(np.sqrt(center @ center)))
    if len(rows) <= leaf or radius == 0:
        return node
    scale = radius / 2 if scale is None else min(scale, radius) / 2
    left, apart = np.arange(len(rows)), squared_distances(own)
    while len(left):
        squares = ((own[left] - own[left[0]]) ** 2).sum(axis=1) if apart is None else apart[left[0]][left]
        near = np.sqrt(squares) <= scale
        node.children.append(cover_tree(points, rows[left[near]], scale, leaf))
        left = left[~near]
    node.centers = np.array([c.center for c in node.children])
    node.radii, node.norms = np.array([c.radius for c in node.children]), np.array([c.norm for c in node.children])
    return node


def bound(q: Node, c: Node) -> float:
    """No product of a point of q and one of c is more."""
    return float(q.center @ c.center) + q.radius * c.norm + c.radius * q.norm + q.radius * c.radius + 1e-6


class TopK:
    def __init__(self, n: int, k: int):
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.scores.shape[1]
        both = np.concatenate([self.scores[rows], scores], axis=1)
        names = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        by_id = np.argsort(names, axis=1, kind="stable")
        both, names = np.take_along_axis(both, by_id, axis=1), np.take_along_axis(names, by_id, axis=1)
        best = np.argsort(-both, axis=1, kind="stable")[:, :k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(both, best, axis=1), np.take_along_axis(names, best, axis=1)


def opened(node: Node) -> tuple[list[Node], np.ndarray, np.ndarray, np.ndarray]:
    """A node's children, or the node itself, with their centers, radii and norms."""
    if node.children:
        return node.children, node.centers, node.radii, node.norms
    return [node], node.center[None, :], np.array([node.radius]), np.array([node.norm])


def dual_search(queries: np.ndarray, query_ids: np.ndarray, q: Node, points: np.ndarray, ids: np.ndarray, c: Node, best: TopK) -> tuple[int, int]:
    """Improves best by the points; tells how many pairs of a query and a point were multiplied, and how many dropped."""
    multiplied = dropped = 0

    def worst(node: Node) -> float:
        return best.scores[node.rows, -1].min()

    def leaves(qs: list[Node], cs: list[Node], bounds: np.ndarray) -> None:
        """All points of leaves qs with those of leaves cs: each query's best bounds first, for as long as one may still count."""
        nonlocal multiplied, dropped
        own, of = np.concatenate([x.rows for x in qs]), np.repeat(np.arange(len(qs)), [len(x.rows) for x in qs])
        theirs, to = np.concatenate([x.rows for x in cs]), np.repeat(np.arange(len(cs)), [len(x.rows) for x in cs])
        left, width = bounds[of][:, to], TOGETHER
        dropped += left.size
        going = np.arange(len(own))
        while True:
            going = going[left[going].max(axis=1) >= best.scores[own[going], -1]]
            going = going[left[going].max(axis=1) > -np.inf]
            if not len(going):
                return
            n = min(width, len(theirs))
            some = np.argpartition(-left[going], n - 1, axis=1)[:, :n]
            known = np.take_along_axis(left[going], some, axis=1)
            counts = (known > -np.inf) & (known >= best.scores[own[going], -1][:, None])
            left[going[:, None], some] = -np.inf
            places, asked = theirs[some], own[going]
            scores = np.einsum("qd,qnd->qn", queries[asked], points[places])
            scores[~counts | (query_ids[asked][:, None] == ids[places])] = -np.inf
            best.add(asked, scores, np.where(counts, ids[places], np.iinfo(np.int64).max))
            multiplied, dropped = multiplied + int(counts.sum()), dropped - int(counts.sum())
            width *= 2

    stack = [(bound(q, c), q, c)]
    while stack:
        most, q, c = stack.pop()
        if most < worst(q):
            dropped += len(q.rows) * len(c.rows)
            continue
        (qs, q_centers, q_radii, q_norms), (cs, c_centers, c_radii, c_norms) = opened(q), opened(c)
        bounds = q_centers @ c_centers.T + np.outer(q_radii, c_norms) + np.outer(q_norms + q_radii, c_radii) + 1e-6
        q_leaf, c_leaf = np.array([not x.children for x in qs]), np.array([not x.children for x in cs])
        if q_leaf.any() and c_leaf.any():
            a, b = np.flatnonzero(q_leaf), np.flatnonzero(c_leaf)
            leaves([qs[i] for i in a], [cs[j] for j in b], bounds[np.ix_(a, b)])
        # others are descended, the most promising next; a pair that can't count any more isn't put aside
        kth, i, j = np.array([worst(x) for x in qs]), *np.nonzero(~(q_leaf[:, None] & c_leaf))
        fine = bounds[i, j] >= kth[i]
        q_sizes, c_sizes = np.array([len(x.rows) for x in qs]), np.array([len(x.rows) for x in cs])
        dropped += int((q_sizes[i] * c_sizes[j])[~fine].sum())
        i, j = i[fine], j[fine]
        order = np.argsort(bounds[i, j], kind="stable")
        stack += [(float(bounds[x, y]), qs[x], cs[y]) for x, y in zip(i[order], j[order], strict=True)]
    return multiplied, dropped


def quantized(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component, or null if the vector, or one of its components, is null or not finite."""
    values = vector.cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(values, lambda x: F.floor(x * factor).cast("double")))


def _packed(df: DataFrame, blocks: int, name: str) -> DataFrame:
    """A row for each block and length of vectors: their ids and components as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def done(batch: pa.Table) -> pa.RecordBatch:
            values = np.concatenate([np.asarray(x, np.float64) for x in batch["vector"].to_numpy()]) if len(batch) else np.empty(0)
            ids = batch["id"].to_numpy().astype(np.int64)
            return pa.RecordBatch.from_arrays([batch["block"].combine_chunks()[:1], batch["size"].combine_chunks()[:1], pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], [f"{name}_block", "size", f"{name}_ids", f"{name}_vectors"])

        last = None
        for batch in batches:
            key = list(zip(batch["block"].to_pylist(), batch["size"].to_pylist(), strict=True))
            at = 0
            while at < len(key):
                to = at
                while to < len(key) and key[to] == key[at]:
                    to += 1
                if last is not None and key[at] != last:
                    yield done(pa.Table.from_batches(rest))
                    rest = []
                last = key[at]
                rest.append(batch.slice(at, to - at))
                at = to
        if rest:
            yield done(pa.Table.from_batches(rest))

    rows = df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("size", F.size("vector"))
    tasks = min(blocks, partitions(df.sparkSession))
    rows = rows.repartition(tasks, block_of(F.col("block"), tasks)).sortWithinPartitions("block", "size")
    return rows.select("block", "size", "id", "vector").mapInArrow(run, f"{name}_block int, size int, {name}_ids binary, {name}_vectors binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row of queries the k best rows of vectors (all, if fewer) but its own.

    Both have id (long) and vector (array of whole numbers as double). Rows with a null id or vector, or an empty one, take no part; ids
    are distinct after rows that are repeated are dropped, and of an id with several vectors the least counts; vectors of
    other lengths than the query's aren't candidates; without any rows there are none in the result.
    """

    def distinct(df: DataFrame) -> DataFrame:
        return df.filter(F.col("id").isNotNull() & (F.size("vector") > 0)).groupBy("id").agg(F.min("vector").alias("vector"))

    vectors, queries = distinct(vectors), distinct(queries)
    equal = Window.partitionBy("vector").orderBy("id")
    vectors = vectors.withColumn("nth", F.row_number().over(equal)).filter(F.col("nth") <= k + 1).drop("nth")
    (n_vectors,), (n_queries,) = vectors.agg(F.count("*")).first(), queries.agg(F.count("*")).first()
    lanes = max(1, -(-n_vectors // CANDIDATES))
    there = _packed(vectors, lanes, "c").withColumnRenamed("size", "c_size")
    asked = _packed(queries, max(1, -(-n_queries // QUERIES)), "q")
    # a broadcast of the pairs would take them all to the driver: the planner only knows how small the queries are
    met = there.hint("shuffle_replicate_nl").crossJoin(asked.repartition(max(1, -(-n_queries // (QUERIES * CARRIED))), "q_block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, of = None, None
        carried: dict[tuple, tuple] = {}

        def told(of_queries: tuple) -> pa.RecordBatch:
            query_ids, _, _, best = of_queries
            row, column = np.nonzero(best.scores > -np.inf)
            return pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(best.ids[row, column]), pa.array(best.scores[row, column].astype(np.int64))], ["query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                block, size, other, q_block = (batch[name][row].as_py() for name in ("c_block", "c_size", "size", "q_block"))
                if size != other:
                    continue
                qi, qv, ci, cv = (batch[name][row].as_buffer() for name in ("q_ids", "q_vectors", "c_ids", "c_vectors"))
                if (block, size) != of:
                    ids, points = np.frombuffer(ci, np.int64), np.frombuffer(cv, np.float64).reshape(-1, size)
                    tree, of = cover_tree(points), (block, size)
                if (q_block, size) not in carried:
                    if len(carried) >= CARRIED:
                        yield told(carried.pop(next(iter(carried))))
                    query_ids, vectors_ = np.frombuffer(qi, np.int64), np.frombuffer(qv, np.float64).reshape(-1, size)
                    carried[q_block, size] = (query_ids, vectors_, cover_tree(vectors_, leaf=1), TopK(len(query_ids), k))
                query_ids, vectors_, root, best = carried[q_block, size]
                dual_search(vectors_, query_ids, root, points, ids, tree, best)
        for own in carried.values():
            yield told(own)

    found = met.mapInArrow(frugal(run), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
