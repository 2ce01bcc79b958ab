"""Connected components by contraction in tasks and jumps between them; no node's edges need to meet in one task.

An edge leads from a node to a lesser one. Each round

1. replaces the edges of each task by stars: each node leads to the least node that it is connected with there. Tasks
   do so twice: with the edges as they lie, so that a node has an edge for each task at most, and then with all edges
   that lead from the same nodes;
2. lets each edge that leads to a node with an edge of its own lead to that one's end.

It ends when no edge moves and each node has one edge: then all lead to the least node of their component. Ends that many
edges have are looked up by dealt_join(), which spreads them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, partitions, settled

CHUNK = 1_000_000  # edges that a task contracts at a time
EDGES = "a long, b long"


def least_connected(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 and edges between a and b, the least node of each one's component."""
    label = np.arange(n)
    while True:
        one, two = label[a], label[b]
        low, high = np.minimum(one, two), np.maximum(one, two)
        apart = low != high
        if not apart.any():
            return label
        np.minimum.at(label, high[apart], low[apart])
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each chunk as stars around the least node of each component that the chunk shows."""
    waiting: list[pa.RecordBatch] = []
    size = 0

    def contracted() -> pa.RecordBatch:
        ends = [np.concatenate([w.column(i).to_numpy() for w in waiting]) for i in (0, 1)]
        nodes, index = np.unique(np.concatenate(ends), return_inverse=True)
        label = least_connected(index[: len(ends[0])], index[len(ends[0]) :], len(nodes))
        some = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[label[some]])], ["a", "b"])

    for batch in batches:
        waiting.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            yield contracted()
            waiting, size = [], 0
    if size:
        yield contracted()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for each node of edges (a, b: long, not null) that has another neighbour than
    itself; no order, direction or repetition of edges matters, and without edges there are no rows. Each round is
    written to the shared folder."""
    n = partitions(edges.sparkSession)
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
    while True:
        met = settled(edges.mapInArrow(stars, EDGES).repartition(n, "a").mapInArrow(stars, EDGES))
        ends = met.groupBy("a").agg(F.min("b").alias("up"), F.max("b").alias("other"))
        moved = dealt_join(met, ends.select(F.col("a").alias("b"), "up"), ["b"], F.xxhash64("a"), "left")
        moved = settled(moved.select("a", F.coalesce("up", "b").alias("b"), F.col("up").isNotNull().alias("moved")))
        edges = moved.select("a", "b")
        if moved.filter("moved").isEmpty() and ends.filter("up != other").isEmpty():
            break
    leaves = edges.distinct().select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component")))
