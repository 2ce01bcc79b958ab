"""Delta Lloyd: clustering by exact integer arithmetic in which each round does only what the last one changed.

Every vector's owner and its distance are kept in a table in the shared folder, sums and counts of all clusters as whole
numbers. A round compares vectors with the centroids that changed; only vectors whose own centroid changed are compared
with the others, too. A vector that changes its owner is taken off the one sum and added to the other: tasks send these
signed transfers, added up, and no vector is added again that stayed where it was.

Vectors are packed into blocks once, dealt by block, and held by the executors from round to round, where a lost part is
made again from the written blocks. Owners and distances, a few bytes for each vector, are what is written and dealt in a
round. The driver holds centroids, sums and counts alone.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, partitions, remove, shared_dir

BLOCK = 4096  # vectors of a block
LARGEST = 1 << 26  # of components, so that squared distances are exact in 64 bits
PACKED = "block long, ids array<long>, vectors binary"
ROUND = "block long, ids array<long>, owners array<int>, distances array<long>, cluster int, count long, sums array<long>"
CLUSTERS = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole_numbers(vector: Column, factor: int, dims: int) -> Column:
    """floor(factor * x) of each component, x as double; null unless there are dims of them, none null or non-finite."""
    values = vector.cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when((F.size(values) == dims) & fine, F.transform(values, lambda x: F.floor(x * factor)))


def starts(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors (all, if fewer) whose ids have the least hashes with seed; ties go to the smaller vector, null ids are
    the last. These k alone come to the driver."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    return [list(r.vector) for r in vectors.orderBy(order.asc_nulls_last(), "vector").limit(k).collect()]


def _blocks(vectors: DataFrame, dims: int) -> DataFrame:
    """Vectors in blocks as they are read, without an exchange; a block's number tells its task and its place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, made = TaskContext.get(), 0
        high = (context.partitionId() if context else 0) << 32
        waiting: list[pa.RecordBatch] = []

        def packed(rows: pa.Table) -> pa.RecordBatch:
            nonlocal made
            values = rows["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
            if len(values) and np.abs(values).max() >= LARGEST:
                raise ValueError(f"components of {LARGEST} and more leave no room for exact distances")
            ids = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows["id"].combine_chunks())
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([high + made]), ids, pa.array([values.astype(np.int32).tobytes()], pa.binary())], ["block", "ids", "vectors"])

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= BLOCK:
                whole = pa.Table.from_batches(waiting)
                while len(whole) >= BLOCK:
                    yield packed(whole.slice(0, BLOCK))
                    whole = whole.slice(BLOCK)
                waiting = whole.to_batches()
        if waiting:
            yield packed(pa.Table.from_batches(waiting))

    return vectors.select("id", "vector").mapInArrow(frugal(run), PACKED)


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points and centroids; products are summed in doubles if these hold them."""
    largest = max(int(np.abs(points).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * largest * largest * points.shape[1] < 1 << 53 else np.int64
    x, c = points.astype(kind), centroids.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)


def compared(points: np.ndarray, centroids: np.ndarray, changed: np.ndarray, owners: np.ndarray | None, distances: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: the smaller number) and distance of each point, from those that it had before centroids with
    the numbers in changed moved (None: it had none), and how many pairs were compared."""
    if owners is None or distances is None:
        all_ = squared_distances(points, centroids)
        best = all_.argmin(axis=1)
        return best.astype(np.int32), all_[np.arange(len(points)), best], all_.size
    owners, distances, pairs = owners.copy(), distances.copy(), 0
    if not len(changed) or not len(points):
        return owners, distances, 0
    far = np.iinfo(np.int64).max
    moved = np.zeros(len(centroids), bool)
    moved[changed] = True
    stale = np.flatnonzero(moved[owners])
    still = np.flatnonzero(~moved)
    distances[stale] = far
    if len(stale) and len(still):
        others = squared_distances(points[stale], centroids[still])
        pairs += others.size
        best = others.argmin(axis=1)
        owners[stale], distances[stale] = still[best], others[np.arange(len(stale)), best]
    to_changed = squared_distances(points, centroids[changed])
    pairs += to_changed.size
    best = to_changed.argmin(axis=1)
    nearest, where = to_changed[np.arange(len(points)), best], changed[best]
    nearer = (nearest < distances) | ((nearest == distances) & (where < owners))
    owners[nearer], distances[nearer] = where[nearer], nearest[nearer]
    return owners.astype(np.int32), distances, pairs


def _round(dims: int, centroids: np.ndarray, changed: np.ndarray, first: bool, last: bool):
    """Assigns the vectors of blocks; afterwards a row for each cluster that gained or lost any: how many and their sum, less
    those that left. Cluster -1 counts the pairs that were compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, pairs = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64), 0
        touched = np.zeros(len(centroids), bool)
        names = [x.split()[0] for x in ROUND.split(", ")]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.list_(pa.int64())]

        def told(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns.get(x, [None] * n), kind) for x, kind in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for row in range(batch.num_rows):
                points = np.frombuffer(batch["vectors"][row].as_buffer(), np.int32).reshape(-1, dims).astype(np.int64)
                old = None if first else batch["owners"][row].values.to_numpy()
                owners, distances, n = compared(points, centroids, changed, old, None if first else batch["distances"][row].values.to_numpy())
                pairs += n
                gone = np.arange(len(points)) if old is None else np.flatnonzero(owners != old)
                for whose, sign in ((owners, 1), (old, -1)):
                    if whose is not None and len(gone):
                        np.add.at(counts, whose[gone], sign)
                        np.add.at(sums, whose[gone], sign * points[gone])
                        touched[whose[gone]] = True
                yield told(block=[batch["block"][row].as_py()], ids=[batch["ids"][row].values if last else None], owners=[owners], distances=[distances])
        who = np.flatnonzero(touched)
        yield told(cluster=[-1, *who.tolist()], count=[pairs, *counts[who].tolist()], sums=[None, *sums[who]])

    return frugal(run)


class Clustering:
    """The state of a run: what is written of vectors and assignments, and centroids, sums and counts on the driver."""

    def __init__(self, vectors: DataFrame, dims: int, centroids: list[list[int]]):
        """vectors: id (long) and vector (array of dims whole numbers); rows with a null vector take no part."""
        self.spark: SparkSession = vectors.sparkSession
        self.dims, self.folder, self.rounds = dims, f"{shared_dir(self.spark)}/centroids-{uuid.uuid4().hex}", 0
        self.centroids = np.array(centroids, np.int64).reshape(-1, dims)
        self.changed = np.arange(len(self.centroids))
        self.sums, self.counts = [[0] * dims for _ in centroids], [0] * len(centroids)
        self.pairs: list[int] = []
        _blocks(vectors.filter("vector is not null"), dims).write.parquet(f"{self.folder}/blocks")
        blocks = self.spark.read.parquet(f"{self.folder}/blocks")
        self.blocks = blocks.repartition(partitions(self.spark), "block").persist(StorageLevel.MEMORY_AND_DISK)

    def assign(self, last: bool = False) -> None:
        """Gives each vector its owner; changes sums and counts by what moved."""
        rows = self.blocks
        if self.rounds:
            before = self.spark.read.parquet(f"{self.folder}/{self.rounds}").filter("block is not null").select("block", "owners", "distances")
            rows = rows.join(before.hint("shuffle_hash"), "block").select("block", "ids", "vectors", "owners", "distances")
        run = _round(self.dims, self.centroids, self.changed, not self.rounds, last)
        rows.mapInArrow(run, ROUND).write.parquet(f"{self.folder}/{self.rounds + 1}")
        if self.rounds:
            remove(self.spark, f"{self.folder}/{self.rounds}")
        self.rounds += 1
        sent = self.spark.read.parquet(f"{self.folder}/{self.rounds}").filter("cluster is not null")
        number = F.posexplode(F.concat(F.array("count"), F.coalesce("sums", F.expr("array()"))))
        moved = sent.select("cluster", number.alias("place", "n")).groupBy("cluster", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
        for cluster, place, n in moved.collect():  # clusters times components
            if cluster < 0:
                self.pairs.append(int(n))
            elif place:
                self.sums[cluster][place - 1] += int(n)
            else:
                self.counts[cluster] += int(n)

    def move(self) -> bool:
        """Sets each centroid that owns vectors to the floor of their mean; whether any changed."""
        rows = [[s // n for s in own] if n else old for own, n, old in zip(self.sums, self.counts, self.centroids.tolist(), strict=True)]
        after = np.array(rows, np.int64).reshape(-1, self.dims)
        self.changed = np.flatnonzero((after != self.centroids).any(axis=1))
        self.centroids = after
        return bool(len(self.changed))

    def result(self) -> DataFrame:
        """id, cluster, distance of the last assignment; what only earlier rounds needed is removed."""
        self.blocks.unpersist()
        remove(self.spark, f"{self.folder}/blocks")
        rows = self.spark.read.parquet(f"{self.folder}/{self.rounds}").filter("block is not null")
        each = F.explode(F.arrays_zip("ids", "owners", "distances")).alias("v")
        return rows.select(each).select(F.col("v.ids").alias("id"), F.col("v.owners").alias("cluster"), F.col("v.distances").alias("distance"))


def delta_lloyd(vectors: DataFrame, dims: int, k: int, rounds: int, seed: int) -> DataFrame:
    """A row for each row of vectors: vec_id, its cluster (from 0) and squared distance after so many rounds and one more
    assignment; the distances summed over its cluster and over all; a hash of its centroid's components.

    vectors has id (long) and vector (array of whole numbers, or null: no part; all others have dims of them, each below
    2^26 in size). Repeated rows count as often as they occur, and so do rows with a null id, which start no centroid
    unless there are no others. With fewer than k vectors there are fewer clusters; an empty table gives no rows; other columns are
    left out. Centroids without vectors stay; ties go to the smaller number. A round that moves no centroid is the last.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("id", "vector").filter("vector is not null")
    first = starts(vectors, k, seed)
    if not first:
        return spark.createDataFrame([], CLUSTERS)
    run = Clustering(vectors, dims, first)
    for done in range(rounds + 1):
        run.assign(last=done == rounds)
        if done < rounds and not run.move():
            run.changed = np.arange(0)
            run.assign(last=True)
            break
    rows = run.result()
    own = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    all_ = rows.agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("t"))
    hashes = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(run.centroids.tolist())]
    named = spark.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    # one row for each cluster
    sums = own.join(named, "cluster").crossJoin(all_).select("cluster", F.col("s").cast("long").alias("cluster_inertia"), F.col("t").cast("long").alias("inertia"), "centroid_sha256")
    return rows.join(F.broadcast(sums), "cluster").select(F.col("id").alias("vec_id"), *[x.split()[0] for x in CLUSTERS.split(", ")[1:]])
