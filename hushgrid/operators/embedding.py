"""Text vectors learned from a corpus: weighted terms on their leading directions, by a randomised block method.

Terms are words, hashed into a fixed number of numbers; a text's row is its terms' (1 + ln count) * idf, of length 1. A
block of random directions is multiplied by all rows and back, once for each pass over the corpus, and made orthogonal
between; what it spans then holds the leading right singular vectors. Texts are cut into words once: the passes read a bag
for each, its different terms and their counts, from the shared folder. A pass sends one block for each task, in parts that
are added up by part; the driver holds blocks of terms times directions, whose size the parameters give.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import shared_folder

TERMS, DIMS, MORE = 1 << 15, 64, 16
PART = 512  # terms of a part of a block
SLICE = 1 << 16  # words, or terms of bags, that are worked on at a time; a longer text is one slice
BAG = T.StructType([T.StructField(name, T.ArrayType(T.IntegerType())) for name in ("terms", "counts")])
PROJECTION = "term int, weight double, direction array<double>"


def terms_of(text: Column, terms: int = TERMS) -> Column:
    """Numbers of a text's words: longest strings of letters and digits, in lower case; null has none."""
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(terms)).cast("int"))


@F.arrow_udf(BAG)
def bag_of(numbers: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The different ones of each row's numbers, in order, and how often each occurs."""
    for batch in numbers:
        own, counts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for lengths, values in _slices(batch):
            low = int(values.min()) if len(values) else 0
            width = int(values.max()) - low + 1 if len(values) else 1
            found, n = np.unique(np.repeat(np.arange(len(lengths)), lengths) * width + (values - low), return_counts=True)
            row, term = np.divmod(found, width)
            own.append((term + low).astype(np.int32))
            counts.append(n.astype(np.int32))
            sizes.append(np.bincount(row, minlength=len(lengths)))
        ends = pa.array(np.concatenate(sizes).cumsum(), pa.int32())
        yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (own, counts)], ["terms", "counts"])


def bags(rows: DataFrame, text: str = "text", terms: int = TERMS) -> DataFrame:
    """rows with ``bag`` instead of their text, made once and kept in the shared folder, for fit_bags() and Projection.embedded_bags()."""
    folder = f"{shared_folder(rows.sparkSession)}/bags-{uuid.uuid4().hex}"
    rows.withColumn("bag", bag_of(terms_of(F.col(text), terms))).drop(text).write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def _slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lengths and values of the lists in a column, for a slice of rows at a time."""
    lengths, values = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy()
    ends = np.cumsum(lengths)
    at = done = 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(ends, done + SLICE, "right")))
        yield lengths[at:to], values[done : ends[to - 1]]
        at, done = to, int(ends[to - 1])


def _weighted(bag: pa.StructArray, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lengths, terms and weights of bags, for a slice at a time; a row's weights are of length 1 together."""
    for (lengths, own), (_, counts) in zip(_slices(bag.field("terms")), _slices(bag.field("counts")), strict=True):
        weights = (1 + np.log(counts)) * idf[own]
        norms = np.ones(len(lengths))
        some = lengths > 0
        if some.any():
            norms[some] = np.sqrt(np.add.reduceat(weights * weights, (np.cumsum(lengths) - lengths)[some]))
        yield lengths, own, weights / np.repeat(np.where(norms > 0, norms, 1), lengths)


def _multiplied(rows: DataFrame, idf: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The sum over all rows a of a (a block), in one pass over their bags."""
    told = rows.sparkSession.sparkContext.broadcast((idf, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, block = told.value
        out = np.zeros_like(block)
        for batch in batches:
            for lengths, own, weights in _weighted(batch.column(0), idf):
                done = 0
                for n in lengths.tolist():
                    at, weight = own[done : done + n], weights[done : done + n]
                    out[at] += weight[:, None] * (weight @ block[at])
                    done += n
        parts = range(0, len(out), PART)
        yield pa.RecordBatch.from_arrays([pa.array([at // PART for at in parts], pa.int32()), pa.array([out[at : at + PART].tobytes() for at in parts], pa.binary())], ["part", "data"])

    def added(parts: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x) for x in parts["data"].to_pylist()], axis=0)
        return pa.table({"part": parts["part"][:1], "data": pa.array([total.tobytes()], pa.binary())})

    sums = rows.select("bag").mapInArrow(run, "part int, data binary").groupBy("part").applyInArrow(added, "part int, data binary").collect()
    out = np.zeros_like(block)
    for part, data in sums:
        out[part * PART : (part + 1) * PART] = np.frombuffer(data).reshape(-1, block.shape[1])
    told.destroy()
    return out


def _counted(rows: DataFrame, terms: int) -> tuple[int, np.ndarray]:
    """How many rows have terms, and how many have each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(terms + 1, np.int64)
        for batch in batches:
            lists = batch.column(0).field("terms")
            n[:terms] += np.bincount(lists.flatten().to_numpy(), minlength=terms)
            n[terms] += np.count_nonzero(lists.value_lengths().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), pa.array(n[n > 0], pa.int64())], ["term", "n"])

    df = np.zeros(terms + 1)
    for term, n in rows.select("bag").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect():  # a row for each term
        df[term] = n
    return int(df[terms]), df[:terms]


@dataclass
class Projection:
    """What texts' vectors are made with: a weight and a row of directions for each term."""

    weights: np.ndarray
    directions: np.ndarray
    values: np.ndarray | None = None

    def table(self, spark: SparkSession) -> DataFrame:
        """term, weight, direction: to be written and read again."""
        rows = pa.table({"term": pa.array(range(len(self.weights)), pa.int32()), "weight": self.weights, "direction": pa.array(list(self.directions), pa.list_(pa.float64()))})
        return spark.createDataFrame(rows, PROJECTION)

    @staticmethod
    def of(table: DataFrame) -> "Projection":
        """From such a table, a row for each term."""
        rows = table.orderBy("term").toArrow()
        directions = np.stack([np.asarray(x) for x in rows["direction"].to_pylist()])
        return Projection(rows["weight"].to_numpy(), directions)

    def embedded(self, rows: DataFrame, text: str, name: str = "embedding") -> DataFrame:
        """rows with a vector of length 1 for the text of each, zeros for one without words; a text's vector depends on it
        alone. The projection is sent to executors once; it has as many rows as there are terms."""
        bag = bag_of(terms_of(F.col(text), len(self.weights)))
        return rows.withColumn(name, self._vectors(rows.sparkSession)(bag))

    def embedded_bags(self, rows: DataFrame, name: str = "embedding") -> DataFrame:
        """The same for rows of bags(), which were cut into as many terms as the projection has."""
        return rows.withColumn(name, self._vectors(rows.sparkSession)(F.col("bag"))).drop("bag")

    def _vectors(self, spark: SparkSession):
        told = spark.sparkContext.broadcast((self.weights, self.directions))

        @F.arrow_udf("array<double>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            idf, directions = told.value
            for batch in batches:
                out = np.zeros((len(batch), directions.shape[1]))
                at = 0
                for lengths, own, weights in _weighted(batch, idf):
                    done = 0
                    for n in lengths.tolist():
                        v = (weights[done : done + n, None] * directions[own[done : done + n]]).sum(axis=0)
                        norm = np.sqrt((v * v).sum())
                        out[at] = v / norm if norm > 0 else v
                        at, done = at + 1, done + n
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))

        return run


def fit(docs: DataFrame, dims: int = DIMS, terms: int = TERMS, more: int = MORE, passes: int = 2, seed: int = 0) -> Projection:
    """Learns a projection from the texts of docs, which are read once. Rare terms weigh more; with more
    extra directions, or passes, the leading ones are nearer to the exact ones. Null and empty texts teach nothing."""
    return fit_bags(bags(docs.select("text"), "text", terms), dims, terms, more, passes, seed)


def fit_bags(rows: DataFrame, dims: int = DIMS, terms: int = TERMS, more: int = MORE, passes: int = 2, seed: int = 0) -> Projection:
    """fit() for rows of bags(), of so many terms: one pass that counts, and passes passes."""
    n, df = _counted(rows, terms)
    idf = np.log((1 + n) / (1 + df)) + 1
    block = np.random.default_rng(seed).normal(size=(terms, min(dims + more, terms)))
    image = block
    for _ in range(passes):
        block = np.linalg.qr(image)[0]
        image = _multiplied(rows, idf, block)
    values, turns = np.linalg.eigh(block.T @ image)
    best = np.argsort(-values, kind="stable")[:dims]
    directions = block @ turns[:, best]
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])])
    return Projection(idf, directions * np.where(signs == 0, 1, signs), np.sqrt(np.maximum(values[best], 0)))
