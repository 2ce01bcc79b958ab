"""Document fingerprints by one-permutation MinHash.

A text's shingle hashes are binned once by their high bits, and each bin keeps its least hash. An empty bin looks
through a fixed random sequence of bins, its own, and takes the first filled one's value (optimal densification). Of
each bin the low-order bits are stored, packed. Two fingerprints agree in a bin by chance with probability
2^-bits, which the estimate takes off again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, partitions, texts
from .shingles import WIDTH, shingle_hashes

BINS = 256  # a power of two
BITS = 8  # kept of each bin: 8, 4, 2 or 1
FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Fingerprinter:
    def __init__(self, bins: int = BINS, bits: int = BITS, width: int = WIDTH, seed: int = 7):
        self.bins, self.bits, self.width = bins, bits, width
        self.shift = np.uint64(64 - bins.bit_length() + 1)
        self.random = np.random.default_rng(seed)
        self.probes = self.random.integers(0, bins, (bins, 16))

    def values(self, hashes: np.ndarray) -> np.ndarray:
        """The least hash of each bin after densification; at least one hash is needed."""
        hashes = np.sort(hashes)
        where = (hashes >> self.shift).astype(np.int64)
        first = np.concatenate(([True], where[1:] != where[:-1]))
        filled = np.zeros(self.bins, bool)
        out = np.zeros(self.bins, np.uint64)
        out[where[first]] = hashes[first]
        filled[where[first]] = True
        empty = np.flatnonzero(~filled)
        at = 0
        while len(empty):
            if at >= self.probes.shape[1]:  # the sequences go on for as long as needed
                self.probes = np.concatenate([self.probes, self.random.integers(0, self.bins, self.probes.shape)], axis=1)
            to = self.probes.shape[1]
            looked = self.probes[empty, at:to]
            hit = filled[looked]
            found = hit.any(axis=1)
            out[empty[found]] = out[looked[found, hit[found].argmax(axis=1)]]
            empty, at = empty[~found], to
        return out

    def packed(self, text: str) -> np.ndarray:
        low = (self.values(shingle_hashes(text, self.width)) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        if self.bits == 8:
            return low
        per = 8 // self.bits
        return np.bitwise_or.reduce(low.reshape(-1, per) << (np.arange(per, dtype=np.uint8) * self.bits), axis=1).astype(np.uint8)

    def likeness(self, a: np.ndarray, b: np.ndarray) -> float:
        """Estimated Jaccard similarity, 0 to 1."""
        differ = a ^ b
        if self.bits != 8:
            differ = (differ[:, None] >> (np.arange(8 // self.bits, dtype=np.uint8) * self.bits)) & ((1 << self.bits) - 1)
        chance = 2.0**-self.bits
        return min(1.0, max(0.0, (1 - np.count_nonzero(differ) / self.bins - chance) / (1 - chance)))


def text_of(packed: np.ndarray) -> str:
    return base64.b64encode(packed.tobytes()).decode()


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """doc_id and fingerprint of each row. Null texts are empty; a text without words has a fingerprint of its own kind,
    which equals that of other such texts; repeated rows stay, an empty table gives none, other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(bins, bits, width)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_of(maker.packed(t)) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return texts(docs).mapInArrow(frugal(run), "doc_id long, fingerprint string")


def _bucket(value: Column, bounds: list[int], low: int = 0) -> Column:
    """How many of the sorted bounds are at most value, by bisection."""
    if not bounds:
        return F.lit(low)
    half = len(bounds) // 2
    return F.when(value < bounds[half], _bucket(value, bounds[:half], low)).otherwise(_bucket(value, bounds[half + 1 :], low + half + 1))


def with_successor(docs: DataFrame, run, schema: str, parts: int | None = None) -> DataFrame:
    """Rows in descending doc_id (null last, ties by text) in runs, each followed by a copy of its successor's first row.

    run gets Arrow batches of bucket, ghost, doc_id, text in this order; the ghost rows of a bucket come last. Only
    the runs' bounds and first ids, one for each run, pass through the driver, and each text is shuffled once.
    """
    spark = docs.sparkSession
    parts = parts or 8 * partitions(spark)  # runs far more than tasks, which get about as many each
    rows = texts(docs).withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63))))
    if parts > 1:
        found = rows.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    else:
        found = None
    rows = rows.withColumn("bucket", _bucket(F.col("at"), sorted(set(found or []))))
    firsts = sorted((b, at) for b, at in rows.groupBy("bucket").agg(F.max("at")).collect())  # at most parts rows
    if not firsts:
        return spark.createDataFrame([], schema)
    pairs = [(at, firsts[(i + 1) % len(firsts)][0]) for i, (_, at) in enumerate(firsts)]
    ghosts = rows.drop("bucket").join(F.broadcast(spark.createDataFrame(pairs, "at long, bucket int")), "at").select("at", "doc_id", "text", "bucket", F.lit(True).alias("ghost"))
    both = rows.select("at", "doc_id", "text", "bucket", F.lit(False).alias("ghost")).unionByName(ghosts)
    dealt = both.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "ghost", F.desc("at"), "text")
    return dealt.select("bucket", "ghost", "doc_id", "text").mapInArrow(run, schema)


def edited_pairs(docs: DataFrame, bins: int = BINS, bits: int = BITS, width: int = WIDTH) -> DataFrame:
    """Fingerprints of each text and of the text whose last third is the beginning of the next document, by descending
    doc_id, the first following the last; and their likenesses. Null texts are empty; repeated rows stay and follow
    one another; a table of one row follows itself; an empty table gives no rows; other columns are left out."""
    names = [x.split()[0] for x in FINGERPRINTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(bins, bits, width)
        last = None  # the row that waits for its successor
        for batch in batches:
            out: list[tuple] = []
            for bucket, ghost, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is None and ghost:
                    continue  # more ghosts of a run that is done
                own = maker.packed(text)
                if last is not None:
                    _, before, old, old_print = last
                    third = len(old) // 3
                    edited = old[: len(old) - third] + text[:third]
                    changed = old_print if edited == old else maker.packed(edited)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((before, len(old), sha, text_of(old_print), text_of(changed), maker.likeness(old_print, changed), maker.likeness(old_print, own)))
                last = None if ghost else (bucket, doc, text, own)
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return with_successor(docs, frugal(run), FINGERPRINTS)
