"""N-gram Jaccard join with Bayesian candidate pruning.

1. A text's word shingles are a set; texts with equal sets are a class, and only one of each class goes on.
2. Classes that share a band of their MinHash signatures, and no others, are candidates. The classes of a band are cut into
   blocks of about BLOCK, and each pair of blocks is a lane, so that a large group is dealt over many tasks. Lanes get
   signatures, not texts.
3. In a lane the MinHash values of pairs are compared ROUND at a time, all pairs at once: from a uniform prior the posterior
   of the similarity after m of n agree is Beta(m + 1, n - m + 1), and a pair is dropped as soon as its probability of
   reaching the threshold is below TOLERANCE. A pair that shares several bands counts in the first of them alone. What
   is left is told as a bit for each partner, a row for each class, not for each pair.
4. Only classes with a partner left get their texts, and lanes verify the pairs exactly on the sets. Each tells the
   number of links of each class, and stars that connect what is linked.
5. The components of the stars are the groups.

At 0.8 a pair of classes shares none of the 30 bands of 5 values with a probability of 7e-6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import any_names, dealt_join, frugal, partitions, parts_of, settled, texts
from .components import components, least_connected
from .meeting import ROUTED, repeated, routed
from .shingles import WIDTH, mixed, shingle_hashes

THRESHOLD = 0.8
BANDS, ROWS = 30, 5
ROUND = 30  # MinHash values compared at a time
TOLERANCE = 1e-6
BLOCK = 256  # classes of a block
FEW = 32  # classes of a lane that is looked at together with others
PAIRS = 200_000  # pairs that are compared at a time
SETS = 20_000  # classes whose bands are looked at together
_rng = np.random.default_rng(31)
_MULTIPLY = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash values of a set of 64-bit hashes: the least of each multiply-add image's high bits."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(out, (hashes[at : at + 512, None] * _MULTIPLY + _ADD).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(values: np.ndarray) -> np.ndarray:
    """Rows of keys, one for each band, of rows of signatures."""
    grid = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), grid.shape[:2])
    for column in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, :, column] + np.uint64(1))
    return key.view(np.int64)


def least_agreeing(n: int, threshold: float, tolerance: float) -> int:
    """The fewest agreements among n at which P(similarity >= threshold) is still tolerance or more: the posterior's
    upper tail is that of at most m of n + 1 trials at the threshold."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def surviving(signs: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which of the pairs of rows of signs the posterior doesn't rule out."""
    left, agree = np.arange(len(first)), np.zeros(len(first), np.int64)
    for at in range(0, signs.shape[1], ROUND):
        to = min(at + ROUND, signs.shape[1])
        agree = agree + np.count_nonzero(signs[first[left], at:to] == signs[second[left], at:to], axis=1)
        ok = agree >= least_agreeing(to, threshold, TOLERANCE)
        left, agree = left[ok], agree[ok]
    return left


def classes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, print (a hash of doc_id and text), high and low (hash of the set of shingles), sign, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            high, low, signs = [], [], []
            for text in batch.column(2):
                hashes = np.unique(shingle_hashes(text.as_py(), width))
                high.append(int(np.bitwise_xor.reduce(mixed(hashes)).view(np.int64)))
                low.append(int(np.sum(mixed(hashes ^ np.uint64(0x5BD1E995)), dtype=np.uint64).view(np.int64)))
                signs.append(signature(hashes).tobytes())
            columns = [batch.column(0), batch.column(1), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "high", "low", "sign"])

    rows = texts(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("print"), "text")
    return rows.mapInArrow(frugal(run), "doc_id long, print long, high long, low long, sign binary")


def signs_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), BANDS * ROWS)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sign) as rows of ROUTED whose keys are bands."""
    waiting: list[pa.RecordBatch] = []

    def done() -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([band_keys(signs_of(w.column(1))) for w in waiting])
        return routed(keys.ravel(), np.repeat(np.concatenate([w.column(0).to_numpy() for w in waiting]), BANDS))

    for batch in batches:
        waiting.append(batch)
        if sum(w.num_rows for w in waiting) >= SETS:
            yield from done()
            waiting = []
    if waiting:
        yield from done()


class Lanes:
    """Rows sorted by lane (key, i, j) and, in these, by block and id."""

    def __init__(self, table: pa.Table):
        self.key, self.i, self.j, self.block, self.id = (table[c].to_numpy() for c in ("key", "i", "j", "block", "id"))
        self.signs = signs_of(table["sign"])
        new = np.ones(len(self.key), bool)
        new[1:] = (self.key[1:] != self.key[:-1]) | (self.i[1:] != self.i[:-1]) | (self.j[1:] != self.j[:-1])
        self.starts = np.flatnonzero(new)
        self.ends = np.append(self.starts[1:], len(new))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of rows that a lane has to look at, about PAIRS at a time: of one block, or of two different ones."""
        sizes = self.ends - self.starts
        small = (sizes <= FEW) & (self.i[self.starts] == self.j[self.starts])
        for size in np.unique(sizes[small & (sizes > 1)]):
            one, two = np.triu_indices(size, 1)
            begins = self.starts[small & (sizes == size)][:, None]
            step = max(1, PAIRS // len(one))
            for at in range(0, len(begins), step):
                yield (begins[at : at + step] + one).ravel(), (begins[at : at + step] + two).ravel()
        for start, end in zip(self.starts[~small].tolist(), self.ends[~small].tolist(), strict=True):
            same = self.i[start] == self.j[start]
            middle = end if same else start + int(np.count_nonzero(self.block[start:end] == self.i[start]))
            step = max(1, PAIRS // (end - start))
            for at in range(start, middle, step):
                rows = np.arange(at, min(at + step, middle))
                others = np.arange(at + 1 if same else middle, end)
                one, two = np.repeat(rows, len(others)), np.tile(others, len(rows))
                fresh = two > one
                yield one[fresh], two[fresh]

    def candidates(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that aren't ruled out and share no earlier band."""
        keys, found = band_keys(self.signs), []
        for one, two in self.pairs():
            left = surviving(self.signs, one, two, threshold)
            one, two = one[left], two[left]
            earliest = (keys[one] == keys[two]).argmax(axis=1)
            mine = keys[one, earliest] == self.key[one]
            found.append((one[mine], two[mine]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2

    def told(self, threshold: float) -> Iterator[pa.RecordBatch]:
        """A row for each class with a candidate in a lane: its rank among these, and the ranks of its later partners
        as bits."""
        one, two = self.candidates(threshold)
        if not len(one):
            return
        rows = np.unique(np.concatenate([one, two]))
        lane = np.searchsorted(self.starts, rows, side="right")
        begins = np.searchsorted(lane, lane)
        rank = np.arange(len(rows)) - begins
        sizes = np.searchsorted(lane, lane, side="right") - begins
        order = np.argsort(one, kind="stable")
        place, partner = np.searchsorted(rows, one[order]), rank[np.searchsorted(rows, two[order])]
        cuts = np.searchsorted(place, np.arange(len(rows) + 1)).tolist()
        bits = []
        for k, size in enumerate(sizes.tolist()):
            flags = np.zeros(size, bool)
            flags[partner[cuts[k] : cuts[k + 1]]] = True
            bits.append(np.packbits(flags).tobytes())
        columns = [self.key[rows], self.i[rows], self.j[rows], rank.astype(np.int32), self.id[rows]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(bits, pa.binary())], [x.split()[0] for x in PARTNERS.split(", ")])


PARTNERS = "key long, i int, j int, rank int, id long, partners binary"


def _lanes(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch])
            whole = whole if rest is None else pa.concat_tables([rest, whole])
            last = [whole[c][-1].as_py() for c in ("key", "i", "j")]
            open_ = np.all([whole[c].to_numpy() == x for c, x in zip(("key", "i", "j"), last, strict=True)], axis=0)
            cut = len(whole) - int(np.count_nonzero(open_))
            rest = whole.slice(cut).combine_chunks()
            if cut:
                yield from Lanes(whole.slice(0, cut)).told(threshold)
        if rest is not None:
            yield from Lanes(rest).told(threshold)

    return frugal(run)


def verified(ids: list[int], copies: list[int], sets: list[np.ndarray], partners: list[bytes], threshold: float) -> list[tuple]:
    """(id, rows linked with it, null) and (id, 0, least id of what it is linked with) for a lane's classes, in the order of
    their ranks."""
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    begins = np.cumsum(sizes) - sizes
    here, one, two = np.zeros(len(words), bool), [], []
    for k, bits in enumerate(partners):
        others = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(sets)))
        if not len(others):
            continue
        own = flat[begins[k] : begins[k] + sizes[k]]
        here[own] = True
        if 4 * len(others) < len(sets):
            shared = np.array([np.count_nonzero(here[flat[begins[o] : begins[o] + sizes[o]]]) for o in others.tolist()])
        else:
            shared = np.add.reduceat(here[flat], begins, dtype=np.int64)[others]
        here[own] = False
        linked = others[shared >= threshold * (sizes[k] + sizes[others] - shared)]
        one.append(np.full(len(linked), k))
        two.append(linked)
    one, two = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (one, two))
    many = np.array(copies, np.float64)
    links = np.bincount(one, weights=many[two], minlength=len(sets)) + np.bincount(two, weights=many[one], minlength=len(sets))
    root = least_connected(one, two, len(sets)).tolist()
    out = [(ids[k], int(n), None) for k, n in enumerate(links.tolist()) if n]
    return out + [(ids[k], 0, ids[to]) for k, to in enumerate(root) if to != k]


def _verify(threshold: float, width: int):
    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["id", "n", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, rows = None, []
        for batch in parts_of(batches):
            out: list[tuple] = []
            keys = zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
            for k, now in enumerate(keys):
                if now != lane and rows:
                    out += verified(*map(list, zip(*rows, strict=True)), threshold)
                    rows = []
                lane = now
                text = batch.column(6)[k].as_py()
                rows.append((batch.column(4)[k].as_py(), batch.column(5)[k].as_py(), np.unique(shingle_hashes(text, width)), batch.column(7)[k].as_py()))
            if out:
                yield table(out)
        if rows and (out := verified(*map(list, zip(*rows, strict=True)), threshold)):
            yield table(out)

    return frugal(run)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """doc_id, print, class_id (the least doc_id of its group) and n_links (other rows with a similarity of threshold or
    more, copies included) of each row.

    Null texts are empty; texts of fewer words than a shingle are one shingle of all their words, so texts without
    words are alike; repeated rows are copies of each other; null doc_ids take part, and a group of only such has class
    null; an empty table gives no rows; other columns are left out. Words are lower-cased and end at blanks.
    """
    n = partitions(docs.sparkSession)
    rows = settled(classes(docs, width))
    own, lane = ["high", "low"], ["key", "i", "j"]
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "print")).alias("pick")
    sets = rows.groupBy(*own).agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), pick, F.first("sign").alias("sign"))
    sets = settled(sets.withColumn("id", F.monotonically_increasing_id()))

    # the classes that share a band, and how many blocks they make; a frequent band is counted in parts
    met = sets.select("id", "sign").mapInArrow(frugal(_banded), ROUTED).repartition(n, "route").sortWithinPartitions("key")
    members = settled(met.mapInArrow(frugal(repeated), "key long, id long").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")))
    per = members.groupBy("key", "part").agg(F.count("*").alias("m"))
    size = per.groupBy("key").agg(F.sum("m").alias("size"))
    blocks = per.join(size, "key").select("key", "part", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(blocks, ["key", "part"]).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "id"), "blocks").cast("int"))

    lanes = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    dealt = placed.join(sets.select("id", "sign"), "id").withColumn("lane", F.explode(lanes))
    dealt = dealt.select("key", "lane.i", "lane.j", "block", "id", "sign").repartition(n, *lane).sortWithinPartitions(*lane, "block", "id")
    partners = settled(dealt.mapInArrow(_lanes(threshold), PARTNERS))

    # the texts of the rows picked for classes with partners; rows that are alike in doc_id and text are one
    wanted = partners.select("id").distinct().join(sets, "id").select("id", "copies", F.col("pick.print").alias("print"), F.col("pick.doc_id").alias("of"))
    text = texts(docs).withColumn("print", F.xxhash64("doc_id", "text"))
    full = wanted.join(text, (wanted["print"] == text["print"]) & wanted["of"].eqNullSafe(text["doc_id"])).select("id", "copies", "text").dropDuplicates(["id"])
    asked = partners.join(full, "id").select(*lane, "rank", "id", "copies", "text", "partners").repartition(n, *lane).sortWithinPartitions(*lane, "rank")
    found = settled(asked.mapInArrow(_verify(threshold, width), "id long, n long, other long"))

    groups = components(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "id")
    links = found.groupBy("id").agg(F.sum("n").alias("links"))
    told = sets.select("id", *own, "copies", "least").join(groups, "id", "left").join(links, "id", "left")
    told = settled(told.select("id", *own, "least", F.coalesce("component", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    names = told.groupBy("component").agg(F.min("least").alias("class_id"))
    told = dealt_join(told.drop("least"), names, ["component"], F.xxhash64("id")).select(*own, "class_id", "n_links")
    return dealt_join(rows.select("doc_id", "print", *own), told, own, F.monotonically_increasing_id()).select("doc_id", "print", "class_id", "n_links")


@any_names
def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """docs, with all its columns, with one row of each group: that of the least doc_id (null last), then of the least
    text hash; of rows alike in doc_id and text one. Null and empty texts, repeated rows and null doc_ids are as in
    near_duplicates(); an empty table stays empty, and no other column's name matters."""
    found = near_duplicates(docs, threshold, width)
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "print")
    # a group without any doc_id has class null and is told apart by nothing else: its rows are kept by their texts
    group = F.coalesce("class_id", F.col("print"))
    kept = found.groupBy(group.alias("group"), F.col("class_id").isNull().alias("none")).agg(F.min(order).alias("pick")).select("pick.print", F.col("pick.doc_id").alias("of"))
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), doc.alias("doc"), F.xxhash64(doc, text).alias("print"))
    one = keyed.join(kept, (keyed["print"] == kept["print"]) & keyed["doc"].eqNullSafe(kept["of"]), "left_semi")
    return one.dropDuplicates(["print", "doc"]).select("row.*")
