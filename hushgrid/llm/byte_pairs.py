"""Byte-level byte-pair encoding of a corpus in which each distinct word is encoded once, and decoding by the token table.

Texts are cut into pre-tokens. A task numbers the different ones of a block of texts and writes, for each text, the numbers
by position; so a word leaves a block once, however often it occurs there. The words of all blocks are shuffled, each
distinct word of the corpus is encoded once and its ids are joined to the blocks that have it, in one pass over sorted
rows that holds one word at a time. Each block then puts its texts together by position. The blocks are a bucketed table, so
that answers come to them and they stay where they are. Decoding joins each id with the table of tokens and their bytes.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, partitions, parts_of, released, shared_dir, texts
from .packing import pattern

BLOCK = 24_000_000  # characters of a block's texts, but for one that is longer by itself
ANSWERS = 1_000_000  # words whose ids are dealt to blocks together
TABLE = 1 << 20  # tokens that a vocabulary may have; its table goes to all tasks that decode
BLOCKS = "block long, doc_ids array<long>, counts array<int>, places binary, words array<binary>"
ANSWERED = "of long, places binary, sizes binary, ids binary"
ENCODED = "doc_id long, n_tokens long, ids binary"


def vocabulary(path: str) -> dict[bytes, int]:
    """Ranks of tokens, from a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, all first bytes, then all second ones and so on: small numbers take little room when this is
    compressed."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _cut(split: str):
    """Blocks of texts: their ids, how many pre-tokens each has, these as numbers of the block's different ones, and those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        find = regex.compile(split).findall
        context, made = TaskContext.get(), 0
        high = (context.partitionId() if context else 0) << 32
        ids, counts, places, size, known = [], [], [], 0, {}

        def block() -> pa.RecordBatch:
            nonlocal ids, counts, places, size, known, made
            made += 1
            numbers = np.concatenate(places)
            order = np.argsort(-np.bincount(numbers, minlength=len(known)), kind="stable")  # frequent words get small numbers
            place = np.empty(len(known), np.uint32)
            place[order] = np.arange(len(known))
            words = list(known)
            rows = [[high + made], [ids], [counts], [planes(place[numbers])], [[words[i].encode() for i in order.tolist()]]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary())]
            ids, counts, places, size, known = [], [], [], 0, {}
            return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in parts_of(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if ids and size + len(text) > BLOCK:
                    yield block()
                found = find(text)
                ids.append(doc)
                counts.append(len(found))
                places.append(np.array([known.setdefault(w, len(known)) for w in found], np.uint32))
                size += len(text)
        if ids:
            yield block()

    return frugal(run)


def gathered(flat: np.ndarray, ends: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The parts of flat with the numbers in which, one after the other; parts end at ends."""
    sizes = np.diff(ends, prepend=0)[which]
    upto = np.cumsum(sizes)
    if not len(upto) or not upto[-1]:
        return flat[:0]
    return flat[np.repeat(ends[which] - upto, sizes) + np.arange(upto[-1])]


def _answers(path: str, split: str):
    """From (block, place, word), sorted by word: for each block, as far as its words are among some that follow one another,
    their numbers there, how many ids each has, and these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("own", pat_str=split, mergeable_ranks=vocabulary(path), special_tokens={})._encode_single_piece
        waiting: list[pa.RecordBatch] = []
        spelled: list[list[int]] = []
        which: list[int] = []
        last = None

        def answers() -> Iterator[pa.RecordBatch]:
            blocks, place = (np.concatenate([b.column(c).to_numpy() for b in waiting]) for c in (0, 1))
            sizes = np.array([len(x) for x in spelled])
            flat, ends, own = np.array([i for x in spelled for i in x], np.uint32), np.cumsum(sizes), np.array(which)
            order = np.argsort(blocks, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], np.diff(blocks[order]) != 0)))
            rows: list[tuple] = []
            for part in np.split(order, starts[1:]):
                words = own[part]
                rows.append((blocks[part[0]], *(zlib.compress(planes(x), 1) for x in (place[part], sizes[words], gathered(flat, ends, words)))))
            for at in range(0, len(rows), 1000):
                columns = zip(*rows[at : at + 1000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), *[pa.binary()] * 3], strict=True)], [x.split()[0] for x in ANSWERED.split(", ")])

        for batch in parts_of(batches, 10_000):
            for word in batch.column(2).to_pylist():
                if word != last:
                    spelled.append(encode(word))
                    last = word
                which.append(len(spelled) - 1)
            waiting.append(batch.select([0, 1]))
            if len(which) >= ANSWERS:
                yield from answers()
                waiting, spelled, which = [], spelled[-1:], []
        if which:
            yield from answers()

    return frugal(run)


def _put_together(left: pa.Table, right: pa.Table) -> pa.Table:
    """The texts of a block from its numbers by position and the ids that these stand for."""
    place, sizes, flat = (np.concatenate([from_planes(zlib.decompress(x)) for x in right[c].to_pylist()] or [np.empty(0, np.uint32)]) for c in ("places", "sizes", "ids"))
    ids, ends = flat.tobytes(), (np.cumsum(sizes, dtype=np.int64) * 4).tolist()
    spelled = [b""] * len(place)
    for k, start, end in zip(place.tolist(), [0, *ends], ends, strict=False):
        spelled[k] = ids[start:end]
    rows: list[tuple] = []
    for docs, counts, places in zip(left["doc_ids"].to_pylist(), left["counts"].to_pylist(), left["places"].to_pylist(), strict=True):
        numbers, at = from_planes(places), 0
        for doc, n in zip(docs, counts, strict=True):
            found = b"".join(map(spelled.__getitem__, numbers[at : at + n].tolist()))
            at += n
            rows.append((doc, len(found) // 4, found))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
    out = pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.binary()], strict=True)], names=[x.split()[0] for x in ENCODED.split(", ")])
    del rows, columns, ids, flat, spelled
    released()
    return out


def _bucketed(rows: DataFrame, folder: str, key: str, schema: str) -> DataFrame:
    """rows, written as a table in buckets of a key, without an exchange, and read again: joins by the key leave it in place."""
    spark, name = rows.sparkSession, f"blocks_{uuid.uuid4().hex}"
    empty = spark.createDataFrame([], schema)
    rows.to(empty.schema).write.option("path", folder).option("compression", "zstd").bucketBy(partitions(spark), key).format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: its folder is its own
    return table


def encode(docs: DataFrame, path: str, split: str | None = None) -> DataFrame:
    """A row for each document: its number of tokens and their ids as little-endian unsigned 32-bit integers. path names a
    file of ranks, which all executors can read, split the pattern of pre-tokens.

    Null texts are empty and have no tokens; an empty table gives no rows; null and repeated doc_ids stay, each row is
    encoded by itself; other columns are left out. A text that is longer than a block is a block by itself. The
    blocks are written to the shared folder first, so that all that follows, lost tasks included, speaks of the same.
    """
    spark, split = docs.sparkSession, split or pattern()
    folder = f"{shared_dir(spark)}/byte-pairs-{uuid.uuid4().hex}"
    blocks = _bucketed(texts(docs).mapInArrow(_cut(split), BLOCKS), folder, "block", BLOCKS)
    asked = blocks.select("block", F.posexplode("words").alias("place", "word")).repartition(partitions(spark), "word").sortWithinPartitions("word")
    answered = asked.mapInArrow(_answers(path, split), ANSWERED)
    whole = blocks.select("block", "doc_ids", "counts", "places").groupBy("block")
    return whole.cogroup(answered.groupBy("of")).applyInArrow(_put_together, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded, which has ids as encode gives them, with ``decoded``: the bytes of these. Each id is joined with the table of
    tokens on the side of the ids; the table has a limit (see TABLE) and is read by each task.

    Null ids decode to null; an id that the table lacks is an error; all other columns and rows stay as they are, but a
    column named decoded, which is replaced.
    """
    kept = encoded.drop("decoded")
    names = [f"c{i}" for i in range(len(kept.columns))]  # others may have names that need quotes
    out = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, kept.schema.fields, strict=True)] + [T.StructField("decoded", T.BinaryType())])
    at = kept.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = vocabulary(path)
        if len(ranks) > TABLE:
            raise ValueError(f"a vocabulary of more than {TABLE} tokens is too large for a table that all tasks hold")
        token = {i: t for t, i in ranks.items()}

        def found(data: bytes | None) -> bytes | None:
            try:
                return None if data is None else b"".join(map(token.__getitem__, np.frombuffer(data, "<u4").tolist()))
            except KeyError as e:
                raise ValueError(f"id {e} is not in the vocabulary") from None

        for batch in parts_of(batches):
            decoded = pa.array([found(x) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], [*names, "decoded"])

    return kept.toDF(*names).mapInArrow(frugal(run), out).toDF(*kept.columns, "decoded")
