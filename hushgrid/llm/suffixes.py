"""Removal of passages that occur earlier, by longest-previous-factor arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier: in an earlier document, or earlier in
its own. Strings that are equal have the same anchor, the least of the hashes of their ANCHOR-byte parts, so they meet
where their anchors meet, and only strings whose anchor occurs twice can be repeated:

1. Each task hashes its texts and sends the anchors it has seen, a row each; those that several of its documents have
   are known to be repeated and send one row only, so a common passage sends a row for each task. The others of these
   documents go past the count, each by a route of its own.
2. The anchors found to be repeated return to their documents, which lie in blocks by a hash. A block cuts out the
   segments whose strings have such anchors. Of equal segments only the first can be the source of others, so that one
   alone goes on, and the others are ranges to remove already.
3. The segments of an anchor meet, in order of their documents, and are one text. Its suffix array orders all their
   strings; from the common prefixes of neighbours and each position's previous and next smaller position in suffix
   order follows its longest previous factor. Positions where this is ``length`` or more start strings to remove.
4. The ranges found return to their blocks, where the texts still lie (the exchange is used again).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .common import any_names, plain, block_of, frugal, partitions, parts_of, released
from .meeting import ROUTED, repeated, routed
from .shingles import prefix_sums, span_hashes

LENGTH = 100  # bytes of a string that counts
ANCHOR = 32  # bytes of its parts
BLOCK = 400_000  # bytes that are hashed at a time
MEETING = 1_500_000  # bytes of segments that are ordered at a time, or all of an anchor's
FIRST = 7  # bytes of the first ranks
SWEEPS = 40  # passes over the suffix order before places are taken one by one
ANCHORS = 4_000_000  # anchors that are sent together


def ranks_by_size(data: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(size, ranks of the strings of size bytes from each place on), by prefix doubling up to depth; past the end stands
    nothing, which comes before all bytes."""
    size = min(FIRST, depth)
    padded = np.concatenate([data.astype(np.int64) + 1, np.zeros(size, np.int64)])
    ranks = np.zeros(len(data), np.int64)
    for k in range(size):
        ranks = (ranks << 9) | padded[k : k + len(data)]
    ranks = np.unique(ranks, return_inverse=True)[1].astype(np.int64) + 1
    out = [(size, ranks)]
    while size < depth:
        step = min(size, depth - size)
        after = np.zeros(len(ranks), np.int64)
        after[: len(ranks) - step] = ranks[step:]
        ranks = np.unique(ranks * (len(ranks) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        size += step
        out.append((size, ranks))
    return out


def common_prefixes(data: np.ndarray, ranks: list[tuple[int, np.ndarray]], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many bytes the strings from two places on share, up to the largest size."""
    n, depth, found = len(data), ranks[-1][0], np.zeros(len(one), np.int64)
    steps = [*reversed(ranks), *[(1, data)] * (FIRST - 1)]
    for size, own in steps:
        a, b = one + found, two + found
        inside = (np.maximum(a, b) + size <= n) & (found + size <= depth)
        same = np.zeros(len(one), bool)
        same[inside] = own[a[inside]] == own[b[inside]]
        found += np.where(same, size, 0)
    return found


def longest_previous(data: np.ndarray, depth: int, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each place (all, or those given in rising order) how many bytes, up to depth, from there on also start at an
    earlier place, and such a place (-1: none)."""
    places = np.arange(len(data)) if places is None else places
    ranks = ranks_by_size(data, depth)
    last = ranks[-1][1][places]
    order = np.argsort(last, kind="stable")  # the suffix array to this depth; ties by place
    at, last = places[order], last[order]
    length, source = np.zeros(len(places), np.int64), np.full(len(places), -1, np.int64)
    # of equal strings each is preceded by the one that is its previous smaller position, and nothing is longer
    tie = np.concatenate(([False], last[1:] == last[:-1])) if len(at) else np.zeros(0, bool)
    ties = np.flatnonzero(tie)
    length[order[ties]] = np.minimum(depth, len(data) - at[ties])
    source[order[ties]] = at[ties - 1]
    rest = np.flatnonzero(~tie)
    at, who = at[rest], order[rest]
    shared = np.concatenate(([0], common_prefixes(data, ranks, at[:-1], at[1:]))) if len(at) else np.zeros(0, np.int64)
    for _ in range(SWEEPS):
        # a place after both its neighbours has these as previous and next smaller positions; then it leaves the list
        if len(at) < 2:
            break
        before, after = np.concatenate(([-1], at[:-1])), np.concatenate((at[1:], [-1]))
        right = np.concatenate((shared[1:], [0]))
        top = np.flatnonzero((at > before) & (at > after))
        length[who[top]] = np.maximum(shared[top], right[top])
        source[who[top]] = np.where(length[who[top]] == 0, -1, np.where(shared[top] >= right[top], before[top], after[top]))
        follows = top[top + 1 < len(at)] + 1
        shared[follows] = np.minimum(shared[follows], shared[follows - 1])
        left = np.ones(len(at), bool)
        left[top] = False
        at, who, shared = at[left], who[left], shared[left]
    else:
        _one_by_one(at.tolist(), who.tolist(), shared.tolist(), length, source)
    return length, source


def _one_by_one(at: list[int], who: list[int], shared: list[int], length: np.ndarray, source: np.ndarray) -> None:
    """The same for what the sweeps leave of places in long rising or falling order: from the last place to the first."""
    n = len(at)
    before, after, shared = list(range(-1, n - 1)), list(range(1, n + 1)), [*shared, 0]
    for k in sorted(range(n), key=at.__getitem__, reverse=True):
        b, a = before[k], after[k]
        left, right = shared[k] if b >= 0 else 0, shared[a] if a < n else 0
        length[who[k]] = max(left, right)
        if max(left, right):
            source[who[k]] = at[b] if left >= right else at[a]
        if a < n:
            before[a], shared[a] = b, min(left, right)
        if b >= 0:
            after[b] = a


def segments(batch: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor hash, text, first and last start of strings, for each run of strings with the same anchor, in order."""
    parts_of = length - ANCHOR + 1
    at = 0
    while at < len(batch):
        if len(batch[at]) > 2 * BLOCK:  # a long text in overlapping pieces; a run that is cut is two runs
            for low in range(0, len(batch[at]) - length + 1, BLOCK):
                for a, _, first, last in segments([batch[at][low : low + BLOCK + length - 1]], length):
                    yield a, np.full(len(a), at), first + low, last + low
            at += 1
            continue
        size, to = 0, at
        while to < len(batch) and (size < BLOCK or to == at) and len(batch[to]) <= 2 * BLOCK:
            size += len(batch[to])
            to += 1
        data = np.frombuffer(b"".join(batch[at:to]), np.uint8)
        ends = np.cumsum([len(b) for b in batch[at:to]])
        begins = ends - [len(b) for b in batch[at:to]]
        n = len(data) - length + 1
        if n > 0:
            places = np.arange(len(data) - ANCHOR + 1)
            hashes = span_hashes(prefix_sums(data), places, places + ANCHOR)
            low = np.uint64((1 << 21) - 1)
            least = (hashes & ~low) | places.astype(np.uint64)  # ties go to the leftmost
            size = 1
            while size < parts_of:
                step = min(size, parts_of - size)
                least = np.minimum(least[:-step], least[step:])
                size += step
            text = np.searchsorted(ends, np.arange(n), side="right")
            fits = np.arange(n) + length <= ends[text]
            anchor = (least & low).astype(np.int64)
            new = fits & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~fits[:-1]))
            first = np.flatnonzero(new)
            final = fits & np.concatenate((new[1:] | ~fits[1:], [True]))
            last = np.flatnonzero(final)
            which = text[first]
            yield hashes[anchor[first]], which + at, first - begins[which], last - begins[which]
        at = to


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, of, size = [], [], 0
        for batch in parts_of(batches):
            keys = batch.column(0).to_numpy()
            for anchor, which, _, _ in segments([t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()], length):
                found.append(anchor)
                of.append(keys[which])
                size += len(anchor)
            if size > ANCHORS:
                yield from routed(np.concatenate(found), np.concatenate(of))
                found, of, size = [], [], 0
        if found:
            yield from routed(np.concatenate(found), np.concatenate(of))

    return frugal(run)


def numbered(left: pa.Table) -> list[tuple[int, int]]:
    """For each row its key and its number among the different rows of this key: 0 unless hashes collide."""
    rows = list(zip(left["key"].to_pylist(), left["doc_id"].to_pylist(), left["text"].to_pylist(), strict=True))
    first: dict[int, tuple] = {}
    several: dict[int, set[tuple]] = {}
    for key, *row in rows:
        if first.setdefault(key, tuple(row)) != tuple(row):
            several.setdefault(key, {first[key]}).add(tuple(row))
    order = {key: sorted(found, key=str) for key, found in several.items()}
    return [(key, order[key].index(tuple(row)) if key in order else 0) for key, *row in rows]


SEGMENTS = "route long, checked boolean, anchor long, key long, nth int, doc_id long, start long, stop long, data binary"


def _cut_out(length: int):
    names = [x.split()[0] for x in SEGMENTS.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        by_key = np.argsort(right["key"].to_numpy(), kind="stable")
        keys, anchors = right["key"].to_numpy()[by_key], right["anchor"].to_numpy()[by_key].view(np.uint64)
        wanted = left.filter(pc.is_in(left["key"], pa.array(np.unique(keys), pa.int64()))) if len(keys) else left.slice(0, 0)
        texts_of = {}
        for name, doc, text in zip(numbered(wanted), wanted["doc_id"].to_pylist(), wanted["text"].to_pylist(), strict=True):
            texts_of[name] = ((1 << 63) - 1 if doc is None else doc, text)
        seen: set[tuple[int, bytes]] = set()
        for (key, nth), (doc, text) in sorted(texts_of.items(), key=lambda x: (x[1][0], x[0])):
            known: list[list[int]] = []  # ranges of which the block has an earlier copy
            data = text.encode("utf-8", "surrogatepass")
            own = np.sort(anchors[np.searchsorted(keys, key, side="left") : np.searchsorted(keys, key, side="right")])
            for anchor, _, first, last in segments([data], length):
                at = np.minimum(np.searchsorted(own, anchor), len(own) - 1)
                hit = np.flatnonzero(own[at] == anchor)
                for a, low, high in zip(anchor[hit].view(np.int64).tolist(), first[hit].tolist(), last[hit].tolist(), strict=True):
                    piece = data[low : high + length]
                    mark = (a, piece)
                    if mark in seen:
                        if known and known[-1][1] >= low:
                            known[-1][1] = high + length
                        else:
                            known.append([low, high + length])
                    else:
                        seen.add(mark)
                        rows.append((a, True, a, key, nth, doc, low, high + length, piece))
            rows += [(key ^ low, False, None, key, nth, None, low, high, None) for low, high in known]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.binary()]
        out = pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        del rows, columns, seen, texts_of
        released()
        return out

    return run


RANGES = "key long, nth int, start long, stop long"


def _ranges(length: int):
    def meet(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
        rows.sort(key=lambda r: r[1:5])  # doc_id, key, nth, start
        seen: dict[int, set[bytes]] = {}
        fresh, found = [], []
        for row in rows:  # of equal segments the first alone can be a source
            own = seen.setdefault(row[0], set())
            if row[5] in own:
                found.append((row[2], row[3], row[4], row[4] + len(row[5])))
            else:
                own.add(row[5])
                fresh.append(row)
        rows = [row for row in fresh if len(seen[row[0]]) > 1]
        if not rows:
            return found
        data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        sizes = np.array([len(r[5]) for r in rows])
        begins = np.cumsum(sizes) - sizes
        strings = sizes - length + 1
        of = np.repeat(np.arange(len(rows)), strings)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(strings) - strings, strings)
        longest, _ = longest_previous(data, length, begins[of] + inside)
        repeats = longest >= length
        of, inside = of[repeats], inside[repeats]
        if not len(of):
            return found
        new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (inside[1:] != inside[:-1] + 1))))
        last = np.concatenate((new[1:] - 1, [len(of) - 1]))
        return found + [(rows[i][2], rows[i][3], rows[i][4] + low, rows[i][4] + high + length) for i, low, high in zip(of[new].tolist(), inside[new].tolist(), inside[last].tolist(), strict=True)]

    def table(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [[]] * 4
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in RANGES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size = 0
        for batch in batches:
            done: list[tuple[int, int, int, int]] = []
            for checked, anchor, key, nth, doc, start, stop, data in zip(*(batch.column(i).to_pylist() for i in range(1, 9)), strict=True):
                if not checked:
                    done.append((key, nth, start, stop))
                    continue
                if size > MEETING and anchor != waiting[-1][0]:
                    done += meet(waiting)
                    waiting, size = [], 0
                waiting.append((anchor, doc, key, nth, start, data))
                size += len(data)
            if done:
                yield table(done)
        if waiting:
            yield table(meet(waiting))

    return frugal(run)


def _repeats(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """docs in blocks with a key for each row, and the ranges of bytes to remove by block and key."""
    n = partitions(docs.sparkSession)
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(doc, text)
    pairs = docs.select(key.alias("key"), text.alias("text")).mapInArrow(_anchors(length), ROUTED)
    pairs = pairs.repartition(n, "route").sortWithinPartitions("key").mapInArrow(frugal(repeated), "key long, id long")
    pairs = pairs.select(F.col("key").alias("anchor"), F.col("id").alias("key"))
    block = lambda df: df.withColumn("block", block_of(F.col("key"), n)).repartition(n, "block")
    others = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"], F.col("text").isNull().alias("null"))
    whole = block(docs.select(key.alias("key"), doc.alias("doc_id"), text.alias("text"), others.alias("whole")))
    cut = whole.groupBy("block").cogroup(block(pairs).groupBy("block")).applyInArrow(_cut_out(length), SEGMENTS)
    ranges = cut.repartition(n, "route").sortWithinPartitions("checked", "anchor").mapInArrow(_ranges(length), RANGES)
    return whole, block(ranges)


def _kept(text: str, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of a text's bytes, and how many runs are removed."""
    data = text.encode("utf-8", "surrogatepass")
    out, at, count = [], 0, 0
    for start, stop in sorted(ranges):
        if start > at or not count:
            count += 1
            out.append(data[at:start])
        at = max(at, stop)
    return b"".join([*out, data[at:]]), count


def _by_name(right: pa.Table) -> dict[tuple[int, int], list[tuple[int, int]]]:
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for key, nth, start, stop in zip(*(right[c].to_pylist() for c in ("key", "nth", "start", "stop")), strict=True):
        found.setdefault((key, nth), []).append((start, stop))
    return found


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """n_bytes, n_removed, n_spans (runs removed) and kept_sha256 of each row.

    Null texts are empty; documents with equal doc_id come in the order of a hash of their texts, null doc_ids after all
    others; rows with equal doc_id and text are one document and have the same result; an empty table gives no rows;
    other columns are left out. Of documents with equal texts all but the first lose all their bytes, if there are
    length or more.
    """
    docs = plain(docs).select("doc_id", "text")
    whole, ranges = _repeats(docs, length)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _by_name(right)
        rows = []
        for name, doc, text in zip(numbered(left), left["doc_id"].to_pylist(), left["text"].to_pylist(), strict=True):
            rest, count = _kept(text, found.get(name, []))
            n = len(text.encode("utf-8", "surrogatepass"))
            rows.append((doc, n, n - len(rest), count, hashlib.sha256(rest).hexdigest()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [*[pa.int64()] * 4, pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return whole.groupBy("block").cogroup(ranges.groupBy("block")).applyInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@any_names
def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with all columns and rows, and texts without the bytes that removed() counts. Parts of a character that a
    cut leaves behind go, too; n_chars follows if it is a column; null texts stay null, empty ones empty; repeated rows
    and null doc_ids are as in removed(); an empty table stays empty, and no other column's name matters."""
    whole, ranges = _repeats(docs, length)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found, own = _by_name(right), numbered(left)
        out = [_kept(text, found[name])[0].decode("utf-8", "ignore") if name in found else text for name, text in zip(own, left["text"].to_pylist(), strict=True)]
        changed = pa.array([name in found for name in own], pa.bool_())
        return pa.table({"clean": pa.array(out, pa.string()), "changed": changed, "whole": left["whole"].combine_chunks()})

    kind = StructType([StructField("clean", StringType()), StructField("changed", BooleanType()), StructField("whole", whole.schema["whole"].dataType)])
    clean = whole.groupBy("block").cogroup(ranges.groupBy("block")).applyInArrow(run, kind)
    out = []
    for i, name in enumerate(docs.columns):
        if name == "text":
            column = F.when(F.col("whole.null"), F.lit(None)).otherwise(F.col("clean"))
        else:
            column = F.col("whole").getField(f"c{i}")
            if name == "n_chars":
                column = F.when(F.col("changed"), F.length("clean").cast(docs.schema[name].dataType)).otherwise(column)
        out.append(column.alias(name))
    return clean.select(*out)
