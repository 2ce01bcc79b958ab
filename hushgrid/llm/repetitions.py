"""Maximal runs of words that repeat with a period, found by Stoye and Gusfield's traversal of a suffix tree.

A tandem repeat is branching if the word behind it differs from the first word of its second half: it is the last square
of a run. For a node v of depth D each leaf i is paired with the leaves i + D and i - D of the same node; as the two parts
of a branching repeat lie below different children, the leaves of all children but the largest are enough, n log n in all.
The tree's nodes are the intervals of equal common prefixes in suffix order, whose leaf lists are ranges of ranks.
A branching repeat is rotated to the left for as long as the words agree, which gives the run that ends with it; repeats
of a power of a shorter word merge into the shorter word's run.

A run of the wanted length is covered by strings of GRAM words that stand again one period further on. So only stretches of
a text that are covered by such repeated strings get a tree; this leaves out no run.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, parts_of, texts
from .shingles import mixed

LEAST = 12  # words of a run, at least
GRAM = 6  # half of it: a run of period q has as many words that agree with those q further on
PASSES = 3  # over stretches of repeated strings, each inside what the last one left
WORDS = 500_000  # words that are searched together
LEAVES = 2_000_000  # leaves that are paired together
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.random.default_rng(31).integers(1, 1 << 63, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
Run = tuple[int, int, int]  # start, length, period


def stretches(words: np.ndarray, borders: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches that are covered by strings of GRAM words which the same stretch has again; words are
    hashes of all words of some texts, one after the other, borders the places at which texts begin."""
    n = len(words)
    if n < LEAST:
        return []
    grams = np.zeros(n - GRAM + 1, np.uint64)
    for k in range(GRAM):
        grams += words[k : k + len(grams)] * _STEPS[k]
    begins = np.zeros(n, bool)
    begins[borders[borders < n]] = True
    part = np.cumsum(begins)  # first the number of the text, then that of the stretch
    at = np.flatnonzero(part[: len(grams)] == part[GRAM - 1 :])
    found: list[tuple[int, int]] = []
    for _ in range(PASSES):
        keys = mixed(grams[at] + part[at].astype(np.uint64) * _ODD)
        inorder = np.sort(keys)
        several = inorder[1:][inorder[1:] == inorder[:-1]]
        if not len(several):
            return []
        place = np.minimum(np.searchsorted(several, keys), len(several) - 1)
        at = at[several[place] == keys]
        edges = np.bincount(at, minlength=n + 1) - np.bincount(at + GRAM, minlength=n + 1)
        covered = np.cumsum(edges[:-1]) > 0
        new = covered & (begins | np.concatenate(([True], ~covered[:-1])))
        starts = np.flatnonzero(new)
        stops = np.flatnonzero(covered & np.concatenate((new[1:] | ~covered[1:], [True]))) + 1
        long = stops - starts >= LEAST
        found = list(zip(starts[long].tolist(), stops[long].tolist(), strict=True))
        part = np.cumsum(new)
        at = at[long[part[at] - 1] & (part[at] == part[at + GRAM - 1])]
    return found


def suffix_order(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order, the rank of each place, and the common prefix of each suffix in order with the one before (-1 at
    either end), by prefix doubling."""
    n, size = len(data), 1
    ranks = np.unique(data, return_inverse=True)[1].astype(np.int64) + 1
    kept = np.int32 if n < (1 << 31) - 1 else np.int64
    sizes = [ranks.astype(kept)]
    while ranks.max() < n:
        after = np.zeros(n, np.int64)
        after[: n - size] = ranks[size:] if size < n else 0
        ranks = np.unique(ranks * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        sizes.append(ranks.astype(kept))
        size *= 2
    rank = ranks - 1
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    one, two, shared = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    for k in range(len(sizes) - 1, -1, -1):
        inside = np.flatnonzero((one < n) & (two < n))
        same = inside[sizes[k][one[inside]] == sizes[k][two[inside]]]
        for x in (one, two, shared):
            x[same] += 1 << k
    return order, rank, np.concatenate(([-1], shared, [-1]))


def suffix_tree(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Depth, first and last rank of each inner node (the first is the root), and the parent of each node and then of each
    leaf, from the common prefixes in suffix order."""
    n = len(shared) - 1
    depth, low, high, path = [0], [0], [n - 1], [0]
    border = [0] * (n + 1)  # the node that has the suffixes on both sides of a border below different children
    for k, x in enumerate(shared[1:n].tolist() + [0], 1):
        first = k - 1
        while depth[path[-1]] > x:
            first = low[path[-1]]
            high[path.pop()] = k - 1
        if depth[path[-1]] < x:
            path.append(len(depth))
            depth.append(x)
            low.append(first)
            high.append(n - 1)
        border[k] = path[-1]
    depths, lows, highs, borders = (np.array(x, np.int64) for x in (depth, low, high, border))
    begin, end = np.concatenate((lows, np.arange(n))), np.concatenate((highs, np.arange(n))) + 1
    parents = borders[np.where(shared[begin] >= shared[end], begin, end)]
    return depths, lows, highs, parents


def branching(data: np.ndarray) -> np.ndarray:
    """(period, start) of all branching tandem repeats of two parts, by period."""
    n = len(data)
    order, rank, shared = suffix_order(data)
    depth, low, high, parent = suffix_tree(shared)
    begin, size = np.concatenate((low, np.arange(n))), np.concatenate((high - low + 1, np.ones(n, np.int64)))
    inner = np.flatnonzero(depth[parent] > 0)  # children of the root share nothing
    inner = inner[np.lexsort((size[inner], parent[inner]))]
    largest = np.concatenate((parent[inner[1:]] != parent[inner[:-1]], [True])) if len(inner) else np.zeros(0, bool)
    smaller = inner[~largest]
    padded = np.concatenate((data, -1 - np.arange(2)))  # what is behind the end equals nothing
    found = []
    upto = np.cumsum(size[smaller])
    cuts = np.searchsorted(upto, np.arange(LEAVES, upto[-1] + LEAVES, LEAVES)) if len(smaller) else []
    for a, b in zip([0, *cuts], cuts, strict=False):
        some = smaller[a : b + 1] if b == len(smaller) - 1 or b >= len(smaller) else smaller[a:b]
        if not len(some):
            continue
        lengths = size[some]
        ends = np.cumsum(lengths)
        leaf = order[np.repeat(begin[some] - (ends - lengths), lengths) + np.arange(ends[-1])]
        node = np.repeat(parent[some], lengths)
        d, first, last = depth[node], low[node], high[node]
        for start, other in ((leaf, leaf + d), (leaf - d, leaf - d)):
            fits = np.flatnonzero((other >= 0) & (other < n))
            ranks = rank[other[fits]]
            fits = fits[(ranks >= first[fits]) & (ranks <= last[fits])]
            s, p = start[fits], d[fits]
            ahead = s + 2 * p
            s, p, ahead = s[ahead <= n], p[ahead <= n], ahead[ahead <= n]
            new = padded[s + p] != padded[ahead]
            found.append(np.stack([p[new], s[new]], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


def rotated(data: np.ndarray, start: int, period: int) -> int:
    """The start of the run of this period that goes on at start: to the left for as long as words agree."""
    width = 16
    while start:
        width = min(width, start)
        other = np.flatnonzero(data[start - width : start] != data[start - width + period : start + period])
        if len(other):
            return start - width + int(other[-1]) + 1
        start -= width
        width *= 2
    return 0


def maximal_runs(data: np.ndarray) -> list[Run]:
    """All runs of two periods or more, each with its smallest period."""
    found: list[Run] = []
    ending: dict[int, list[tuple[int, int]]] = {}
    for period, start in branching(data).tolist() if len(data) > 1 else []:
        end = start + 2 * period
        same_end = ending.setdefault(end, [])
        if not any(period % p == 0 and s <= start for s, p in same_end):
            first = rotated(data, start, period)
            same_end.append((first, period))
            found.append((first, end - first, period))
    return found


def runs_of(batch: list[list[bytes]]) -> list[list[Run]]:
    """For each text, as its words, the runs of LEAST words or more and two periods or more, by start and period."""
    sizes = np.array([len(w) for w in batch], np.int64)
    ends = np.cumsum(sizes)
    out: list[list[Run]] = [[] for _ in batch]
    total = int(ends[-1]) if len(batch) else 0
    hashes = np.fromiter(map(hash, chain.from_iterable(batch)), np.int64, total).view(np.uint64)
    found = stretches(hashes, ends - sizes)
    if not found:
        return out
    starts, stops = (np.array(x) for x in zip(*found, strict=True))
    which = np.searchsorted(ends, starts, side="right")
    data, at = np.empty(int((stops - starts + 1).sum()), np.int64), 0
    begins, last = [], 0
    for t, a, b in zip(which.tolist(), starts.tolist(), stops.tolist(), strict=True):
        known: dict[bytes, int] = {}  # words of different stretches, and the border behind each, are all different
        offset = a - int(ends[t] - sizes[t])
        own = [known.setdefault(w, last + len(known)) for w in batch[t][offset : offset + b - a]]
        last += len(known)
        data[at : at + len(own)] = own
        data[at + len(own)] = last
        begins.append(at)
        at, last = at + len(own) + 1, last + 1
    places = np.array(begins)
    for start, length, period in maximal_runs(data):
        if length >= LEAST:
            k = int(np.searchsorted(places, start, side="right")) - 1
            t = int(which[k])
            out[t].append((start - int(places[k]) + int(starts[k] - (ends[t] - sizes[t])), length, period))
    for own in out:
        own.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """words without those that a run has after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def repeated_tail(doc: int | None, words: list[bytes]) -> list[bytes]:
    """words, for a tenth of all doc_ids with a part of them repeated up to the end; crc32 of the doc_id says which."""
    more, tenth = divmod(zlib.crc32(b"" if doc is None else str(doc).encode()), 10)
    n = len(words)
    if tenth or not n:
        return words
    first = more % n
    period = 1 + (n - first) // (3 + more % 8)
    return words[:first] + (words[first : first + period] * -(-(n - first) // period))[: n - first]


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_STRUCT = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """A row for each document: its number of words, its runs by start and period, and its words, joined by one space,
    without those that a run has after its first period. change gives other words for a doc_id and its words.

    Words are longest strings of characters other than the blank and U+0009 to U+000D. Null texts are empty and have no
    words; an empty table gives no rows; null and repeated doc_ids stay, each row is searched by itself; other columns
    are left out. A text is searched whole, by the task that reads it; no rows are exchanged.
    """

    def rows(ids: list, batch: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(batch)
        flat = [{"start": s, "length": n, "period": p} for own in found for s, n, p in own]
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(own) for own in found]))), pa.int32())
        told = pa.ListArray.from_arrays(offsets, pa.array(flat, _STRUCT))
        left = pa.array([b" ".join(collapsed(w, own)) for w, own in zip(batch, found, strict=True)], pa.binary()).cast(pa.string())
        columns = [pa.array(ids, pa.int64()), pa.array([len(w) for w in batch], pa.int64()), told, left]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, waiting, n = [], [], 0
        for batch in parts_of(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = text.as_py().encode().split()
                words = change(doc, words) if change else words
                ids.append(doc)
                waiting.append(words)
                n += len(words)
                if n >= WORDS:
                    yield rows(ids, waiting)
                    ids, waiting, n = [], [], 0
        if ids:
            yield rows(ids, waiting)

    return texts(docs).mapInArrow(frugal(run), RUNS)


def run_digests(found: DataFrame) -> DataFrame:
    """Of the rows of periodic_runs: doc_id, n_runs, the longest run (ties: the least start, then the least period; null
    without any) with its exponent in thousandths, and hashes of all runs and of the words that are left."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
