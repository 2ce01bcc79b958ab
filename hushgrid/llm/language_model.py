"""Language-model scoring by a weighted backoff automaton.

States are the root, the tokens, and the kept n-grams that are histories of longer ones; arcs are the kept n-grams' last
tokens; each state has a failure arc to its history less the oldest token, which costs the state's backoff weight. Texts
are read once from left to right: a state is carried for each, and each token takes the state's arc or falls back until
one fits, while the log-probabilities add up. A long text is read in pieces; as a state depends on the last tokens
alone, a piece finds its own by reading these first.

- Counts are exact over all training rows. All n-grams of two and more tokens that occur ``least`` times (1: all) are
  kept, of any words, at any size of the corpus: the automaton grows with it and is never held whole anywhere.
- Documents are dealt into blocks, and keys into as many ranges. A block asks each range for its own tokens and n-grams
  and tells what it counted; the range answers with the totals, in the order asked. The first round is for tokens and
  pairs; each further one for the next longer n-grams, where all shorter ones inside occur ``least`` times (others can't
  themselves), and for backoffs: one of the blocks that have a kept n-gram adds it to its history.
- The root's weights are counts less a discount that follows from the counts of counts (one for tokens seen once,
  twice, and more often); what is taken off is shared by the tokens that weren't seen, each by its spelling: an automaton
  over bytes, whose states are the byte before, reads it from its beginning to its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_of, crc_remainder, frugal, partitions, parts_of, released, settled, texts
from .shingles import prefix_sums, runs, span_hashes

ORDER = 3
LEAST_GRAM = 2  # times that a longer n-gram must occur to be kept
PIECE = 512  # tokens of a text that are read after one another
SPELLING = 0.1  # added to the count of each byte after another
DISCOUNT = 7  # tenths: sums of discounted counts are whole numbers of tenths
BLOCK = 1_000_000  # bytes that are hashed at a time
END = np.uint64(0xE0D)  # stands for the end's hash
_TOKEN = np.array([b not in (0x20, *range(9, 14)) for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, known_score double"


@dataclass
class Block:
    """Texts as tokens: each text's tokens and then an end. text: its number of each token; spelt: log10 of its spelling."""

    hashes: np.ndarray
    text: np.ndarray
    spelt: np.ndarray | None = None


def byte_pairs(data: np.ndarray) -> np.ndarray:
    """256 times the byte before and each byte, where a blank stands for all that isn't in a token."""
    own = np.where(_TOKEN[data], data, np.uint8(0x20)).astype(np.uint16)
    pairs = own.copy()
    pairs[1:] |= own[:-1] << np.uint16(8)
    pairs[:1] |= np.uint16(0x2000)
    return pairs


def spelling(counts: np.ndarray) -> np.ndarray:
    """log10 of the probability of each byte after another, from the counts of byte_pairs(): at its beginning a token has
    one of the 250 bytes that tokens have, later one of these or its end. No token is left without a probability."""
    grid = counts.reshape(256, 256).astype(np.float64) + SPELLING
    blank = ~_TOKEN
    grid[:, blank] = 0
    grid[~blank, 0x20] = counts.reshape(256, 256)[~blank, 0x20] + SPELLING
    grid[blank & (np.arange(256) != 0x20)] = 0
    total = grid.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(grid > 0, np.log10(grid / total), 0.0).ravel()


def learned_spelling(docs: DataFrame) -> np.ndarray:
    """spelling() of the tokens of all rows of (text): 65,536 numbers at most are on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16, np.int64)
        for batch in parts_of(batches):
            whole = "\n".join([*batch.column(0).to_pylist(), ""]).encode("utf-8", "surrogatepass")
            counts += np.bincount(byte_pairs(_LOWER[np.frombuffer(whole, np.uint8)]), minlength=1 << 16)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["pair", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for pair, n in docs.select("text").mapInArrow(frugal(run), "pair int, n long").groupBy("pair").agg(F.sum("n")).collect():
        counts[pair] = n
    return spelling(counts)


def blocks(batch: list[str] | list[bytes], spelled: np.ndarray | None = None) -> Iterator[tuple[int, int, Block]]:
    """(from, to, block) of consecutive texts with about BLOCK bytes each."""
    at = 0
    while at < len(batch):
        parts, size, to = [], 0, at
        while to < len(batch) and (size < BLOCK or to == at):
            parts.append(batch[to] if isinstance(batch[to], bytes) else batch[to].encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
            to += 1
        data = _LOWER[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
        starts, ends = runs(data, _TOKEN)
        cuts = np.cumsum([len(p) + 1 for p in parts])
        text = np.searchsorted(cuts, starts, side="right")
        n = len(parts)
        order = np.argsort(np.concatenate([text, np.arange(n)]), kind="stable")
        hashes = span_hashes(prefix_sums(data), starts, ends)
        spelt = None
        if spelled is not None:
            upto = np.concatenate(([0.0], np.cumsum(spelled[byte_pairs(data)])))
            spelt = np.concatenate([upto[ends + 1] - upto[starts], np.zeros(n)])[order]
        yield at, to, Block(np.concatenate([hashes, np.full(n, END)])[order], np.concatenate([text, np.arange(n)])[order], spelt)
        at = to


class Counter64:
    """Counts of 64-bit keys, summed up whenever many wait."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting > 4_000_000:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys, index = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(index, weights=np.concatenate(self.counts)).astype(np.int64)
        self.keys, self.counts, self.waiting = [keys], [counts], 0
        return keys, counts


def _looked_up(keys: np.ndarray, sorted_keys: np.ndarray, values: np.ndarray, missing) -> np.ndarray:
    if not len(sorted_keys):
        return np.full(len(keys), missing, values.dtype)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, values[at], missing)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, sorted, and where each is among them; only the different ones are sorted, so that it is
    faster than np.unique where most values repeat."""
    coded = pa.array(values).dictionary_encode()
    kinds = coded.dictionary.to_numpy()
    order = np.argsort(kinds)
    rank = np.empty(len(kinds), np.int32)
    rank[order] = np.arange(len(kinds), dtype=np.int32)
    return kinds[order], rank[coded.indices.to_numpy()]


def discounts(of_counts: list[int]) -> tuple[float, float, float]:
    """What is taken off a count of 1, of 2, and of 3 or more, from the numbers of tokens seen 1, 2, 3 and 4 times."""
    n = [max(1, x) for x in of_counts]
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.05) for k in (1, 2, 3))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shifted(values: np.ndarray, first) -> np.ndarray:
    out = np.empty_like(values)
    out[1:], out[:1] = values[:-1], first
    return out


def gram_keys(tokens: np.ndarray, text: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size from 2 on, the key of the n-gram that ends at each token, and whether it is one: a text begins in
    the state of an end, and no n-gram goes further back."""
    begins = text != _shifted(text, -1)
    history, whole, out = np.where(begins, _mixed(np.array([END])), _shifted(tokens, 0)), np.ones(len(tokens), bool), []
    for _ in range(2, order + 1):
        own = _mixed(history * np.uint64(0x9E3779B97F4A7C15) + tokens)
        out.append((own, whole))
        history, whole = _shifted(own, 0), _shifted(whole, False) & ~begins
    return out


@dataclass
class Level:
    """The n-grams of one size in texts. keys: sorted, without repeats; places: where in keys the one is that ends at each
    token; histories: the same for the shorter one before the token; the place after the last is none. n, sums: by place, of
    all rows, how often, and the discounted counts of the kept n-grams that it is the history of; own: to be added up here."""

    keys: np.ndarray
    places: np.ndarray
    histories: np.ndarray | None = None
    n: np.ndarray | None = None
    own: np.ndarray | None = None
    sums: np.ndarray | None = None


class Grams:
    """The tokens and n-grams of texts, and rounds 1 to order of questions about them."""

    def __init__(self, block: Block, counted: np.ndarray, order: int, least: int = LEAST_GRAM):
        self.counted, self.order, self.least = counted, order, least
        self.tokens = self.longest = _mixed(block.hashes)
        self.begins = block.text != _shifted(block.text, -1)
        self.levels = [Level(*_distinct(self.tokens))]

    def _grow(self) -> None:
        """Adds the next longer n-grams, but not those that can't occur often enough as a shorter one doesn't."""
        last, size = self.levels[-1], len(self.levels) + 1
        if size == 2:
            whole, first = np.ones(len(self.tokens), bool), np.searchsorted(last.keys, _mixed(np.array([END])))[0]
            before = np.where(self.begins, _mixed(np.array([END])), _shifted(self.tokens, 0))
        else:
            often, first, before = last.n[last.places] >= self.least, len(last.keys), _shifted(self.longest, 0)
            whole = often & _shifted(often, False) & ~self.begins
        self.longest = _mixed(before * np.uint64(0x9E3779B97F4A7C15) + self.tokens)
        del before
        keys, index = np.unique(self.longest[whole], return_inverse=True)
        places = np.full(len(whole), len(keys), np.int32)
        places[whole] = index
        self.levels.append(Level(keys, places, np.where(self.begins, np.int32(first), _shifted(last.places, 0))))
        if size == self.order:
            self.tokens = self.longest = None

    def question(self, number: int) -> np.ndarray:
        """Sorted keys of a round, after the answers of those before it."""
        self.wanted: list[tuple[int, np.ndarray | None]] = []  # levels, and the places there for sums, or None for counts
        for size in (1, 2) if number == 1 else (number + 1,):
            if size <= self.order:
                if size > 1:
                    self._grow()
                self.wanted.append((size - 1, None))
        if 1 < number <= self.order:
            level, above = self.levels[number - 2], self.levels[number - 1]
            some = np.zeros(len(level.keys) + 1, bool)
            some[above.histories] = True
            self.wanted.append((number - 2, np.flatnonzero(some & (level.n >= self.least))))
        keys = np.concatenate([np.empty(0, np.uint64), *(self.levels[k].keys if at is None else self.levels[k].keys[at] for k, at in self.wanted)])
        self.sorted = np.argsort(keys, kind="stable")  # each level's are sorted already
        return keys[self.sorted]

    def values(self) -> np.ndarray:
        """What is known here about the keys of the question: counts, and sums in tenths of n-grams that are own."""
        out = []
        for k, at in self.wanted:
            level = self.levels[k]
            if at is None:
                out.append(np.bincount(level.places[self.counted], minlength=len(level.keys) + 1)[:-1])
            else:
                above, sums = self.levels[k + 1], np.zeros(len(level.keys) + 1, np.int64)
                history = np.empty(len(above.keys) + 1, np.int64)
                history[above.places] = above.histories
                some = np.flatnonzero((above.n >= self.least) & above.own)
                np.add.at(sums, history[some], 10 * above.n[some] - DISCOUNT)
                out.append(sums[at])
        return np.concatenate([np.empty(0, np.int64), *out])[self.sorted]

    def answer(self, totals: np.ndarray, own: np.ndarray) -> None:
        said, mine, start = np.empty_like(totals), np.empty_like(own), 0
        said[self.sorted], mine[self.sorted] = totals, own
        for k, at in self.wanted:
            level = self.levels[k]
            to = start + (len(level.keys) if at is None else len(at))
            if at is None:
                level.n, level.own = np.append(said[start:to], 0), np.append(mine[start:to], False)
            else:
                level.sums = np.zeros(len(level.keys) + 1, np.int64)
                level.sums[at] = said[start:to]
            start = to

    def known(self) -> list[int]:
        """Tokens counted here; of the different tokens that are own, all that were seen, and those seen 1, 2, 3 and 4 times."""
        seen = self.levels[0].n[self.levels[0].own]
        return [int(self.counted.sum()), len(seen), *[int((seen == k).sum()) for k in (1, 2, 3, 4)]]


class Machine:
    """The automaton of a block's n-grams. States are 0, the root, then each level's n-grams, up to those of order - 1 tokens.

    The arcs of a level's n-grams leave the states of their histories; source (-1: not kept), target and log-probability are
    by n-gram, and arcs that a text may take at a token are found by the n-grams that end there.
    """

    def __init__(self, grams: Grams, root: np.ndarray, unseen: np.ndarray):
        """root: probabilities of the tokens without a history; unseen: log10 to be added to each, 0 for those seen."""
        levels, self.order, self.begins = grams.levels, grams.order, grams.begins
        sizes = [len(x.keys) for x in levels]
        self.offsets = np.concatenate(([1], 1 + np.cumsum(sizes))).astype(np.int64)
        self.places = [x.places for x in levels]
        self.start = self.offsets[0] + int(np.searchsorted(levels[0].keys, _mixed(np.array([END])))[0]) if self.order > 1 else 0
        p = np.ones(sizes[0])
        p[levels[0].places] = root
        self.root = np.log10(p)
        spelt = np.zeros(sizes[0])
        spelt[levels[0].places] = unseen
        self.root += spelt
        states = int(self.offsets[max(0, self.order - 1)])
        self.fail, self.weight = np.zeros(states, np.int64), np.zeros(states)
        self.arcs: list[tuple] = [()]
        for k in range(1, self.order):
            level, below, size = levels[k], levels[k - 1], sizes[k]
            history, shorter = np.zeros(size + 1, np.int32), np.zeros(size + 1, np.int32)  # of each n-gram, by place below
            history[level.places], shorter[level.places] = level.histories, below.places
            history[size] = shorter[size] = 0
            p = step(p[shorter[:-1]], level.n[:-1], below.n[history[:-1]], below.sums[history[:-1]], grams.least)
            log10 = np.append(np.log10(p), 0.0)
            source, shorter = np.where(level.n >= grams.least, self.offsets[k - 1] + history, -1), self.offsets[k - 1] + shorter
            own = slice(int(self.offsets[k - 1]), int(self.offsets[k]))
            self.weight[own] = np.log10(np.maximum(1e-9, 1 - below.sums[:-1] / (10 * np.maximum(below.n[:-1], 1))))
            if k < self.order - 1:  # the n-gram is the history of longer ones, and falls back to the shorter one
                target = self.offsets[k] + np.arange(size + 1)
                self.fail[int(self.offsets[k]) : int(self.offsets[k + 1])] = shorter[:-1]
            else:
                target = shorter
            self.arcs.append((source, target, log10))

    def read(self) -> np.ndarray:
        """log10 of the probability of each token, in one traversal of all texts."""
        n = len(self.begins)
        out, first = np.empty(n), np.flatnonzero(self.begins)
        ends = np.append(first[1:], n)
        pieces = -(-(ends - first) // PIECE)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(first, pieces)
        start = begin + within * PIECE
        stop = np.minimum(start + PIECE, np.repeat(ends, pieces))
        at = np.maximum(begin, start - (self.order - 1))  # where reading begins, to find the state at start
        state = np.where(at == begin, self.start, 0)
        order = np.argsort(at - stop, kind="stable")
        at, start, state, length = at[order], start[order], state[order], (stop - at)[order]
        for step_ in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -step_, side="left"))
            place, now = at[:live] + step_, state[:live].copy()
            total, left, after = np.zeros(live), np.arange(live), np.zeros(live, np.int64)
            for k in range(self.order - 1, 0, -1):
                source, target, log10 = self.arcs[k]
                arc, own = self.places[k][place[left]], now[left]
                here = own >= self.offsets[k - 1]  # no state of shorter histories has such arcs
                fits = source[arc] == own
                taken, missed = left[fits], left[here & ~fits]
                total[taken] += log10[arc[fits]]
                after[taken] = target[arc[fits]]
                total[missed] += self.weight[now[missed]]
                now[missed] = self.fail[now[missed]]
                left = left[~fits]
            token = self.places[0][place[left]]
            total[left] += self.root[token]
            if self.order > 1:
                after[left] = self.offsets[0] + token
            state[:live] = after
            real = place >= start[:live]
            out[place[real]] = total[real]
        return out


def step(p: np.ndarray, n: np.ndarray, of: np.ndarray, sums: np.ndarray, least: int = LEAST_GRAM) -> np.ndarray:
    """Probabilities with a history, from those with the next shorter one, the n-grams' and the histories' counts, and the
    histories' sums."""
    of = np.maximum(of, 1)
    arc = np.where(n >= least, (10 * n - DISCOUNT) / (10 * of), 0.0)
    return arc + np.maximum(1e-9, 1 - sums / (10 * of)) * p  # the failure arc's weight


class Automaton:
    """keys: sorted, of tokens and n-grams; n: their counts; sums: of the kept n-grams that they are the history of.
    of_counts: how many tokens were seen 1, 2, 3 and 4 times."""

    def __init__(self, tokens: int, kinds: int, of_counts: list[int], keys: np.ndarray, n: np.ndarray, sums: np.ndarray, order: int = ORDER):
        self.n, self.kinds, self.order, self.keys = tokens, kinds, order, keys
        self.discounts = np.array([0.0, *discounts(of_counts)])
        taken = self.discounts[1] * of_counts[0] + self.discounts[2] * of_counts[1] + self.discounts[3] * (kinds - of_counts[0] - of_counts[1])
        self.unseen = taken / tokens if tokens else 1.0
        self.counts, self.sums = np.append(n, 0), np.append(sums, 0)

    def digits(self, hashes: np.ndarray) -> np.ndarray:
        return _mixed(hashes)

    def root(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities without a history, from tokens' counts; for those not seen, of all these together."""
        left = counts - self.discounts[np.minimum(counts, 3).astype(np.int64)]
        return np.where(counts > 0, left / max(1, self.n), self.unseen)

    def places(self, keys: np.ndarray) -> np.ndarray:
        return _looked_up(keys, self.keys, np.arange(len(self.keys)), len(self.keys))

    def log10(self, digits: np.ndarray, text: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Of each token. A text begins in the state of an end."""
        none, begins = len(self.keys), text != _shifted(text, -1)
        longer = [np.where(whole, self.places(keys), none) for keys, whole in gram_keys(digits, text, self.order)]
        first = np.where(begins, self.places(_mixed(np.array([END]))), _shifted(self.places(digits), none))
        histories = [first, *[np.where(begins, none, _shifted(p, none)) for p in longer[:-1]]][: self.order - 1]
        p = root
        for place, history in zip(longer, histories, strict=True):
            p = step(p, self.counts[place], self.counts[history], self.sums[history])
        return np.log10(p)

    def walk(self, digits: list[int], root: list[float]) -> float:
        """The same for one text, token by token: the state is the longest kept history."""
        table = {k: (n, s) for k, n, s in zip(self.keys.tolist(), self.counts.tolist(), self.sums.tolist(), strict=False)}
        one = lambda x: int(_mixed(np.array([x % 2**64], np.uint64))[0])
        carried, total = [one(int(END))], 0.0
        for digit, p in zip(digits, root, strict=True):
            now = [digit]
            for history in carried:
                n, kept = table.get(history, (0, 0))
                now.append(one(history * 0x9E3779B97F4A7C15 + digit))
                arc = table.get(now[-1], (0, 0))[0]
                p = ((10 * arc - DISCOUNT) / (10 * n) if arc >= LEAST_GRAM else 0.0) + max(1e-9, 1 - kept / (10 * max(n, 1))) * p
            total += float(np.log10(p))
            carried = now[: self.order - 1]
        return total


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64) if keys.dtype == np.uint64 else keys, pa.int64())


def token_counts(docs: DataFrame) -> DataFrame:
    """token (hash as long), n: over all rows of (text); settled, as it is used more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter64()
        for batch in batches:
            for _, _, block in blocks(batch.column(0).to_pylist()):
                counts.add(block.hashes)
        keys, n = counts.total()
        yield pa.RecordBatch.from_arrays([_signed(keys), pa.array(n, pa.int64())], ["token", "n"])

    return settled(docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))


def gathered(batch: list[str] | list[bytes], spelled: np.ndarray | None = None) -> Block:
    """All texts as one block."""
    hashes, text, spelt = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0)]
    for at, _, block in blocks(batch, spelled):
        hashes.append(block.hashes)
        text.append((block.text + at).astype(np.int32))
        if spelled is not None:
            spelt.append(block.spelt)
    return Block(np.concatenate(hashes), np.concatenate(text), None if spelled is None else np.concatenate(spelt))


def train(docs: DataFrame, order: int = ORDER) -> tuple[Automaton, DataFrame]:
    """The automaton in one place, and the counts of all tokens, learned from all rows of (text): for small tables, as
    score() deals it out."""
    block = gathered([text for (text,) in docs.select("text").collect()])
    grams = Grams(block, np.ones(len(block.hashes), bool), order)
    for number in range(1, order + 1):
        grams.question(number)
        grams.answer(values := grams.values(), values > 0)
    tokens, kinds, *of_counts = grams.known()
    keys, n = np.concatenate([x.keys for x in grams.levels]), np.concatenate([x.n[:-1] for x in grams.levels])
    sums = np.concatenate([np.zeros(len(x.keys), np.int64) if x.sums is None else x.sums[:-1] for x in grams.levels])
    by_key = np.argsort(keys)
    return Automaton(tokens, kinds, of_counts, keys[by_key], n[by_key], sums[by_key], order), token_counts(docs)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte: the high bytes are mostly 0."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], 8 * size, "zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, size).T).view("<u8").ravel()


PACK = "block int, doc_ids array<long>, held_out array<boolean>, sizes array<long>, data binary"


def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, held_out, block) with the texts of a batch that go to the same block, lower-cased, in one row."""
    zstd = pa.Codec("zstd", 6)
    for batch in batches:
        ids, held, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
        null, words = batch.column(0).is_null().to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        out: list[list] = [[], [], [], [], []]
        for which in np.unique(block).tolist():
            own = np.flatnonzero(block == which)
            parts = [words[i].encode("utf-8", "surrogatepass").lower() for i in own]
            row = (which, [None if null[i] else int(ids[i]) for i in own], held[own].tolist(), [len(x) for x in parts], zstd.compress(b"".join(parts), asbytes=True))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], [x.split()[0] for x in PACK.split(", ")])


def opened(table: pa.Table) -> tuple[list[int | None], np.ndarray, list[bytes]]:
    """doc_id, held_out and text of what was packed."""
    ids, held, found = [], [], []
    for row in table.to_pylist():
        ids += row["doc_ids"]
        held += row["held_out"]
        data, at = pa.decompress(row["data"], sum(row["sizes"]), "zstd", asbytes=True) if any(row["sizes"]) else b"", 0
        for size in row["sizes"]:
            found.append(data[at : at + size])
            at += size
    return ids, np.array(held, bool), found


QUESTION = "block int, range int, keys binary, counts binary, known array<long>"
ANSWER = "block int, range int, totals binary, known array<long>"


def questions(block: int, keys: np.ndarray, counts: np.ndarray, known: list[int], ranges: int) -> pa.Table:
    """A row for each range of keys, also for those without any."""
    cuts = [0, *np.searchsorted(keys, np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)).tolist(), len(keys)]
    parts = list(zip(cuts, cuts[1:], strict=False))
    return pa.table({
        "block": pa.array([block] * ranges, pa.int32()), "range": pa.array(range(ranges), pa.int32()),
        "keys": pa.array([packed(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in parts], pa.binary()),
        "counts": pa.array([packed(counts[a:b]) for a, b in parts], pa.binary()), "known": pa.array([known] * ranges, pa.list_(pa.int64())),
    })


def answers(asked: pa.Table) -> pa.Table:
    """For the questions of all blocks to one range: each key's total, twice, and 1 more for the first block that counted it."""
    asked = asked.sort_by("block")  # the first one is the same if a task runs again
    keys = [np.cumsum(unpacked(x), dtype=np.uint64) for x in asked["keys"].to_pylist()]
    counts = np.concatenate([unpacked(x) for x in asked["counts"].to_pylist()]).astype(np.int64)
    different, index = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.zeros(len(different), np.int64)
    np.add.at(totals, index, counts)
    some = np.flatnonzero(counts > 0)
    _, first = np.unique(index[some], return_index=True)
    out = 2 * totals[index]
    out[some[first]] += 1
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    known = np.sum(asked["known"].to_pylist(), axis=0).tolist()
    return pa.table({"block": asked["block"], "range": asked["range"], "totals": pa.array([packed(x) for x in np.split(out, cuts)], pa.binary()), "known": pa.array([known] * len(asked), pa.list_(pa.int64()))})


def answered(asked: DataFrame, n: int, name: str) -> DataFrame:
    """block, and all answers to it."""
    found = asked.repartition(n, "range").groupBy("range").applyInArrow(answers, ANSWER).repartition(n, "block")
    return found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("range", "totals", "known"))).alias(name))


def score(docs: DataFrame, modulus: int = 10, held_out: int = 0, order: int = ORDER, least: int = LEAST_GRAM) -> DataFrame:
    """Scores every row by the automaton learned from the rows that aren't held out, and by their token counts alone;
    known_score is the part of the score that known tokens have.

    Null texts are empty and have their end as the only token; repeated rows and null doc_ids stay; if no rows are
    there to learn from, all tokens are unseen, base is 0 and score that of the spelling; an empty
    table gives no rows; other columns are left out. Tokens and n-grams are told apart by 64-bit hashes. n-grams of two
    and more tokens are kept if they occur least times; with 1, all are.
    """
    n, rounds = partitions(docs.sparkSession), max(order, 2)  # what is known of the whole comes with the second answer
    rows = texts(docs, (crc_remainder("doc_id", modulus) == held_out).alias("held_out"))
    spelled = learned_spelling(rows.filter("not held_out"))
    rows = rows.withColumn("block", block_of(F.xxhash64("doc_id", "text"), n))
    dealt = rows.select("doc_id", "text", "held_out", "block").mapInArrow(frugal(packs), PACK).repartition(n, "block")
    names = [x.split()[0] for x in SCORES.split(", ")]

    def asked(held: np.ndarray, found: list[bytes], right: pa.Table | None, rounds: int, table: np.ndarray | None = None) -> tuple[Block, Grams, list[int]]:
        """The block's n-grams after the answers of so many rounds, and what they say about the whole."""
        block, known = gathered(found, table), [0] * 6
        found.clear()
        grams = Grams(block, ~held[block.text], order, least)
        for number in range(1, rounds + 1):
            grams.question(number)
            said = right[f"answer{number}"].to_pylist()[0]
            totals = np.concatenate([unpacked(x["totals"]) for x in said]).astype(np.int64)
            grams.answer(totals >> 1, (totals & 1).astype(bool))
            known = said[0]["known"]
        return block, grams, known

    def first(left: pa.Table) -> pa.Table:
        _, grams, known = asked(*opened(left)[1:], None, 0)
        out = questions(left["block"][0].as_py(), grams.question(1), grams.values(), known, n)
        del grams
        released()
        return out

    def further(number: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            _, grams, _ = asked(*opened(left)[1:], right, number - 1)
            out = questions(left["block"][0].as_py(), grams.question(number), grams.values(), grams.known(), n)
            del grams
            released()
            return out

        return run

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, held, found = opened(left)
        block, grams, (tokens, kinds, *of_counts) = asked(held, found, right, rounds, spelled)
        none = np.empty(0, np.int64)
        model, c = Automaton(tokens, kinds, of_counts, none, none, none, order), grams.levels[0].n[grams.levels[0].places]
        log10 = Machine(grams, model.root(c), np.where(c > 0, 0.0, block.spelt)).read()
        base = np.log10((c + 0.1) / (model.n + 0.1 * (model.kinds + 1)))
        size = len(ids)
        lists = {
            "doc_id": pa.array(ids, pa.int64()), "held_out": held, "n_tokens": np.bincount(block.text, minlength=size),
            "n_known": np.bincount(block.text, weights=c > 0, minlength=size).astype(np.int64), "train_tokens": np.full(size, model.n),
            "base_score": np.bincount(block.text, weights=base, minlength=size), "score": np.bincount(block.text, weights=log10, minlength=size),
            "known_score": np.bincount(block.text, weights=np.where(c > 0, log10, 0.0), minlength=size),
        }
        out = pa.table({k: lists[k] for k in names})
        del block, grams, log10, base, c
        released()
        return out

    def blocked():
        return dealt.groupBy("block")

    known = answered(blocked().applyInArrow(first, QUESTION), n, "answer1")
    for number in range(2, rounds + 1):
        asking = blocked().cogroup(known.groupBy("block")).applyInArrow(further(number), QUESTION)
        # all blocks are answered; a left join adds no filter to known, which is so exchanged once for both its uses
        known = known.join(answered(asking, n, f"answer{number}"), "block", "left")
    return blocked().cogroup(known.groupBy("block")).applyInArrow(scored, SCORES)
