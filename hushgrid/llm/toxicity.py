"""Toxic spans and document scores by a linear-chain conditional random field.

Labels are of documents, so tokens get theirs from a bounded sample of labelled documents: in a toxic document a token
is toxic if documents with its word, or its beginning, are toxic far more often than others. A chain with the states
clean and toxic is then fitted to these sequences. A token's potentials come from its word and its first 4 and 5 bytes,
if toxic tokens of the sample had them; any other token is neutral, and a run of neutral tokens is one power of a 2 x 2
matrix, so that forward-backward over a whole text takes a step for each token that isn't neutral. The marginals at
these are aggregated: their sum, maximum and share go through a logistic function fitted to the sample's labels.

The model is a few thousand numbers, bounded by the sample; documents are scored where they are, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import any_names, crc_remainder, frugal, texts
from .shingles import WORD, prefix_sums, runs, shingle_hashes, span_hashes

SAMPLE = 1500  # labelled documents of either class that the model is fitted to, at most
SAMPLE_MB = 12  # million characters of text of either class in the sample, at most
ODDS = 10.0  # how many times the share of documents with a feature must be among toxic ones
LEAST_DOCS = 3  # toxic documents that have the feature
REJECTED = 0.7  # score of a document that counts as toxic
STEPS = 60
PREFIXES = (4, 5)
SCORES = "doc_id long, held_out boolean, score double, predicted int, n_tokens long, toxic_tokens double, spans array<struct<start:int,end:int,marginal:double>>"


def lowered(text: str) -> np.ndarray:
    """UTF-8 bytes of the lower-cased text, with each character where it was."""
    low, data = text.lower(), text.encode("utf-8", "surrogatepass")
    out = low.encode("utf-8", "surrogatepass")
    if len(out) != len(data) or len(low) != len(text):
        same = lambda c: c.lower() if len(c.lower()) == 1 and len(c.lower().encode("utf-8", "surrogatepass")) == len(c.encode("utf-8", "surrogatepass")) else c
        out = "".join(map(same, text)).encode("utf-8", "surrogatepass")
    return np.frombuffer(out, np.uint8)


def token_features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in bytes, and a row of feature hashes, of each token; a feature that a token lacks is 0."""
    data = lowered(text)
    starts, ends = runs(data, WORD)
    sums = prefix_sums(data)
    columns = [span_hashes(sums, starts, ends)]
    for size in PREFIXES:
        to = starts + size
        long = to < ends
        columns.append(np.where(long, span_hashes(sums, starts, np.where(long, to, starts)) ^ np.uint64(size), np.uint64(0)))
    return starts, ends, np.stack(columns, axis=1)


@dataclass
class Chain:
    """Transition scores (from clean to clean: 0), weights by sorted feature hash, and the logistic aggregate."""

    enter: float = -6.0
    stay: float = -3.0
    leave: float = 0.0
    known: np.ndarray = None
    weights: np.ndarray = None
    aggregate: np.ndarray = None

    def potentials(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the tokens that aren't neutral, and indices of their weights (-1: none)."""
        if not len(self.known):
            return np.empty(0, np.int64), np.empty((0, features.shape[1]), np.int64)
        if not hasattr(self, "maybe"):
            self.maybe = np.zeros(1 << 22, bool)
            self.maybe[self.known & np.uint64((1 << 22) - 1)] = True
        at = np.flatnonzero(self.maybe[features & np.uint64((1 << 22) - 1)].any(axis=1))
        index = np.minimum(np.searchsorted(self.known, features[at]), len(self.known) - 1)
        index = np.where(self.known[index] == features[at], index, -1)
        some = (index >= 0).any(axis=1)
        return at[some], index[some]


class Sequences:
    """Texts as chains of tokens that aren't neutral, the longest first, so that all are run in step: what belongs to the
    kth of these tokens of the texts that have so many lies together, in arrays as long as there are such tokens."""

    def __init__(self, lengths: list[int], hits: list[np.ndarray]):
        self.order = np.argsort([-len(h) for h in hits], kind="stable")
        self.n = np.array(lengths, np.int64)[self.order]
        counts = np.array([len(hits[i]) for i in self.order], np.int64)
        most = int(counts.max(initial=0))
        live = np.searchsorted(-counts, -np.arange(most), side="left")  # texts with more than k hits
        self.cuts = np.concatenate(([0], np.cumsum(live))).astype(np.int64)
        flat = np.concatenate([hits[i] for i in self.order]) if len(hits) else np.empty(0, np.int64)
        self.row = np.repeat(np.arange(len(counts)), counts)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.place = self.cuts[column] + self.row
        gaps = np.diff(flat, prepend=-1) - 1
        gaps[column == 0] = flat[column == 0]
        last = np.full(len(counts), -1, np.int64)
        last[self.row] = flat
        self.gaps = self.laid(gaps.astype(np.float64))
        self.tail = (self.n - 1 - last).astype(np.float64)
        self.neutral = np.bincount(self.row, weights=gaps, minlength=len(counts)) + self.tail

    def laid(self, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[self.place] = values
        return out

    def run(self, chain: Chain, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log Z of each text, in self.order, and the marginal of toxic at each hit, in the order of the hits given."""
        logs, marginals = self.run_all([(chain.enter, chain.stay, chain.leave)], scores)
        return logs[0], marginals

    def run_all(self, moves: list[tuple[float, float, float]], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log Z of each text for each of several (enter, stay, leave), and the marginals for the first of these."""
        m = np.exp([[[0.0, enter], [leave, stay]] for enter, stay, leave in moves])
        half, spread = (m[:, 0, 0] + m[:, 1, 1]) / 2, np.sqrt(((m[:, 0, 0] - m[:, 1, 1]) / 2) ** 2 + m[:, 0, 1] * m[:, 1, 0])
        top, low = half + spread, half - spread
        first = (m - low[:, None, None] * np.eye(2)) / (top - low)[:, None, None]
        second, ratio = np.eye(2) - first, low / top

        def power(gap: np.ndarray) -> np.ndarray:
            return first[:, None] + np.power(ratio[:, None], gap)[:, :, None, None] * second[:, None]

        s = self.laid(scores)
        shift = np.maximum(s, 0)
        steps = power(self.gaps) @ m[:, None] * np.exp(np.stack([-shift, s - shift], axis=1))[None, :, None, :]
        upper, lower = np.ascontiguousarray(steps[:, :, 0]), np.ascontiguousarray(steps[:, :, 1])
        forward = np.zeros((len(moves), len(self.n), 2))
        forward[:, :, 0] = 1.0
        totals, kept = np.empty(steps.shape[:2]), np.empty((steps.shape[1], 2))
        cuts = list(zip(self.cuts.tolist(), self.cuts[1:].tolist(), strict=False))
        for at, to in cuts:
            now = forward[:, : to - at]
            a = now[:, :, :1] * upper[:, at:to] + now[:, :, 1:] * lower[:, at:to]
            total = a[:, :, 0] + a[:, :, 1]
            totals[:, at:to] = total
            np.divide(a, total[:, :, None], out=now)
            kept[at:to] = now[0]
        end = power(self.tail)
        logs = np.log(top)[:, None] * self.neutral + np.log((forward[:, :, :, None] * end).sum(axis=(2, 3)))
        gained = np.log(totals) + shift
        logs += np.stack([np.bincount(self.row, weights=g[self.place], minlength=len(self.n)) for g in gained])
        backward, out = end[0].sum(axis=2), np.empty(len(s))
        back = steps[0]
        for at, to in reversed(cuts):
            now = backward[: to - at]
            both = kept[at:to] * now
            out[at:to] = both[:, 1] / (both[:, 0] + both[:, 1])
            b = (back[at:to] * now[:, None, :]).sum(axis=2)
            np.divide(b, b.sum(axis=1, keepdims=True), out=now)
        return logs, out[self.place]


def _scores(chain: Chain, index: np.ndarray) -> np.ndarray:
    return (np.where(index >= 0, chain.weights[index], 0.0)).sum(axis=1) if len(index) else np.empty(0)


def _aggregates(sequences: Sequences, marginals: np.ndarray) -> np.ndarray:
    """Of each text, in its place: 1, the log of the expected number of toxic tokens, the largest marginal, their share."""
    size = len(sequences.n)
    total, most = np.bincount(sequences.row, weights=marginals, minlength=size), np.zeros(size)
    np.maximum.at(most, sequences.row, marginals)
    rows = np.stack([np.ones(size), np.log1p(total), most, 10 * total / np.maximum(sequences.n, 1)], axis=1)
    out = np.empty_like(rows)
    out[sequences.order] = rows
    return out


def _distinct(sample: list[str]) -> list[int]:
    """Indices of texts without those most of whose shingles stand in earlier ones: copies would make their words count."""
    if not sample:
        return []
    sets = [np.unique(shingle_hashes(text)) for text in sample]
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, first, index = np.unique(np.concatenate(sets), return_index=True, return_inverse=True)
    earlier = np.bincount(of, weights=of[first][index] < of, minlength=len(sets))
    return np.flatnonzero(earlier <= 0.5 * np.bincount(of, minlength=len(sets))).tolist()


def fit(sample: list[tuple[str, int]]) -> Chain:
    """The chain fitted to texts and their labels; no toxic text at all gives a chain that scores 0 everywhere."""
    chain = Chain(known=np.empty(0, np.uint64), weights=np.empty(0))
    sample = sorted(sample)
    sample = [sample[i] for i in _distinct([t for t, _ in sample])]
    labels = np.array([y for _, y in sample])
    if not labels.any():
        return chain

    def features() -> Iterator[np.ndarray]:  # anew for each pass: those of all texts take far more memory than the texts
        for text, _ in sample:
            yield token_features(text)[2]

    def by_docs(of: int) -> tuple[np.ndarray, np.ndarray]:
        rows = [np.unique(f[f != 0]) for f, y in zip(features(), labels, strict=True) if y == of]
        return np.unique(np.concatenate(rows), return_counts=True) if rows else (np.empty(0, np.uint64), np.empty(0, np.int64))

    (toxic, of_toxic), (clean, of_clean) = by_docs(1), by_docs(0)
    at = np.minimum(np.searchsorted(clean, toxic), max(len(clean) - 1, 0))
    others = np.where(clean[at] == toxic, of_clean[at], 0) if len(clean) else np.zeros(len(toxic))
    odds = ((of_toxic + 0.5) / labels.sum()) / ((others + 0.5) / max(1, (1 - labels).sum()))
    marked = toxic[(odds >= ODDS) & (of_toxic >= LEAST_DOCS)]
    gold = [np.isin(f, marked).any(axis=1) if y else np.zeros(len(f), bool) for f, y in zip(features(), labels, strict=True)]
    used = np.unique(np.concatenate([np.unique(f[g]) for f, g in zip(features(), gold, strict=True)]))
    chain.known = used[used != 0]
    chain.weights = np.zeros(len(chain.known))
    found = [chain.potentials(f) for f in features()]
    sequences = Sequences([len(g) for g in gold], [p for p, _ in found])
    index = np.concatenate([found[i][1] for i in sequences.order])
    truth = np.concatenate([gold[i][found[i][0]] for i in sequences.order]).astype(np.float64)
    pairs = [np.concatenate(([False], g)).astype(int) for g in gold]
    moves = np.sum([[np.sum((1 - p[:-1]) * p[1:]), np.sum(p[:-1] * p[1:]), np.sum(p[:-1] * (1 - p[1:]))] for p in pairs], axis=0)
    scale, names = 1 / len(sample), ("enter", "stay", "leave")
    first, second = np.zeros(3 + len(chain.weights)), np.zeros(3 + len(chain.weights))
    for step in range(1, STEPS + 1):
        scores = _scores(chain, index)
        now = (chain.enter, chain.stay, chain.leave)
        changed = [tuple(v + 1e-5 * (i == k) for i, v in enumerate(now)) for k in range(3)]
        logs, m = sequences.run_all([now, *changed], scores)
        gradient = np.zeros_like(first)
        np.add.at(gradient, 3 + index[index >= 0], np.repeat(truth - m, (index >= 0).sum(axis=1)))
        # expected moves inside neutral runs: the slope of log Z
        gradient[:3] = moves - (logs[1:] - logs[0]).sum(axis=1) / 1e-5
        gradient = gradient * scale - 1e-3 * np.concatenate([[chain.enter, chain.stay, chain.leave], chain.weights]) * np.concatenate([[0.1] * 3, np.ones(len(chain.weights))])
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        change = 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        chain.enter, chain.stay, chain.leave = (getattr(chain, n) + c for n, c in zip(names, change, strict=False))
        chain.weights = chain.weights + change[3:]
    x = _aggregates(sequences, sequences.run(chain, _scores(chain, index))[1])
    chain.aggregate = _logistic(x, labels)
    return chain


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a penalised logistic regression by Newton's method with halved steps; the first column is constant."""
    penalty = np.array([1e-6] + [0.05] * (x.shape[1] - 1))

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + penalty @ (w * w) / 2)

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), gradient)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * change) > now:
            size /= 2
        w = w - size * change
        if np.abs(size * change).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, sample_docs: int = SAMPLE, sample_mb: float = SAMPLE_MB) -> Chain:
    """Fits a chain to at most sample_docs documents of either class, drawn by a hash of doc_id from all labelled rows that
    aren't held out. Of these, a document that would take its class over sample_mb million characters is passed over, and
    the next ones that fit are taken. Rows without doc_id or label don't count; a doc_id with both labels is toxic."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    named = named.filter(crc_remainder("doc_id", modulus) != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample: list[tuple[str, int]] = []
    for y in (0, 1):
        ids = named.filter((F.col("toxic") > 0) == bool(y)).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample_docs)
        size = 0
        for (text,) in texts(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").select("text").limit(sample_docs).toLocalIterator():
            if size + len(text) <= sample_mb * 1_000_000:
                size += len(text)
                sample.append((text, y))
    return fit(sample)


def score_texts(chain: Chain, batch: list[str], spans: bool = True) -> list[tuple]:
    """(score, tokens, expected toxic tokens, spans) of each text; a text without toxic tokens gets the least score."""
    if chain.aggregate is None:
        return [(0.0, len(token_features(t)[0]), 0.0, []) for t in batch]
    parts = []
    for text in batch:
        starts, ends, features = token_features(text)
        at, index = chain.potentials(features)
        parts.append((len(starts), at, index, starts[at], ends[at]))
    sequences = Sequences([p[0] for p in parts], [p[1] for p in parts])
    index = np.concatenate([parts[i][2] for i in sequences.order]) if len(parts) else np.empty((0, 3), np.int64)
    m = sequences.run(chain, _scores(chain, index))[1]
    x = _aggregates(sequences, m)
    scores = 1 / (1 + np.exp(-np.clip(x @ chain.aggregate, -30, 30)))
    own: list[np.ndarray] = [np.empty(0)] * len(parts)
    at = 0
    for i in sequences.order:
        own[i] = m[at : at + len(parts[i][1])]
        at += len(parts[i][1])
    out = []
    for text, part, marginals, score in zip(batch, parts, own, scores.tolist(), strict=True):
        said = []
        if spans and len(marginals) and marginals.max() >= 0.5:
            data = text.encode("utf-8", "surrogatepass")
            place, before = 0, 0
            for k in np.flatnonzero(marginals >= 0.5):
                start, end = int(part[3][k]), int(part[4][k])
                place += len(data[before:start].decode("utf-8", "surrogatepass"))
                size = len(data[start:end].decode("utf-8", "surrogatepass"))
                said.append((place, place + size, float(marginals[k])))
                place, before = place + size, end
        out.append((score, part[0], float(marginals.sum()), said))
    return out


def toxicity(docs: DataFrame, chain: Chain, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """Scores every row and names its offending spans (code points, end exclusive).

    Null texts are empty and, as all texts without toxic tokens, get the least score. Rows with null or repeated doc_id
    stay as they are; an empty table gives no rows; other columns are left out.
    """
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = score_texts(chain, part.column(1).to_pylist())
                spans = pa.array([[{"start": a, "end": b, "marginal": p} for a, b, p in r[3]] for r in rows], span)
                score = pa.array([r[0] for r in rows], pa.float64())
                flags = pa.array([int(r[0] >= REJECTED) for r in rows], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), score, flags, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), spans], [x.split()[0] for x in SCORES.split(", ")])

    return texts(docs, (crc_remainder("doc_id", modulus) == held_out).alias("held_out")).mapInArrow(frugal(run), SCORES)


@any_names
def without_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs, with all its columns, without the rows whose text the chain rejects."""
    names, place = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = score_texts(chain, [t or "" for t in part.column(place).to_pylist()], spans=False)
                kept = part.filter(pa.array([r[0] < REJECTED for r in rows], pa.bool_()))
                if kept.num_rows:
                    yield kept

    return docs.select(*names).mapInArrow(frugal(run), docs.schema)
