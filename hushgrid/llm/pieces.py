"""SentencePiece encoding and decoding with N-best segmentation.

A text is the lattice of all pieces that match somewhere in it; a path's score is the sum of its pieces' scores. Where
no piece holds a character, its bytes' pieces do. No piece has a blank after another character, so the lattice is a
chain of the words' lattices, each led by its blanks, and words are looked at once for a block of texts:

- A forward Viterbi pass over all different words of a block at once, in arrays, gives each its best path, and with the
  backward pass the best path through any piece; the best of these off the best path is the second-best score.
- N-best segmentations of a text differ from the best in the N - 1 words that lose least by their second-best path, so
  only for these are N-best paths searched: a backward A* search from the word's end, whose forward Viterbi scores are
  exact heuristics, so that it pops paths in order of their scores and expands nothing that isn't on one of them.

The model decides what scores mean. In a unigram model they are log-probabilities, and the best path is the library's own
encoding. In a byte-pair model, as the public one is, they are merge ranks, and the library encodes by merges, not by
scores: of 150 documents none had the same pieces. Best then means least sum of ranks; decoding is the same.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import frugal, parts_of, texts
from .shingles import prefix_sums, span_values

BLANK = "▁"
N_BEST = 3
LONG = 48  # bytes of words that are run in step; longer ones go one by one
BLOCK = 1_000_000  # characters of a block of texts
STEP = 300_000  # bytes of words that are run together
SLOTS = 18  # bits of a value that say if a piece may begin so
KEPT = 600_000  # words that a worker remembers
WORD = re.compile(f"{BLANK}+[^{BLANK}]*")
SEGMENTED = "doc_id long, n_pieces long, ids_crc32 long, score double, nbest_scores array<double>, nbest_crc32 array<long>, decoded boolean"


class Pieces:
    """A model's pieces: their scores, and the bytes' own."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = []
        self.score_of = np.zeros(len(model))
        self.byte_ids = np.full(256, model.unk_id(), np.int64)
        self.ids: dict[bytes, int] = {}
        for i in range(len(model)):
            name, self.score_of[i] = model.id_to_piece(i), model.get_score(i)
            data = b""
            if model.is_byte(i):
                data = bytes([int(name[3:5], 16)])
                self.byte_ids[data[0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                data = name.encode()
                if re.search(f"[^{BLANK}]{BLANK}", name):
                    raise ValueError(f"piece {i} goes over the beginning of a word")
                self.ids[data] = i
            self.bytes_of.append(data)
        self.unknown = float(min(self.score_of[i] for i in self.ids.values())) - 10.0  # a character by its bytes
        # for each size the values of all pieces' beginnings, sorted, with the piece that ends there, or -1
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in range(1, max(map(len, self.ids)) + 1):
            heads = sorted({p[:size] for p in self.ids if len(p) >= size})
            starts = np.arange(0, size * len(heads), size)
            values = span_values(prefix_sums(np.frombuffer(b"".join(heads), np.uint8)), starts, starts + size)
            order, maybe = np.argsort(values), np.zeros(1 << SLOTS, bool)
            maybe[values >> np.uint64(64 - SLOTS)] = True
            self.tables.append((maybe, values[order], np.array([self.ids.get(h, -1) for h in heads], np.int32)[order]))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def arcs(self, data: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, piece) of each piece that matches in data before its place's limit, the end of its word; piece -2:
        a character that is no piece, by its bytes. By sizes, and places in these."""
        sums = prefix_sums(data)
        heads = np.flatnonzero((data & 0xC0) != 0x80)
        sizes = np.minimum(np.append(heads[1:], len(data)), limit[heads]) - heads
        alone, alive, found = np.ones(len(data), bool), heads, []
        whole = np.zeros(len(data), np.int64)
        whole[heads] = sizes
        for size, (maybe, values, ids) in enumerate(self.tables, 1):
            alive = alive[alive + size <= limit[alive]]
            if not len(alive):
                break
            value = span_values(sums, alive, alive + size)
            some = maybe[value >> np.uint64(64 - SLOTS)]
            alive, value = alive[some], value[some]
            index = np.minimum(np.searchsorted(values, value), len(values) - 1)
            hit = values[index] == value
            alive, piece = alive[hit], ids[index[hit]]
            full = piece >= 0
            start, piece = alive[full], piece[full]
            alone[start[whole[start] == size]] = False
            found.append((start, np.full(len(start), size), piece))
        rest = alone[heads]
        found.append((heads[rest], sizes[rest], np.full(int(rest.sum()), -2, np.int32)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def scores(self, piece: np.ndarray) -> np.ndarray:
        return np.where(piece >= 0, self.score_of[piece], self.unknown)

    def n_best(self, word: bytes, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths with their scores, the best first; the order of equal ones is fixed by the word."""
        return self.n_best_all([word], n)[0]

    def n_best_all(self, words: list[bytes], n: int) -> list[list[tuple[float, tuple[int, ...]]]]:
        data = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.array([len(w) for w in words], np.int64)
        start, size, piece = self.arcs(data, np.repeat(np.cumsum(lengths), lengths))
        order = np.argsort(start + size, kind="stable")
        cuts = np.searchsorted((start + size)[order], np.arange(len(data) + 2)).tolist()
        arcs = start[order].tolist(), piece[order].tolist(), self.scores(piece[order]).tolist()
        ends = np.cumsum(lengths).tolist()
        return [self._backward(data, cuts, *arcs, end - len(word), end, n) for word, end in zip(words, ends, strict=True)]

    def _backward(self, data: np.ndarray, cuts: list[int], start: list[int], piece: list[int], score: list[float], begin: int, end: int, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The A* search in the word from begin to end; the arcs cuts[i] to cuts[i + 1] end at i."""
        none = -math.inf
        forward = [0.0]
        for to in range(begin + 1, end + 1):
            best = none
            for k in range(cuts[to], cuts[to + 1]):
                through = forward[start[k] - begin] + score[k]
                if through > best:
                    best = through
            forward.append(best)
        # (loss against the best path, number, place, score behind, the arc taken, its end and the entry it was taken from);
        # the loss is that of the arcs taken, as what is ahead is the best; of equal entries the last one goes on
        heap: list[tuple] = [(0.0, 0, end, 0.0, None)]
        out, pushed = [], 0
        while heap and len(out) < n:
            loss, _, at, behind, link = heapq.heappop(heap)
            if at == begin:
                ids: list[int] = []
                before = begin
                while link is not None:
                    k, to, link = link
                    ids += [piece[k]] if piece[k] >= 0 else self.byte_ids[data[before:to]].tolist()
                    before = to
                out.append((behind, tuple(ids)))
                continue
            top = forward[at - begin]
            for k in range(cuts[at], cuts[at + 1]):
                ahead = forward[start[k] - begin] + score[k]
                if ahead > none:
                    pushed -= 1
                    heapq.heappush(heap, (loss + top - ahead, pushed, start[k], score[k] + behind, (k, at, link)))
        return out

    def second_best(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Of each word the best path's ids (as little-endian unsigned 32-bit bytes), its score, and the second-best (-inf: none)."""
        ids: list[bytes] = [b""] * len(words)
        best, second = np.full(len(words), -np.inf), np.full(len(words), -np.inf)
        part, size = [], 0
        for i, word in enumerate(words):
            if len(word) > LONG:
                paths = self.n_best(word, 2)
                best[i], ids[i] = paths[0][0], np.array(paths[0][1], "<u4").tobytes()
                second[i] = paths[1][0] if len(paths) > 1 else -np.inf
                continue
            part.append(i)
            size += len(word)
            if size >= STEP:
                self._together(words, part, ids, best, second)
                part, size = [], 0
        if part:
            self._together(words, part, ids, best, second)
        return ids, best, second

    def _together(self, words: list[bytes], part: list[int], ids: list[bytes], best: np.ndarray, second: np.ndarray) -> None:
        """Fills in the results of the words in part. A node is a place in a word, its end included; arcs are run through by
        their ends', and backwards by their starts', places in the words."""
        data = np.frombuffer(b"".join([words[i] for i in part]), np.uint8)
        lengths = np.array([len(words[i]) for i in part])
        begins = np.cumsum(lengths) - lengths
        row_of = np.repeat(np.arange(len(part)), lengths)
        start, size, piece = self.arcs(data, np.repeat(begins + lengths, lengths))
        row = row_of[start]
        within = start - begins[row]
        source, score = start + row, self.scores(piece)
        target = source + size
        first, last = begins + np.arange(len(part)), begins + lengths + np.arange(len(part))
        nodes = len(data) + len(part)
        forward, by = np.full(nodes, -np.inf), np.zeros(nodes, np.int64)
        forward[first] = 0.0
        order = np.argsort((within + size).astype(np.uint8), kind="stable")
        cuts = np.searchsorted((within + size)[order], np.arange(1, lengths.max() + 2))
        for at, to in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            own = order[at:to]
            through = forward[source[own]] + score[own]
            np.maximum.at(forward, target[own], through)
            fits = own[through == forward[target[own]]][::-1]  # of equal ones the shortest piece is written last
            by[target[fits]] = fits
        backward = np.full(nodes, -np.inf)
        backward[last] = 0.0
        order = np.argsort(within.astype(np.uint8), kind="stable")
        cuts = np.searchsorted(within[order], np.arange(lengths.max() + 1))
        for at, to in zip(cuts[:-1][::-1].tolist(), cuts[1:][::-1].tolist(), strict=True):
            own = order[at:to]
            np.maximum.at(backward, source[own], score[own] + backward[target[own]])
        steps, at = [], last
        begun = np.zeros(nodes, bool)
        begun[first] = True
        while len(at):
            steps.append(by[at])
            at = source[steps[-1]]
            at = at[~begun[at]]
        path = np.concatenate(steps)
        path = path[np.argsort(target[path])]
        through = forward[source] + score + backward[target]
        through[path] = -np.inf
        runner_up = np.full(len(part), -np.inf)
        np.maximum.at(runner_up, row, through)
        best[part], second[part] = forward[last], runner_up
        count = np.where(piece[path] >= 0, 1, size[path])
        flat = np.repeat(piece[path], count).astype(np.int64)
        inside = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
        spelt = flat < 0
        flat[spelt] = self.byte_ids[data[(np.repeat(start[path], count) + inside)[spelt]]]
        told = flat.astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(row[path], weights=count, minlength=len(part)))).astype(np.int64).tolist()
        begin = 0
        for i, end in zip(part, ends, strict=True):
            ids[i] = told[begin:end]
            begin = end


def normalized(text: str) -> str:
    """Blanks marked, and one in front."""
    return BLANK + text.replace(" ", BLANK) if text else ""


def decoded(pieces: Pieces, ids: list[int]) -> str:
    """The text of ids: pieces and bytes joined, marks as blanks, less the one in front."""
    return pieces.decode(ids).decode("utf-8", "replace").replace(BLANK, " ")[1:]


def combined(options: list[list[tuple[float, int]]], n: int) -> list[tuple[float, dict[int, int]]]:
    """The n least sums of one loss from each list, the first loss of which is 0; as (sum, choices other than 0 by list)."""
    best: list[tuple[float, dict[int, int]]] = [(0.0, {})]
    for place, losses in enumerate(options):
        best = heapq.nsmallest(n, ((a + b, chosen | ({place: k} if k else {})) for a, chosen in best for b, k in losses), key=lambda x: x[0])
    return best


class Segmenter:
    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.kept: dict[str, list[tuple[float, bytes]]] = {}
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.same: list[bool] = []
        self.best = self.lost = np.empty(0)

    def learn(self, words: set[str]) -> None:
        """Best and second-best paths of words not seen before, kept for later blocks until KEPT are."""
        if len(self.index) + len(words) > KEPT:
            self.forget()
        new = [w for w in words if w not in self.index]
        data = [w.encode("utf-8", "surrogatepass") for w in new]
        ids, best, second = self.pieces.second_best(data)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.ids += ids
        self.best, self.lost = np.concatenate([self.best, best]), np.concatenate([self.lost, best - second])
        flat = np.frombuffer(b"".join(ids), "<u4").tolist()
        if self.pieces.decode(flat) == b"".join(data):
            self.same += [True] * len(new)
        else:
            self.same += [self.pieces.decode(np.frombuffer(i, "<u4").tolist()) == w for i, w in zip(ids, data, strict=True)]

    def search(self, words: set[str], n: int) -> None:
        """N-best paths of words that aren't kept yet."""
        if len(self.kept) + len(words) > 100_000:
            self.kept.clear()
        new = sorted(w for w in words if w not in self.kept)
        for word, found in zip(new, self.pieces.n_best_all([w.encode("utf-8", "surrogatepass") for w in new], n), strict=True):
            self.kept[word] = [(s, np.array(p, "<u4").tobytes()) for s, p in found]

    def block(self, batch: list[str], n: int) -> Iterator[tuple[bytes, float, list[tuple[float, bytes]], bool]]:
        """Of each text the ids, the score, the n best (score, ids), and if decoding gives the text again."""
        split = [WORD.findall(normalized(t)) for t in batch]
        words_: set[str] = set()
        words_.update(*split)
        self.learn(words_)
        ids, known = self.ids, self.index.__getitem__
        best, lost, same = self.best, self.lost, np.array(self.same, bool)
        numbers = [np.fromiter(map(known, words), np.int64, len(words)) for words in split]
        closest = []
        for number in numbers:
            close = np.argsort(lost[number], kind="stable")[: n - 1]
            closest.append(close[np.isfinite(lost[number[close]])].tolist())
        self.search({words[c] for words, close in zip(split, closest, strict=True) for c in close}, n)
        for words, number, close in zip(split, numbers, closest, strict=True):
            parts = [ids[i] for i in number.tolist()]
            score = float(best[number].sum())
            paths = [self.kept[words[c]] for c in close]
            found = []
            for loss, chosen in combined([[(own[0][0] - s, k) for k, (s, _) in enumerate(own)] for own in paths], n):
                changed = list(parts)
                for place, k in chosen.items():
                    changed[close[place]] = paths[place][k][1]
                found.append((score - loss, b"".join(changed)))
            yield b"".join(parts), score, found, bool(same[number].all())


_segmenters: dict[str, Segmenter] = {}


def segmenter(path: str) -> Segmenter:
    if path not in _segmenters:
        _segmenters[path] = Segmenter(path)
    return _segmenters[path]


def segment(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """Best and n best segmentations of every text: number of pieces, CRC-32 of the ids (little-endian unsigned 32-bit),
    scores, and whether decoding gives the text back.

    Null texts are empty; an empty text has the empty segmentation, with score 0, alone; texts with fewer than n
    segmentations have those there are; repeated rows and null doc_ids stay; an empty table gives no rows; other columns
    are left out. Among segmentations with equal scores the order is fixed by the text alone.
    """
    names = [x.split()[0] for x in SEGMENTED.replace("array<", "").replace(">", "").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(path)
        for batch in parts_of(batches, 2000):
            docs_, all_texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(all_texts):
                size, to = 0, at
                while to < len(all_texts) and (size < BLOCK or to == at):
                    size += len(all_texts[to])
                    to += 1
                rows = [(len(ids) // 4, zlib.crc32(ids), score, [s for s, _ in found], [zlib.crc32(p) for _, p in found], same) for ids, score, found, same in own.block(all_texts[at:to], n)]
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_()]
                yield pa.RecordBatch.from_arrays([docs_.slice(at, to - at), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)
                at = to

    return texts(docs).mapInArrow(frugal(run), SEGMENTED)
