"""Best-fit packing of token sequences.

Documents become runs of token ids; runs longer than a sequence are cut; every piece goes to the open sequence with
the least free space that still holds it. The number of open sequences is bounded: they sit in stacks by free space,
and an integer used as a bitset has a bit for each free space that occurs, so the best fit is the lowest set bit at or
above the piece's length. If all places are taken the fullest open sequence closes first.

Each task packs the documents of its own partition in one pass over them. No rows are shuffled, and at most
``open_bins`` sequences of each task stay partly filled.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import frugal, parts_of, texts

LENGTH = 1024  # tokens of a sequence
OPEN_BINS = 4096  # sequences that a task keeps open
END_ID = 2  # follows each document
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """Online best-fit with a bounded number of open bins."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.opened = self.open = 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin's number and the offset in it for a piece of 1 to capacity units."""
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most:  # the fullest closes: the lowest bit that is set
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            number, free = self.opened, self.capacity
            self.opened += 1
            self.open += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        return number


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    Texts without a special token's name go to a faster encoder over the same vocabulary and merges, read from the
    same file (a token's id is its merge rank); the others to the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        self.path, self.tokenizer = path, None
        letters = byte_letters()
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.special = [t["content"] for t in told["added_tokens"]]
        ranks = {bytes(letters[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("same", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            if self.tokenizer is None:  # only where a text needs it, as it takes memory
                from tokenizers import Tokenizer

                self.tokenizer = Tokenizer.from_file(self.path)
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return array("I", ids).tobytes()


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write bytes that print as themselves, and the others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def pattern() -> str:
    """How the byte-level vocabulary's pre-tokenizer splits texts, as its package says."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, and a shorter one in front if n isn't a multiple."""
    head = n % length
    return ([(0, head)] if head else []) + [(at, length) for at in range(head, n, length)]


def pack(docs: DataFrame, path: str, length: int = LENGTH, open_bins: int = OPEN_BINS, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: where it starts in its document and where it lies in which sequence.

    Null texts are empty and consist of end_id alone; an empty table gives no rows; null and repeated doc_ids stay,
    each row is packed by itself; other columns are left out. Sequence numbers differ between tasks by their high bits.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        high = (context.partitionId() if context else 0) << 40
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, bins = Encoder(path).encode, BestFit(length, open_bins)
        for batch in parts_of(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(encode(text.as_py()) + end)
                for piece, (start, size) in enumerate(cut(len(data) // 4, length)):
                    number, offset = bins.place(size)
                    rows.append((doc, piece, start, size, zlib.crc32(data[4 * start : 4 * (start + size)]), high | number, offset))
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                names = [x.split()[0] for x in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return texts(docs).mapInArrow(frugal(run), PIECES)
