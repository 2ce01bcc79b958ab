"""A model of words that is trained here and continues prompts: followers of words, and a cache of the prompt's own words.

Counts cover all texts; the vocabulary is the size - 1 most frequent words (ties: the lesser word) and the end. What a
worker gets is a matrix of size by size numbers, which bounds the broadcast (4 bytes each, 4 MB by default). Tasks count
words and pairs of their own texts before anything is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SPACES
from ..sources import versions

END = "<end>"
BREAKS = re.compile(f"[{re.escape(SPACES)}]+")
LARGEST = 1 << 13  # 256 MB of followers
HELD = 1 << 18  # different words that a task counts before it sends them; four times as many places of words


@dataclass(frozen=True)
class WordModel:
    """Scores are ln((1 - cache) * P(w | last) + cache * C(w)). P adds weight times the share of w in all words to the followers
    of the answer's last word (the end, before its first), C is the share in the prompt, with one word spread evenly."""

    vocabulary: list[str]
    counts: np.ndarray  # of words; of texts, for the end
    followers: np.ndarray  # [last, next]
    cache: float = 0.3
    weight: float = 2.0
    end: int = 0

    def next_logits(self, prompts: list[str], answer: list[int]) -> np.ndarray:
        size = len(self.vocabulary)
        share = (self.counts + 1) / (self.counts.sum() + size)
        last = self.followers[answer[-1] if answer else self.end].astype(np.float64)
        follows = (last + self.weight * share) / (last.sum() + self.weight)
        place = {w: i for i, w in enumerate(self.vocabulary)}
        own = np.zeros((len(prompts), size))
        for row, prompt in zip(own, prompts, strict=True):
            for word in BREAKS.split(prompt.lower()):
                at = place.get(word, self.end)
                if at != self.end:
                    row[at] += 1
        cached = (own + 1 / size) / (own.sum(axis=1, keepdims=True) + 1)
        return np.log((1 - self.cache) * follows + self.cache * cached)

    def save(self, spark: SparkSession, folder: str) -> int:
        """The model as the latest version of a table (id, word, n, cache, weight, followers), for load()."""
        rows = [(i, w, int(self.counts[i]), self.cache, self.weight, self.followers[i].tolist()) for i, w in enumerate(self.vocabulary)]
        return versions.publish(spark.createDataFrame(rows, ROW), folder)


ROW = "id int, word string, n long, cache double, weight double, followers array<int>"


def load(spark: SparkSession, folder: str) -> WordModel:
    """The latest version in a folder."""
    place = versions.current(spark, folder)
    if place is None:
        raise FileNotFoundError(folder)
    rows = spark.read.schema(ROW).json(place).orderBy("id").collect()  # a row for each word of a bounded vocabulary
    return WordModel([r.word for r in rows], np.array([r.n for r in rows], np.float64), np.array([r.followers for r in rows], np.int32), rows[0].cache, rows[0].weight)


def _lowered(texts: DataFrame, text: str) -> DataFrame:
    return texts.select(F.lower(F.col(text)).alias("t")).filter("t is not null")


def _words(batch: pa.RecordBatch) -> Iterator[list[str]]:
    """The words of each text; str.split() knows the same white space as SPACES. Words that look like the end are left out."""
    for t in batch.column(0):
        said = t.as_py()
        own = said.split()
        yield [w for w in own if w != END] if END in said else own


def vocabulary(texts: DataFrame, text: str, size: int) -> DataFrame:
    """id, word, n: the size - 1 most frequent words, from 1 on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["word", "n"])

        n: Counter[str] = Counter()
        for batch in batches:
            for own in _words(batch):
                n.update(own)
                if len(n) >= HELD:
                    yield sent()
                    n.clear()
        yield sent()

    counted = _lowered(texts, text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    first = counted.orderBy(F.desc("n"), "word").limit(size - 1)
    return first.select(F.row_number().over(Window.orderBy(F.desc("n"), "word")).alias("id"), "word", "n")


def followers(texts: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """last, next, n: how often known words follow each other, by id. The end (0) stands before a text's first word and after
    its last; other words interrupt, so that nothing follows them. known has fewer rows than a vocabulary's size; each task gets them."""
    told = texts.sparkSession.sparkContext.broadcast({r.word: r.id for r in known.select("id", "word").collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = told.value
        size = len(ids) + 1
        places: list[int] = []

        def sent() -> pa.RecordBatch:
            at = np.array([-1, *places], np.int64)
            met = (at[:-1] >= 0) & (at[1:] >= 0)
            pairs, n = np.unique(at[:-1][met] * size + at[1:][met], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((pairs // size, pa.int32()), (pairs % size, pa.int32()), (n, pa.int64()))], ["last", "next", "n"])

        for batch in batches:
            for own in _words(batch):
                places.append(0)
                places.extend([ids.get(w, -1) for w in own])
                places += (0, -1)
                if len(places) >= 4 * HELD:
                    yield sent()
                    places.clear()
        yield sent()

    return _lowered(texts, text).mapInArrow(run, "last int, next int, n long").groupBy("last", "next").agg(F.sum("n").alias("n"))


def train(texts: DataFrame, text: str = "text", size: int = 1024, cache: float = 0.3, weight: float = 2.0) -> WordModel:
    """A model of all texts; null texts are none. Without any words, every token is the end."""
    if not 1 <= size <= LARGEST:
        raise ValueError(f"size must be from 1 to {LARGEST}")
    known = vocabulary(texts, text, size).cache()
    try:
        met = known.orderBy("id").collect()  # fewer than size rows
        rows = followers(texts, text, known).toPandas()  # at most size * size rows of three numbers
    finally:
        known.unpersist()
    matrix = np.zeros((len(met) + 1, len(met) + 1), np.int32)
    matrix[rows["last"].to_numpy(int), rows["next"].to_numpy(int)] = np.minimum(rows["n"].to_numpy(np.int64), np.iinfo(np.int32).max)
    n_texts = float(matrix[0].sum())
    return WordModel([END, *(r.word for r in met)], np.array([n_texts, *(r.n for r in met)], np.float64), matrix, cache, weight)
