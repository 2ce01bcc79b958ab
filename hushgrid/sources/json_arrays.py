"""Elements of a file that is one JSON array of objects, read by many tasks.

Spark's text reader splits a file by bytes and cuts it at closing braces; which of these end an element shows only from the
start. So each split is read twice: first to tell, for a start outside and inside a string, in which state and how
much deeper it ends; then, with the states composed from split to split, to cut it into elements. An element that goes
over a border is put together from its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\\.|["{}\[\]]', re.S)
STATES = "file string, start long, outside_ends boolean, outside_depth long, inside_ends boolean, inside_depth long"
STARTS = "file string, start long, inside boolean, depth long"
PARTS = "file string, start long, nth long, part string, text string"


def scanned(piece: str, inside: bool, depth: int) -> tuple[bool, int, int]:
    """State and depth behind a piece, without the brace that ends it, and where in it depth went from 1 to 2 (-1: nowhere)."""
    opened = -1
    for token in _TOKEN.finditer(piece):
        sign = token.group()
        if sign == '"':
            inside = not inside
        elif not inside and sign in "{[":
            depth += 1
            if depth == 2:
                opened = token.start()
        elif not inside and sign in "}]":
            depth -= 1
    return inside, depth, opened


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple, list] = {}
    for file, start, piece in _rows(batches):
        both = known.setdefault((file, start), [False, 0, True, 0])
        for k in (0, 2):
            inside, depth, _ = scanned(piece, both[k], both[k + 1])
            both[k], both[k + 1] = inside, depth if inside else depth - 1
    rows = [(file, start, *both) for (file, start), both in known.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], [x.split()[0] for x in STATES.split(", ")])


def _composed(splits: pa.Table) -> pa.Table:
    inside, depth, rows = False, 0, []
    for r in splits.sort_by("start").to_pylist():
        rows.append((r["file"], r["start"], inside, depth))
        how = "inside" if inside else "outside"
        inside, depth = r[f"{how}_ends"], depth + r[f"{how}_depth"]
    return pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in STARTS.split(", ")])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole elements, and what a split has of those that begin before it (head) or end behind it (tail)."""
    states: dict[tuple, list] = {}  # inside, depth, number of elements begun, parts of the open one, whether it began here
    rows: list[tuple] = []

    def told() -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in PARTS.split(", ")])

    for file, start, piece, inside, depth in _rows(batches):
        own = states.setdefault((file, start), [inside, depth, 0, [], False])
        open_before = own[1] > 1
        own[0], own[1], opened = scanned(piece, own[0], own[1])
        if opened >= 0:
            own[2], own[4], piece = own[2] + 1, True, piece[opened:]
        if open_before or opened >= 0:
            own[3].append(piece + "}")
        if not own[0]:
            own[1] -= 1
            if own[1] == 1 and own[3]:
                rows.append((file, start, own[2], "whole" if own[4] else "head", "".join(own[3])))
                own[3], own[4] = [], False
        if len(rows) >= 1000:
            yield told()
            rows.clear()
    for (file, start), (_, _, nth, parts, here) in states.items():
        if parts:
            rows.append((file, start, nth, "tail" if here else "head", "".join(parts)))
    if rows:
        yield told()


def elements(spark: SparkSession, path: str) -> DataFrame:
    """place, element: the objects of the array in a file, as texts; places rise with their order. An empty array, or file,
    has none."""
    pieces = spark.read.option("lineSep", "}").text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("piece"))
    starts = pieces.mapInArrow(_states, STATES).groupBy("file").applyInArrow(_composed, STARTS)
    # a row for each split; the join keeps the order of pieces
    placed = pieces.join(F.broadcast(starts), ["file", "start"]).select("file", "start", "piece", "inside", "depth")
    parts = placed.mapInArrow(_parts, PARTS)
    place = F.col("start") + F.col("nth")  # a split has fewer elements than bytes
    whole = parts.filter("part = 'whole'").select(place.alias("place"), F.col("text").alias("element"))
    return whole.unionByName(_joined(parts.filter("part <> 'whole'")))


def _joined(parts: DataFrame) -> DataFrame:
    """Elements over borders: a tail and the heads that follow it, two rows for a split at most."""
    rows = F.array_sort(F.collect_list(F.struct("start", (F.col("part") == "tail").alias("tail"), "nth", "text")))
    per_file = parts.groupBy("file").agg(rows.alias("rows"))

    def run(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files:
            places, texts = [], []
            for own in batch.column(1).to_pylist():
                for r in own:
                    if r["tail"]:
                        places.append(r["start"] + r["nth"])
                        texts.append(r["text"])
                    elif texts:
                        texts[-1] += r["text"]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(texts, pa.string())], ["place", "element"])

    return per_file.mapInArrow(run, "place long, element string")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of the schema, and place, for each object of the array in a file; what isn't there, or of another kind, is
    null."""
    return elements(spark, path).select("place", F.from_json("element", schema).alias("e")).select("place", "e.*")
