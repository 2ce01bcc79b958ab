"""Corpus and dataset preparation: cleaning, distinct texts in order, seeded samples, star rows, synthetic draws."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import non_empty
from ..functions.vectors import let
from .ordering import settled


def distinct_texts(rows: DataFrame, order: str, text: str) -> DataFrame:
    """order, text: stripped texts that aren't empty, each once, with the least place at which it stands."""
    clean = rows.select(F.col(order).alias("place"), non_empty(F.col(text)).alias("text")).filter("text is not null")
    return clean.groupBy("text").agg(F.min("place").alias("place")).select("place", "text")


def first_n(rows: DataFrame, order: str, n: int) -> DataFrame:
    return rows.orderBy(order).limit(n)


def sorted_first(rows: DataFrame, order: str, n: int, by: str) -> DataFrame:
    """place, by: the first n rows by order, cut before they are sorted by another column; place counts from 0. No more than
    n rows are sorted in one task."""
    first = first_n(rows.select(order, by), order, n)
    return first.select((F.row_number().over(Window.orderBy(by, order)) - 1).alias("place"), by)


def dense(rows: DataFrame, order: str, name: str = "ordinal") -> DataFrame:
    """rows with their 0-based place by order (distinct values), counted in two levels: by range, and inside each."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is None:
        return rows.withColumn(name, F.lit(0).cast("long"))
    width = max(1, -(-(high - low + 1) // (4 * parts)))
    placed = rows.withColumn("_b", F.floor((F.col(order) - low) / width).cast("long"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over at most 4 * parts rows
    per = placed.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1
    return placed.join(F.broadcast(per), "_b").withColumn(name, F.col("_before") + inside).drop("_b", "_before")


def seeded_sample(rows: DataFrame, order: str, n: int, seed: int) -> DataFrame:
    """n rows (all, if fewer) at the places that Python's generator samples from range(count), with ``draw``, the order
    in which it draws them. Places alone, n at most, are on the driver."""
    total = rows.count()
    places = random.Random(seed).sample(range(total), min(n, total))
    drawn = rows.sparkSession.createDataFrame(list(zip(places, range(len(places)), strict=True)), "ordinal long, draw long")
    return dense(rows, order).join(F.broadcast(drawn), "ordinal")


def missing(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def star_rows(patients: DataFrame, diseases: DataFrame, checked: bool = False) -> DataFrame:
    """patients (.., disease) with the columns of their disease; checked: an error if a disease is unknown."""
    joined = patients.join(diseases.withColumn("_known", F.lit(True)), "disease", "left" if checked else "inner")
    if checked:
        fine = F.coalesce("_known", F.lit(False)) | F.raise_error(F.lit("a patient's disease is unknown")).cast("boolean")
        joined = joined.filter(fine)
    return joined.drop("_known")


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number strictly between 0 and 1 that seed and keys fix, wherever and however often it is computed."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def dirichlet(items: DataFrame, key: str, seed: int, u: Column | None = None) -> DataFrame:
    """items with ``probability``, a draw of all of them from the flat Dirichlet: exponential draws over their sum; seed and
    key, or numbers u between 0 and 1 for each row, fix it."""
    drawn = items.withColumn("_e", -F.log(uniform(seed, key) if u is None else u))
    total = drawn.agg(F.sum("_e").alias("_total"))
    return drawn.join(F.broadcast(total)).withColumn("probability", F.col("_e") / F.col("_total")).drop("_e", "_total")


def cumulated(weights: DataFrame) -> DataFrame:
    """item, start, stop: where each item's share of all probability begins and ends, in the order of items, from 0 to 1.

    Sums run inside the parts of a sort by range, and over the parts."""
    parts = int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = weights.select("item", F.col("probability").cast("double").alias("probability")).repartitionByRange(parts, "item")
    placed = settled(ranged.withColumn("_part", F.spark_partition_id()))
    per = placed.groupBy("_part").agg(F.sum("probability").alias("_sum"))
    over = Window.orderBy("_part")  # a row for each part
    per = per.select("_part", F.coalesce(F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"), F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    inside = Window.partitionBy("_part").orderBy("item")
    upto = placed.join(per, "_part").withColumn("_upto", F.col("_before") + F.sum("probability").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    start = F.coalesce(F.lag("_upto").over(inside), F.col("_before")) / F.col("_total")
    return upto.select("item", start.alias("start"), (F.col("_upto") / F.col("_total")).alias("stop"))


def categorical(rows: DataFrame, weights: DataFrame, u: Column) -> DataFrame:
    """rows with ``item``: the first of weights (item, probability) whose cumulated share is above u, in the order of items.

    The numbers from 0 to 1 are cut into as many cells as there are items, and each item stands in the cells that its share
    touches, two on average; a row meets those in its own cell. So a row's work doesn't grow with the items, and
    no table has to fit into a task. Items of probability 0 are never drawn; without any weight item is null.
    """
    cells = max(1, weights.count())
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
    shares = cumulated(weights.filter("probability > 0")).select("item", "start", "stop", F.explode(F.sequence(cell(F.col("start")), cell(F.col("stop")))).alias("_cell"))
    placed = rows.withColumn("_u", u).withColumn("_cell", cell(F.col("_u")))
    met = (placed["_cell"] == shares["_cell"]) & (placed["_u"] >= shares["start"]) & (placed["_u"] < shares["stop"])
    return placed.join(shares, met, "left").select(*[placed[f"`{c}`"] for c in rows.columns], shares["item"])


def question(symptoms: Column) -> Column:
    return F.concat(F.lit("I am experiencing the following symptoms: "), F.array_join(symptoms, ", "), F.lit(". What is my disease?"))


def extended(question_: Column, answer: Column) -> Column:
    return F.concat(F.lit("Question: "), question_, F.lit("\nAnswer: "), answer)


def optional_equal(rows: DataFrame, column: str, value: str | None) -> DataFrame:
    """rows whose column has the value; all of them for None or an empty value."""
    return rows.filter(F.col(column) == value) if value else rows


NAMES = "Ada Ben Cleo Dan Eva Finn Gia Hugo Ida Jon".split()
COLORS = "black brown blond red grey white".split()


def hair_colors(spark: SparkSession, n: int, seed: int, specific: int = 0, draw: Callable[[int], Column] | None = None) -> DataFrame:
    """doc_id, text: synthetic documents on people's hair; the first ones on one and the same person. draw gives numbers
    between 0 and 1 for the names (1) and colours (2) of rows (id); else seed fixes them."""
    draw = draw or (lambda k: uniform(seed + k, "id"))
    pick = lambda words, k: F.get(F.array(*[F.lit(x) for x in words]), F.floor(draw(k) * len(words)).cast("int"))
    name = F.when(F.col("id") < specific, F.lit("Alice")).otherwise(pick(NAMES, 1))
    color = F.when(F.col("id") < specific, F.lit("blue")).otherwise(pick(COLORS, 2))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(name, F.lit(" has "), color, F.lit(" hair.")).alias("text"))
