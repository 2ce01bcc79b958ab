"""Counts at several grains in one pass, and accuracy by frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where buckets of counts begin; the last is open, so counts of 500 and more are in it, too.
BUCKETS = ((0, "[0,10)"), (10, "[10,20)"), (20, "[20,50)"), (50, "[50,100)"), (100, ">=100"))


def grain_counts(observed: DataFrame, kind: str, item: str, epsilon: str, success: str) -> DataFrame:
    """kind, item, epsilon, grain, n, successes for the grains: all; kind; kind and item; both with the epsilon spent."""
    view = observed.select(F.col(kind).alias("kind"), F.col(item).alias("item"), F.col(epsilon).alias("epsilon"), F.col(success).cast("int").alias("success"))
    sets = [[], [F.col("kind")], [F.col("kind"), F.col("item")], [F.col("kind"), F.col("epsilon")], [F.col("kind"), F.col("item"), F.col("epsilon")]]
    grouped = view.groupingSets(sets, "kind", "item", "epsilon")
    return grouped.agg(F.grouping_id("kind", "item", "epsilon").alias("grain"), F.count("*").alias("n"), F.coalesce(F.sum("success"), F.lit(0)).alias("successes"))


def bucket(count: Column) -> Column:
    out = F.lit(None).cast("string")
    for begin, name in BUCKETS:
        out = F.when(count >= begin, name).otherwise(out)
    return out


def bucket_accuracy(per_item: DataFrame) -> DataFrame:
    """bucket, items, n, successes, accuracy from (n, successes) by item: successes of a bucket over its observations."""
    grouped = per_item.groupBy(bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("items"), F.sum("n").alias("n"), F.sum("successes").alias("successes"))
    return grouped.withColumn("accuracy", F.when(F.col("n") > 0, F.col("successes") / F.when(F.col("n") > 0, F.col("n")).otherwise(1)))


def key_text(*parts: Column) -> Column:
    """A counter's key: the JSON array of its parts; text parts are quoted."""
    return F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))


def parsed_keys(counters: DataFrame) -> DataFrame:
    """Counters (key, n) whose key is a JSON array, with the array as ``parts``; others, as null, go."""
    return counters.withColumn("parts", F.from_json("key", "array<string>")).filter("parts is not null")


def item_totals(counters: DataFrame, kind: str) -> DataFrame:
    """item, n of parsed counters with the key (kind, item), without the total."""
    p = F.col("parts")
    return counters.filter((F.size(p) == 2) & (F.get(p, F.lit(0)) == kind) & (F.get(p, F.lit(1)) != "*")).select(F.get(p, F.lit(1)).alias("item"), "n")


def remaining(rows: DataFrame, index: str, n_done: int) -> DataFrame:
    """The rows that an interrupted evaluation has not done yet."""
    return rows.filter(F.col(index) >= n_done)
