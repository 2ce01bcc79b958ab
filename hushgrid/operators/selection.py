"""Exact order statistics by counting: no sort and no map of all values, however they are distributed.

Values from the least to the greatest are cut into ranges and counted, map-side first; the range that holds the wanted rank is
cut again, until few rows are in it, or one value. Only these are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import settled

RANGES = 1024
FEW = 100_000  # rows that are put in order in one task


def nth(rows: DataFrame, wanted: DataFrame, few: int = FEW) -> DataFrame:
    """key, name, value: for each row of wanted (key, name, rank) the value of this 0-based rank among the rows (key, value)
    of its key, in rising order; nulls are no values, and a rank beyond them gives no row."""
    rows = rows.filter("value is not null").select("key", F.col("value").cast("double").alias("value"))
    ends = rows.groupBy("key").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
    at = settled(wanted.select("key", "name", "rank").join(ends, "key").filter("rank >= 0 and rank < n"))
    keys = ["key", "name", "rank", "low", "high"]

    def inside() -> DataFrame:
        return rows.join(at.select(*keys), "key").filter("value between low and high")

    while (at.filter("high > low").agg(F.max("n")).first()[0] or 0) > few:
        part = F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * RANGES), F.lit(RANGES - 1))
        part = F.when(F.col("high") > F.col("low"), part).otherwise(0)
        counted = inside().groupBy(*keys, part.alias("part")).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
        over = Window.partitionBy("key", "name").orderBy("part")  # at most RANGES rows
        counted = counted.withColumn("before", F.sum("n").over(over) - F.col("n")).filter("before <= rank and rank < before + n")
        at = settled(counted.select("key", "name", (F.col("rank") - F.col("before")).alias("rank"), F.col("least").alias("low"), F.col("most").alias("high"), "n"))
    counted = inside().groupBy("key", "name", "rank", "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("key", "name").orderBy("value"))
    return counted.withColumn("upto", upto).filter("upto > rank").groupBy("key", "name").agg(F.min("value").alias("value"))


def medians(rows: DataFrame, few: int = FEW) -> DataFrame:
    """key, mean, median of rows (key, value); of an even number of values the mean of the two in the middle."""
    rows = rows.select("key", F.col("value").cast("double").alias("value")).filter("value is not null")
    told = rows.groupBy("key").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    ranks = F.array(F.struct(F.lit("lower").alias("name"), F.floor((F.col("n") - 1) / 2).alias("rank")), F.struct(F.lit("upper").alias("name"), F.floor(F.col("n") / 2).alias("rank")))
    wanted = told.select("key", F.explode(ranks).alias("r")).select("key", "r.name", "r.rank")
    middle = nth(rows, wanted, few).groupBy("key").agg(F.avg("value").alias("median"))
    return told.join(middle, "key").select("key", "mean", "median")
