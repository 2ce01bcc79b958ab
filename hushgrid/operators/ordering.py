"""Ranks and running sums over all rows of a key, in two levels, so that no task gets a key's rows all together."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; where all runs on one machine and the session names
    none, a temporary one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="hushgrid-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def running(rows: DataFrame, key: str, value: str, sums: dict[str, Column], low: Column | float, high: Column | float, buckets: int = BUCKETS) -> DataFrame:
    """rows (one for each key and value) with ``next`` (the next larger value of the key, or null), and for each of sums
    the running sum up to and with the row, and the key's total as ``total_<name>``.

    Values from low to high are cut into buckets of equal width. Windows run over the buckets' sums, at most buckets
    rows for each key, and inside each bucket. rows are computed once: what the sums are joined to is written first.
    """
    low, high = (F.lit(x) if not isinstance(x, Column) else x for x in (low, high))
    width = F.when(high > low, high - low).otherwise(1.0)
    placed = rows.withColumn("_b", F.floor((F.col(value) - low) / width * buckets).cast("long")).withColumns({f"_{n}": c for n, c in sums.items()})
    placed = settled(placed)
    per = placed.groupBy(key, "_b").agg(F.min(value).alias("_first"), *[F.sum(f"_{n}").alias(f"_sum_{n}") for n in sums])
    over = Window.partitionBy(key).orderBy("_b")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(key, "_b", F.lead("_first").over(over).alias("_after"), *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0.0)).alias(f"_before_{n}") for n in sums], *[F.sum(f"_sum_{n}").over(Window.partitionBy(key)).alias(f"total_{n}") for n in sums])
    inside = Window.partitionBy(key, "_b").orderBy(value)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(per, [key, "_b"]).withColumns({"next": F.coalesce(F.lead(value).over(inside), "_after")} | {n: F.col(f"_before_{n}") + F.sum(f"_{n}").over(upto) for n in sums})
    return out.drop("_b", "_after", *[f"_{n}" for n in sums], *[f"_before_{n}" for n in sums])
