"""Counters at several grains that a stream keeps, so that an evaluation which stops goes on without counting twice.

The totals are Spark's own streaming state, kept with the number of the batch under the checkpoint. Each batch hands out the
totals that it changed; they go to the batch's own folder, which a batch that is done again replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ("kind", "item", "epsilon", "grain")
ROW = "kind string, item string, epsilon string, grain long, n long, successes long"


def _grains() -> Column:
    """An array of the five grains of a row; grain has a bit for each column that is counted over (4, 2 and 1)."""
    kind, item, epsilon = (F.col(c).cast("string") for c in ("kind", "item", "epsilon"))
    none = F.lit(None).cast("string")
    sets = ((none, none, none, 7), (kind, none, none, 3), (kind, item, none, 1), (kind, none, epsilon, 2), (kind, item, epsilon, 0))
    return F.array(*[F.struct(k.alias("kind"), i.alias("item"), e.alias("epsilon"), F.lit(g).cast("long").alias("grain")) for k, i, e, g in sets])


def keep_counts(stream: DataFrame, kind: str, item: str, epsilon: str, success: str, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Counts the rows of a stream at the grains all; kind; kind and item; both with the epsilon spent, and keeps the totals in
    a folder, for counts(). Keys are texts there. folder and checkpoint belong together and are on a disk that all machines
    share: started again with both, it goes on after the last batch that was finished. A null key is a key of its own; a null
    success counts as an observation without one. A stream without rows gives no counts."""
    empty = stream.sparkSession.createDataFrame([], ROW)
    empty.write.mode("overwrite").parquet(f"{folder}/batch=-1")
    named = stream.select(F.col(kind).alias("kind"), F.col(item).alias("item"), F.col(epsilon).alias("epsilon"), F.col(success).cast("int").alias("success"))
    at = named.withColumn("g", F.explode(_grains())).select("g.*", "success")
    totals = at.groupBy(*KEYS).agg(F.count("*").alias("n"), F.coalesce(F.sum("success"), F.lit(0)).alias("successes"))

    def put(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = totals.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """kind, item, epsilon, grain, n, successes as of the last batch in a folder: each key's latest totals."""
    rows = spark.read.schema(f"{ROW}, batch long").parquet(folder)
    latest = F.max(F.struct("batch", "n", "successes")).alias("t")
    return rows.groupBy(*KEYS).agg(latest).select(*KEYS, "t.n", "t.successes")
