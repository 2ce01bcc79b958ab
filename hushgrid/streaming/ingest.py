"""Incremental growth of a store: not needed for a query, but a store that documents stream into."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(stream: DataFrame, store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends each batch's (doc_id, text) rows whose text isn't at store yet, one row a text. A batch that is done again
    after a failure replaces its own folder, so it adds nothing twice."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.filter("text is not null").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text")
        if number:
            known = spark.read.option("basePath", store).schema("doc_id long, text string, batch long").parquet(store).filter(F.col("batch") < number)
            first = first.join(known.select("text"), "text", "left_anti").select("doc_id", "text")
        first.write.mode("overwrite").parquet(f"{store}/batch={number}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by key in windows of event time, for batches and streams; rows later than the watermark are dropped by streams."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
