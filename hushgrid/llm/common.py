"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none it is a temporary one, if all runs on this machine
    (tests), and an error on a cluster, whose machines don't share one."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="hushgrid-checkpoint-")
    context.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that only Spark may be able to reach."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation of its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession, least: int = 1) -> int:
    """The session's number of shuffle partitions, which the cluster's owner sizes to the input."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


OWN = ("doc_id", "text", "n_chars")


def plain(docs: DataFrame) -> DataFrame:
    """docs whose columns other than doc_id, text and n_chars are named by their place: names that need quotes, or differ
    from one of these by case alone, can't be mistaken."""
    return docs.toDF(*[name if name in OWN else f"_c{i}" for i, name in enumerate(docs.columns)])


def any_names(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that keeps the columns of docs, its first argument, run on plain names."""

    @wraps(stage)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        return stage(plain(docs), *args, **kwargs).toDF(*docs.columns)

    return run


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text with null as empty, and nothing else that could clash."""
    return plain(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def crc_remainder(column: Column | str, modulus: int) -> Column:
    """crc32 of a column as text, modulo modulus; null counts as the empty text."""
    value = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")) % modulus


def dealt_join(rows: DataFrame, table: DataFrame, on: list[str], by: Column, how: str = "inner") -> DataFrame:
    """rows joined with table, which has one row for each value of the columns on, where many rows may have the same.

    Rows are dealt by these columns and a number that follows from by; a row of table is repeated for those numbers that
    ask for it, so the rows of a frequent value go to as many tasks as there are partitions. rows are read twice.
    """
    salted = rows.withColumn("_salt", F.pmod(by, F.lit(partitions(rows.sparkSession))).cast("int"))
    told = salted.select("_salt", *on).distinct().join(table, on)
    return salted.join(told, ["_salt", *on], how).drop("_salt")


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with what a worker has allocated given back when a task ends: workers wait for further tasks,
    whatever their stage, and would keep it."""

    @wraps(run)
    def careful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        released()

    return careful


def released() -> None:
    """Gives memory that isn't used any more back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that no more texts are held at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def block_numbers(n: int) -> list[int]:
    """Integers that Spark's hash (32-bit Murmur3 of an int) takes to 0, 1, .. n - 1, by its steps in reverse."""
    word, half = np.uint32, lambda c: np.uint32(pow(c, -1, 1 << 32))
    turned = lambda x, k: (x << word(k)) | (x >> word(32 - k))
    h = np.arange(n, dtype=word)
    h = (h ^ (h >> word(16))) * half(0xC2B2AE35)
    h = (h ^ (h >> word(13)) ^ (h >> word(26))) * half(0x85EBCA6B)
    h = h ^ (h >> word(16)) ^ word(4)
    h = turned((h - word(0xE6546B64)) * half(5), 19) ^ word(42)
    return (turned(h * half(0x1B873593), 17) * half(0xCC9E2D51)).view(np.int32).tolist()


def block_of(key: Column, n: int) -> Column:
    """One of n numbers, by a hash key; repartition(n, number) then deals one block to each task, none and two to no one."""
    numbers = F.split(F.lit(",".join(map(str, block_numbers(n)))), ",").cast("array<int>")
    return F.get(numbers, F.pmod(key, F.lit(n)).cast("int"))
