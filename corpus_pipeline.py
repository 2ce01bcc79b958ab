"""A training-corpus pipeline of five stages over documents, each written as Parquet before the next one reads it.

In all stages a null text counts as an empty one and stays null, no name of another column matters, and an empty table
gives an empty one; null and repeated doc_ids are rows like others but where a stage says more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hushgrid.llm import jaccard, packing, secrets, suffixes, toxicity
from hushgrid.llm.common import remove, shared_dir
from hushgrid.llm.queries import table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the limit; the model learns from a sample of the labelled documents of
    sf_dir that aren't held out. Empty texts stay, and so does each of repeated rows or none."""
    return toxicity.without_toxic(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least doc_id (null last). Empty texts are alike, so one
    of them stays; of repeated rows one stays."""
    return jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier; a document that is all copied stays, with an empty text."""
    return suffixes.without_repeats(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences of tokens; an empty text is its end alone."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: The first stage is a trained model and the last an online packing; SQL expresses neither.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again, and removed when the next
    one is written. The last one's stays for as long as the result is used."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
