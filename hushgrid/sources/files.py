"""Readers and writers of corpora, queries, caches, datasets and results. Schemas are given, never inferred, and all
paths go through Spark, so any store that it reads will do."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import non_empty
from ..operators.preparation import extended, optional_equal, seeded_sample
from .json_arrays import json_array
from .versions import current, publish, write_document

CORPUS = "instruction string, input string, output string"
QUERIES = "input string, answer_icliniq string"
MEDICAL = "patient_id bigint, patient_name string, patient_request string, doctor_response string, symptom array<string>, disease string, treatment string"
EXTENDED = "question string, answer string"
COUNTERS = "key string, n bigint"


def _in_order(rows: DataFrame, column: str) -> DataFrame:
    """place, and what is left of a column: stripped texts that aren't empty."""
    return rows.withColumn(column, non_empty(F.col(column))).filter(F.col(column).isNotNull())


def corpus(spark: SparkSession, path: str, limit: int | None = None, sample_seed: int | None = None) -> DataFrame:
    """doc_id (rank by first place), text of the distinct outputs; of these the first, or a seeded sample, if limited."""
    rows = _in_order(json_array(spark, path, CORPUS), "output").groupBy(F.col("output").alias("text")).agg(F.min("place").alias("doc_id"))
    if limit is None:
        return rows.select("doc_id", "text")
    if sample_seed is None:
        return rows.orderBy("doc_id").limit(limit).select("doc_id", "text")
    return seeded_sample(rows, "doc_id", limit, sample_seed).select("doc_id", "text", "draw")


def queries(spark: SparkSession, path: str, n: int = 200, seed: int = 42) -> DataFrame:
    """query_id, query, reference (empty if absent): a seeded sample of those with a query, in the order of draws."""
    rows = _in_order(json_array(spark, path, QUERIES), "input")
    drawn = seeded_sample(rows, "place", n, seed)
    return drawn.select(F.col("draw").alias("query_id"), F.col("input").alias("query"), F.coalesce("answer_icliniq", F.lit("")).alias("reference"))


def medical(spark: SparkSession, path: str, disease: str | None = None, responses_only: bool = False) -> DataFrame:
    """Medical rows, all or of one disease; responses_only: their doctor_response alone."""
    rows = optional_equal(spark.read.schema(MEDICAL).json(path), "disease", disease)
    return rows.select("doctor_response") if responses_only else rows


def questions_and_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXTENDED).json(path).select(extended(F.col("question"), F.col("answer")).alias("text"))


def cached(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The latest version of what was written to a path, or an empty table of the schema if nothing was."""
    latest = current(spark, path)
    return spark.read.schema(schema).json(latest) if latest else spark.createDataFrame([], schema)


def write_cache(rows: DataFrame, path: str) -> None:
    """Replaces what cached() finds at path; rows may come from there."""
    publish(rows, path)


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header; arrays, maps and structs as JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    rows.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in rows.schema]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_result(config: dict, summary: DataFrame, per_query: DataFrame, path: str) -> None:
    """One indented document, result.json, of the config and of a summary that has a row for each setting, and a table,
    per_query, of any size; each replaces the one before as a whole."""
    spark = summary.sparkSession
    publish(per_query, f"{path}/per_query")
    write_document(spark, json.loads(result_document(config, summary).first().document), f"{path}/result.json")


def result_document(config: dict, summary: DataFrame) -> DataFrame:
    """One row, document: a JSON text of the config and of a summary that has a row for each setting."""
    named = F.create_map(*[x for k, v in sorted(config.items()) for x in (F.lit(k), F.lit(str(v)))])
    rows = F.sort_array(F.collect_list(F.struct(*sorted(summary.columns))))
    return summary.agg(rows.alias("results")).select(F.to_json(F.struct(named.alias("config"), "results"), {"pretty": "true"}).alias("document"))


def write_checkpoint(counters: DataFrame, path: str, run: int) -> None:
    """Appends the counters of a run; the latest run of those at path counts."""
    counters.withColumn("run", F.lit(run)).write.mode("append").parquet(path)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """key, n of the latest run at path, or none."""
    try:
        rows = spark.read.schema(f"{COUNTERS}, run int").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], COUNTERS)
    latest = rows.agg(F.max("run").alias("run"))
    return rows.join(F.broadcast(latest), "run").select("key", "n")
