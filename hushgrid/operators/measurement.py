"""Rates, means and sweeps over decisions and generated tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import let
from .prefilter import Strategy, decide
from .selection import medians


def decisions(pairs: DataFrame, by_name: dict[str, Strategy]) -> DataFrame:
    """pairs (query_id, step, logit_rag, logit_norag) with a row for each strategy: its name and decision. The outer explode
    infers no filter on the decisions, which would be computed again below the joins."""
    if not by_name:
        raise ValueError("no strategy is named")
    decided = decide(pairs, by_name)
    keys = [c for c in decided.columns if c != "decisions"]
    return decided.select(*keys, F.explode_outer("decisions").alias("d")).select(*keys, "d.strategy", "d.decision.*")


def trigger_rates(decided: DataFrame, *by: str) -> DataFrame:
    """Share of consistent decisions and mean score for each of by and strategy."""
    return decided.groupBy(*by, "strategy").agg(F.coalesce(F.avg(F.col("consistent").cast("double")), F.lit(0.0)).alias("trigger_rate"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"), F.count("*").alias("n_steps"))


def without_last(tokens: Column, end: int | str) -> Column:
    """tokens without a last one that is the end."""
    ended = F.element_at(tokens, -1) == F.lit(end)
    return F.when((F.size(tokens) > 0) & ended, F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)


def aligned(a: Column, b: Column) -> Column:
    """struct<a, b, n>: both arrays up to the shorter one's end, and its length, so that they tell of the same places."""
    n = F.least(F.size(a), F.size(b))
    return F.struct(F.slice(a, 1, n).alias("a"), F.slice(b, 1, n).alias("b"), n.alias("n"))


def consistency(a: Column, b: Column) -> Column:
    """Share of places, up to the shorter one's end, at which two arrays agree; 0 if there are none."""

    def rate(s: Column) -> Column:
        n = F.least(F.size(s["a"]), F.size(s["b"]))
        same = F.aggregate(F.zip_with(F.slice(s["a"], 1, n), F.slice(s["b"], 1, n), lambda x, y: F.when(x.eqNullSafe(y), 1).otherwise(0)), F.lit(0), lambda t, x: t + x)
        return F.when(n > 0, same / F.when(n > 0, n).otherwise(1)).otherwise(0.0)

    return let(F.struct(a.alias("a"), b.alias("b")), rate)


def mean_and_median(values: DataFrame, *columns: str) -> DataFrame:
    """One row: the number of rows, and mean and exact median of each column; null if it has no values."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in columns]))
    told = medians(values.select(each.alias("v")).select("v.key", "v.value"))
    rows = values.agg(F.count("*").alias("n_queries")).withColumn("key", F.explode(F.array(*[F.lit(c) for c in columns]))).join(told, "key", "left")
    return rows.groupBy("n_queries").agg(*[F.max(F.when(F.col("key") == c, F.col(name))).alias(f"{name}_{c}") for c in columns for name in ("mean", "median")])


def sweep_summary(runs: DataFrame) -> DataFrame:
    """runs (temperature, query_id, strategy, n_documents, trigger, rouge_l): for each temperature and strategy the
    mean trigger over queries with documents, mean ROUGE-L over all, and how many have none."""
    some = F.col("n_documents") > 0
    return runs.groupBy("temperature", "strategy").agg(F.count("*").alias("n_queries"), F.sum(F.when(some, 0).otherwise(1)).alias("n_zero_doc"), F.coalesce(F.avg(F.when(some, F.col("trigger"))), F.lit(0.0)).alias("mean_trigger"), F.avg("rouge_l").alias("mean_rouge_l"))
