"""Scoring a corpus against queries, and selecting documents above a threshold that may be drawn privately.

A query's score vector is a column keyed by (query_id, doc_id). Thresholds come from sorted clipped scores with a
sentinel at either end; equal scores are merged with their number before they are ordered, as intervals of no width
have no probability.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from .ordering import running, settled


@dataclass(frozen=True)
class RetrievalConfig:
    """top_p wins if both are set; with differential_privacy the threshold is drawn by the exponential mechanism."""

    top_k: int | None = None
    top_p: float | None = None
    epsilon: float = 0.1
    min_score: float = -0.5
    max_score: float = 0.8
    top_p_alpha: float = 5.0
    differential_privacy: bool = True
    max_retrieve: int | None = None
    mode: str = "sentinels"  # or "paper": counts documents only, without the sentinels' shift by two

    def __post_init__(self):
        if self.top_k is None and self.top_p is None:
            raise ValueError("top_k or top_p must be set")
        if self.min_score >= self.max_score:
            raise ValueError("min_score must be below max_score")
        if self.mode not in ("sentinels", "paper"):
            raise ValueError("mode must be sentinels or paper")


def lacking(store: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new whose text the store lacks; of equal new texts that with the least doc_id."""
    first = new.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text")
    return first.join(store.select("text"), "text", "left_anti").select("doc_id", "text")


def append(store: DataFrame, new: DataFrame) -> DataFrame:
    """store and the rows of new that it lacks."""
    return store.select("doc_id", "text").unionByName(lacking(store, new))


def score(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, doc_id, score for all pairs; queries (query_id, query_vector) are few, corpus is (doc_id, embedding).

    Spark broadcasts queries only if they are as small as its limit; else the pairs are made by blocks on both sides.
    """
    return corpus.crossJoin(queries).select("query_id", "doc_id", dot(F.col("query_vector"), F.col("embedding")).alias("score"))


def _merged(scores: DataFrame, low: Column | float, high: Column | float, sentinels: bool = True) -> DataFrame:
    """query_id, s, n: clipped scores with their numbers and a sentinel -1 and +1 of each query, clipped, too."""
    clip = lambda c: F.least(F.greatest(c, F.lit(low) if isinstance(low, float) else low), F.lit(high) if isinstance(high, float) else high)
    counted = scores.groupBy("query_id", clip(F.col("score")).alias("s")).agg(F.count("*").cast("double").alias("n"))
    if not sentinels:
        return counted
    ends = scores.select("query_id").distinct().select("query_id", F.explode(F.array(*[clip(F.lit(x)) for x in (-1.0, 1.0)])).alias("s")).withColumn("n", F.lit(1.0))
    return counted.unionByName(ends).groupBy("query_id", "s").agg(F.sum("n").alias("n"))


def _normalized(intervals: DataFrame, utility: Column, epsilon: float) -> DataFrame:
    """query_id, s, next, pdf of intervals with a width; in logarithms less their maximum, so nothing underflows."""
    kept = intervals.filter(F.col("next") > F.col("s")).withColumn("_lw", F.lit(epsilon / 2) * utility + F.log(F.col("next") - F.col("s")))
    kept = settled(kept)
    top = kept.groupBy("query_id").agg(F.max("_lw").alias("_top"))
    weighed = kept.join(top, "query_id").withColumn("_w", F.exp(F.col("_lw") - F.col("_top")))
    total = weighed.groupBy("query_id").agg(F.sum("_w").alias("_total"))
    return weighed.join(total, "query_id").select("query_id", "s", "next", (F.col("_w") / F.col("_total")).alias("pdf"))


def top_k_pdf(scores: DataFrame, c: RetrievalConfig) -> DataFrame:
    """Probability of each interval of scores under the exponential mechanism whose utility is highest where the number
    of documents above is top_k (two fewer in the mode "sentinels", which counts these, too)."""
    return top_k_pdf_of(_merged(scores, c.min_score, c.max_score), c)


def top_k_pdf_of(merged: DataFrame, c: RetrievalConfig) -> DataFrame:
    """The same from (query_id, s, n): different scores with their numbers."""
    ranked = running(merged, "query_id", "s", {"upto": F.col("n")}, c.min_score, c.max_score)
    shift = 0 if c.mode == "sentinels" else 2
    # the last of equal scores starts the interval: its 0-based place is upto - 1
    utility = -F.abs(F.col("total_upto") - shift - c.top_k - (F.col("upto") - 1) + F.lit(shift / 2))
    return _normalized(ranked, utility, c.epsilon)


def top_p_weight(s: Column, c: RetrievalConfig) -> Column:
    return F.exp(F.lit(c.top_p_alpha) * (s - c.max_score) / (c.max_score - c.min_score))


def top_p_pdf(scores: DataFrame, c: RetrievalConfig) -> DataFrame:
    """The same for a utility that is highest where the documents above hold top_p of all weight."""
    return top_p_pdf_of(_merged(scores, c.min_score, c.max_score).withColumn("mass", F.col("n") * top_p_weight(F.col("s"), c)), c)


def top_p_pdf_of(merged: DataFrame, c: RetrievalConfig) -> DataFrame:
    """The same from (query_id, s, n, mass): different scores with their numbers and weights."""
    ranked = running(merged.withColumnRenamed("mass", "own_mass"), "query_id", "s", {"mass": F.col("own_mass")}, c.min_score, c.max_score)
    return _normalized(ranked, -F.abs(F.col("total_mass") * (1 - c.top_p) - F.col("mass")), c.epsilon)


def draw(pdf: DataFrame, points: DataFrame) -> DataFrame:
    """query_id, u, threshold: the left end of the first interval whose cumulated probability is above u, for each row of
    points (u), which are few. The distribution function is summed in two levels, like all running sums here."""
    ends = pdf.groupBy("query_id").agg(F.min("s").alias("_low"), F.max("s").alias("_high"))
    cdf = running(pdf.join(ends, "query_id").drop("next"), "query_id", "s", {"cdf": F.col("pdf")}, F.col("_low"), F.col("_high"))
    return cdf.join(F.broadcast(points), cdf["cdf"] / cdf["total_cdf"] > points["u"]).groupBy("query_id", "u").agg(F.min("s").alias("threshold"))


def draw_one(pdf: DataFrame, u: Column) -> DataFrame:
    """query_id, threshold: the same at one u for each query, which follows from query_id."""
    ends = pdf.groupBy("query_id").agg(F.min("s").alias("_low"), F.max("s").alias("_high"))
    cdf = running(pdf.join(ends, "query_id").drop("next"), "query_id", "s", {"cdf": F.col("pdf")}, F.col("_low"), F.col("_high"))
    return cdf.filter(F.col("cdf") / F.col("total_cdf") > u).groupBy("query_id").agg(F.min("s").alias("threshold"))


def draw_gumbel(pdf: DataFrame, seed: int) -> DataFrame:
    """query_id, threshold: the same distribution by the Gumbel-max trick; a draw is fixed by seed, query and interval."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "query_id", "s"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = pdf.withColumn("_g", F.log("pdf") - F.log(-F.log(u)))
    return keyed.groupBy("query_id").agg(F.max_by("s", "_g").alias("threshold"))


def top_k_threshold(scores: DataFrame, k: int) -> DataFrame:
    """query_id, threshold: the (k + 1)th greatest score without privacy; null if there are no more than k."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"))
    few = scores.select("query_id", "score", F.row_number().over(order).alias("place")).filter(F.col("place") <= k + 1)
    return few.groupBy("query_id").agg(F.max(F.when(F.col("place") == k + 1, F.col("score"))).alias("threshold"))


def top_p_threshold(scores: DataFrame, p: float, alpha: float = 5.0) -> DataFrame:
    """query_id, threshold: the first score at which the documents above come closest to p of all weight; weights and the
    doubled ends follow the observed range. If all scores are equal they are the threshold."""
    ends = scores.groupBy("query_id").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    counted = scores.groupBy("query_id", F.col("score").alias("s")).agg(F.count("*").cast("double").alias("n")).join(ends, "query_id")
    n = F.col("n") + F.when(F.col("s") == F.col("low"), 1).otherwise(0) + F.when(F.col("s") == F.col("high"), 1).otherwise(0)
    span = F.col("high") - F.col("low")
    single = F.when(span > 0, F.exp(F.lit(alpha) * (F.col("s") - F.col("high")) / F.when(span > 0, span).otherwise(1.0))).otherwise(1.0)
    return top_p_threshold_of(counted.select("query_id", "low", "high", "s", n.alias("n"), (n * single).alias("mass"), F.lit(True).alias("real")), p)


def top_p_threshold_of(merged: DataFrame, p: float) -> DataFrame:
    """The same from (query_id, low, high, s, n, mass, real): different scores with their numbers and weights, both ends
    doubled; a row that isn't real counts, but isn't a threshold."""
    ranked = running(merged.withColumnRenamed("mass", "own_mass"), "query_id", "s", {"mass": F.col("own_mass")}, F.col("low"), F.col("high"))
    # of equal scores each has its own running sum; the best of them counts, and the first of the best
    one = F.col("own_mass") / F.col("n")
    target = F.col("total_mass") * (1 - p)
    past = F.col("mass") - F.col("own_mass")
    nearest = F.least(F.greatest(F.round((target - past) / one), F.lit(1.0)), F.col("n"))
    utility = -F.abs(target - (past + nearest * one))
    best = F.max(F.struct(F.col("_u"), (-F.col("s")).alias("s"))).alias("best")
    return ranked.filter("real").withColumn("_u", utility).groupBy("query_id").agg(best).select("query_id", (-F.col("best.s")).alias("threshold"))


def above(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The rows of scores strictly above their query's threshold; a null threshold keeps all."""
    return scores.join(thresholds, "query_id").filter(F.col("threshold").isNull() | (F.col("score") > F.col("threshold"))).drop("threshold")


def ranked(selected: DataFrame) -> DataFrame:
    """selected with ``rank``, from 1: the best score first, then the least doc_id."""
    return selected.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def capped(selected: DataFrame, most: int, seed: int, by: Column | None = None) -> DataFrame:
    """At most so many rows of each query, with their place from 1; chosen evenly and in an order that seed fixes, or in
    the order of by."""
    by = F.xxhash64(F.lit(seed), "query_id", "doc_id") if by is None else by
    order = Window.partitionBy("query_id").orderBy(by, "doc_id")
    return selected.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def thresholds(scores: DataFrame, c: RetrievalConfig, seed: int = 0) -> DataFrame:
    if c.differential_privacy:
        return draw_gumbel(top_p_pdf(scores, c) if c.top_p is not None else top_k_pdf(scores, c), seed)
    return top_p_threshold(scores, c.top_p, c.top_p_alpha) if c.top_p is not None else top_k_threshold(scores, c.top_k)


def utility_curve(scores: DataFrame, grid: Column, k: int | None = None, p: float | None = None, low: float = 0.2, high: float = 0.9, alpha: float = 1.0) -> DataFrame:
    """query_id, tau, utility: how far the number (or, by p, the weight) above each tau of grid, an array, is from the aim.

    Scores and taus are put in one order and summed in two levels, so that the work is their number, not their product."""
    s = F.least(F.greatest(F.col("score"), F.lit(low)), F.lit(high))
    w = F.exp(F.lit(alpha) * (s - high) / (high - low))
    rows = scores.groupBy("query_id", F.col("score").alias("s")).agg(F.count("*").cast("double").alias("_n"), F.sum(w).alias("_w")).withColumn("_tau", F.lit(False))
    taus = scores.select("query_id").distinct().select("query_id", F.explode(F.array_distinct(grid)).alias("s"), F.lit(0.0).alias("_n"), F.lit(0.0).alias("_w"), F.lit(True).alias("_tau"))
    met = rows.unionByName(taus).groupBy("query_id", "s").agg(F.sum("_n").alias("_n"), F.sum("_w").alias("_w"), F.max("_tau").alias("_tau"))
    ends = met.groupBy("query_id").agg(F.min("s").alias("_low"), F.max("s").alias("_high"))
    summed = running(met.join(ends, "query_id"), "query_id", "s", {"n": F.col("_n"), "w": F.col("_w")}, F.col("_low"), F.col("_high")).filter("_tau")
    value = -F.abs(F.col("total_n") - F.col("n") - k) if k is not None else -F.abs(F.col("total_w") - F.col("w") - p * F.col("total_w"))
    return summed.select("query_id", F.col("s").alias("tau"), value.alias("utility"))
