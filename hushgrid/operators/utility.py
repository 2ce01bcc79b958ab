"""Utilities of next tokens over vocabularies of any size, and the exponential mechanism that draws from them.

Scores are rows (query_id, step, stream_id, first, logits): a slice of a stream's vocabulary that begins at token
``first``; stream 0 is the public prompt. What is known of a whole stream (its greatest and least score and the sum of its
exponentials) is put together in two levels, inside slices and over a stream's slices, so no row holds a vocabulary.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import doubles, let
from .aggregation import KEYS, clip_scale


@dataclass(frozen=True)
class UtilityConfig:
    """theta weighs the public stream's log-probabilities, clip bounds what a document adds to a token's utility."""

    clip: float
    epsilon: float
    theta: float = 1.0

    def __post_init__(self):
        if not self.clip > 0:
            raise ValueError("clip must be above 0")


def sliced(streams: DataFrame, width: int) -> DataFrame:
    """Streams (query_id, step, stream_id, logits) as rows of at most width tokens; an empty one has none."""
    v = F.col("logits")
    begins = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1, F.lit(width)))
    return streams.withColumn("first", F.explode(begins)).select(*KEYS, "stream_id", F.col("first").cast("long").alias("first"), F.slice(v, F.col("first") + 1, width).alias("logits"))


def with_ends(slices: DataFrame) -> DataFrame:
    """slices with ``top``, ``low`` and ``log_sum`` of their whole stream: the greatest and the least score, and the log of the
    sum of exponentials. Streams with a null or non-finite score take no part, as a whole."""
    whole = Window.partitionBy(*KEYS, "stream_id")  # as many rows as slices of one vocabulary
    bad = F.coalesce(F.exists("logits", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)), F.lit(True))
    own = let(
        F.struct(F.col("logits").alias("v"), F.array_max("logits").alias("top")),
        lambda s: F.struct(s["top"].alias("top"), F.array_min(s["v"]).alias("low"), F.aggregate(s["v"], F.lit(0.0), lambda t, x: t + F.exp(x - s["top"])).alias("sum")),
    )
    met = slices.withColumn("logits", doubles("logits")).withColumn("_bad", bad).withColumn("_own", F.when(~F.col("_bad"), own))
    met = met.withColumns({"top": F.max("_own.top").over(whole), "low": F.min("_own.low").over(whole), "_out": F.max("_bad").over(whole)}).filter("not _out")
    met = met.withColumn("_copies", F.count("*").over(Window.partitionBy(*KEYS, "stream_id", "first")))  # a repeated slice is in the sum once
    total = F.sum(F.col("_own.sum") * F.exp(F.col("_own.top") - F.col("top")) / F.col("_copies")).over(whole)
    return met.withColumn("log_sum", F.col("top") + F.log(total)).drop("_bad", "_own", "_out", "_copies")


def shaped(z: Column, alpha: float) -> Column:
    """(exp(alpha * z) - 1) / alpha of z, a score less its stream's greatest; z itself at 0, and for an infinite alpha 0 at the
    greatest and -1 elsewhere."""
    if alpha == math.inf:
        return F.when(z == 0, 0.0).otherwise(-1.0)
    return (F.exp(F.lit(float(alpha)) * z) - 1) / alpha if alpha else z


def _part(alpha: float, c: UtilityConfig) -> Column:
    """What a slice adds to its tokens' utilities. The shape rises with the score, so that the middle of its range, and the norm
    after it is taken off, follow from the stream's ends."""
    least = shaped(F.col("low") - F.col("top"), alpha)
    ends = F.struct(F.col("logits").alias("v"), F.col("top").alias("top"), (least / 2).alias("middle"), clip_scale(-least / 2, c.clip).alias("scale"))
    private = let(ends, lambda s: F.transform(s["v"], lambda x: (shaped(x - s["top"], alpha) - s["middle"]) * s["scale"]))
    public = let(F.struct(F.col("logits").alias("v"), F.col("log_sum").alias("log_sum")), lambda s: F.transform(s["v"], lambda x: F.lit(c.theta) * (x - s["log_sum"])))
    return F.when(F.col("stream_id") == 0, public).otherwise(private)


def utilities(slices: DataFrame, c: UtilityConfig, alphas: Sequence[float] = (1.0,)) -> DataFrame:
    """query_id, step, alpha, token, utility: theta times the public log-probability plus the clipped, centred shape of each
    document's scores, for all alphas in one pass. An alpha is 0 or more, infinity included.

    A token that only some streams have gets what these add. Repeated rows count as often as they occur; no rows give none.
    """
    if not alphas or any(math.isnan(a) or a < 0 for a in alphas):
        raise ValueError("alphas must be 0 or more")
    each = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), _part(a, c).alias("part")) for a in alphas])
    one = with_ends(slices).select(*KEYS, "first", F.explode(each).alias("e")).select(*KEYS, "first", "e.alpha", F.posexplode("e.part").alias("_i", "_x"))
    return one.groupBy(*KEYS, "alpha", (F.col("first") + F.col("_i")).alias("token")).agg(F.sum("_x").alias("utility"))


def _weight(c: UtilityConfig) -> Column:
    return F.col("utility") * F.lit(c.epsilon / (2 * c.clip))


def probabilities(found: DataFrame, c: UtilityConfig) -> DataFrame:
    """found with ``probability``: exp(epsilon * utility / (2 * clip)) over its sum. Groups are as large as the vocabulary, and
    the greatest is taken off first."""
    group = Window.partitionBy(*KEYS, "alpha")
    weighted = found.withColumn("_w", F.exp(_weight(c) - F.max(_weight(c)).over(group)))
    return weighted.withColumn("probability", F.col("_w") / F.sum("_w").over(group)).drop("_w")


def drawn(found: DataFrame, c: UtilityConfig, seed: int, u: Column | None = None) -> DataFrame:
    """query_id, step, alpha, token drawn by the exponential mechanism at epsilon, by the Gumbel-max trick, without a sum over
    the vocabulary; seed, or numbers u between 0 and 1 for each row, fix all draws."""
    if u is None:
        u = (F.pmod(F.xxhash64(F.lit(seed), *KEYS, "alpha", "token"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = found.withColumn("_g", F.struct((_weight(c) - F.log(-F.log(u))).alias("g"), (-F.col("token")).alias("t")))
    return keyed.groupBy(*KEYS, "alpha").agg(F.max("_g").alias("_b")).select(*KEYS, "alpha", (-F.col("_b.t")).alias("token"))
