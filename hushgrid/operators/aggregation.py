"""Aggregation of next-token scores over documents, clipped so that no document moves it by more than a bound.

Logits are rows (query_id, step, stream_id, logits); stream 0 is the public prompt, the others have a document each. A
stream is brought into range inside its own row, by array expressions; only then its components become rows and are
summed, map-side first. The same formulas over a NumPy block serve the generation loop.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.accounting import clip_bound
from ..functions.vectors import argmax, doubles, let

KEYS = ("query_id", "step")


@dataclass(frozen=True)
class AggregationConfig:
    """alpha shapes the scores before they are centred, omega weighs the public stream."""

    token_epsilon: float
    temperature: float = 1.0
    alpha: float = 1.0
    omega: float = 0.01
    differential_privacy: bool = True

    @property
    def bound(self) -> float:
        return clip_bound(self.token_epsilon, self.temperature)


def centred(logits: Column, alpha: float) -> Column:
    """(exp(alpha * (x - max)) - 1) / alpha of each component (for alpha 0 its limit, x - max), less the middle of its range."""

    def shaped(v: Column) -> Column:
        one = (lambda z: (F.exp(F.lit(alpha) * z) - 1) / alpha) if alpha else (lambda z: z)
        return let(F.array_max(v), lambda top: F.transform(v, lambda a: one(a - top)))

    def moved(x: Column) -> Column:
        return let((F.array_max(x) + F.array_min(x)) / 2, lambda middle: F.transform(x, lambda a: a - middle))

    return let(let(doubles(logits), shaped), moved)


def largest(v: Column) -> Column:
    return F.array_max(F.transform(v, lambda a: F.abs(a)))


def clip_scale(norm: Column, bound: float) -> Column:
    """What a stream is multiplied with; 1 for one that is zero everywhere."""
    return F.when(norm == 0, 1.0).otherwise(F.least(F.lit(bound) / F.when(norm == 0, 1.0).otherwise(norm), F.lit(1.0)))


def with_parts(streams: DataFrame, c: AggregationConfig) -> DataFrame:
    """streams with ``norm`` and ``scale`` (null for the public stream) and ``part``, what each adds to the sum."""
    private = F.col("stream_id") != 0
    public_part = F.transform(doubles("logits"), lambda a: F.lit(c.omega) * a)
    if not c.differential_privacy:
        shifted = let(doubles("logits"), lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda a: a - top)))
        return streams.withColumn("part", F.when(private, shifted).otherwise(public_part))

    def clipped(x: Column) -> Column:
        def scaled(norm: Column) -> Column:
            return let(clip_scale(norm, c.bound), lambda scale: F.struct(norm.alias("norm"), scale.alias("scale"), F.transform(x, lambda a: a * scale).alias("part")))

        return let(largest(x), scaled)

    nothing = F.struct(F.lit(None).cast("double").alias("norm"), F.lit(None).cast("double").alias("scale"), public_part.alias("part"))
    made = F.when(private, let(centred(F.col("logits"), c.alpha), clipped)).otherwise(nothing)
    # an array of one struct is taken apart as rows are, so that its fields are computed together, once
    return streams.select("*", F.inline(F.array(made)))


def aggregated(streams: DataFrame, c: AggregationConfig) -> DataFrame:
    """query_id, step, token, logit: omega times the public stream plus the private parts; without private streams
    only the former."""
    tokens = with_parts(streams, c).select(*KEYS, F.posexplode("part").alias("token", "_x"))
    return tokens.groupBy(*KEYS, "token").agg(F.sum("_x").alias("logit"))


def diagnostics(streams: DataFrame, c: AggregationConfig) -> DataFrame:
    """For each query and step: the range of norms before and after clipping, and the sum of the scales."""
    kept = with_parts(streams, c).filter("stream_id != 0")
    clipped = F.col("norm") * F.col("scale")
    return kept.groupBy(*KEYS).agg(F.count("*").alias("streams"), F.min("norm").alias("norm_min"), F.max("norm").alias("norm_max"), F.min(clipped).alias("clipped_min"), F.max(clipped).alias("clipped_max"), F.sum("scale").alias("scale_sum"))


def greedy_tokens(logits: DataFrame) -> DataFrame:
    """query_id, step, token with the greatest logit; the lowest token on ties."""
    best = F.max(F.struct(F.col("logit"), (-F.col("token")).alias("t"))).alias("best")
    return logits.groupBy(*KEYS).agg(best).select(*KEYS, (-F.col("best.t")).alias("token"))


def before_and_after(streams: DataFrame, c: AggregationConfig) -> DataFrame:
    """query_id, step, before, after: the greatest token of the public stream alone and of the aggregate; the lowest on ties."""
    public = streams.filter("stream_id = 0").select(*KEYS, argmax(doubles("logits")).alias("before"))
    return public.join(greedy_tokens(aggregated(streams, c)).withColumnRenamed("token", "after"), list(KEYS))


def token_probabilities(logits: DataFrame, temperature: float) -> DataFrame:
    """query_id, step, token, probability: what drawn_tokens() draws from, exp(logit / temperature) over its sum. Groups are
    as large as the vocabulary; the greatest logit is taken off first, so that nothing overflows."""
    group = Window.partitionBy(*KEYS)
    weighted = logits.withColumn("_w", F.exp((F.col("logit") - F.max("logit").over(group)) / temperature))
    return weighted.select(*KEYS, "token", (F.col("_w") / F.sum("_w").over(group)).alias("probability"))


def drawn_tokens(logits: DataFrame, temperature: float, seed: int, u: Column | None = None) -> DataFrame:
    """query_id, step, token drawn by softmax at a temperature, by the Gumbel-max trick; seed, or numbers u between 0 and 1
    for each row, fix all draws."""
    if u is None:
        u = (F.pmod(F.xxhash64(F.lit(seed), *KEYS, "token"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = logits.withColumn("_g", F.col("logit") / temperature - F.log(-F.log(u)))
    return keyed.groupBy(*KEYS).agg(F.max_by("token", "_g").alias("token"))


def aggregate_block(block: np.ndarray, c: AggregationConfig) -> np.ndarray:
    """The aggregate of a block whose row 0 is the public stream."""
    block = np.asarray(block, np.float64)
    private = block[1:] - block[1:].max(axis=1, keepdims=True) if len(block) > 1 else block[1:]
    if c.differential_privacy and len(private):
        x = (np.exp(c.alpha * private) - 1) / c.alpha if c.alpha else private
        x = x - (x.max(axis=1, keepdims=True) + x.min(axis=1, keepdims=True)) / 2
        norm = np.abs(x).max(axis=1, keepdims=True)
        private = x * np.where(norm == 0, 1.0, np.minimum(c.bound / np.where(norm == 0, 1.0, norm), 1.0))
    return c.omega * block[0] + private.sum(axis=0)
