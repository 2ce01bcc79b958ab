"""Pre-filters that tell, from the scores with and without documents, whether a token depends on the documents.

A strategy builds a column from two arrays of logits: struct<consistent boolean, token_id int, score double>. The token is
always the one without documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import argmax, doubles, set_jaccard, top_places

Strategy = Callable[[Column, Column], Column]
# The grids that are measured.
TOP_KS = (10, 20, 50)
TAUS = (0.5, 0.7, 0.9, 1.0)
TEMPERATURES = (0.1, 0.3, 0.5, 0.7)
EPSILONS = (5.0, 10.0, 20.0, 40.0)


def _checked(rag: Column, norag: Column, value: Column) -> Column:
    """value; an error at run time if the arrays are null or differ in length."""
    fine = rag.isNotNull() & norag.isNotNull() & (F.size(rag) == F.size(norag)) & (F.size(rag) > 0)
    return F.when(fine, value).otherwise(F.raise_error(F.lit("logits must be two arrays of one length")))


def _decision(consistent: Column, token: Column, score: Column) -> Column:
    return F.struct(consistent.alias("consistent"), token.alias("token_id"), score.alias("score"))


def same_argmax(rag: Column, norag: Column) -> Column:
    """Consistent if both have their greatest logit at the same token; the score is 1 or 0."""
    rag, norag = doubles(rag), doubles(norag)
    same = argmax(rag) == argmax(norag)
    return _checked(rag, norag, _decision(same, argmax(norag), F.when(same, 1.0).otherwise(0.0)))


def top_k_jaccard(rag: Column, norag: Column, k: int) -> Column:
    """Jaccard similarity of the sets of the k greatest logits' tokens; k beyond the vocabulary is all of it."""
    return set_jaccard(top_places(rag, k), top_places(norag, k))


def similar_top_k(k: int, tau: float) -> Strategy:
    """Consistent if the top-k Jaccard similarity is tau or more; the score is the similarity."""
    if k < 1:
        raise ValueError("k must be 1 or more")

    def strategy(rag: Column, norag: Column) -> Column:
        rag, norag = doubles(rag), doubles(norag)
        similarity = top_k_jaccard(rag, norag, k)
        return _checked(rag, norag, _decision(similarity >= tau, argmax(norag), similarity))

    strategy.__name__ = f"strategy_b_k{k}_tau{tau}"
    strategy.k, strategy.tau = k, tau
    return strategy


def decide(pairs: DataFrame, by_name: dict[str, Strategy], rag: str = "logit_rag", norag: str = "logit_norag") -> DataFrame:
    """pairs without its logits, and ``decisions``, an array of struct<strategy, decision> in the order of by_name. Both
    arrays are sorted once, whatever number of top-k strategies there is: these read slices of the largest k."""
    keys = [c for c in pairs.columns if c not in (rag, norag)]
    ks = sorted({s.k for s in by_name.values() if hasattr(s, "k")})
    a, b = doubles(rag), doubles(norag)
    whole = pairs.select(*keys, _checked(a, b, a).alias("_a"), b.alias("_b"))
    if ks:
        whole = whole.select("*", top_places(F.col("_a"), ks[-1]).alias("_ta"), top_places(F.col("_b"), ks[-1]).alias("_tb"))
    whole = whole.select("*", argmax(F.col("_b")).alias("_token"), *[set_jaccard(F.slice("_ta", 1, k), F.slice("_tb", 1, k)).alias(f"_j{k}") for k in ks])

    def one(s: Strategy) -> Column:
        if hasattr(s, "k"):
            return _decision(F.col(f"_j{s.k}") >= s.tau, F.col("_token"), F.col(f"_j{s.k}"))
        return s(F.col("_a"), F.col("_b"))

    built = [F.struct(F.lit(name).alias("strategy"), one(s).alias("decision")) for name, s in by_name.items()]
    return whole.select(*keys, F.array(*built).alias("decisions"))


def strategies() -> dict[str, Strategy]:
    """By name: the argmax strategy and the whole grid of the other."""
    grid = [similar_top_k(k, tau) for k in TOP_KS for tau in TAUS]
    return {"strategy_a": same_argmax} | {s.__name__: s for s in grid}


def min_overlap(k: Column | float, tau: Column | float) -> Column | float:
    """How many of k tokens two top-k sets must share for a similarity of tau."""
    return 2 * k * tau / (1 + tau)
