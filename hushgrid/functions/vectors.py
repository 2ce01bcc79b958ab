"""Column builders for dense vectors held as arrays of doubles; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once. What a lambda uses from outside is computed anew for each element, and
    the optimizer moves columns that are used once into it; a lambda's own variable is a value."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(vector: Column | str) -> Column:
    return (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed from left to right."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalized(v: Column) -> Column:
    """v over its norm; a zero vector stays zero."""
    one = F.struct(doubles(v).alias("v"), l2_norm(v).alias("n"))
    return let(one, lambda s: F.transform(s["v"], lambda x: x / F.when(s["n"] == 0, 1.0).otherwise(s["n"])))


def argmax(v: Column) -> Column:
    """0-based place of the greatest component; ties go to the lowest place."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def top_places(v: Column, k: int) -> Column:
    """0-based places of the k greatest components (all, if fewer), the greatest first; ties go to the lowest place."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    placed = F.transform(doubles(v), lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(placed), 1, k), lambda s: s["i"])


def set_jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union; 0 for two empty sets."""
    sizes = F.struct(F.size(F.array_intersect(a, b)).alias("both"), F.size(F.array_union(a, b)).alias("all"))
    return let(sizes, lambda s: F.when(s["all"] == 0, 0.0).otherwise(s["both"] / F.when(s["all"] == 0, 1).otherwise(s["all"])))


def softmax(v: Column, temperature: float = 1.0) -> Column:
    weights = let(F.struct(v.alias("v"), F.array_max(v).alias("top")), lambda s: F.transform(s["v"], lambda x: F.exp((x - s["top"]) / temperature)))
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
    return let(weights, lambda w: let(total(w), lambda t: F.transform(w, lambda x: x / t)))
