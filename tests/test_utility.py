import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushgrid.operators import utility

ROWS = "query_id long, step int, stream_id long, logits array<double>"
C = utility.UtilityConfig(clip=0.3, epsilon=0.9, theta=0.7)


def by_hand(public, private, alpha, c):
    out = np.zeros(len((public + private)[0]))
    for v in public:
        out += c.theta * (np.array(v) - max(v) - math.log(sum(math.exp(x - max(v)) for x in v)))
    for v in private:
        z = np.array(v) - max(v)
        if alpha == math.inf:
            z = np.where(z == 0, 0.0, -1.0)
        elif alpha:
            z = (np.exp(alpha * z) - 1) / alpha
        z = z - (z.max() + z.min()) / 2
        norm = np.abs(z).max()
        out += z * (min(1.0, c.clip / norm) if norm else 1.0)
    return out


@pytest.mark.parametrize("width", [1, 3, 50])
def test_utilities(spark, width):
    draws = np.random.default_rng(2)
    streams = [(q, 0, s, draws.normal(scale=5, size=11).tolist()) for q in range(3) for s in range(4)] + [(7, 1, 5, [2.0] * 11)]
    streams += [streams[0], streams[1]]  # repeated rows
    slices = utility.sliced(spark.createDataFrame(streams, ROWS), width)
    alphas = (0.0, 0.5, 1.0, math.inf)
    got = {(r.query_id, r.alpha, r.token): r for r in utility.probabilities(utility.utilities(slices, C, alphas), C).collect()}
    for q in (0, 1, 2, 7):
        public = [v for k, _, s, v in streams if k == q and s == 0]
        private = [v for k, _, s, v in streams if k == q and s]
        for alpha in alphas:
            want = by_hand(public, private, alpha, C)
            weights = np.exp(C.epsilon * want / (2 * C.clip))
            assert [got[q, alpha, t].utility for t in range(11)] == pytest.approx(want.tolist())
            assert [got[q, alpha, t].probability for t in range(11)] == pytest.approx((weights / weights.sum()).tolist())


def test_large_alpha_comes_near_the_limit_and_small_ones_near_zero(spark):
    slices = utility.sliced(spark.createDataFrame([(1, 0, 1, [0.0, -1.0, -2.0]), (1, 0, 2, [-3.0, 1.0, 0.5])], ROWS), 2)
    got = {(r.alpha, r.token): r.utility for r in utility.utilities(slices, C, (0.0, 1e-7)).collect()}
    assert all(got[0.0, t] == pytest.approx(got[1e-7, t], abs=1e-5) for t in range(3))
    limit = {r.token: r.utility for r in utility.utilities(slices, utility.UtilityConfig(9.0, 1.0), (math.inf,)).collect()}
    assert limit == {0: 0.0, 1: 0.0, 2: -1.0}


def test_scores_of_any_size_and_odd_streams(spark):
    rows = [(1, 0, 0, [1e6, 0.0]), (1, 0, 1, [-1e6, 1e6]), (1, 0, 2, [float("nan"), 0.0]), (1, 0, 3, [None, 0.0]), (1, 0, 4, [-math.inf, 0.0]), (1, 0, 5, []), (1, 0, 6, None)]
    found = utility.utilities(utility.sliced(spark.createDataFrame(rows, ROWS), 1), C)
    got = {r.token: r.utility for r in found.collect()}
    assert got == pytest.approx({0: -0.3, 1: -7e5 + 0.3})
    assert [r.probability for r in utility.probabilities(found, C).orderBy("token").collect()] == [1.0, 0.0]
    assert utility.utilities(utility.sliced(spark.createDataFrame([], ROWS), 4), C).count() == 0
    for bad in ((), (-1.0,), (math.nan,)):
        with pytest.raises(ValueError):
            utility.utilities(utility.sliced(spark.createDataFrame(rows, ROWS), 1), C, bad)
    with pytest.raises(ValueError):
        utility.UtilityConfig(clip=0.0, epsilon=1.0)


def test_draws_follow_the_probabilities(spark):
    streams = spark.range(4000).select(F.col("id").alias("query_id"), F.lit(0).alias("step"), F.lit(1).cast("long").alias("stream_id"), F.array(*[F.lit(x) for x in (0.0, -0.5, -3.0)]).alias("logits"))
    found = utility.utilities(utility.sliced(streams, 2), C)
    share = {r.token: r.n / 4000 for r in utility.drawn(found, C, 5).groupBy("token").agg(F.count("*").alias("n")).collect()}
    want = {r.token: r.probability for r in utility.probabilities(found.filter("query_id = 0"), C).collect()}
    assert all(abs(share[t] - want[t]) < 0.04 for t in want)
    assert sorted(utility.drawn(found, C, 5).collect()) == sorted(utility.drawn(found, C, 5).collect())


def test_one_shuffle_for_streams_and_one_for_tokens(spark):
    slices = spark.createDataFrame([(1, 0, 0, 0, [1.0])], "query_id long, step int, stream_id long, first long, logits array<double>")
    plan = utility.utilities(slices, C, (0.0, 1.0, math.inf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
