import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushgrid.functions import accounting, text, vectors
from hushgrid.operators import prefilter

CASES = [  # rag, norag, strategy, consistent, token, score
    ([5.0, 3.0, 1.0, 0.5], [5.0, 3.0, 1.0, 0.5], prefilter.same_argmax, True, 0, 1.0),
    ([1.0, 9.0, 8.0, 0.0], [2.0, 9.0, 0.5, 7.0], prefilter.same_argmax, True, 1, 1.0),
    ([9.0, 1.0, 0.0], [1.0, 9.0, 0.0], prefilter.same_argmax, False, 1, 0.0),
    ([5.0, 5.0, 1.0], [5.0, 4.9, 1.0], prefilter.same_argmax, True, 0, 1.0),
    ([9.0, 8.0, 1.0], [1.0, 9.0, 8.0], prefilter.similar_top_k(2, 1 / 3), True, 1, 1 / 3),
    ([9.0, 8.0, 1.0], [1.0, 9.0, 8.0], prefilter.similar_top_k(2, 0.5), False, 1, 1 / 3),
    ([9.0, 8.0, 1.0], [1.0, 9.0, 8.0], prefilter.similar_top_k(2, 0.9), False, 1, 1 / 3),
    ([9.0, 8.0, 0.0], [8.0, 9.0, 0.0], prefilter.same_argmax, False, 1, 0.0),
    ([9.0, 8.0, 0.0], [8.0, 9.0, 0.0], prefilter.similar_top_k(2, 1.0), True, 1, 1.0),
]
JACCARD = [([5, 4, 3, 2, 1], [5, 4, 3, 2, 1], 3, 1.0), ([9, 8, 0, 0], [0, 0, 9, 8], 2, 0.0), ([9, 8, 1], [1, 9, 8], 2, 1 / 3), ([3, 2, 1], [1, 2, 3], 99, 1.0)]


def column(values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_strategies(spark):
    for rag, norag, strategy, consistent, token, score in CASES:
        got = spark.range(1).select(strategy(column(rag), column(norag)).alias("d")).first()["d"]
        assert (got.consistent, got.token_id) == (consistent, token)
        assert got.score == pytest.approx(score)
    got = spark.range(1).select(*[prefilter.top_k_jaccard(column(a), column(b), k) for a, b, k, _ in JACCARD]).first()
    assert list(got) == pytest.approx([x[3] for x in JACCARD])


def test_temperature_does_not_change_decisions(spark):
    rag, norag = [9, 8, 3, 1], [8.5, 8, 0.5, 2]
    s = prefilter.similar_top_k(3, 0.5)
    got = spark.range(1).select(*[s(column([x / t for x in rag]), column([x / t for x in norag])) for t in (0.1, 0.3, 0.5, 0.7, 1)]).first()
    assert len(set(got)) == 1


def test_invalid_logits(spark):
    with pytest.raises(ValueError):
        prefilter.similar_top_k(0, 0.5)
    with pytest.raises(Exception, match="one length"):
        spark.range(1).select(prefilter.same_argmax(column([1, 2]), column([1, 2, 3]))).collect()


def test_min_overlap():
    assert prefilter.min_overlap(20, 0.9) == pytest.approx(18.947368)
    assert prefilter.min_overlap(20, 1.0) == 20


def test_vectors(spark):
    got = spark.range(1).select(vectors.l2_normalized(column([3, 4])), vectors.l2_normalized(column([0, 0])), vectors.dot(column([1, 2]), column([3, 4])), vectors.softmax(column([1, 2, 3]), 0.5)).first()
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0, 0] and got[2] == 11
    e = np.exp(np.array([1, 2, 3]) / 0.5)
    assert got[3] == pytest.approx((e / e.sum()).tolist())


def test_text(spark):
    spaces = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    samples = [spaces + "a b" + spaces, "", spaces, "x"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(samples)), "i int, t string").orderBy("i").select(text.stripped(F.col("t"))).collect()]
    assert got == [s.strip() for s in samples]
    rows = spark.createDataFrame([("the cat sat on the mat", "the cat lay on a mat"), ("", "a"), ("x", "y")], "a string, b string")
    got = rows.select(text.lcs_length(text.words(F.col("a")), text.words(F.col("b"))), text.rouge_l(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [4, 0, 0]
    assert [r[1] for r in got] == pytest.approx([2 * 4 / 12, 0, 0])
    listed = spark.createDataFrame([('see ["a b", "c"] ok',), ("none",), ("[broken",)], "t string").select(text.json_list(F.col("t"))).collect()
    assert [r[0] for r in listed] == [["a b", "c"], None, None]


def test_accounting():
    loss = accounting.pure(0.2)
    for total, want in ((5, 0.1277), (10, 0.2192), (20, 0.3644), (40, 0.5894)):
        own = accounting.token_epsilon(total, 1e-3, 128, loss, tolerance=1e-7)
        assert own == pytest.approx(want, abs=1e-4)
        assert accounting.pure(want, 128).compose(loss).epsilon(1e-3) == pytest.approx(total, rel=0.01)
        assert accounting.clip_bound(own, 1.0) == own / 2
    answer = accounting.pure(accounting.token_epsilon(5, 1e-3, 70), 70).compose(accounting.pure(0.5))
    assert answer.epsilon(1e-3) == pytest.approx(5.308, abs=0.02)
    assert accounting.IDENTITY.epsilon(1e-3) == 0
    one = accounting.pure(1.0, grid=0)
    assert one.delta(0.5) == pytest.approx((1 - math.exp(-0.5)) / (1 + math.exp(-1)))
