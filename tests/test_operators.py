import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushgrid.functions import text
from hushgrid.operators import aggregation, evaluation, measurement, preparation, products, retrieval
from hushgrid.operators.retrieval import RetrievalConfig


def score_rows(spark, values):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "query_id long, doc_id long, score double")


def intervals(values, low, high):
    return np.clip(np.concatenate([[-1], np.sort(values), [1]]), low, high)


VALUES = np.round(np.random.default_rng(4).normal(0.1, 0.3, 60), 2)


def test_top_k_pdf(spark):
    c = RetrievalConfig(top_k=7)
    s = intervals(VALUES, c.min_score, c.max_score)
    w = np.exp(c.epsilon * -np.abs(len(s) - 7 - np.arange(len(s) - 1)) / 2) * np.diff(s)
    want = {round(a, 9): p for a, p in zip(s, w / w.sum()) if p > 0}
    got = {round(r.s, 9): r.pdf for r in retrieval.top_k_pdf(score_rows(spark, VALUES), c).collect()}
    assert got == pytest.approx(want)


def test_top_p_pdf_and_draw(spark):
    c = RetrievalConfig(top_p=0.3, epsilon=2.0)
    s = intervals(VALUES, c.min_score, c.max_score)
    p = np.exp(5 * (s - c.max_score) / (c.max_score - c.min_score))
    w = np.exp(c.epsilon * -np.abs(p.sum() * 0.7 - np.cumsum(p)[:-1]) / 2) * np.diff(s)
    pdf = w / w.sum()
    frame = retrieval.top_p_pdf(score_rows(spark, VALUES), c)
    assert {round(r.s, 9): r.pdf for r in frame.collect()} == pytest.approx({round(a, 9): x for a, x in zip(s, pdf) if x > 0})
    points = [0.01, 0.3, 0.5, 0.77, 0.99]
    got = {r.u: r.threshold for r in retrieval.draw(frame, spark.createDataFrame([(u,) for u in points], "u double")).collect()}
    cdf = np.cumsum(pdf)
    assert got == pytest.approx({u: s[np.searchsorted(cdf, u, side="right")] for u in points})


def test_gumbel_draws_follow_the_pdf(spark):
    c = RetrievalConfig(top_k=2, epsilon=4.0)
    many = spark.range(4000).select((F.col("id")).alias("query_id"), F.explode(F.arrays_zip(F.array(*[F.lit(i) for i in range(4)]).alias("doc_id"), F.array(*[F.lit(x) for x in (0.0, 0.2, 0.4, 0.6)]).alias("score"))).alias("x")).select("query_id", "x.*")
    pdf = retrieval.top_k_pdf(many, c)
    want = {round(r.s, 6): r.p for r in pdf.groupBy("s").agg(F.avg("pdf").alias("p")).collect()}
    got = {round(r.threshold, 6): r["n"] / 4000 for r in retrieval.draw_gumbel(pdf, 1).groupBy("threshold").agg(F.count("*").alias("n")).collect()}
    assert all(abs(got.get(k, 0) - p) < 0.03 for k, p in want.items())


def test_thresholds_without_privacy(spark):
    frame = score_rows(spark, VALUES)
    assert retrieval.top_k_threshold(frame, 7).first().threshold == np.sort(VALUES)[-8]
    assert retrieval.top_k_threshold(frame, 60).first().threshold is None
    s = np.concatenate([[VALUES.min()], np.sort(VALUES), [VALUES.max()]])
    w = np.exp(5 * (s - s.max()) / (s.max() - s.min()))
    want = s[np.argmax(-np.abs(w.sum() * 0.8 - np.cumsum(w)))]
    assert retrieval.top_p_threshold(frame, 0.2).first().threshold == pytest.approx(want)
    assert retrieval.top_p_threshold(score_rows(spark, [0.5, 0.5]), 0.2).first().threshold == 0.5


def test_retrieve_and_cap(spark):
    corpus = spark.createDataFrame([(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(50)], "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vector array<double>")
    c = RetrievalConfig(top_k=20, differential_privacy=False, max_retrieve=5)
    got = products.retrieve(asked, corpus, c, seed=1).collect()
    best = set(sorted(range(50), key=lambda i: -np.cos(i))[:20])
    assert len(got) == 5 and {r.doc_id for r in got} <= best
    assert {r.doc_id for r in got} == {r.doc_id for r in products.retrieve(asked, corpus, c, seed=1).collect()}
    with pytest.raises(ValueError):
        RetrievalConfig()


@pytest.mark.parametrize("private", [True, False])
def test_aggregation(spark, private):
    rng = np.random.default_rng(2)
    block = rng.normal(size=(5, 12)) * 4
    block[3] = 1.5  # a stream that is the same everywhere
    c = aggregation.AggregationConfig(token_epsilon=0.5, temperature=0.8, alpha=0.7, differential_privacy=private)
    frame = spark.createDataFrame([(1, 0, i, row.tolist()) for i, row in enumerate(block)], "query_id int, step int, stream_id int, logits array<double>")
    got = [r.logit for r in aggregation.aggregated(frame, c).orderBy("token").collect()]
    assert got == pytest.approx(aggregation.aggregate_block(block, c).tolist())
    only = aggregation.aggregated(frame.filter("stream_id = 0"), c).orderBy("token").collect()
    assert [r.logit for r in only] == pytest.approx((c.omega * block[0]).tolist())
    assert aggregation.greedy_tokens(aggregation.aggregated(frame, c)).first().token == int(np.argmax(got))
    if private:
        parts = aggregation.with_parts(frame, c).filter("stream_id > 0").collect()
        assert all(max(map(abs, r.part)) <= c.bound + 1e-12 for r in parts)


def test_evaluation(spark):
    rows = [("symptoms", f"d{i % 3}", "5.3", i % 2 == 0) for i in range(30)]
    got = evaluation.grain_counts(spark.createDataFrame(rows, "k string, d string, e string, s boolean"), "k", "d", "e", "s").collect()
    by = {(r.kind, r["item"], r.epsilon): (r.n, r.successes) for r in got}
    assert by[(None, None, None)] == (30, 15) and by[("symptoms", "d0", None)] == (10, 5) and len(by) == 1 + 1 + 3 + 1 + 3
    per = spark.createDataFrame([(5, 1), (9, 2), (10, 3), (600, 300), (100, 50)], "n long, successes long")
    acc = {r.bucket: (r["items"], r.accuracy) for r in evaluation.bucket_accuracy(per).collect()}
    assert acc == {"[0,10)": (2, 3 / 14), "[10,20)": (1, 0.3), ">=100": (2, 0.5)}
    counters = spark.createDataFrame([("null", 9), (json.dumps(["symptoms", "*"]), 8), (json.dumps(["symptoms", "flu"]), 3)], "key string, n long")
    assert [tuple(r) for r in evaluation.item_totals(evaluation.parsed_keys(counters), "symptoms").collect()] == [("flu", 3)]


def test_measurement(spark):
    rows = spark.createDataFrame([([1, 2, 3], [1, 9, 3, 4]), ([], [1]), ([7], [7])], "a array<int>, b array<int>")
    got = rows.select(measurement.consistency(F.col("a"), F.col("b")).alias("c"), measurement.without_last(F.col("a"), 3).alias("t")).collect()
    assert [r.c for r in got] == pytest.approx([2 / 3, 0, 1]) and [r.t for r in got] == [[1, 2], [], [7]]
    m = measurement.mean_and_median(spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double"), "x").first()
    assert (m.n_queries, m.mean_x, m.median_x) == (4, 4.25, 3.0)


def test_preparation(spark):
    texts = spark.createDataFrame([(3, " a "), (1, "b"), (2, "a"), (4, "  "), (5, None)], "i long, t string")
    assert sorted(tuple(r) for r in preparation.distinct_texts(texts, "i", "t").collect()) == [(1, "b"), (2, "a")]
    many = spark.range(5, 1005, 3).withColumnRenamed("id", "i")
    n = many.count()
    got = preparation.seeded_sample(many, "i", 20, 42).orderBy("draw").collect()
    assert [r.i for r in got] == [5 + 3 * p for p in random.Random(42).sample(range(n), 20)]
    patients = spark.createDataFrame([(1, "flu"), (2, "none")], "p int, disease string")
    diseases = spark.createDataFrame([("flu", "rest")], "disease string, treatment string")
    assert preparation.star_rows(patients, diseases).count() == 1
    with pytest.raises(Exception, match="unknown"):
        preparation.star_rows(patients, diseases, checked=True).collect()
    weights = spark.createDataFrame([("a", 0.2), ("b", 0.5), ("c", 0.3)], "item string, probability double")
    u = spark.createDataFrame([(0.1,), (0.2,), (0.69,), (0.71,), (0.999,)], "u double")
    assert [r["item"] for r in preparation.categorical(u, weights, F.col("u")).orderBy("u").collect()] == ["a", "b", "b", "c", "c"]
    total = preparation.dirichlet(weights, "item", 3).agg(F.sum("probability")).first()[0]
    assert total == pytest.approx(1)
    assert preparation.missing(patients, diseases, "disease").count() == 1


def test_padding_cuts_first_and_pads_either_side(spark):
    rows = spark.createDataFrame([(0, ["a", "b", "c", "d"]), (1, ["a"]), (2, []), (3, None)], "k int, t array<string>")
    for left, one in ((True, ["-", "-", "a"]), (False, ["a", "-", "-"])):
        got = [r.p for r in rows.select("k", text.padded(F.col("t"), 3, "-", left).alias("p")).orderBy("k").collect()]
        assert [g.tokens for g in got] == [["a", "b", "c"], one, ["-"] * 3, ["-"] * 3]
        assert [g.mask for g in got] == [[1, 1, 1], [int(x != "-") for x in one], [0] * 3, [0] * 3]


def test_output_is_cut_before_it_is_sorted(spark):
    rows = spark.createDataFrame([(3, "a"), (0, "z"), (2, "m"), (1, "z")], "k int, name string")
    assert [tuple(r) for r in preparation.sorted_first(rows, "k", 3, "name").orderBy("place").collect()] == [(0, "m"), (1, "z"), (2, "z")]
    assert preparation.sorted_first(rows.filter("k > 9"), "k", 3, "name").isEmpty()


def test_token_probabilities_are_a_softmax(spark):
    logits = [900.0, 899.0, -900.0]
    rows = spark.createDataFrame([(1, 0, k, x) for k, x in enumerate(logits)], "query_id int, step int, token int, logit double")
    got = [r.probability for r in aggregation.token_probabilities(rows, 0.5).orderBy("token").collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-2)), math.exp(-2) / (1 + math.exp(-2)), 0])


def test_alpha_zero_is_the_limit(spark):
    rows = [(1, 0, k, [float(x) for x in np.random.default_rng(k).normal(size=5)]) for k in range(4)]
    streams = spark.createDataFrame(rows, "query_id long, step int, stream_id long, logits array<double>")
    found = []
    for alpha in (0.0, 1e-7):
        c = aggregation.AggregationConfig(token_epsilon=3.0, alpha=alpha)
        found.append([r.logit for r in aggregation.aggregated(streams, c).orderBy("token").collect()])
        assert found[-1] == pytest.approx(aggregation.aggregate_block(np.array([r[3] for r in rows]), c).tolist())
    assert found[0] == pytest.approx(found[1], abs=1e-5)
