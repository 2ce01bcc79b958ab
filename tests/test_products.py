import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushgrid.operators import measurement, preparation, products, retrieval, selection
from hushgrid.operators.retrieval import RetrievalConfig


def vectors(spark, rows, key, value):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], f"{key} long, {value} array<double>")


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v / np.linalg.norm(v)) for i, v in enumerate(np.round(rng.normal(size=(700, 6)), 1))]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]  # ties
    asked = [(i, rows[i][1][::-1]) for i in range(20)]
    corpus, queries = vectors(spark, rows, "doc_id", "embedding"), vectors(spark, asked, "query_id", "query_vector")
    return queries, corpus, retrieval.score(queries, corpus).persist()


CONFIGS = [
    RetrievalConfig(top_k=20, differential_privacy=False),
    RetrievalConfig(top_k=380, differential_privacy=False),
    RetrievalConfig(top_k=760, differential_privacy=False),
    RetrievalConfig(top_p=0.1, differential_privacy=False),
    RetrievalConfig(top_k=20),
    RetrievalConfig(top_k=20, epsilon=300.0, mode="paper"),
    RetrievalConfig(top_k=20, epsilon=300.0, min_score=-2.0, max_score=3.0),
    RetrievalConfig(top_p=0.3, epsilon=900.0),
]


@pytest.mark.parametrize("c", CONFIGS, ids=str)
def test_products_equal_pairs(many, monkeypatch, c):
    monkeypatch.setattr(products, "BLOCK", 100)
    monkeypatch.setattr(products, "QUERIES", 7)
    queries, corpus, scores = many
    own = products.Products(queries, corpus, c)
    assert sorted(map(tuple, own.retrieved(seed=5).collect())) == sorted(map(tuple, retrieval.above(scores, retrieval.thresholds(scores, c, 5)).collect()))
    if c.differential_privacy:
        given = retrieval.top_p_pdf(scores, c) if c.top_p is not None else retrieval.top_k_pdf(scores, c)
        want = {(r.query_id, r.s): r.pdf for r in given.collect() if r.pdf > 0}
        got = {(r.query_id, r.s): r.pdf for r in own.pdf().collect()}
        assert all(got[at] == pytest.approx(p, rel=1e-6, abs=1e-300) for at, p in want.items())
        assert all(p < 1e-300 for at, p in got.items() if at not in want)


def test_capped_and_odd_vectors(spark):
    rows = [(1, [1, 0]), (2, [0.5, 0]), (3, None), (4, [None, 1]), (5, [1, 0, 0]), (6, []), (7, [0.25, 0]), (None, [0.75, 0]), (8, [0, 0])]
    corpus, queries = vectors(spark, rows, "doc_id", "embedding"), vectors(spark, [(1, [1, 0]), (2, [0, 0]), (3, None), (4, [1, 1, 1]), (5, [9] * 4), (None, [1, 0])], "query_id", "query_vector")
    found = {(r.query_id, r.doc_id, r.score) for r in products.retrieve(queries, corpus, RetrievalConfig(top_k=2, differential_privacy=False)).collect()}
    assert found == {(1, 1, 1.0), (1, None, 0.75), (4, 5, 1.0)}  # all of query 2's scores are equal, and none is above
    one = products.retrieve(queries, corpus, RetrievalConfig(top_k=2, epsilon=1e4, max_score=2.0, max_retrieve=1), seed=3).collect()
    assert all(r.place == 1 for r in one) and len({r.query_id for r in one}) == len(one)
    for a, b in ((queries.limit(0), corpus), (queries, corpus.limit(0))):
        for c in CONFIGS[::3]:
            assert products.retrieve(a, b, c).count() == 0


def test_few_rows_leave_the_products(spark):
    rng = np.random.default_rng(9)
    corpus = vectors(spark, enumerate(rng.normal(size=(20_000, 4))), "doc_id", "embedding").repartition(4)
    queries = vectors(spark, enumerate(rng.normal(size=(300, 4))), "query_id", "query_vector")
    own = products.Products(queries, corpus, RetrievalConfig(top_k=10, differential_privacy=False))
    assert own.windows.count() == 300 and own.retrieved().count() == 3000
    assert own.found.filter("place <> 'before'").count() < 300 * 60  # of 6,000,000 pairs
    plan = products._pairs(own.documents, products.packed(own.asked.selectExpr("*", "0D low", "1D high", "0 first"), products.QUERIES))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Cross") == 1 and plan.index("Join Cross") < plan.index("MapInArrow")  # of blocks
    sharp = products.Products(queries, corpus, RetrievalConfig(top_k=10, epsilon=200.0, min_score=-20.0, max_score=20.0))
    assert sharp.found.filter("place <> 'before'").count() < 0.05 * 6_000_000


@pytest.mark.parametrize("few", [1, 10, 10_000])
def test_order_statistics(spark, few):
    rng = random.Random(few)
    values = {"even": [rng.random() for _ in range(400)], "odd": [float(rng.randrange(5)) for _ in range(301)], "far": [10.0 ** rng.randrange(-300, 300) for _ in range(99)], "same": [2.5] * 200, "one": [-1.0]}
    rows = spark.createDataFrame([(k, v) for k, own in values.items() for v in own] + [("even", None), ("none", None)], "key string, value double")
    wanted = [(k, str(r), r) for k, own in values.items() for r in (0, len(own) // 3, len(own) - 1, len(own))]
    got = {(r.key, r["name"]): r.value for r in selection.nth(rows, spark.createDataFrame(wanted, "key string, name string, rank long"), few).collect()}
    assert got == {(k, name): sorted(values[k])[r] for k, name, r in wanted if r < len(values[k])}
    assert {r.key: r.median for r in selection.medians(rows, few).collect()} == {k: pytest.approx(np.median(v)) for k, v in values.items()}


def test_mean_and_median_without_values(spark):
    rows = spark.createDataFrame([(1.0, None), (4.0, None)], "a double, b double")
    r = measurement.mean_and_median(rows, "a", "b").first()
    assert (r.n_queries, r.mean_a, r.median_a, r.mean_b, r.median_b) == (2, 2.5, 2.5, None, None)
    assert "percentile" not in measurement.mean_and_median(rows, "a")._jdf.queryExecution().optimizedPlan().toString()


def test_utility_curve_is_a_merge(spark):
    rng = random.Random(2)
    rows = [(q, i, round(rng.random(), 2)) for q in (1, 2) for i in range(200)]
    scores = spark.createDataFrame(rows, "query_id long, doc_id long, score double")
    grid = F.array(*[F.lit(x / 20) for x in range(21)])
    found = retrieval.utility_curve(scores, grid, k=7)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.query_id, r.tau): r.utility for r in found.collect()} == {(q, x / 20): -abs(sum(s > x / 20 for p, _, s in rows if p == q) - 7) for q in (1, 2) for x in range(21)}


def test_draws_from_many_categories(spark):
    n = 300_000
    weights = spark.range(n).select(F.col("id").alias("item"), (F.col("id") % 7).cast("double").alias("probability"))
    rows = spark.range(2000).select("id", ((F.col("id") + 0.5) / 2000).alias("u"))
    p = np.arange(n) % 7
    ends = np.cumsum(p) / p.sum()
    got = {r.id: r["item"] for r in preparation.categorical(rows, weights, F.col("u")).collect()}
    want = np.searchsorted(ends, (np.arange(2000) + 0.5) / 2000, side="right")
    assert len(got) == 2000 and all(abs(got[i] - want[i]) <= 1 for i in range(2000)) and sum(got[i] == want[i] for i in range(2000)) > 1990
    assert {r["item"] for r in preparation.categorical(rows, weights.limit(0), F.col("u")).collect()} == {None}


def by_passes(spark, monkeypatch, queries, corpus, c, u, parts, blocks):
    """Rows and thresholds of the one pass, with those of the passes that count."""
    monkeypatch.setattr(products, "BLOCK", parts)
    monkeypatch.setattr(products, "QUERIES", blocks)
    own = products.Products(queries, corpus, c)
    told = own.once(u, True), own.once(u, False)
    assert all(x is not None for x in told) and "windows" not in own.__dict__
    passed = own.passes(0, u)
    want = retrieval.above(own.scores(), passed), passed
    for got, other in zip(told, want, strict=True):
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, other.select(got.columns).collect()), key=str)
    return told


@pytest.mark.parametrize("parts", [100, 4096])
def test_one_pass_finds_the_greatest(many, spark, monkeypatch, parts):
    queries, corpus, _ = many
    for k in (20, 760):
        by_passes(spark, monkeypatch, queries, corpus, RetrievalConfig(top_k=k, differential_privacy=False), None, parts, 7)


def test_one_pass_has_blocks_for_all_tasks(many, spark, monkeypatch):
    queries, corpus, _ = many
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")  # more than blocks of QUERIES: what is found isn't written
        by_passes(spark, monkeypatch, queries, corpus, RetrievalConfig(top_p=0.3, differential_privacy=False), None, 100, 256)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)


def test_one_pass_draws(many, spark, monkeypatch):
    queries, corpus, _ = many
    u = (F.col("query_id") + 0.5) / 20
    by_passes(spark, monkeypatch, queries, corpus, RetrievalConfig(top_k=20), u, 4096, 7)  # as in products_dp_topk_draw_u, by lists


def test_a_draw_that_a_list_does_not_decide(spark):
    rows = [(i, [1.0, 0.0]) for i in range(600)] + [(600 + i, [i / 300, 0.0]) for i in range(100)]
    corpus, queries = vectors(spark, rows, "doc_id", "embedding"), vectors(spark, [(1, [1, 0]), (2, [0.3, 0])], "query_id", "query_vector")
    own = products.Products(queries, corpus, RetrievalConfig(top_k=20, epsilon=1.0))  # the list holds equal scores only
    got = {r.query_id: r.threshold for r in own.thresholds(u=F.lit(0.4)).collect()}
    assert got == {r.query_id: r.threshold for r in own.passes(0, F.lit(0.4)).collect()} and len(got) == 2


@pytest.mark.parametrize("scale", [1.0, 1e-30, 1e20])
@pytest.mark.parametrize("total", [None, 3000])
def test_lists_hold_the_greatest(scale, total):
    rng = np.random.default_rng(4)
    queries, vectors = rng.normal(size=(40, 16)) * scale, np.round(rng.normal(size=(3000, 16)), 1)
    vectors[::7] = vectors[3]  # ties
    own = products.Greatest(np.arange(40), np.zeros(40), 50, total)
    for at in range(0, 3000, 700):
        own.add(queries, vectors[at : at + 700], np.arange(at, min(at + 700, 3000)))
    every = products.product(queries, vectors)
    for query, _, n, scores, documents in own.told():
        assert n == 3000 and (len(scores) == 50 if total is None else 40 <= len(scores) < 450)
        assert np.array_equal(np.sort(scores), np.sort(every[query])[-len(scores) :]) and np.array_equal(every[query][documents], scores)


def test_some_products_are_summed_in_order():
    rng = np.random.default_rng(8)
    queries, vectors = rng.normal(size=(50, 64)), rng.normal(size=(60, 64))
    every = products.product(queries, vectors)
    for n in (1, 2, 9, 400):
        q, d = rng.integers(0, 50, n), rng.integers(0, 60, n)
        assert np.array_equal(products.some_products(queries, vectors, q, d), every[q, d])


def test_short_lists_decide_draws():
    """Lists are as short as a draw allows: what is left out can't change it, or the list doesn't decide."""
    rng = np.random.default_rng(6)
    c = RetrievalConfig(top_k=20)
    decided = 0
    for u in (rng.integers(0, 10007, 300) + 0.5) / 10007:
        scores = np.sort(rng.normal(size=5000) / 8)
        whole = products.threshold_of(scores, 5000, u, c)
        for most in (100, 502):
            sure, *told = products.threshold_of(scores[-most:], 5000, u, c)
            assert not sure or (True, *told) == whole
            decided += sure and most == 502
    assert decided == 300
    own = products.Greatest(np.array([1]), np.array([0.5]), 502, 5000)
    assert own.scores.shape[1] < 1222  # 1222 were held before, for each of them
    assert not products.threshold_of(np.sort(rng.normal(size=502)) + 9, 5000, 0.5, c)[0]  # all are clipped
