import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushgrid.operators import embedding
from hushgrid.operators.retrieval import RetrievalConfig
from hushgrid.plans.engine import Engine, GenerationConfig


def corpus():
    rng = random.Random(1)
    topics = [[f"{t}word{i}" for i in range(30)] for t in "abc"]
    rows = [(i, " ".join(rng.choices(topics[i % 3], k=25) + rng.choices(["the", "of"], k=5))) for i in range(36)]
    return [*rows, (50, ""), (51, None), (52, "... !")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)


def test_directions_equal_those_of_a_dense_decomposition(spark, docs):
    terms, dims = 2048, 6
    own = embedding.fit(docs, dims=dims, terms=terms, more=40, passes=2)
    rows = {r.doc_id: r.t for r in docs.select("doc_id", embedding.terms_of(F.col("text"), terms).alias("t")).collect()}
    some = sorted(d for d, t in rows.items() if t)
    df = np.zeros(terms)
    for d in some:
        df[list(set(rows[d]))] += 1
    matrix = np.zeros((len(some), terms))
    for i, d in enumerate(some):
        for t in set(rows[d]):
            matrix[i, t] = (1 + math.log(rows[d].count(t))) * (math.log((1 + len(some)) / (1 + df[t])) + 1)
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    _, values, turned = np.linalg.svd(matrix, full_matrices=False)
    assert own.values == pytest.approx(values[:dims], rel=1e-6)
    want = matrix @ turned[:dims].T
    want /= np.linalg.norm(want, axis=1)[:, None]
    got = {r.doc_id: r.embedding for r in own.embedded(docs, "text").collect()}
    made = np.array([got[d] for d in some])
    assert made @ made.T == pytest.approx(want @ want.T, abs=1e-6)
    assert all(got[d] == [0.0] * dims for d in (50, 51, 52))


def test_vectors_depend_on_the_text_alone(spark, docs, tmp_path):
    own = embedding.fit(docs, dims=8, terms=1024)
    own.table(spark).write.parquet(str(tmp_path / "p"))
    again = embedding.Projection.of(spark.read.parquet(str(tmp_path / "p")))
    whole = sorted((r.doc_id, r.embedding) for r in own.embedded(docs, "text").collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted((r.doc_id, r.embedding) for r in again.embedded(docs.coalesce(1), "text").collect()) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_texts_are_cut_into_words_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(text):
        seen.add(1)
        return text

    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    own = embedding.fit(docs.select("doc_id", F.udf(told, "string").asNondeterministic()("text").alias("text")), dims=4, terms=1024, passes=3)
    assert seen.value == len(corpus())
    kept = embedding.bags(docs, "text", 1024)
    again = embedding.fit_bags(kept, dims=4, terms=1024, passes=3)
    assert again.values == pytest.approx(own.values) and again.weights == pytest.approx(own.weights)
    want = sorted((r.doc_id, r.embedding) for r in own.embedded(docs, "text").collect())
    assert sorted((r.doc_id, r.embedding) for r in own.embedded_bags(kept).collect()) == want


def test_near_copies_are_nearer_than_others(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("length(text) > 200")
    cut = given.select((-F.col("doc_id") - 1).alias("doc_id"), F.expr("substr(text, length(text) div 10)").alias("text"))  # a tenth is gone
    own = embedding.fit(given)
    vectors = {r.doc_id: np.array(r.embedding) for r in own.embedded(given.unionByName(cut), "text").collect()}
    ids = sorted(d for d in vectors if d >= 0)
    near = [vectors[d] @ vectors[-d - 1] for d in ids]
    far = [vectors[a] @ vectors[b] for a, b in zip(ids, ids[7:] + ids[:7], strict=True)]
    assert np.median(near) > 0.95 and np.mean(np.array(near) > np.array(far)) > 0.95


def test_engine_with_learned_vectors(spark, docs):
    store = docs.filter("length(text) > 5")
    engine = Engine(store, RetrievalConfig(top_k=4, differential_privacy=False), GenerationConfig(max_new_tokens=3), embedding=embedding.fit(store, dims=8, terms=1024))
    found = engine.retrieved(spark.createDataFrame([(1, "aword1 aword2 aword3 aword4")], "query_id long, query string")).collect()
    assert len(found) == 4 and all("aword" in r.text for r in found)
