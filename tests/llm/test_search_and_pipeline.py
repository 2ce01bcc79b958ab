import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hushgrid.llm import search

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def brute(ids, rows, k, asked):
    out = []
    for i in asked:
        scores = [(-int(np.dot(rows[i], rows[j])), ids[j], -int(np.dot(rows[i], rows[j]))) for j in range(len(ids)) if ids[j] != ids[i] and len(rows[j]) == len(rows[i])]
        out += [(ids[i], rank, j, -s) for rank, (s, j, _) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def frame(spark, ids, rows):
    return spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, rows)], "id long, vector array<double>")


@pytest.mark.parametrize("spread", [1, 40])
def test_search_against_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(search, "CANDIDATES", 150)
    monkeypatch.setattr(search, "QUERIES", 8)
    rng = np.random.default_rng(spread)
    centers = rng.integers(-200, 200, (5, 6))
    rows = (centers[rng.integers(0, 5, 500)] + rng.integers(-spread, spread + 1, (500, 6))).tolist()
    rows += [rows[0]] * 30 + [[1, 2]] * 3
    ids = list(range(533))
    whole = frame(spark, ids, rows)
    got = search.top_k(whole.unionByName(whole.filter("id < 9")), whole.filter("id % 50 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == brute(ids, rows, 5, range(0, 533, 50))


def test_cover_tree_covers():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.2, (150, 3)) for c in (0, 10, 30)])
    stack, leaves = [search.cover_tree(points)], []
    assert stack[0].children
    while stack:
        node = stack.pop()
        assert np.sqrt(((points[node.rows] - node.center) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            stack += node.children
        else:
            leaves.append(node.rows)
    assert len(np.concatenate(leaves)) == 450


@pytest.mark.parametrize("given", [True, False])
def test_pairs_are_pruned_and_counted(given):
    if given:
        rows = pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pandas()
        points = np.floor(np.stack(rows["embedding"].to_numpy()).astype(float) * 256)
    else:
        rng = np.random.default_rng(2)
        points = np.concatenate([rng.integers(-5, 6, (200, 8)) + 300 * np.eye(8)[k] for k in range(4)])
    ids = np.arange(len(points))
    asked = ids[::50]
    tree, best = search.cover_tree(points), search.TopK(len(asked), 5)
    assert len(tree.children) > 1
    multiplied, dropped = search.dual_search(points[asked], asked, search.cover_tree(points[asked], leaf=1), points, ids, tree, best)
    assert multiplied + dropped == len(asked) * len(points) and dropped > 0.5 * len(asked) * len(points)
    got = [(int(asked[r]), c + 1, int(best.ids[r, c]), int(best.scores[r, c])) for r in range(len(asked)) for c in range(5)]
    assert sorted(got) == brute(ids.tolist(), points, 5, asked.tolist())


def test_quantized_and_empty(spark):
    rows = spark.createDataFrame([(0, [0.5, -0.001]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (50, [1.0, 1.0]), (None, [1.0, 1.0]), (7, [])], "vec_id long, embedding array<float>")
    q = rows.select(F.col("vec_id").alias("id"), search.quantized(F.col("embedding"), 256).alias("vector"))
    assert {r.id: r.vector for r in q.collect() if r.vector} == {0: [128.0, -1.0], 50: [256.0, 256.0], None: [256.0, 256.0]}
    got = search.top_k(q, q.filter("id % 50 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 50, 32512), (50, 1, 0, 32512)]
    assert search.top_k(q.limit(0), q.limit(0), 5).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == names, name
        kept.append(docs.count())
    assert kept[0] > kept[1] > kept[2] == kept[3] == kept[4]
    packed = corpus_pipeline.run(spark, SF)
    per_doc = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    assert per_doc == {r.doc_id for r in docs.select("doc_id").collect()}
    assert pq.read_table(f"{SF}/documents.parquet").num_rows == kept[0]


def test_no_pair_of_blocks_is_broadcast_or_shuffled(spark, monkeypatch):
    monkeypatch.setattr(search, "CANDIDATES", 100)
    rng = np.random.default_rng(5)
    whole = frame(spark, range(2000), rng.integers(-300, 301, (2000, 16)).tolist())
    found = search.top_k(whole, whole.filter("id % 50 = 0"), 5)
    assert found.count() == 200
    found.write.format("noop").mode("overwrite").save()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan and "Generate" not in plan
