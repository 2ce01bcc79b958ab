import json
import random

import pytest
from pyspark.sql import functions as F

from hushgrid.sources import files, json_arrays, versions


def objects(rng, n):
    texts = ["", "a", '"', "\\", '\\"', "}", "{", "]}", '"},{"', "é漢🙂", "\n", "x" * 300, '{"output": "no"}', "\\\\"]
    return [{"output": "".join(rng.choices(texts, k=rng.randrange(6))), "more": [{"deep": rng.choice(texts)}, [], {}], "n": i} for i in range(n)]


@pytest.mark.parametrize(("size", "n"), [(61, 25), (1000, 200), (10**7, 200)])
@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"ensure_ascii": False}])
def test_json_arrays_in_splits(spark, tmp_path, size, n, style):
    rows = objects(random.Random(size), n)
    path = tmp_path / "rows.json"
    path.write_text(json.dumps(rows, **style), encoding="utf-8")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = json_arrays.elements(spark, str(path)).orderBy("place").collect()
        texts = files.json_array(spark, str(path), "output string, n int").orderBy("place").collect()
        splits = spark.read.option("lineSep", "}").text(str(path)).select("_metadata.file_block_start").distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [json.loads(r.element) for r in found] == rows and len({r.place for r in found}) == n
    assert [(r.output, r.n) for r in texts] == [(r["output"], r["n"]) for r in rows]
    assert splits > 20 or size > 10**6


def test_json_arrays_without_elements(spark, tmp_path):
    for i, text in enumerate(["[]", "", " [ ]\n", "[\n]"]):
        (tmp_path / f"{i}.json").write_text(text)
        assert files.json_array(spark, str(tmp_path / f"{i}.json"), "output string").count() == 0
    (tmp_path / "one.json").write_text('[{"output": 5}, {"other": "x"}]')
    assert [tuple(r) for r in files.json_array(spark, str(tmp_path / "one.json"), "output string").orderBy("place").select("output").collect()] == [("5",), (None,)]


def test_cache_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "cache")
    schema = "k string, n long"
    assert files.cached(spark, path, schema).count() == 0
    files.write_cache(spark.createDataFrame([("a", 1)], schema), path)
    for _ in range(4):  # each reads what it replaces
        files.write_cache(files.cached(spark, path, schema).withColumn("n", F.col("n") + 1).unionByName(spark.createDataFrame([("b", 0)], schema)), path)
    assert sorted(map(tuple, files.cached(spark, path, schema).collect())) == [("a", 5), ("b", 0), ("b", 1), ("b", 2), ("b", 3)]
    assert len(versions.versions(spark, path)) == 2
    reader = files.cached(spark, path, schema)
    failing = files.cached(spark, path, schema).withColumn("n", F.when(F.col("k") == "b", F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="killed"):
        files.write_cache(failing, path)
    assert files.cached(spark, path, schema).count() == 5
    files.write_cache(spark.createDataFrame([("c", 1)], schema), path)
    assert reader.count() == 5 and files.cached(spark, path, schema).count() == 1


def test_result_is_one_document(spark, tmp_path):
    summary = spark.createDataFrame([(0.5, 3), (0.1, 2)], "temperature double, n long")
    for k in (1, 2):
        files.write_result({"k": k, "name": "é"}, summary, spark.range(3), str(tmp_path))
        text = (tmp_path / "result.json").read_text(encoding="utf-8")
        assert json.loads(text) == {"config": {"k": str(k), "name": "é"}, "results": [{"n": 2, "temperature": 0.1}, {"n": 3, "temperature": 0.5}]}
        assert text.startswith('{\n  "config": {')
    assert spark.read.json(versions.current(spark, f"{tmp_path}/per_query")).count() == 3
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["per_query", "result.json"]


def test_questions_and_answers(spark, tmp_path):
    (tmp_path / "qa.jsonl").write_text('{"question": "q?", "answer": "a"}\n{"question": "r?"}\n')
    assert [r.text for r in files.questions_and_answers(spark, str(tmp_path / "qa.jsonl")).collect()] == ["Question: q?\nAnswer: a", None]
