import json

import duckdb
import pytest
from pyspark.sql import functions as F

from hushgrid import queries
from hushgrid.operators import measurement
from hushgrid.operators.prefilter import strategies
from hushgrid.operators.retrieval import RetrievalConfig
from hushgrid.plans import prompts
from hushgrid.plans.engine import Engine, GenerationConfig
from hushgrid.plans.providers import embedded
from hushgrid.sources import files
from hushgrid.streaming.ingest import ingest

SF = "/root/testdata/sf0.001"


def test_prompts(spark):
    row = spark.createDataFrame([("q?", "doc", ["a", "b"], [])], "q string, d string, some array<string>, no array<string>")
    got = row.select(prompts.per_document(F.col("q"), F.col("d")).alias("p"), prompts.joined_documents(F.col("q"), F.col("some")).alias("s"), prompts.joined_documents(F.col("q"), F.col("no")).alias("n")).first()
    assert got.p[0].content.endswith('Document:\n"doc"') and got.p[1].content == "q?"
    assert got.s[0].content.endswith('Document 1:\n"a"\n\nDocument 2:\n"b"')
    assert got.n[0].content == prompts.PUBLIC
    v = prompts.variants(row.select(F.col("d").alias("context"), F.col("q").alias("question"))).collect()
    assert [r.variant for r in v] == [0, 1, 2, 3] and all("doc" in str(r.prompt) for r in v)


def test_embedding_does_not_depend_on_batches(spark):
    docs = spark.range(50).select(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" word")).alias("t")).orderBy("t")
    one = [r[0] for r in docs.select(embedded(F.col("t"))).collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        two = [r[0] for r in docs.select(embedded(F.col("t"))).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert one == two and all(sum(x * x for x in v) == pytest.approx(1) for v in one)


def test_engine(spark):
    store = spark.createDataFrame([(i, f"patient {i} has condition {i % 4}") for i in range(30)], "doc_id long, text string")
    engine = Engine(store, RetrievalConfig(top_k=5, epsilon=0.5, max_retrieve=3), GenerationConfig(max_new_tokens=6))
    engine.add(spark.createDataFrame([(90, "patient 1 has condition 1"), (91, "new")], "doc_id long, text string"))
    assert engine.store.count() == 31
    asked = spark.createDataFrame([(1, "which condition"), (2, "patient 3")], "query_id long, query string")
    one, two = ({r.query_id: r.text for r in engine.chat(asked).collect()} for _ in range(2))
    assert one == two and set(one) == {1, 2}
    assert engine.epsilon_per_answer() == pytest.approx(5.3, abs=0.3)
    assert engine.epsilon_in_total() == pytest.approx(4 * engine.epsilon_per_answer())
    measured = engine.measured(asked, 3, strategies())
    assert measured.select("strategy").distinct().count() == 13


def test_sources(spark, tmp_path):
    corpus = tmp_path / "corpus.json"
    corpus.write_text(json.dumps([{"output": " a "}, {"output": "b"}, {"output": "a"}, {"output": " "}, {}]), encoding="utf-8")
    assert sorted(r.text for r in files.corpus(spark, str(corpus)).collect()) == ["a", "b"]
    assert files.corpus(spark, str(corpus), 1).first().text == "a"
    asked = tmp_path / "queries.json"
    asked.write_text(json.dumps([{"input": "x", "answer_icliniq": "r"}, {"input": "y"}]), encoding="utf-8")
    assert {(r.query, r.reference) for r in files.queries(spark, str(asked)).collect()} == {("x", "r"), ("y", "")}
    rows = spark.createDataFrame([(1, "n", "q", "r é", ["s1", "s,2"], "d", "t")], files.MEDICAL)
    files.write_jsonl(rows, str(tmp_path / "j"))
    assert files.medical(spark, str(tmp_path / "j"), "d").collect() == rows.collect()
    assert files.medical(spark, str(tmp_path / "j"), "other").count() == 0
    files.write_csv(rows, str(tmp_path / "c"))
    assert json.loads(spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first().symptom) == ["s1", "s,2"]
    assert files.cached(spark, str(tmp_path / "none"), files.EXTENDED).count() == 0
    counters = spark.createDataFrame([("null", 3)], files.COUNTERS)
    assert files.read_checkpoint(spark, str(tmp_path / "k")).count() == 0
    for run in (1, 2):
        files.write_checkpoint(counters.withColumn("n", F.col("n") * run), str(tmp_path / "k"), run)
    assert files.read_checkpoint(spark, str(tmp_path / "k")).first().n == 6
    document = json.loads(files.result_document({"k": 2}, counters).first().document)
    assert document == {"config": {"k": "2"}, "results": [{"key": "null", "n": 3}]}


def test_ingest(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    stream = lambda: spark.readStream.schema("doc_id long, text string").parquet(str(source))
    for part in ([(1, "a"), (2, "a"), (3, "b")], [(4, "b"), (5, "c")]):
        spark.createDataFrame(part, "doc_id long, text string").write.mode("append").parquet(str(source))
        ingest(stream(), store, str(tmp_path / "state")).awaitTermination()
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(store).collect()) == [(1, "a"), (3, "b"), (5, "c")]


@pytest.mark.parametrize("name", ["retrieve_topk_nondp", "dp_topk_draw_u", "dp_aggregate", "trigger_rates", "bucket_accuracy", "corpus_strip_dedupe", "prompt_joined_docs"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings labels conversations benchmark".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in frame.collect())
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert got == sorted(str(tuple(r)) for r in want)


def test_completions_and_generation(spark, tmp_path):
    from hushgrid.plans import engine, prompts

    g = engine.GenerationConfig(max_new_tokens=6)
    asked = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "query_id long, text string")
    said = {r.query_id: r.text for r in engine.text_completion(asked, g).collect()}
    assert said.keys() == {1, 2, 3} and said[2].startswith("two")
    rows = asked.select(F.col("query_id").alias("patient"), prompts.patient_request(F.col("text"), F.array(F.lit("a"), F.lit("b"))).alias("prompt"))
    first = sorted(map(tuple, engine.generated_until_complete(rows.filter("patient < 3"), f"{tmp_path}/made", "patient", g, batch=1).collect()))
    every = sorted(map(tuple, engine.generated_until_complete(rows, f"{tmp_path}/made", "patient", g, batch=1).collect()))
    assert [p for p, _ in every] == [1, 2, 3] and first == every[:2]
    with pytest.raises(ValueError):
        measurement.decisions(rows, {})


def test_plans_sort_and_scan_once(spark):
    plan = queries.QUERIES["strategy_b_grid"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array_sort") == 2
    drawn = queries.QUERIES["dp_topk_draw_u"](spark, "/root/testdata/sf0.001")
    assert drawn._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") <= 2
