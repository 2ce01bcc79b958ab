import numpy as np
import pytest
from pyspark.sql import functions as F

from hushgrid.operators import evaluation, throughput
from hushgrid.operators.retrieval import RetrievalConfig
from hushgrid.plans.chain import START, BlockChain, FrameChain, argmax, one_table, public_argmax
from hushgrid.plans.engine import Engine, GenerationConfig, aggregation_chain, generate
from hushgrid.plans.prompts import fan_out
from hushgrid.streaming import counters

SF = "/root/testdata/sf0.001"


def test_each_step_is_computed_once(spark):
    seen = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def counting(place):
        def run(batches):
            for b in batches:
                seen[place].add(b.num_rows)
                yield b

        return lambda rows: rows.mapInArrow(run, rows.schema)

    chain = FrameChain(
        {"first": counting(0), "second": counting(1)},
        {"in": (START, lambda d: d.agg(F.count("*").alias("n"))), "mid": ("first", lambda d: d.agg(F.sum("id").alias("n"))), "out": ("second", lambda d: d.agg(F.max("id").alias("n")))},
    )
    found = chain.run(spark.range(100).toDF("id"))
    got = {r.tap: r.n for r in one_table({t: found[t] for t in chain.taps}, ["n"]).collect()}
    assert got == {"in": 100, "mid": 4950, "out": 99} and found["second"].count() == 100
    assert [a.value for a in seen] == [100, 100]


def test_chains_without_steps_or_taps(spark):
    rows = spark.range(3).toDF("id")
    assert FrameChain({}, {}).run(rows)[START].count() == 3
    assert FrameChain({"more": lambda d: d.union(d)}, {}).run(rows)["more"].count() == 6
    assert FrameChain({"none": lambda d: d.filter("false")}, {"n": ("none", lambda d: d.agg(F.count("*").alias("n")))}).run(rows)["n"].first().n == 0
    for steps, taps in (({START: None}, {}), ({"a": None}, {"t": ("b", None)})):
        with pytest.raises(ValueError):
            FrameChain(steps, taps)
        with pytest.raises(ValueError):
            BlockChain(steps, taps)


def test_block_chain_records():
    chain = BlockChain({"sum": lambda b: b.sum(axis=0), "turn": lambda v: -v}, {"public": (START, public_argmax), "sum": ("sum", argmax), "turned": ("turn", argmax)})
    record = {}
    assert chain(np.array([[1.0, 0.0], [0.0, 5.0]]), record).tolist() == [-1.0, -5.0]
    chain(np.array([[0.0, 0.0], [0.0, 0.0]]), record)
    assert record == {"public": [0, 0], "sum": [1, 0], "turned": [0, 0]}
    with pytest.raises(ValueError):
        BlockChain({}, {})(np.zeros((2, 2)), {})


def test_answers_with_a_chain(spark):
    store = spark.createDataFrame([(i, f"patient {i} has condition {i % 4}") for i in range(30)], "doc_id long, text string")
    g = GenerationConfig(max_new_tokens=8)
    engine = Engine(store, RetrievalConfig(top_k=5, epsilon=0.5, max_retrieve=3), g)
    asked = spark.createDataFrame([(1, "which condition"), (2, "patient 3")], "query_id long, query string")
    streams = fan_out(asked, engine.retrieved(asked))
    plain = {r.query_id: r.tokens for r in generate(streams, g).collect()}
    told = {r.query_id: r for r in generate(streams, g, chain=aggregation_chain(g)).collect()}
    assert {q: r.tokens for q, r in told.items()} == plain  # taps change nothing
    assert all(len(r.recorded["before"]) == len(r.recorded["after"]) == len(r.tokens) for r in told.values())
    greedy = GenerationConfig(max_new_tokens=8, greedy=True)
    best = generate(streams, greedy, chain=aggregation_chain(greedy)).collect()
    assert all(r.recorded["after"] == r.tokens for r in best)
    rates = {r.query_id: r for r in engine.consistencies(asked).collect()}
    for q, r in told.items():
        same = [a == b for a, b in zip(r.recorded["before"], r.tokens)]
        assert rates[q].n_tokens == len(same) and rates[q].sampled == pytest.approx(sum(same) / len(same) if same else 0)
    swapped = BlockChain({"public alone": lambda b: b[0]}, {"public": (START, public_argmax)})
    alone = generate(streams, greedy, chain=swapped).collect()
    assert all(r.recorded["public"] == r.tokens for r in alone)


def test_a_stopped_count_goes_on(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    source, folder, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    events.repartition(6).write.parquet(source)

    def view(rows):
        return rows.select("event_type", F.col("user_id").cast("string").alias("user_id"), F.lit("5.3").alias("epsilon"), (F.col("value") > 50).alias("success"))

    stream = view(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source))
    names = ("event_type", "user_id", "epsilon", "success")
    query = counters.keep_counts(stream, *names, folder, state, once=False)
    while not (tmp_path / "out" / "batch=1" / "_SUCCESS").exists():
        assert query.isActive
    query.stop()
    some = counters.counts(spark, folder).filter("grain = 7").first().n
    assert 0 < some <= events.count()
    for _ in range(2):
        counters.keep_counts(stream, *names, folder, state).awaitTermination()
    want = evaluation.grain_counts(view(events), *names)
    columns = [*counters.KEYS, "n", "successes"]
    assert sorted(map(repr, counters.counts(spark, folder).select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))


def test_a_batch_that_is_done_again_counts_once(spark, tmp_path):
    rows = "kind string, item string, epsilon string, success boolean"
    source, folder, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([("a", None, "1", True), (None, "x", None, None), ("a", None, "1", False)], rows).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(rows).parquet(source)
    names = ("kind", "item", "epsilon", "success")
    counters.keep_counts(stream, *names, folder, state).awaitTermination()
    for commit in (tmp_path / "state" / "commits").iterdir():
        commit.unlink()  # as if it had stopped before it said that the batch was done
    counters.keep_counts(stream, *names, folder, state).awaitTermination()
    got = {(r.kind, r.item, r.epsilon, r.grain): (r.n, r.successes) for r in counters.counts(spark, folder).collect()}
    assert got[None, None, None, 7] == (3, 1) and got["a", None, "1", 0] == (2, 1) and got[None, "x", None, 0] == (1, 0) and got[None, None, None, 3] == (1, 0)
    counters.keep_counts(spark.readStream.schema(rows).parquet(f"{tmp_path}/non*"), *names, str(tmp_path / "none"), str(tmp_path / "s2")).awaitTermination()
    assert counters.counts(spark, str(tmp_path / "none")).count() == 0


def test_a_meter_counts_in_the_job(spark, tmp_path):
    meter = throughput.Meter({"even": F.count(F.when(F.col("id") % 2 == 0, 1))})
    with pytest.raises(ValueError):
        meter.report()
    meter.of(spark.range(1000)).write.parquet(str(tmp_path / "t"))
    told = meter.report()
    assert told["rows"] == 1000 and told["even"] == 500 and told["rows_per_second"] == pytest.approx(1000 / told["seconds"])
    with pytest.raises(ValueError):
        meter.of(spark.range(1))
    with pytest.raises(ValueError):
        throughput.Meter({"rows": F.lit(1)}).of(spark.range(1))
    peaks = throughput.executor_peaks(spark)
    assert peaks.columns == ["executor", "metric", "bytes"]
    assert all(r.bytes >= 0 for r in peaks.collect())
