from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushgrid import queries
from hushgrid.functions.text import SPACES, words
from hushgrid.operators.retrieval import RetrievalConfig
from hushgrid.plans import learned
from hushgrid.plans.engine import Engine, GenerationConfig, aggregation_chain, chat_completion, completed, generate
from hushgrid.plans.prompts import fan_out

SF = "/root/testdata/sf0.001"
TEXTS = ["the cat sat", "The  cat ran", "a dog ran\nthe cat", "", None, "<end> cat <end>", "the cat sat"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def by_hand(texts, size):
    rows = [[w for w in t.lower().split() if w != "<end>"] for t in texts if t is not None]
    counts = Counter(w for r in rows for w in r)
    known = ["<end>", *sorted(counts, key=lambda w: (-counts[w], w))[: size - 1]]
    pairs = Counter((a, b) for r in rows for a, b in zip(["<end>", *r], [*r, "<end>"]) if a in known and b in known)
    return known, counts, pairs


@pytest.mark.parametrize("size", [1, 3, 100])
def test_training_counts_everything(spark, size):
    model = learned.train(frame(spark, TEXTS), size=size)
    known, counts, pairs = by_hand(TEXTS, size)
    assert model.vocabulary == known
    assert model.counts[1:].tolist() == [counts[w] for w in known[1:]]
    assert {(known[a], known[b]): n for (a, b), n in np.ndenumerate(model.followers) if n} == dict(pairs)


def test_tasks_count_before_rows_are_made(spark, monkeypatch):
    monkeypatch.setattr(learned, "HELD", 2)  # what a task holds is sent several times
    spaces = [f"a{c}{c}b {c}İx" for c in SPACES]
    docs = frame(spark, [*TEXTS, *spaces, *[" ".join(["the", "cat"] * 500)] * 20]).repartition(2)
    known = learned.vocabulary(docs, "text", 4)
    counted, met = known.select("word", "n"), learned.followers(docs, "text", known)
    said = docs.select(words(F.col("text")).alias("w"))
    want = Counter(w for r in said.filter("w is not null").collect() for w in r.w if w != "<end>")
    assert [tuple(r) for r in counted.collect()] == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:3]
    pairs = {(r["last"], r["next"]): r.n for r in met.collect()}
    ids = {r.word: r.id for r in known.collect()}
    rows = [[0, *(ids.get(w, -1) for w in r.w if w != "<end>"), 0] for r in said.filter("w is not null").collect()]
    assert pairs == dict(Counter((a, b) for r in rows for a, b in zip(r, r[1:]) if a >= 0 and b >= 0))
    for made in (known, met):  # a row for each word, or pair, is what an explode makes
        assert "Generate" not in made._jdf.queryExecution().toString()


def test_scores_are_logs_of_a_distribution(spark):
    model = learned.train(frame(spark, TEXTS))
    cat = model.vocabulary.index("cat")
    scores = model.next_logits(["about a dog", "", "dog dog dog unheard"], [model.vocabulary.index("the")])
    assert np.exp(scores).sum(axis=1) == pytest.approx([1, 1, 1])
    assert scores[1].argmax() == cat  # what follows "the" everywhere
    dog = model.vocabulary.index("dog")
    assert scores[2][dog] > scores[0][dog] > scores[1][dog]
    assert np.array_equal(scores[1], model.next_logits([""], [model.vocabulary.index("the")])[0])


def test_models_are_kept_and_replaced(spark, tmp_path):
    folder = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        learned.load(spark, folder)
    for texts in (TEXTS, TEXTS[:1]):
        model = learned.train(frame(spark, texts), cache=0.25)
        model.save(spark, folder)
        again = learned.load(spark, folder)
        assert again.vocabulary == model.vocabulary and again.cache == 0.25
        assert np.array_equal(again.followers, model.followers) and np.array_equal(again.counts, model.counts)


def test_no_words(spark):
    for texts in ([], [None], ["", " "]):
        model = learned.train(frame(spark, texts))
        assert model.vocabulary == ["<end>"]
        asked = spark.createDataFrame([(1, "hello")], "query_id long, asked string")
        assert completed(asked, GenerationConfig(max_new_tokens=3), model).first().text == ""
    for size in (0, learned.LARGEST + 1):
        with pytest.raises(ValueError):
            learned.train(frame(spark, TEXTS), size=size)


def test_answers_of_a_trained_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = learned.train(docs, size=200)
    g = GenerationConfig(max_new_tokens=5, greedy=True, differential_privacy=False)
    engine = Engine(docs.filter("text is not null").limit(40), RetrievalConfig(top_k=5, epsilon=0.5, max_retrieve=3), g, model=model)
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    streams = fan_out(asked, engine.retrieved(asked))
    got = {r.query_id: r for r in generate(streams, g, model, chain=aggregation_chain(g)).collect()}
    said = {}
    for r in streams.collect():
        said.setdefault(r.query_id, {})[r.stream_id] = "\n".join(f"{m.role}: {m.content}" for m in r.prompt)
    for query, prompts in said.items():
        tokens = []
        while len(tokens) < g.max_new_tokens:
            block = model.next_logits([prompts[s] for s in sorted(prompts)], tokens)
            total = g.omega * block[0] + sum((row - row.max() for row in block[1:]), np.zeros(block.shape[1]))
            if int(total.argmax()) == model.end:
                break
            tokens.append(int(total.argmax()))
        assert got[query].tokens == tokens
    plain = chat_completion(streams.filter("stream_id = 0").select("query_id", "prompt"), g, model)
    assert all(r.text == " ".join(model.vocabulary[t] for t in r.tokens) for r in plain.collect())


def test_private_answers_over_the_tables(spark):
    got = queries.word_dp_chat(spark, SF).collect()
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").count()
    assert len(got) == asked and all(0 <= r.consistency <= 1 for r in got)
