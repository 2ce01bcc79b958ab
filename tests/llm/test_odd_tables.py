"""All stages and pair operators on tables with clashing names, nulls, repeated rows, ties and a very long text."""

import math
import random

import pytest

from hushgrid.llm import fingerprints, jaccard, packing, secrets, suffixes, toxicity
from hushgrid.llm.common import plain
from hushgrid.llm.queries import tokenizer_path

NAMES = "doc_id long, text string, _print long, print string, _null boolean, null int, _salt int, key string, block int, whole string, clean string, row long, part int, low string, n_chars long, `a.b` string, `c``d` int, DOC_ID int, Text string, _c3 int"
BAD = "vile grotty scummy".split()


def rows_of():
    rng = random.Random(11)
    plain = [f"word{i}" for i in range(300)]
    long = " ".join(rng.choices(plain, k=60_000))
    texts = [" ".join(rng.choices(plain, k=60)) for _ in range(30)]
    texts += [f"{t} {rng.choice(BAD)} {rng.choice(BAD)} {rng.choice(BAD)}" for t in (" ".join(rng.choices(plain, k=20)) for _ in range(12))]
    rows = list(enumerate(texts)) + [(100, long), (101, long + " end"), (102, ""), (103, None), (None, "alone"), (None, None), (104, texts[3]), (5, texts[5])]
    return rows + [(5, texts[5])]


@pytest.fixture(scope="module")
def odd(spark):
    rows = rows_of()
    full = [(d, t, 7, "p", True, 1, 3, "k", 2, "w", "c", 9, 4, "L", len(t or ""), "dot", 5, 6, "T", 8) for d, t in rows]
    docs = spark.createDataFrame(full, NAMES)
    labels = spark.createDataFrame([(d, int(any(b in t for b in BAD))) for d, t in rows if d is not None and t and d < 100], "doc_id long, toxic int")
    return rows, docs, toxicity.train(docs, labels)


def others(rows):
    return {tuple(r[c] for c in "_print print _null null _salt key block whole clean row part low a.b c`d DOC_ID Text _c3".split()) for r in rows}


def test_stages_keep_columns(spark, odd):
    rows, docs, chain = odd
    toxic = {d for d, t in rows if t and any(b in t for b in BAD)}
    kept = toxicity.without_toxic(docs, chain).collect()
    ids = {r.doc_id for r in kept}
    assert {d for d, _ in rows} - toxic <= ids and len(ids & toxic) <= 2 and sum(r.doc_id == 5 for r in kept) == 3
    one = jaccard.one_of_each(docs).collect()
    assert sum(r.doc_id == 5 for r in one) == 1 and not {101, 103, 104} & {r.doc_id for r in one} and {100, 102} <= {r.doc_id for r in one}
    clean = suffixes.without_repeats(docs).collect()
    by = {r.doc_id: r for r in clean}
    assert len(clean) == len(rows) and by[103].text is None and by[104].text == "" and by[101].n_chars < 200 < by[100].n_chars
    hidden = secrets.redact(docs).collect()
    assert len(hidden) == len(rows) and {r.text for r in hidden} == {t for _, t in rows}
    for result in (kept, one, clean, hidden):
        assert [f for f in result[0].asDict()] == docs.columns and others(result) == {(7, "p", True, 1, 3, "k", 2, "w", "c", 9, 4, "L", "dot", 5, 6, "T", 8)}
    empty = docs.limit(0)
    for stage in (jaccard.one_of_each, suffixes.without_repeats, secrets.redact, lambda d: toxicity.without_toxic(d, chain)):
        found = stage(empty)
        assert found.columns == docs.columns and found.count() == 0


def test_ties_and_long_texts(spark, odd):
    rows, docs, chain = odd
    scores = [(r.doc_id, r.score) for r in toxicity.toxicity(docs, chain).collect()]
    assert len(scores) == len(rows) and len({s for d, s in scores if d in (5, 102, 103)}) == 1  # equal texts, and texts without toxic tokens
    likeness = {r.doc_id: r.near_next for r in fingerprints.edited_pairs(plain(docs).filter("doc_id in (100, 101)")).collect()}
    assert likeness[101] == likeness[100] > 0.9


def test_packing_leaves_little_room(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choices(["the", "cat", "sat", "on", "a", "mat"], k=rng.randrange(20, 1500)))) for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), tokenizer_path("byte_bpe_50k.json")).collect()
    least = math.ceil(sum(r.length for r in got) / 1024)
    assert least <= len({r.sequence_id for r in got}) <= 1.05 * least
