import array
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hushgrid.llm import byte_pairs, centroids, repetitions
from hushgrid.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_multi_50k.tiktoken")
EXTRA = "doc_id long, text string, block long, place int, runs string, `a.b` int, DOC int"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, "r", 3, 4) for d, t in rows], EXTRA)


# --- byte pairs ------------------------------------------------------------------------------------------------------
def plain_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.vocabulary(PATH), special_tokens={})


def test_encoding_equals_the_library(spark, monkeypatch):
    monkeypatch.setattr(byte_pairs, "BLOCK", 4000)
    monkeypatch.setattr(byte_pairs, "ANSWERS", 50)
    rng = random.Random(5)
    letters = "abcdefghij  \n\t'’123äßñ漢字🙂́​\x00\x1c\x85"
    rows = [(i, "".join(rng.choices(letters, k=rng.randrange(0, 300)))) for i in range(60)]
    rows += [(100, ""), (101, None), (None, "no id"), (None, None), (5, rows[5][1]), (5, rows[5][1]), (102, "x" * 20_000 + " y" * 3000), (103, "<|endoftext|> it's I'LL    ")]
    rows += [(104, "".join(rng.choices("abcdefgh", k=60_000)))]  # one word with very many tokens
    own = plain_encoding()
    got = byte_pairs.decode(byte_pairs.encode(documents(spark, rows).repartition(3), PATH), PATH).collect()
    want = [(d, array.array("I", own.encode_ordinary(t or "")).tobytes(), (t or "").encode()) for d, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got), key=key) == sorted(want, key=key)
    assert all(r.n_tokens == len(r.ids) // 4 for r in got)
    assert byte_pairs.encode(documents(spark, []), PATH).count() == 0


def test_each_distinct_word_is_sent_once_for_a_block(spark):
    batches = documents(spark, [(1, "the cat the cat the"), (2, "the the")]).select("doc_id", "text").coalesce(1).mapInArrow(byte_pairs._cut(public_tokenizers.PATTERN), byte_pairs.BLOCKS)
    (block,) = batches.collect()
    assert [bytes(w) for w in block.words] == [b" the", b"the", b" cat"] and block.counts == [5, 2]
    assert byte_pairs.from_planes(block.places).tolist() == [1, 2, 0, 2, 0, 1, 0]


def test_blocks_stay_and_words_are_encoded_once(spark, capsys):
    rows = [(i, f"word{i % 3} and word{i % 5}") for i in range(50)]
    coded = byte_pairs.encode(documents(spark, rows).repartition(4), PATH)
    coded.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 2 and "Bucketed: true" in plan  # words to their task, answers to their block


def test_decoding_joins_the_table(spark):
    own, texts = plain_encoding(), ["It's 3 o'clock.", "", "漢字 🙂", "a" * 3000]
    rows = [(i, array.array("I", own.encode_ordinary(t)).tobytes(), 7, "x") for i, t in enumerate(texts)] + [(9, None, 7, "x"), (None, bytes(8), 7, "x")]
    coded = spark.createDataFrame(rows, "doc_id long, ids binary, `a.b` int, decoded string")
    found = byte_pairs.decode(coded, PATH)
    got = {r.doc_id: None if r.decoded is None else bytes(r.decoded) for r in found.collect()}
    assert found.columns == ["doc_id", "ids", "a.b", "decoded"]
    assert got == {**{i: t.encode() for i, t in enumerate(texts)}, 9: None, None: own.decode_bytes([0, 0])}
    with pytest.raises(Exception, match="vocabulary"):
        byte_pairs.decode(spark.createDataFrame([(1, array.array("I", [60_000]).tobytes())], "doc_id long, ids binary"), PATH).collect()


# --- runs ------------------------------------------------------------------------------------------------------------
def plain_runs(words):
    """All maximal runs of two periods or more, by comparing all words at each distance."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def words_of(rng):
    n, letters = rng.randrange(0, 70), rng.choice(["a", "ab", "abc", "abcdef"])
    words = [rng.choice(letters) for _ in range(n)]
    if n and rng.random() < 0.7:
        a = rng.randrange(n)
        p = rng.randrange(1, n - a + 1)
        words = words[:a] + (words[a : a + p] * n)[: n - a] + words[: rng.randrange(5)]
    return words


def test_runs_against_brute_force():
    rng = random.Random(3)
    batch = [[w.encode() for w in words_of(rng)] for _ in range(400)] + [[b"a"] * 500]
    older, newer = [b"a"], [b"a", b"b"]
    while len(newer) < 300:  # very many runs
        older, newer = newer, newer + older
    batch.append(newer)
    for words in batch:
        numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
        assert sorted(repetitions.maximal_runs(np.array([numbers[w] for w in words], np.int64)), key=lambda r: (r[0], r[2])) == plain_runs(words)
    assert repetitions.runs_of(batch) == [[r for r in plain_runs(w) if r[1] >= 12] for w in batch]


def test_leaves_are_paired_in_parts(monkeypatch):
    rng = random.Random(8)
    data = np.array([rng.randrange(2) for _ in range(400)], np.int64)
    whole = repetitions.branching(data).tolist()
    for n in (1, 7, 100, 1000):
        monkeypatch.setattr(repetitions, "LEAVES", n)
        assert repetitions.branching(data).tolist() == whole


def test_run_digests_by_definition(spark, monkeypatch):
    monkeypatch.setattr(repetitions, "WORDS", 300)
    rng = random.Random(4)
    rows = [(i, rng.choice([" ", "\t\x0b ", "\n"]).join(words_of(rng))) for i in range(150)]
    rows += [(200, ""), (201, None), (None, " ".join("abcab" * 6)), (None, None), (7, rows[7][1]), (202, "    " * 20), (203, " ".join(map(str, range(30_000))) + " x" * 5000)]
    want = []
    for doc, text in rows:
        words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ") if w]
        n, h = len(words), zlib.crc32(("" if doc is None else str(doc)).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = [r for r in plain_runs(words) if r[1] >= 12] if n < 5000 else [(30_000, 5000, 1)]
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        lines, kept = "".join(f"{a},{b},{c}\n" for a, b, c in runs), " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((doc, len(runs), s, length, q, 1000 * length // q if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    got = repetitions.run_digests(repetitions.periodic_runs(documents(spark, rows), repetitions.repeated_tail)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 and d < 150 for d in range(150))
    empty = repetitions.run_digests(repetitions.periodic_runs(documents(spark, [])))
    assert empty.count() == 0 and empty.columns == [f.name for f in spark.createDataFrame(got[:1]).schema]


# --- clusters --------------------------------------------------------------------------------------------------------
def plain_lloyd(rows, k, rounds, seed):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"{seed}:{rows[i][0]}".encode()).hexdigest(), rows[i][1]))
    cents = [list(rows[i][1]) for i in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in rows]

    for _ in range(rounds):
        owned = assign()
        for j in range(len(cents)):
            own = [v for (_, v), (_, o) in zip(rows, owned) if o == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own)]
    owned = assign()
    per = [sum(d for d, o in owned if o == j) for j in range(len(cents))]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, o, d, per[o], sum(per), name[o]) for (i, _), (d, o) in zip(rows, owned)), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "id long, vector array<long>, block long, `a.b` int, cluster int")


@pytest.mark.parametrize("rounds", [0, 1, 7, 60])
def test_clusters_against_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(centroids, "BLOCK", 64)
    rng = np.random.default_rng(rounds)
    points = [[int(x) for x in rng.integers(-60, 60, 3)] for _ in range(300)]
    rows = list(enumerate(points)) + [(400 + i, points[0]) for i in range(100)] + [(7, points[7]), (7, points[8]), (None, points[9]), (None, points[9])]
    got = centroids.delta_lloyd(vectors(spark, [*rows, (900, None)]).repartition(5), 3, 6, rounds, 3).collect()
    assert sorted(map(tuple, got), key=str) == plain_lloyd(rows, 6, rounds, 3)


def test_few_none_and_large(spark):
    few = [(1, [5, 5]), (2, [5, 5]), (3, [-9, 0])]
    assert sorted(map(tuple, centroids.delta_lloyd(vectors(spark, few), 2, 8, 4, 3).collect()), key=str) == plain_lloyd(few, 8, 4, 3)
    none = centroids.delta_lloyd(vectors(spark, [(1, None)]), 2, 8, 4, 3)
    assert none.count() == 0 and none.columns[0] == "vec_id"
    with pytest.raises(Exception, match="exact distances"):
        centroids.delta_lloyd(vectors(spark, [(1, [1 << 26, 0])]), 2, 8, 4, 3)
    large = [(i, [(1 << 26) - 1 - i * i, -(1 << 26) + 1 + 7 * i]) for i in range(40)]
    assert sorted(map(tuple, centroids.delta_lloyd(vectors(spark, large), 2, 4, 3, 3).collect()), key=str) == plain_lloyd(large, 4, 3, 3)


def test_rounds_compare_what_changed(spark):
    rng = np.random.default_rng(1)
    centers = rng.integers(-4000, 4000, (8, 5))
    rows = [(i, (centers[i % 8] + rng.integers(-40, 40, 5)).tolist()) for i in range(800)]
    run = centroids.Clustering(vectors(spark, rows), 5, [r[1] for r in rows[:3]] + [rows[3][1]] + [r[1] for r in rows[4:8]])
    run.assign()
    while run.move():
        run.assign()
        direct = np.array([0] * 8)
        for d, j in (min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(run.centroids.tolist())) for _, v in rows):
            direct[j] += 1
        assert run.counts == direct.tolist()
    assert run.pairs[0] == 800 * 8 and all(n <= 800 * 8 for n in run.pairs)
    run.changed = np.arange(0)
    run.assign()
    assert run.pairs[-1] == 0


def test_only_changed_centroids_are_compared():
    rng = np.random.default_rng(2)
    points, cents = rng.integers(-50, 50, (200, 4)), rng.integers(-50, 50, (6, 4))
    owners, distances, pairs = centroids.compared(points, cents, np.arange(6), None, None)
    assert pairs == 1200
    cents[[1, 4]] += 9
    again = centroids.compared(points, cents, np.array([1, 4]), owners, distances)
    whole = centroids.compared(points, cents, np.arange(6), None, None)
    assert (again[0] == whole[0]).all() and (again[1] == whole[1]).all()
    assert again[2] == 200 * 2 + int(np.isin(owners, [1, 4]).sum()) * 4


def test_whole_numbers(spark):
    rows = [(0, [0.5, -0.001]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("-inf"), 0.0]), (5, [1.0]), (6, [])]
    found = spark.createDataFrame(rows, "id long, embedding array<float>").select("id", centroids.whole_numbers(F.col("embedding"), 1024, 2).alias("v"))
    assert {r.id: r.v for r in found.collect() if r.v} == {0: [512, -2]}
