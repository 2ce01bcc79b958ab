import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushgrid.llm import fingerprints, jaccard, suffixes
from hushgrid.llm.components import components
from hushgrid.llm.shingles import shingle_hashes

SCHEMA = "doc_id long, text string, source string, print string, row long, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def documents(spark, rows):
    """With extra columns, some of whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "s", "p", 7, len(t or "")) for d, t in rows], SCHEMA)


def corpus(seed=1):
    rng = random.Random(seed)
    rows = []
    for group in range(6):
        base = [rng.choice(WORDS) for _ in range(rng.choice([4, 60, 200]))]
        for _ in range(rng.choice([1, 3, 9])):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append(" ".join(words))
    rows += [rows[0]] * 4 + ["", None, "  ", "one two", "One  TWO", "é" * 300, "x" * 5000]
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


def brute(rows):
    sets = [frozenset(shingle_hashes(t or "").tolist()) for _, t in rows]
    parent, links = list(range(len(rows))), Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, least[root(i)], links[i]) for i, (d, _) in enumerate(rows))


def test_join_against_all_pairs(spark, monkeypatch):
    rows = corpus()
    got = jaccard.near_duplicates(documents(spark, rows)).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got)) == brute(rows)
    monkeypatch.setattr(jaccard, "BLOCK", 3)  # components over several blocks
    got = jaccard.near_duplicates(documents(spark, rows)).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got)) == brute(rows)
    kept = jaccard.one_of_each(documents(spark, rows + [rows[3]]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute(rows)})
    assert kept.columns == [x.split()[0] for x in SCHEMA.split(", ")]


def test_join_of_nothing_and_nulls(spark):
    assert jaccard.near_duplicates(documents(spark, [])).count() == 0
    got = jaccard.near_duplicates(documents(spark, [(None, "a b c"), (None, "a b c"), (3, "d")])).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == [("3", "3", 0), ("None", "None", 1), ("None", "None", 1)]
    assert jaccard.one_of_each(documents(spark, [(None, "a b c"), (None, "a b c"), (3, "d")])).count() == 2


def test_pruning_is_sound():
    assert jaccard.least_agreeing(30, 0.8, 1e-6) < 15
    for n in (30, 60, 150):
        m = jaccard.least_agreeing(n, 0.8, 1e-6)
        grid = np.linspace(0, 1, 200_001)[1:-1]
        weight = grid**m * (1 - grid) ** (n - m)
        assert weight[grid >= 0.8].sum() / weight.sum() >= 1e-6
        weight = grid ** (m - 1) * (1 - grid) ** (n - m + 1)
        assert weight[grid >= 0.8].sum() / weight.sum() < 1e-6


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    least = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert got == {k: v for k, v in least.items() if any(k in e and e[0] != e[1] for e in edges)}


def repeats(spark, rows, length):
    """Brute force: (doc_id, n_bytes, n_removed, n_spans, sha) of distinct rows in order: of equal ids by a hash."""
    keyed = documents(spark, rows).select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("k")).collect()
    order = {(r.doc_id, r.text): r.k for r in keyed}
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, order[r])):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for a, b in zip(b"\0" + gone, gone) if b and not a)
        out[(d, t)] = (d, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def passages():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcde é") for _ in range(n))
    shared, long = text(150), text(400)
    rows = [(i, text(rng.randrange(300)) + (shared if i % 3 else "") + text(50) + (long[i:] if i % 4 == 1 else "")) for i in range(24)]
    rows += [(30, "ab" * 200), (31, long + long), (32, None), (33, ""), (34, shared[:99]), (35, rows[2][1]), (2, rows[2][1]), (None, shared), (30, "ab" * 190), (36, text(3000) + shared)]
    return rows


def test_suffix_dedup_against_brute_force(spark, monkeypatch):
    rows = passages()
    want = repeats(spark, rows, 100)
    expected = sorted(str(want[r][:5]) for r in rows)
    assert sorted(str(tuple(r)) for r in suffixes.removed(documents(spark, rows)).collect()) == expected
    clean = suffixes.without_repeats(documents(spark, rows))
    assert clean.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    got = sorted((str(r.doc_id), r.text, r.n_chars) for r in clean.collect())
    texts = [(str(d), None if t is None else want[(d, t)][5].decode("utf-8", "ignore")) for d, t in rows]
    assert got == sorted(((d, t, len(t or "")) for d, t in texts), key=lambda r: (r[0], r[1] or "")) or sorted(map(str, got)) == sorted(str((d, t, len(t or ""))) for d, t in texts)
    assert suffixes.removed(documents(spark, [])).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    rng = np.random.default_rng(1)
    data = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (5000, 120, 50, 900)]
    whole = {}
    for _, text, first, last in suffixes.segments(data, 100):
        for t, a, b in zip(text.tolist(), first.tolist(), last.tolist()):
            for s in range(a, b + 1):
                assert (t, s) not in whole
                whole[t, s] = True
    assert len(whole) == sum(max(0, len(d) - 99) for d in data)


@pytest.mark.parametrize("sweeps", [0, 2, 40])
@pytest.mark.parametrize("depth", [1, 3, 7, 25, 100])
def test_longest_previous_factors(monkeypatch, depth, sweeps):
    monkeypatch.setattr(suffixes, "SWEEPS", sweeps)
    rng = np.random.default_rng(depth)
    data = np.concatenate([rng.integers(0, 3, 150, dtype=np.uint8), np.arange(40, dtype=np.uint8), np.zeros(60, np.uint8), rng.integers(0, 2, 60, dtype=np.uint8), np.arange(40, dtype=np.uint8)])
    text, common = data.tobytes(), np.zeros((len(data) + 1, len(data) + 1), int)
    for i in range(len(text) - 1, -1, -1):
        for j in range(i - 1, -1, -1):
            common[i, j] = common[i + 1, j + 1] + 1 if text[i] == text[j] else 0
    want = [min(depth, max(common[i, :i], default=0)) for i in range(len(text))]
    length, source = suffixes.longest_previous(data, depth)
    assert length.tolist() == want
    for i, (n, j) in enumerate(zip(length.tolist(), source.tolist())):
        assert (j == -1) if n == 0 else (j < i and text[j : j + n] == text[i : i + n])
    some = np.flatnonzero(rng.random(len(data)) < 0.5)
    length, _ = suffixes.longest_previous(data, depth, some)
    assert length.tolist() == [min(depth, max((common[i, j] for j in some if j < i), default=0)) for i in some]


def test_collided_keys_stay_apart():
    import pyarrow as pa

    left = pa.table({"key": [5, 5, 7, 5], "doc_id": [1, 2, None, 1], "text": ["a", "b", "c", "a"]})
    assert suffixes.numbered(left) == [(5, 0), (5, 1), (7, 0), (5, 0)]


def test_blocks_are_dealt_one_to_a_task(spark):
    from hushgrid.llm.common import block_of

    rows = spark.range(5000).withColumn("block", block_of(F.xxhash64("id"), 37)).repartition(37, "block").withColumn("at", F.spark_partition_id())
    got = rows.groupBy("block").agg(F.count_distinct("at").alias("p"), F.min("at").alias("at")).collect()
    assert len(got) == 37 and {r.p for r in got} == {1} and sorted(r.at for r in got) == list(range(37))


def test_fingerprints(spark):
    rows = corpus(2)
    got = {r.doc_id: r for r in fingerprints.edited_pairs(documents(spark, rows)).collect()}
    texts = {d: t or "" for d, t in rows}
    order = sorted(texts, reverse=True)
    assert sorted(got) == sorted(texts)
    for d, n in zip(order, order[1:] + order[:1]):
        t, k = texts[d], len(texts[d]) // 3
        edited = t[: len(t) - k] + texts[n][:k]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for other, near in ((edited, r.near_edited), (texts[n], r.near_next)):
            a, b = set(shingle_hashes(t).tolist()), set(shingle_hashes(other).tolist())
            exact = len(a & b) / len(a | b)
            # five standard errors of the bins that tell apart: no more than there are shingles
            assert abs(exact - near) < 5 * np.sqrt(exact * (1 - exact) / min(256, len(a | b))) + 0.02
        assert (r.fingerprint == got[n].fingerprint) == (r.near_next == 1.0)
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(documents(spark, rows)).collect()}
    assert plain == {d: r.fingerprint for d, r in got.items()}
    one = fingerprints.edited_pairs(documents(spark, [(5, "a b c d e f g h")])).first()
    assert one.near_next == 1.0
    assert fingerprints.edited_pairs(documents(spark, [])).count() == 0
    ties = fingerprints.edited_pairs(documents(spark, [(None, "x"), (4, "y"), (4, "y"), (4, None)])).collect()
    assert len(ties) == 4


@pytest.mark.parametrize("bits", [8, 4, 2, 1])
def test_estimates_are_unbiased(bits):
    maker, rng = fingerprints.Fingerprinter(bits=bits), np.random.default_rng(bits)
    found = []
    for _ in range(60):
        a = [f"v{i}" for i in rng.integers(0, 10**6, 300)]
        b = a[:200] + [f"v{i}" for i in rng.integers(0, 10**6, 100)]
        x, y = " ".join(a), " ".join(b)
        s, t = set(shingle_hashes(x).tolist()), set(shingle_hashes(y).tolist())
        found.append(maker.likeness(maker.packed(x), maker.packed(y)) - len(s & t) / len(s | t))
    assert abs(np.mean(found)) < 0.03
