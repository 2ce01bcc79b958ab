"""The driver's queries over these operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edited_pairs

    return edited_pairs(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity, train

    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secrets

    return secrets(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score

    return score(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import removed

    return removed(table(spark, sf_dir, "documents"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .search import quantized, top_k

    rows = table(spark, sf_dir, "embeddings")
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), quantized(F.col("embedding"), 256).alias("vector"))
    return top_k(rows, rows.filter("id % 50 = 0"), 5)


def op7_piece_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import segment

    return segment(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge, labelled_urls, train

    return judge(table(spark, sf_dir, "pages"), train(labelled_urls(spark)))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .centroids import delta_lloyd, whole_numbers

    rows = table(spark, sf_dir, "embeddings")
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), whole_numbers(F.col("embedding"), 1024, 64).alias("vector"))
    return delta_lloyd(rows, dims=64, k=8, rounds=10, seed=3)


def op12_byte_pair_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .byte_pairs import decode, encode

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    coded = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repetitions import periodic_runs, repeated_tail, run_digests

    return run_digests(periodic_runs(table(spark, sf_dir, "documents"), repeated_tail))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_best_fit_packing,
        op3_url_filters,
        op4_lm_scoring,
        op5_secret_scans,
        op6_exact_top_k,
        op7_piece_segmentation,
        op8_toxicity,
        op9_suffix_dedup,
        op10_fingerprints,
        op11_centroid_clustering,
        op12_byte_pair_coding,
        op13_periodic_runs,
    )
}


def _secrets_sql() -> str:
    from .secrets import KINDS, PATTERNS, SCOPE

    weak, selects = KINDS.index("key_id"), []
    for kind, pattern in enumerate(PATTERNS):
        quoted = "'" + pattern.replace("'", "''") + "'"
        value = f"regexp_extract_all(text, {quoted}, 2)" if kind == 0 else "NULL::VARCHAR[]"
        selects.append(f"SELECT row, {kind} AS kind, string_split_regex(text, {quoted}) AS p, regexp_extract_all(text, {quoted}) AS m, {value} AS v FROM d WHERE regexp_matches(text, {quoted})")
    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    roles = {"id": (1, 3), "secret": (0, 2, 4)}
    beside = ", ".join(f"sum(CASE WHEN fine AND kind IN {kinds} THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY start RANGE BETWEEN {SCOPE} PRECEDING AND {SCOPE} FOLLOWING) > 0 AS {role}" for role, kinds in roles.items())
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
a AS ({" UNION ALL ".join(selects)}),
u AS (SELECT row, kind, unnest(range(1, len(m) + 1)) AS i, p, m, v FROM a),
s AS (SELECT row, kind, m[i] AS x, sum(length(p[i]) + length(m[i])) OVER (PARTITION BY row, kind ORDER BY i) AS stop, CASE kind WHEN 0 THEN length(v[i]) >= 6 WHEN 4 THEN length(m[i]) = 40 AND regexp_matches(m[i], '[a-z]') AND regexp_matches(m[i], '[A-Z]') AND regexp_matches(m[i], '[0-9]') ELSE TRUE END AS fine FROM u),
b AS (SELECT row, kind, stop - length(x) AS start, stop, fine FROM s),
c AS (SELECT row, kind, start, stop, fine AND (kind < {weak} OR coalesce(max(CASE WHEN fine AND kind < {weak} THEN stop END) OVER (PARTITION BY row ORDER BY start, kind ROWS UNBOUNDED PRECEDING) <= start, TRUE)) AS fine FROM b),
e AS (SELECT row, kind, start, stop, fine, {beside} FROM c),
f AS (SELECT row, kind, start, {name} || ':' || start || ':' || stop AS t FROM e WHERE fine AND CASE kind WHEN 3 THEN secret WHEN 4 THEN id WHEN 5 THEN id AND secret ELSE TRUE END),
g AS (SELECT row, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, string_agg(t, ',' ORDER BY start, kind) FILTER (WHERE kind < {weak}) AS base, string_agg(t, ',' ORDER BY start, kind) AS spans FROM f GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.row = d.row"""


def _clustering_sql(k: int = 8, rounds: int = 10) -> str:
    d = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v, c)])::BIGINT"
    parts = [
        """v AS (SELECT row_number() OVER () AS r, vec_id, [floor(x::DOUBLE * 1024)::BIGINT for x in embedding] AS v FROM embeddings
WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS j, v AS c FROM v QUALIFY j < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, v, min({{'d': {d}, 'j': j}}) AS b FROM v, c{i} GROUP BY r, vec_id, v)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT b.j AS j, p, sum(x) AS s, count(*) AS n FROM (SELECT b, unnest(range(64)) AS p, unnest(v) AS x FROM a{i}) GROUP BY ALL)")
            parts.append(f"m{i} AS (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS c FROM s{i} GROUP BY j)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.j AS j, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON m{i}.j = c{i}.j)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, b.j::INT AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.j))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON j = b.j"""


def _runs_sql(least: int = 12, gram: int = 6) -> str:
    crc = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], [ord(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')]), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))))"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {crc} AS h, [x for x in string_split_regex(coalesce(text, ''), '[ 	-
]+') if x <> ''] AS w FROM documents),
e AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM d), f AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
t AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [w[(CASE WHEN i < a THEN i ELSE a + (i - a) % p END)::BIGINT + 1] for i in range(n)] ELSE w END AS w FROM f),
g AS MATERIALIZED (SELECT r, unnest(range(n - {gram} + 1)) AS i, unnest([hash(w[i + 1 : i + {gram}]) for i in range(n - {gram} + 1)]) AS s FROM t WHERE n >= {least}),
x AS (SELECT a.r, a.i, b.i - a.i AS q FROM g a JOIN g b ON a.r = b.r AND a.s = b.s AND a.i < b.i),
y AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM x),
z AS (SELECT r, q, min(i) AS start, max(i) + {gram} - min(i) + q AS length FROM y GROUP BY r, q, k),
u AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM z WHERE length >= greatest({least}, 2 * q) GROUP BY r, start, length),
o AS (SELECT r, count(*) AS n_runs, max({{'length': length, 'start': -start, 'period': -period}}) AS b, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS l FROM u GROUP BY r),
c AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM u), k AS (SELECT r, list(i) AS gone FROM c GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -b.start AS start, b.length AS length, -b.period AS period, (1000 * b.length) // -b.period AS exponent_milli, sha256(coalesce(l, '')) AS runs_sha256,
sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce((SELECT string_agg(w[m.i + 1], ' ' ORDER BY m.i) FROM (SELECT unnest(range(t.n)) AS i) m WHERE NOT list_contains(gone, m.i)), '') END) AS collapsed_sha256
FROM t LEFT JOIN o USING (r) LEFT JOIN k USING (r)"""


ORACLE_SQL: dict[str, str] = {
    "op11_centroid_clustering": _clustering_sql(),
    "op13_periodic_runs": _runs_sql(),
    "op5_secret_scans": _secrets_sql(),
    "op1_ngram_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, [x for x in string_split_regex(lower(coalesce(text, '')), '[\x01-\x20]+') if x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = doc_id), doc_id)) AS class_id, (SELECT count(*) FROM e WHERE e.a = doc_id) AS n_links FROM documents""",
    "op6_exact_top_k": """WITH v AS (SELECT vec_id AS id, [floor(x::DOUBLE * 256) for x in embedding] AS v FROM embeddings),
p AS (SELECT a.id AS query_id, b.id AS vec_id, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p) WHERE rank <= 5""",
}
