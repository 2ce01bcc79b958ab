"""The library's queries over the driver's tables, each with the SQL for the same rows.

Floats are rounded to six places on both sides, as parallel sums come in no fixed order. Logit streams are the vectors
of a label, ten times as large; pairs of logits are neighbours by id; questions and answers are turns of conversations.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import accounting, text
from .functions.vectors import argmax, doubles, l2_norm
from .operators import aggregation, embedding, evaluation, measurement, prefilter, preparation, products, retrieval, throughput, utility
from .operators.ordering import shared_folder
from .operators.retrieval import RetrievalConfig
from .plans import learned, prompts
from .plans.chain import START, FrameChain, one_table
from .plans.providers import embedded
from .streaming import counters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
POINTS = (0.05, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95)
TOP_K = RetrievalConfig(top_k=20)
PAPER = RetrievalConfig(top_k=20, mode="paper")
TOP_P = RetrievalConfig(top_p=0.02, epsilon=0.5)
AGGREGATION = aggregation.AggregationConfig(token_epsilon=0.2192)
PLAIN = aggregation.AggregationConfig(token_epsilon=0.2192, differential_privacy=False)


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# --- retrieval -----------------------------------------------------------------------------------------------------
def one_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.agg(F.min_by("vec_id", "vec_id").alias("query_id"), F.min_by("embedding", "vec_id").alias("query_vector"))


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vector of each label."""
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.min("vec_id").alias("query_id"), F.min_by("embedding", "vec_id").alias("query_vector")).drop("label")


def scores(spark: SparkSession, sf_dir: str, asked=one_query) -> DataFrame:
    return retrieval.score(asked(spark, sf_dir), corpus(spark, sf_dir))


_SCORES = """q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
sc AS (SELECT query_id, e.vec_id AS doc_id, list_dot_product(q.qv::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings e, q)"""
_MANY = """q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
sc AS (SELECT query_id, e.vec_id AS doc_id, list_dot_product(q.qv::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings e, q)"""


@query(f"WITH {_SCORES} SELECT query_id, doc_id, round(score, 6) AS score FROM sc")
def score_all(spark, sf_dir):
    return scores(spark, sf_dir).withColumn("score", r6("score"))


@query(f"WITH {_SCORES}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC) AS p FROM sc) SELECT query_id, doc_id, round(score, 6) AS score FROM r WHERE score > (SELECT score FROM r WHERE p = 21)")
def retrieve_topk_nondp(spark, sf_dir):
    s = scores(spark, sf_dir)
    return retrieval.above(s, retrieval.top_k_threshold(s, 20)).withColumn("score", r6("score"))


_TOPP = """o AS (SELECT query_id, score AS s FROM sc UNION ALL SELECT query_id, min(score) FROM sc GROUP BY query_id UNION ALL SELECT query_id, max(score) FROM sc GROUP BY query_id),
w AS (SELECT query_id, s, exp(5.0 * (s - max(s) OVER (PARTITION BY query_id)) / (max(s) OVER (PARTITION BY query_id) - min(s) OVER (PARTITION BY query_id))) AS w FROM o),
u AS (SELECT query_id, s, -abs(sum(w) OVER (PARTITION BY query_id) * (1 - 0.3) - sum(w) OVER (PARTITION BY query_id ORDER BY s ROWS UNBOUNDED PRECEDING)) AS u FROM w),
t AS (SELECT query_id, s AS tau FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY u DESC, s) AS p FROM u) WHERE p = 1)"""


@query(f"WITH {_SCORES}, {_TOPP} SELECT sc.query_id, doc_id, round(score, 6) AS score FROM sc JOIN t ON sc.query_id = t.query_id WHERE score > tau")
def retrieve_topp_nondp(spark, sf_dir):
    s = scores(spark, sf_dir)
    return retrieval.above(s, retrieval.top_p_threshold(s, 0.3)).withColumn("score", r6("score"))


_CLIPPED = """o AS (SELECT query_id, least(greatest(s, -0.5), 0.8) AS s FROM (SELECT query_id, score AS s FROM sc UNION ALL SELECT DISTINCT query_id, unnest([-1.0, 1.0]) FROM sc)),
i AS (SELECT query_id, s, row_number() OVER w - 1 AS i, lead(s) OVER w AS nxt, count(*) OVER (PARTITION BY query_id) AS l, sum(exp(5.0 * (s - 0.8) / 1.3)) OVER (PARTITION BY query_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS m, sum(exp(5.0 * (s - 0.8) / 1.3)) OVER (PARTITION BY query_id) AS tm FROM o WINDOW w AS (PARTITION BY query_id ORDER BY s))"""


def _pdf(utility: str, epsilon: float) -> str:
    return f"""lw AS (SELECT query_id, s, {epsilon} / 2 * {utility} + ln(nxt - s) AS lw FROM i WHERE nxt > s),
pdf AS (SELECT query_id, s, exp(lw - max(lw) OVER (PARTITION BY query_id)) AS w FROM lw), pd AS (SELECT query_id, s, w / sum(w) OVER (PARTITION BY query_id) AS pdf FROM pdf)"""


_TOP_K_PDF, _TOP_P_PDF = _pdf("(-abs(l - 20 - i))", 0.1), _pdf("(-abs(tm * (1 - 0.02) - m))", 0.5)
_DRAW = f"""c AS (SELECT query_id, s, sum(pdf) OVER (PARTITION BY query_id ORDER BY s ROWS UNBOUNDED PRECEDING) / sum(pdf) OVER (PARTITION BY query_id) AS cdf FROM pd), u AS (SELECT unnest([{", ".join(map(str, POINTS))}])::DOUBLE AS u)
SELECT query_id, u, round(min(s), 6) AS threshold FROM c JOIN u ON cdf > u GROUP BY query_id, u"""


def _rounded_pdf(pdf: DataFrame) -> DataFrame:
    return pdf.select("query_id", r6("s").alias("s"), r6("pdf").alias("pdf"))


@query(f"WITH {_MANY}, {_CLIPPED}, {_TOP_K_PDF} SELECT query_id, round(s, 6) AS s, round(pdf, 6) AS pdf FROM pd")
def dp_topk_pdf(spark, sf_dir):
    return _rounded_pdf(retrieval.top_k_pdf(scores(spark, sf_dir, label_queries), TOP_K))


@query(f"WITH {_MANY}, {_CLIPPED}, {_pdf('(-abs(l - 2 - 20 - i + 1))', 0.1)} SELECT query_id, round(s, 6) AS s, round(pdf, 6) AS pdf FROM pd")
def dp_topk_pdf_paper(spark, sf_dir):
    return _rounded_pdf(retrieval.top_k_pdf(scores(spark, sf_dir, label_queries), PAPER))


@query(f"WITH {_MANY}, {_CLIPPED}, {_TOP_P_PDF} SELECT query_id, round(s, 6) AS s, round(pdf, 6) AS pdf FROM pd")
def dp_topp_pdf(spark, sf_dir):
    return _rounded_pdf(retrieval.top_p_pdf(scores(spark, sf_dir, label_queries), TOP_P))


def _points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u,) for u in POINTS], "u double")


@query(f"WITH {_SCORES}, {_CLIPPED}, {_TOP_K_PDF}, {_DRAW}")
def dp_topk_draw_u(spark, sf_dir):
    return retrieval.draw(retrieval.top_k_pdf(scores(spark, sf_dir), TOP_K), _points(spark)).withColumn("threshold", r6("threshold"))


@query(f"WITH {_SCORES}, {_CLIPPED}, {_TOP_P_PDF}, {_DRAW}")
def dp_topp_draw_u(spark, sf_dir):
    return retrieval.draw(retrieval.top_p_pdf(scores(spark, sf_dir), TOP_P), _points(spark)).withColumn("threshold", r6("threshold"))


@query()
def retrieve_dp_capped(spark, sf_dir):
    return products.retrieve(label_queries(spark, sf_dir), corpus(spark, sf_dir), RetrievalConfig(top_k=20, max_retrieve=10), seed=7)


@query(f"WITH {_SCORES}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC) AS p FROM sc), t AS (SELECT * FROM r WHERE score > (SELECT score FROM r WHERE p = 31)), c AS (SELECT query_id, doc_id, score, row_number() OVER (ORDER BY (doc_id * 7919 + 5) % 10007, doc_id)::INT AS place FROM t) SELECT query_id, doc_id, place, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM c WHERE place <= 10")
def retrieve_capped_u(spark, sf_dir):
    s = scores(spark, sf_dir)
    kept = retrieval.capped(retrieval.above(s, retrieval.top_k_threshold(s, 30)), 10, 0, F.pmod(F.col("doc_id") * 7919 + 5, F.lit(10007)))
    return retrieval.ranked(kept).select("query_id", "doc_id", "place", "rank")


@query(f"WITH {_MANY}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS p FROM sc), t AS (SELECT query_id, score AS tau FROM r WHERE p = 11) SELECT r.query_id, doc_id, round(score, 6) AS score FROM r JOIN t ON r.query_id = t.query_id WHERE score > tau")
def multi_query_topk(spark, sf_dir):
    s = scores(spark, sf_dir, label_queries)
    return retrieval.above(s, retrieval.top_k_threshold(s, 10)).withColumn("score", r6("score"))


# --- many queries --------------------------------------------------------------------------------------------------
def mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two queries for each vector: itself, and its components from the last to the first."""
    e = table(spark, sf_dir, "embeddings")
    each = F.explode(F.array(F.struct((F.col("vec_id") * 2).alias("query_id"), F.col("embedding").alias("query_vector")), F.struct((F.col("vec_id") * 2 + 1).alias("query_id"), F.reverse("embedding").alias("query_vector"))))
    return e.select(each.alias("q")).select("q.query_id", "q.query_vector")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


_MIRRORED = """q AS (SELECT vec_id * 2 AS query_id, embedding AS qv FROM embeddings UNION ALL SELECT vec_id * 2 + 1, list_reverse(embedding) FROM embeddings),
sc AS (SELECT query_id, e.vec_id AS doc_id, list_dot_product(q.qv::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings e, q)"""
_OF_QUERY = "(((query_id * 7919 + 5) % 10007 + 0.5) / 10007.0::DOUBLE)"


def of_query() -> Column:
    return (F.pmod(F.col("query_id") * 7919 + 5, F.lit(10007)) + 0.5) / F.lit(10007.0)


def _of_products(spark: SparkSession, sf_dir: str, asked: Callable[[SparkSession, str], DataFrame], c: RetrievalConfig) -> DataFrame:
    return products.retrieve(asked(spark, sf_dir), corpus(spark, sf_dir), c).withColumn("score", r6("score"))


def _above_rank(queries: str, rank: str) -> str:
    return f"WITH {queries}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS p FROM sc), t AS (SELECT query_id, score AS tau FROM r WHERE p = {rank}) SELECT r.query_id, doc_id, round(score, 6) AS score FROM r JOIN t ON r.query_id = t.query_id WHERE score > tau"


@query(_above_rank(_MANY, "11"))
def products_topk_few(spark, sf_dir):
    return _of_products(spark, sf_dir, label_queries, RetrievalConfig(top_k=10, differential_privacy=False))


@query(_above_rank(_MIRRORED, "11"))
def products_topk_many(spark, sf_dir):
    return _of_products(spark, sf_dir, mirrored, RetrievalConfig(top_k=10, differential_privacy=False))


@query(_above_rank(_MANY, "(SELECT count(*) // 2 + 1 FROM embeddings)"))
def products_topk_half(spark, sf_dir):
    half = table(spark, sf_dir, "embeddings").count() // 2
    return _of_products(spark, sf_dir, label_queries, RetrievalConfig(top_k=half, differential_privacy=False))


@query(f"WITH {_MIRRORED}, {_TOPP} SELECT sc.query_id, doc_id, round(score, 6) AS score FROM sc JOIN t ON sc.query_id = t.query_id WHERE score > tau")
def products_topp_many(spark, sf_dir):
    return _of_products(spark, sf_dir, mirrored, RetrievalConfig(top_p=0.3, differential_privacy=False))


def _drawn_for_each(queries: str, pdf: str) -> str:
    return f"""WITH {queries}, {_CLIPPED}, {pdf}, c AS (SELECT query_id, s, sum(pdf) OVER (PARTITION BY query_id ORDER BY s ROWS UNBOUNDED PRECEDING) / sum(pdf) OVER (PARTITION BY query_id) AS cdf FROM pd),
d AS (SELECT query_id, min(s) AS tau FROM c WHERE cdf > {_OF_QUERY} GROUP BY query_id)"""


@query(f"{_drawn_for_each(_MIRRORED, _TOP_K_PDF)} SELECT query_id, round(tau, 6) AS threshold FROM d")
def products_dp_topk_draw_u(spark, sf_dir):
    return products.Products(mirrored(spark, sf_dir), corpus(spark, sf_dir), TOP_K).thresholds(u=of_query()).withColumn("threshold", r6("threshold"))


@query(f"{_drawn_for_each(_MIRRORED, _pdf('(-abs(l - 20 - i))', 300.0))} SELECT sc.query_id, doc_id, round(score, 6) AS score FROM sc JOIN d ON sc.query_id = d.query_id WHERE score > tau")
def products_dp_topk_sharp(spark, sf_dir):
    sharp = products.Products(mirrored(spark, sf_dir), corpus(spark, sf_dir), RetrievalConfig(top_k=20, epsilon=300.0))
    return sharp.retrieved(u=of_query()).withColumn("score", r6("score"))


@query(f"{_drawn_for_each(_MANY, _TOP_P_PDF)} SELECT query_id, round(tau, 6) AS threshold FROM d")
def products_dp_topp_draw_u(spark, sf_dir):
    return products.Products(label_queries(spark, sf_dir), corpus(spark, sf_dir), TOP_P).thresholds(u=of_query()).withColumn("threshold", r6("threshold"))


@query(f"""{_drawn_for_each(_MANY, _TOP_K_PDF)}, o10 AS (SELECT sc.query_id, doc_id, score, row_number() OVER (PARTITION BY sc.query_id ORDER BY (doc_id * 7919 + 5) % 10007, doc_id)::INT AS place FROM sc JOIN d ON sc.query_id = d.query_id WHERE score > tau)
SELECT query_id, doc_id, round(score, 6) AS score, place FROM o10 WHERE place <= 10""")
def retrieve_dp_capped_u(spark, sf_dir):
    found = products.retrieve(label_queries(spark, sf_dir), corpus(spark, sf_dir), TOP_K, u=of_query())
    return retrieval.capped(found, 10, 0, F.pmod(F.col("doc_id") * 7919 + 5, F.lit(10007))).withColumn("score", r6("score"))


def _grid() -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: i / F.lit(999.0))


_GRID = "g AS (SELECT range / 999.0::DOUBLE AS tau FROM range(1000))"


@query(f"WITH {_SCORES}, {_GRID} SELECT query_id, round(tau, 6) AS tau, -abs(sum(CASE WHEN score > tau THEN 1 ELSE 0 END) - 7)::DOUBLE AS utility FROM sc, g GROUP BY query_id, tau")
def utility_curve_topk(spark, sf_dir):
    return retrieval.utility_curve(scores(spark, sf_dir), _grid(), k=7).withColumn("tau", r6("tau"))


@query(f"WITH {_SCORES}, {_GRID}, w AS (SELECT *, exp((least(greatest(score, 0.2), 0.9) - 0.9) / 0.7) AS w FROM sc) SELECT query_id, round(tau, 6) AS tau, round(-abs(sum(CASE WHEN score > tau THEN w ELSE 0 END) - 0.3 * sum(w)), 6) AS utility FROM w, g GROUP BY query_id, tau")
def utility_curve_topp(spark, sf_dir):
    return retrieval.utility_curve(scores(spark, sf_dir), _grid(), p=0.3).withColumns({"tau": r6("tau"), "utility": r6("utility")})


@query()
def document_vectors(spark, sf_dir):
    docs = embedding.bags(table(spark, sf_dir, "documents").select("doc_id", "text"))
    vectors = embedding.fit_bags(docs).embedded_bags(docs)
    return vectors.select("doc_id", F.transform("embedding", r6).alias("embedding"))


@query("SELECT vec_id, round(sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])), 6) AS norm FROM embeddings")
def embedding_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(l2_norm(F.col("embedding"))).alias("norm"))


@query("SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT min(doc_id) AS doc_id, text FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0) GROUP BY text")
def store_append(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieval.append(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"))


# --- generation ----------------------------------------------------------------------------------------------------
def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("_first"))
    public = F.when(F.col("vec_id") == F.col("_first"), F.lit(0).cast("long")).otherwise(F.col("vec_id") + 1)
    ten = F.transform(doubles("embedding"), lambda x: x * 10)
    return e.join(F.broadcast(first), "label").select(F.col("label").alias("query_id"), F.lit(0).alias("step"), public.alias("stream_id"), ten.alias("logits"))


_STREAMS = """s AS (SELECT label AS query_id, 0 AS step, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, [x::DOUBLE * 10 for x in embedding] AS l FROM embeddings),
z AS (SELECT *, [exp(x - list_max(l)) - 1 for x in l] AS x FROM s WHERE k > 0), c AS (SELECT *, [a - (list_max(x) + list_min(x)) / 2 for a in x] AS c FROM z),
n AS (SELECT *, list_max([abs(a) for a in c]) AS norm FROM c), f AS (SELECT *, CASE WHEN norm = 0 THEN 1.0 ELSE least(0.1096 / norm, 1.0) END AS scale FROM n)"""
_DP_TOKENS = """t AS (SELECT query_id, step, unnest(range(len(c))) AS token, unnest([a * scale for a in c]) AS x FROM f UNION ALL SELECT query_id, step, unnest(range(len(l))), unnest([a * 0.01 for a in l]) FROM s WHERE k = 0),
g AS (SELECT query_id, step, token, sum(x) AS logit FROM t GROUP BY ALL)"""


@query(f"WITH {_STREAMS}, {_DP_TOKENS} SELECT query_id, step, token::INT AS token, round(logit, 6) AS logit FROM g")
def dp_aggregate(spark, sf_dir):
    return aggregation.aggregated(streams(spark, sf_dir), AGGREGATION).withColumn("logit", r6("logit"))


_UNSHAPED = _STREAMS.replace("exp(x - list_max(l)) - 1", "x - list_max(l)")


@query(f"WITH {_UNSHAPED}, {_DP_TOKENS} SELECT query_id, step, token::INT AS token, round(logit, 6) AS logit FROM g")
def dp_aggregate_alpha_zero(spark, sf_dir):
    c = aggregation.AggregationConfig(token_epsilon=0.2192, alpha=0.0)
    return aggregation.aggregated(streams(spark, sf_dir), c).withColumn("logit", r6("logit"))


@query(f"WITH {_STREAMS}, t AS (SELECT query_id, step, unnest(range(len(l))) AS token, unnest([a - list_max(l) for a in l]) AS x FROM s WHERE k > 0 UNION ALL SELECT query_id, step, unnest(range(len(l))), unnest([a * 0.01 for a in l]) FROM s WHERE k = 0) SELECT query_id, step, token::INT AS token, round(sum(x), 6) AS logit FROM t GROUP BY query_id, step, token")
def nondp_aggregate(spark, sf_dir):
    return aggregation.aggregated(streams(spark, sf_dir), PLAIN).withColumn("logit", r6("logit"))


@query(f"WITH {_STREAMS} SELECT query_id, step, count(*) AS streams, round(min(norm), 6) AS norm_min, round(max(norm), 6) AS norm_max, round(min(norm * scale), 6) AS clipped_min, round(max(norm * scale), 6) AS clipped_max, round(sum(scale), 6) AS scale_sum FROM f GROUP BY query_id, step")
def clip_diagnostics(spark, sf_dir):
    d = aggregation.diagnostics(streams(spark, sf_dir), AGGREGATION)
    return d.select("query_id", "step", "streams", *[r6(c).alias(c) for c in ("norm_min", "norm_max", "clipped_min", "clipped_max", "scale_sum")])


@query(f"WITH {_STREAMS}, {_DP_TOKENS} SELECT query_id, step, token::INT AS token FROM (SELECT *, row_number() OVER (PARTITION BY query_id, step ORDER BY logit DESC, token) AS p FROM g) WHERE p = 1")
def greedy_token(spark, sf_dir):
    return aggregation.greedy_tokens(aggregation.aggregated(streams(spark, sf_dir), AGGREGATION))


@query(f"WITH {_STREAMS}, {_DP_TOKENS}, u AS (SELECT *, ((query_id * 7919 + token * 104729 + 13) % 10007 + 0.5) / 10007.0::DOUBLE AS u FROM g) SELECT query_id, step, token::INT AS token FROM (SELECT *, row_number() OVER (PARTITION BY query_id, step ORDER BY logit - ln(-ln(u)) DESC) AS p FROM u) WHERE p = 1")
def drawn_token(spark, sf_dir):
    u = (F.pmod(F.col("query_id") * 7919 + F.col("token") * 104729 + 13, F.lit(10007)) + 0.5) / F.lit(10007.0)
    return aggregation.drawn_tokens(aggregation.aggregated(streams(spark, sf_dir), AGGREGATION), 1.0, seed=3, u=u)


@query(
    f"""WITH {_STREAMS}, {_DP_TOKENS}, w AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY query_id, step)) / 0.5) AS w FROM g)
SELECT query_id, step, token::INT AS token, round(w / sum(w) OVER (PARTITION BY query_id, step), 6) AS probability FROM w"""
)
def token_probabilities(spark, sf_dir):
    return aggregation.token_probabilities(aggregation.aggregated(streams(spark, sf_dir), AGGREGATION), 0.5).withColumn("probability", r6("probability"))


@query(f"WITH {_STREAMS}, {_DP_TOKENS}, a AS (SELECT query_id, step, token::INT AS after FROM (SELECT *, row_number() OVER (PARTITION BY query_id, step ORDER BY logit DESC, token) AS p FROM g) WHERE p = 1), b AS (SELECT query_id, step, (list_position(l, list_max(l)) - 1)::INT AS before FROM s WHERE k = 0) SELECT query_id, step, before, after FROM a JOIN b USING (query_id, step)")
def argmax_before_and_after(spark, sf_dir):
    return aggregation.before_and_after(streams(spark, sf_dir), AGGREGATION)


UTILITY = utility.UtilityConfig(clip=0.1, epsilon=0.4, theta=0.5)
ALPHAS = (0.0, 1.0, math.inf)
_UTILITIES = f"""{_STREAMS}, h AS (SELECT query_id, step, k, l, list_max(l) AS top FROM s),
a AS (SELECT query_id, step, k, '0.0' AS alpha, [x - top for x in l] AS v FROM h WHERE k > 0
 UNION ALL SELECT query_id, step, k, '1.0', [exp(x - top) - 1 for x in l] FROM h WHERE k > 0
 UNION ALL SELECT query_id, step, k, 'Infinity', [CASE WHEN x = top THEN 0.0 ELSE -1.0 END for x in l] FROM h WHERE k > 0),
m AS (SELECT *, (list_max(v) + list_min(v)) / 2 AS mid, (list_max(v) - list_min(v)) / 2 AS half FROM a),
t AS (SELECT query_id, step, alpha, unnest(range(len(v))) AS token, unnest([(x - mid) * CASE WHEN half = 0 THEN 1.0 ELSE least(0.1 / half, 1.0) END for x in v]) AS x FROM m
 UNION ALL SELECT query_id, step, alpha, unnest(range(len(l))), unnest([0.5 * (x - top - ln(list_sum([exp(y - top) for y in l]))) for x in l]) FROM h, (VALUES ('0.0'), ('1.0'), ('Infinity')) q(alpha) WHERE k = 0),
u AS (SELECT query_id, step, alpha, token, sum(x) AS utility FROM t GROUP BY ALL)"""


def utilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utility.utilities(utility.sliced(streams(spark, sf_dir), 16), UTILITY, ALPHAS)


@query(f"WITH {_UTILITIES}, w AS (SELECT *, exp(2 * (utility - max(utility) OVER (PARTITION BY query_id, step, alpha))) AS w FROM u) SELECT query_id, step, alpha, token, round(utility, 6) AS utility, round(w / sum(w) OVER (PARTITION BY query_id, step, alpha), 6) AS probability FROM w")
def context_utilities(spark, sf_dir):
    found = utility.probabilities(utilities(spark, sf_dir), UTILITY)
    return found.select("query_id", "step", F.col("alpha").cast("string").alias("alpha"), "token", r6("utility").alias("utility"), r6("probability").alias("probability"))


@query(f"WITH {_UTILITIES}, d AS (SELECT *, ((query_id * 7919 + token * 104729 + 13) % 10007 + 0.5) / 10007.0::DOUBLE AS p FROM u) SELECT query_id, step, alpha, token FROM (SELECT *, row_number() OVER (PARTITION BY query_id, step, alpha ORDER BY 2 * utility - ln(-ln(p)) DESC, token) AS r FROM d) WHERE r = 1")
def context_token(spark, sf_dir):
    """The exponential mechanism over the same utilities."""
    p = (F.pmod(F.col("query_id") * 7919 + F.col("token") * 104729 + 13, F.lit(10007)) + 0.5) / F.lit(10007.0)
    return utility.drawn(utilities(spark, sf_dir), UTILITY, seed=3, u=p).withColumn("alpha", F.col("alpha").cast("string"))


_BEST = "row_number() OVER (PARTITION BY query_id, step ORDER BY {} DESC, token) AS p"


@query(
    f"""WITH {_STREAMS}, {_DP_TOKENS}, w AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY query_id, step)) / 0.5) AS w FROM g),
o AS (SELECT query_id, step, token, w / sum(w) OVER (PARTITION BY query_id, step) AS x FROM w)
SELECT 'before' AS tap, query_id, step, (list_position(l, list_max(l)) - 1)::INT AS token, round(list_max(l), 6) AS value FROM s WHERE k = 0
UNION ALL SELECT 'aggregate', query_id, step, token::INT, round(logit, 6) FROM (SELECT *, {_BEST.format("logit")} FROM g) WHERE p = 1
UNION ALL SELECT 'after', query_id, step, token::INT, round(x, 6) FROM (SELECT *, {_BEST.format("x")} FROM o) WHERE p = 1"""
)
def processor_chain(spark, sf_dir):
    """Best tokens before, in and after a chain of two steps, from one pass over the streams."""

    def best(value: str) -> Callable[[DataFrame], DataFrame]:
        top = F.max(F.struct(F.col(value).alias("value"), (-F.col("token")).alias("t"))).alias("b")
        return lambda rows: rows.groupBy("query_id", "step").agg(top).select("query_id", "step", (-F.col("b.t")).cast("int").alias("token"), r6("b.value").alias("value"))

    def public(rows: DataFrame) -> DataFrame:
        return rows.filter("stream_id = 0").select("query_id", "step", argmax(doubles("logits")).alias("token"), r6(F.array_max(doubles("logits"))).alias("value"))

    chain = FrameChain(
        {"aggregated": lambda rows: aggregation.aggregated(rows, AGGREGATION), "weighed": lambda rows: aggregation.token_probabilities(rows, 0.5)},
        {"before": (START, public), "aggregate": ("aggregated", best("logit")), "after": ("weighed", best("probability"))},
    )
    found = chain.run(streams(spark, sf_dir))
    return one_table({tap: found[tap] for tap in chain.taps}, ["query_id", "step", "token", "value"])


@query("WITH j AS (SELECT range AS j FROM range(71)), l AS (SELECT (2 * j - 70) * 0.1::DOUBLE AS loss, exp(lgamma(71) - lgamma(j + 1) - lgamma(71 - j) + j * ln(1 / (1 + exp(-0.1::DOUBLE))) + (70 - j) * ln(1 - 1 / (1 + exp(-0.1::DOUBLE)))) AS mass FROM j), e AS (SELECT range / 10.0::DOUBLE AS epsilon FROM range(71)) SELECT round(epsilon, 6) AS epsilon, round(sum(CASE WHEN loss > epsilon THEN mass * (1 - exp(epsilon - loss)) ELSE 0 END), 6) AS delta FROM l, e GROUP BY epsilon")
def pld_delta_curve(spark, sf_dir):
    losses = accounting.as_table(spark, accounting.pure(0.1, 70))
    grid = spark.range(71).select((F.col("id") / 10.0).alias("epsilon"))
    met = losses.crossJoin(F.broadcast(grid)).groupBy("epsilon").agg(accounting.delta_of(F.col("loss"), F.col("mass"), F.col("epsilon")).alias("delta"))
    return met.select(r6("epsilon").alias("epsilon"), r6("delta").alias("delta"))


def _binomial(name: str, epsilon: float, times: int) -> str:
    """SQL for the losses of a pure mechanism composed with itself."""
    logs = f"lgamma({times + 1}) - lgamma(j + 1) - lgamma({times + 1} - j)"
    p = f"(1 / (1 + exp(-{epsilon}::DOUBLE)))"
    return f"{name} AS (SELECT (2 * j - {times}) * {epsilon}::DOUBLE AS loss, exp({logs} + j * ln{p} + ({times} - j) * ln(1 - {p})) AS mass FROM (SELECT range AS j FROM range({times + 1})))"


_COMPOSED = f"""{_binomial("a", 0.2, 1)}, {_binomial("b", 0.1, 40)},
l AS (SELECT round(a.loss + b.loss, 6) AS loss, sum(a.mass * b.mass) AS mass FROM a, b GROUP BY 1)"""


def _composed() -> accounting.PrivacyLoss:
    return accounting.pure(0.2).compose(accounting.pure(0.1, 40))


@query(f"WITH {_COMPOSED} SELECT loss, round(mass, 9) AS mass FROM l")
def composed_losses(spark, sf_dir):
    return accounting.as_table(spark, _composed()).select(r6("loss").alias("loss"), F.round("mass", 9).alias("mass"))


@query(
    f"""WITH {_COMPOSED}, s AS (SELECT lag(loss) OVER (ORDER BY loss) AS low, loss AS high, sum(mass) OVER w AS m, sum(mass * exp(-loss)) OVER w AS e
FROM l WINDOW w AS (ORDER BY loss ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
d AS (SELECT unnest([0.1, 0.01, 0.001, 0.0001, 0.00001])::DOUBLE AS delta)
SELECT delta, round(ln((m - delta) / e), 5) AS epsilon FROM s, d WHERE m > delta AND ln((m - delta) / e) >= low AND ln((m - delta) / e) < high"""
)
def epsilon_for_delta(spark, sf_dir):
    loss = _composed()
    return spark.createDataFrame([(d, round(loss.epsilon(d), 5)) for d in (0.1, 0.01, 0.001, 0.0001, 0.00001)], "delta double, epsilon double")


@query("SELECT * FROM (VALUES (5.0::DOUBLE, 0.1277::DOUBLE, 0.06385::DOUBLE), (10.0, 0.2192, 0.1096), (20.0, 0.3644, 0.1822), (40.0, 0.5894, 0.2947)) t(epsilon, token_epsilon, clip)")
def token_budgets(spark, sf_dir):
    rows = []
    for e in prefilter.EPSILONS:
        own = accounting.token_epsilon(e, 1e-3, 128, accounting.pure(0.2), tolerance=1e-7)
        rows.append((e, round(own, 4), round(accounting.clip_bound(round(own, 4), 1.0), 5)))
    return spark.createDataFrame(rows, "epsilon double, token_epsilon double, clip double")


@query()
def stub_dp_chat(spark, sf_dir):
    from .plans.engine import Engine, GenerationConfig

    store = table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text")
    engine = Engine(store, RetrievalConfig(top_k=8, max_retrieve=4, epsilon=1.0), GenerationConfig(max_new_tokens=12))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return engine.chat(asked)


@query()
def stub_dp_summary(spark, sf_dir):
    from .plans.engine import Engine, GenerationConfig

    store = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    engine = Engine(store, RetrievalConfig(top_k=8, max_retrieve=4, epsilon=1.0), GenerationConfig(max_new_tokens=12))
    return engine.summary(table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), F.col("r_name").alias("query")))


@query()
def stub_completion(spark, sf_dir):
    from .plans.engine import GenerationConfig, chat_completion, text_completion

    g = GenerationConfig(max_new_tokens=12)
    said = text_completion(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), g).select("query_id", F.lit("text").alias("kind"), "text")
    dialogs = prompts.medical_dialogs(spark).select(F.col("dialog").cast("long").alias("query_id"), "prompt")
    return said.unionByName(chat_completion(dialogs, g).select("query_id", F.lit("chat").alias("kind"), "text"))


_WORDS_IN = f"[x for x in string_split_regex(lower(text), '{text.SPACE}+') if x <> '']"
_FOLLOWERS = f"""dw AS (SELECT {_WORDS_IN} AS w FROM documents WHERE text IS NOT NULL),
vo AS (SELECT *, row_number() OVER (ORDER BY n DESC, word)::INT AS id FROM (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM dw) GROUP BY word ORDER BY n DESC, word LIMIT 255)),
ids AS (SELECT id, word FROM vo UNION ALL SELECT 0, '<end>'),
ex AS (SELECT list_concat(['<end>'], w, ['<end>']) AS w FROM dw),
pa AS (SELECT a, b, count(*) AS n FROM (SELECT unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM ex) GROUP BY a, b),
fo AS (SELECT i.id AS last, j.id AS next, n FROM pa JOIN ids i ON a = i.word JOIN ids j ON b = j.word)"""


@query(f"WITH {_FOLLOWERS} SELECT last, next, n FROM fo")
def word_followers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return learned.followers(docs, "text", learned.vocabulary(docs, "text", 256))


@query(
    f"""WITH RECURSIVE {_FOLLOWERS}, co AS (SELECT id, n FROM vo UNION ALL SELECT 0, (SELECT sum(n) FROM fo WHERE last = 0)),
sh AS (SELECT id, (n + 1)::DOUBLE / (SELECT sum(n) + 256 FROM co) AS share FROM co), tt AS (SELECT last, sum(n) AS total FROM fo GROUP BY last),
pr AS (SELECT l.id AS last, s.id AS next, (coalesce(n, 0) + 2.0::DOUBLE * share) / (coalesce(total, 0) + 2.0::DOUBLE) AS p FROM ids l CROSS JOIN sh s LEFT JOIN fo ON fo.last = l.id AND fo.next = s.id LEFT JOIN tt ON tt.last = l.id),
bw AS (SELECT item_id, unnest({_WORDS_IN}) AS word FROM benchmark),
bc AS (SELECT item_id, id, count(*) AS n FROM bw JOIN vo USING (word) GROUP BY ALL), bt AS (SELECT item_id, sum(n) AS total FROM bc GROUP BY item_id),
ca AS (SELECT b.item_id, i.id, (coalesce(n, 0) + 1.0::DOUBLE / 256) / (coalesce(total, 0) + 1) AS c FROM benchmark b CROSS JOIN ids i LEFT JOIN bc ON bc.item_id = b.item_id AND bc.id = i.id LEFT JOIN bt ON bt.item_id = b.item_id),
st AS (SELECT item_id, 0 AS step, 0 AS last FROM benchmark
 UNION ALL SELECT item_id, step + 1, next FROM (SELECT st.item_id, st.step, pr.next, row_number() OVER (PARTITION BY st.item_id ORDER BY 0.7::DOUBLE * p + 0.3::DOUBLE * c DESC, pr.next) AS r FROM st JOIN pr ON pr.last = st.last JOIN ca ON ca.item_id = st.item_id AND ca.id = pr.next WHERE step < 6 AND (step = 0 OR st.last <> 0)) WHERE r = 1)
SELECT b.item_id AS query_id, coalesce(s.said, '') AS text FROM benchmark b LEFT JOIN (SELECT item_id, string_agg(word, ' ' ORDER BY step) AS said FROM st JOIN ids ON id = last WHERE step > 0 AND last <> 0 GROUP BY item_id) s USING (item_id)"""
)
def word_completion(spark, sf_dir):
    """Each benchmark text continued by the best six words of a model that is trained on all documents."""
    from .plans.engine import GenerationConfig, completed

    model = learned.train(table(spark, sf_dir, "documents"), "text", 256)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("asked"))
    return completed(asked, GenerationConfig(max_new_tokens=6, greedy=True), model).select("query_id", "text")


@query()
def word_dp_chat(spark, sf_dir):
    """Private answers to all benchmark texts, from documents retrieved by learned vectors, by a trained model, and how often
    the public prompt alone would have gone on in the same way."""
    from .operators.measurement import consistency
    from .plans.engine import Engine, GenerationConfig, aggregation_chain

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id")).filter("text is not null").select("doc_id", "text")
    engine = Engine(store, RetrievalConfig(top_k=8, max_retrieve=4, epsilon=1.0), GenerationConfig(max_new_tokens=12), embedding.fit(docs), learned.train(docs, "text", 256))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    said = engine.chat(asked, aggregation_chain(engine.generation))
    return said.select("query_id", "text", consistency(F.col("recorded")["before"], F.col("tokens")).alias("consistency"))


# --- pre-filters and measurement -------------------------------------------------------------------------------------
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    side = lambda odd, name: e.filter(F.pmod("vec_id", F.lit(2)) == odd).select(F.floor(F.col("vec_id") / 2).alias("query_id"), doubles("embedding").alias(name))
    return side(0, "logit_rag").join(side(1, "logit_norag"), "query_id").withColumn("step", F.pmod("query_id", F.lit(10)).cast("int"))


_PAIRS = """p AS (SELECT a.vec_id // 2 AS query_id, (a.vec_id // 2) % 10 AS step, a.embedding::DOUBLE[] AS r, b.embedding::DOUBLE[] AS n FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
ra AS (SELECT query_id, i, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, i) AS k FROM (SELECT query_id, unnest(r) AS x, unnest(range(len(r))) AS i FROM p)),
na AS (SELECT query_id, i, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, i) AS k FROM (SELECT query_id, unnest(n) AS x, unnest(range(len(n))) AS i FROM p)),
am AS (SELECT p.query_id, step, ra.i AS r, na.i AS n FROM p JOIN ra ON ra.query_id = p.query_id AND ra.k = 1 JOIN na ON na.query_id = p.query_id AND na.k = 1),
ks AS (SELECT unnest([10, 20, 50]) AS k), ov AS (SELECT ra.query_id, ks.k, count(*) AS n FROM ks JOIN ra ON ra.k <= ks.k JOIN na ON na.query_id = ra.query_id AND na.i = ra.i AND na.k <= ks.k GROUP BY ALL),
jc AS (SELECT am.query_id, step, am.n AS token_id, ks.k, coalesce(ov.n, 0)::DOUBLE / (2 * least(ks.k, 64) - coalesce(ov.n, 0)) AS j FROM am CROSS JOIN ks LEFT JOIN ov ON ov.query_id = am.query_id AND ov.k = ks.k),
ts AS (SELECT unnest([0.5, 0.7, 0.9, 1.0])::DOUBLE AS tau),
de AS (SELECT query_id, step, 'strategy_a' AS strategy, r = n AS consistent, n::INT AS token_id, CASE WHEN r = n THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM am
UNION ALL SELECT query_id, step, 'strategy_b_k' || k || '_tau' || tau, j >= tau, token_id::INT, j FROM jc, ts)"""


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurement.decisions(pairs(spark, sf_dir), prefilter.strategies())


@query(f"WITH {_PAIRS} SELECT query_id, step::INT AS step, consistent, token_id, score FROM de WHERE strategy = 'strategy_a'")
def strategy_a(spark, sf_dir):
    return measurement.decisions(pairs(spark, sf_dir), {"strategy_a": prefilter.same_argmax}).drop("strategy")


@query(f"WITH {_PAIRS} SELECT query_id, step::INT AS step, strategy, consistent, token_id, round(score, 6) AS score FROM de WHERE strategy <> 'strategy_a'")
def strategy_b_grid(spark, sf_dir):
    return decided(spark, sf_dir).filter("strategy != 'strategy_a'").withColumn("score", r6("score"))


@query(f"WITH {_PAIRS} SELECT query_id, k, round(j, 6) AS jaccard FROM jc")
def jaccard_topk(spark, sf_dir):
    p = pairs(spark, sf_dir)
    built = [F.struct(F.lit(k).alias("k"), r6(prefilter.top_k_jaccard(F.col("logit_rag"), F.col("logit_norag"), k)).alias("jaccard")) for k in prefilter.TOP_KS]
    return p.select("query_id", F.inline_outer(F.array(*built)))


@query("SELECT k, tau, round(2 * k * tau / (1 + tau), 6) AS overlap FROM (SELECT unnest([10, 20, 50]) AS k), (SELECT unnest([0.5, 0.7, 0.9, 1.0])::DOUBLE AS tau)")
def min_overlap(spark, sf_dir):
    rows = [(k, t) for k in prefilter.TOP_KS for t in prefilter.TAUS]
    return spark.createDataFrame(rows, "k int, tau double").withColumn("overlap", r6(prefilter.min_overlap(F.col("k"), F.col("tau"))))


@query(f"WITH {_PAIRS} SELECT strategy, round(avg(CASE WHEN consistent THEN 1.0 ELSE 0.0 END), 6) AS trigger_rate, round(avg(score), 6) AS mean_score, count(*) AS n_steps FROM de GROUP BY strategy")
def trigger_rates(spark, sf_dir):
    return measurement.trigger_rates(decided(spark, sf_dir)).withColumns({c: r6(c) for c in ("trigger_rate", "mean_score")})


@query(f"WITH {_PAIRS} SELECT step::INT AS step, strategy, round(avg(CASE WHEN consistent THEN 1.0 ELSE 0.0 END), 6) AS trigger_rate, round(avg(score), 6) AS mean_score, count(*) AS n_steps FROM de GROUP BY step, strategy")
def trigger_rates_by_step(spark, sf_dir):
    return measurement.trigger_rates(decided(spark, sf_dir), "step").withColumns({c: r6(c) for c in ("trigger_rate", "mean_score")})


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, hypothesis, reference: what the user says, and the next turn if it is the assistant's."""
    c = table(spark, sf_dir, "conversations")
    answers = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("hypothesis")).join(answers, ["conv_id", "turn"])


_SPACE = text.SPACE
_TURNS = f"""tu AS (SELECT a.conv_id, a.turn, a.text AS h, b.text AS r FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
tw AS (SELECT conv_id, turn, [x for x in string_split_regex(lower(h), '{_SPACE}+') if x <> ''] AS h, [x for x in string_split_regex(lower(r), '{_SPACE}+') if x <> ''] AS r FROM tu)"""
_MATCHES = "list_sum([CASE WHEN h[i] = r[i] THEN 1 ELSE 0 END for i in range(1, least(len(h), len(r)) + 1)])"
_RATE = f"CASE WHEN least(len(h), len(r)) > 0 THEN {_MATCHES}::DOUBLE / least(len(h), len(r)) ELSE 0.0 END"


def consistencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    return t.select("conv_id", "turn", measurement.consistency(text.words(F.col("hypothesis")), text.words(F.col("reference"))).alias("consistency"))


@query(f"WITH {_TURNS} SELECT conv_id, turn, round({_RATE}, 6) AS consistency FROM tw")
def consistency_rate(spark, sf_dir):
    return consistencies(spark, sf_dir).withColumn("consistency", r6("consistency"))


@query(f"WITH {_TURNS}, v AS (SELECT {_RATE} AS consistency FROM tw) SELECT count(*) AS n_queries, round(avg(consistency), 6) AS mean_consistency, round(median(consistency), 6) AS median_consistency FROM v")
def consistency_mean_median(spark, sf_dir):
    m = measurement.mean_and_median(consistencies(spark, sf_dir), "consistency")
    return m.select("n_queries", r6("mean_consistency").alias("mean_consistency"), r6("median_consistency").alias("median_consistency"))


@query(f"WITH {_TURNS} SELECT conv_id, turn, least(len(h), len(r))::INT AS n, array_to_string(h[:least(len(h), len(r))], ' ') AS a, array_to_string(r[:least(len(h), len(r))], ' ') AS b FROM tw")
def aligned_turns(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("s", measurement.aligned(text.words(F.col("hypothesis")), text.words(F.col("reference"))))
    return t.select("conv_id", "turn", "s.n", F.array_join("s.a", " ").alias("a"), F.array_join("s.b", " ").alias("b"))


@query(
    f"""WITH w AS (SELECT conv_id, turn, [x for x in string_split_regex(lower(text), '{_SPACE}+') if x <> ''][:8] AS w FROM conversations)
SELECT conv_id, turn, trim(repeat('<pad> ', (8 - len(w))::BIGINT) || array_to_string(w, ' ')) AS tokens, repeat('0', (8 - len(w))::BIGINT) || repeat('1', len(w)::BIGINT) AS mask FROM w"""
)
def padded_tokens(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("p", text.padded(text.words(F.col("text")), 8, "<pad>"))
    return c.select("conv_id", "turn", F.array_join("p.tokens", " ").alias("tokens"), F.array_join("p.mask", "").alias("mask"))


@query(
    f"""WITH RECURSIVE {_TURNS}, p AS (SELECT conv_id, turn, h, r, row_number() OVER () AS pair FROM tw),
d AS (SELECT pair, 0 AS i, unnest(range(len(r) + 1)) AS j, 0::BIGINT AS x FROM p
 UNION ALL SELECT pair, i + 1, j, max(own) OVER (PARTITION BY pair ORDER BY j)
 FROM (SELECT d.pair, d.i, d.j, CASE WHEN d.j > 0 AND h[d.i + 1] = r[d.j] THEN 1 + lag(x, 1, 0) OVER (PARTITION BY d.pair ORDER BY d.j) ELSE x END AS own FROM d JOIN p USING (pair) WHERE d.i < len(h))),
c AS (SELECT pair, max(x) AS common FROM d GROUP BY pair)
SELECT conv_id, turn, round(CASE WHEN len(h) + len(r) > 0 THEN 2.0::DOUBLE * common / (len(h) + len(r)) ELSE 0.0 END, 6) AS rouge_l FROM p JOIN c USING (pair)"""
)
def rouge_l(spark, sf_dir):
    t = turns(spark, sf_dir)
    return t.select("conv_id", "turn", r6(text.rouge_l(F.col("hypothesis"), F.col("reference"))).alias("rouge_l"))


@query("SELECT conv_id, turn, CASE WHEN len(w) > 0 AND w[-1] = 'the' THEN array_to_string(w[:-2], '|') ELSE array_to_string(w, '|') END AS tokens FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)")
def end_dropped(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(measurement.without_last(F.split("text", " "), "the"), "|").alias("tokens"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each pair, strategy and temperature; pairs of a query_id divisible by 7 have no documents."""
    d = decided(spark, sf_dir).select("query_id", "strategy", F.col("consistent").cast("double").alias("trigger"), F.col("score").alias("rouge_l"))
    temperatures = F.explode(F.array(*[F.lit(t) for t in prefilter.TEMPERATURES])).alias("temperature")
    return d.select("*", (F.pmod("query_id", F.lit(7))).alias("n_documents"), temperatures)


@query(f"WITH {_PAIRS}, r AS (SELECT *, query_id % 7 AS nd, unnest([0.1, 0.3, 0.5, 0.7])::DOUBLE AS temperature FROM de) SELECT temperature, strategy, count(*) AS n_queries, sum(CASE WHEN nd > 0 THEN 0 ELSE 1 END)::BIGINT AS n_zero_doc, round(coalesce(avg(CASE WHEN nd > 0 THEN CASE WHEN consistent THEN 1.0 ELSE 0.0 END END), 0), 6) AS mean_trigger, round(avg(score), 6) AS mean_rouge_l FROM r GROUP BY temperature, strategy")
def sweep_summary(spark, sf_dir):
    return measurement.sweep_summary(runs(spark, sf_dir)).withColumns({c: r6(c) for c in ("mean_trigger", "mean_rouge_l")})


@query(f"WITH {_MANY}, t AS (SELECT query_id, count(*) FILTER (WHERE score > 0.6 AND doc_id <> query_id) AS n FROM sc GROUP BY query_id) SELECT count(*) FILTER (WHERE n = 0) AS n_zero_doc, count(*) AS n_queries FROM t")
def zero_doc_count(spark, sf_dir):
    per = scores(spark, sf_dir, label_queries).groupBy("query_id").agg(F.count_if((F.col("score") > 0.6) & (F.col("doc_id") != F.col("query_id"))).alias("n"))
    return per.agg(F.count_if(F.col("n") == 0).alias("n_zero_doc"), F.count("*").alias("n_queries"))


# --- evaluation ------------------------------------------------------------------------------------------------------
def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return d.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("epsilon", F.lit("5.3"))


@query("SELECT lang AS kind, source AS item, epsilon, grouping(lang, source, epsilon)::BIGINT AS grain, count(*) AS n, sum(quality)::BIGINT AS successes FROM (SELECT d.lang, d.source, '5.3' AS epsilon, l.quality FROM documents d JOIN labels l USING (doc_id)) GROUP BY GROUPING SETS ((), (lang), (lang, source), (lang, epsilon), (lang, source, epsilon))")
def counter_grouping_sets(spark, sf_dir):
    return evaluation.grain_counts(observed(spark, sf_dir), "lang", "source", "epsilon", "quality")


@query("SELECT event_type AS kind, user_id AS item, epsilon, grouping(event_type, user_id, epsilon)::BIGINT AS grain, count(*) AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS successes FROM (SELECT event_type, user_id, '5.3' AS epsilon, value FROM events) GROUP BY GROUPING SETS ((), (event_type), (event_type, user_id), (event_type, epsilon), (event_type, user_id, epsilon))")
def counter_over_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "user_id", F.lit("5.3").alias("epsilon"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("success"))
    return evaluation.grain_counts(e, "event_type", "user_id", "epsilon", "success")


@query(ORACLE_SQL["counter_over_events"].replace("user_id AS item", "user_id::VARCHAR AS item"))
def counter_stream(spark, sf_dir):
    """The same counts kept by a stream over the table's files, which is started twice: the second time it finds nothing new."""
    path, place = f"{sf_dir}/events.parquet", f"{shared_folder(spark)}/counters-{uuid.uuid4().hex}"
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8).parquet(f"{path[:-1]}[t]")  # a pattern, as a stream takes no single file
    seen = events.select("event_type", "user_id", F.lit("5.3").alias("epsilon"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("success"))
    for _ in range(2):
        counters.keep_counts(seen, "event_type", "user_id", "epsilon", "success", f"{place}/totals", f"{place}/state").awaitTermination()
    return counters.counts(spark, f"{place}/totals")


@query("SELECT count(*) AS rows, count(*) AS vectors, count(*) * 64 AS components, true AS timed FROM documents")
def embedding_throughput(spark, sf_dir):
    """All documents embedded and written; what is counted comes from the job that writes them."""
    vectors = table(spark, sf_dir, "documents").select("doc_id", embedded(F.col("text")).alias("embedding"))
    meter = throughput.Meter({"vectors": F.count("embedding"), "components": F.sum(F.size("embedding"))})
    meter.of(vectors).write.parquet(f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}")
    told = meter.report()
    row = (told["rows"], told["vectors"], told["components"] or 0, told["rows_per_second"] > 0)
    return spark.createDataFrame([row], "rows long, vectors long, components long, timed boolean")


@query("SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source")
def disease_counts(spark, sf_dir):
    return observed(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))


@query("WITH i AS (SELECT source, length(bin(doc_id % 128 + 1)) AS part, count(*) AS n, sum(quality) AS s FROM documents JOIN labels USING (doc_id) GROUP BY ALL) SELECT CASE WHEN n >= 100 THEN '>=100' WHEN n >= 50 THEN '[50,100)' WHEN n >= 20 THEN '[20,50)' WHEN n >= 10 THEN '[10,20)' ELSE '[0,10)' END AS bucket, count(*) AS items, sum(n)::BIGINT AS n, sum(s)::BIGINT AS successes, round(sum(s) / sum(n), 6) AS accuracy FROM i GROUP BY bucket")
def bucket_accuracy(spark, sf_dir):
    part = F.length(F.bin(F.pmod("doc_id", F.lit(128)) + 1))
    per = observed(spark, sf_dir).groupBy("source", part.alias("part")).agg(F.count("*").alias("n"), F.sum("quality").alias("successes"))
    return evaluation.bucket_accuracy(per).withColumn("accuracy", r6("accuracy"))


@query("SELECT source AS item, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source")
def counter_json_keys(spark, sf_dir):
    """Counters written with JSON keys and read again."""
    o = observed(spark, sf_dir)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    key = lambda *p: evaluation.key_text(*[quoted(F.lit(x) if x in ("symptoms", "*") else F.col(x)) for x in p])
    keys = F.explode(F.array(F.lit("null"), key("*", "*"), key("symptoms", "*"), key("symptoms", "source"))).alias("key")
    return evaluation.item_totals(evaluation.parsed_keys(o.select(keys).groupBy("key").agg(F.count("*").alias("n"))), "symptoms")


@query("SELECT event_id FROM events WHERE event_id >= 100")
def remaining_rows(spark, sf_dir):
    return evaluation.remaining(table(spark, sf_dir, "events"), "event_id", 100).select("event_id")


@query("SELECT d.doc_id, contains(d.text, b.word) AS success FROM documents d, (SELECT min(split_part(text, ' ', 1)) AS word FROM benchmark) b")
def answer_success(spark, sf_dir):
    word = table(spark, sf_dir, "benchmark").agg(F.min(F.split_part("text", F.lit(" "), F.lit(1))).alias("word"))
    return table(spark, sf_dir, "documents").join(F.broadcast(word)).select("doc_id", F.contains("text", "word").alias("success"))


# --- data preparation ------------------------------------------------------------------------------------------------
_STRIP = f"regexp_replace(regexp_replace(text, '^{_SPACE}+', ''), '{_SPACE}+$', '')"


@query("SELECT (row_number() OVER (ORDER BY text, doc_id) - 1)::INT AS place, text FROM (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 50)")
def sorted_first(spark, sf_dir):
    return preparation.sorted_first(table(spark, sf_dir, "documents"), "doc_id", 50, "text")


@query(f"SELECT min(doc_id) AS place, {_STRIP} AS text FROM documents WHERE length({_STRIP}) > 0 GROUP BY {_STRIP}")
def corpus_strip_dedupe(spark, sf_dir):
    return preparation.distinct_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"SELECT min(doc_id) AS place, {_STRIP} AS text FROM documents WHERE length({_STRIP}) > 0 GROUP BY {_STRIP} ORDER BY place LIMIT 100")
def corpus_limit(spark, sf_dir):
    return preparation.first_n(preparation.distinct_texts(table(spark, sf_dir, "documents"), "doc_id", "text"), "place", 100)


@query()
def corpus_seeded_sample(spark, sf_dir):
    return preparation.seeded_sample(preparation.distinct_texts(table(spark, sf_dir, "documents"), "doc_id", "text"), "place", 50, 42).select("place", "ordinal", "draw", "text")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents")
def dense_ordinals(spark, sf_dir):
    return preparation.dense(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(f"SELECT c_custkey, regexp_replace(c_name, '{text.NOT_LETTERS}', '', 'g') AS letters, regexp_replace(c_name, '{text.NOT_ALNUM}', '', 'g') AS alnum FROM customer")
def name_clean(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.letters_only(F.col("c_name")).alias("letters"), text.alnum_only(F.col("c_name")).alias("alnum"))


@query("SELECT doc_id, contains(text, ' ') AND length(text) < 32 AS full_name, NOT (contains(text, 'fun') OR contains(text, 'Fun')) AS serious FROM documents")
def name_valid(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.is_full_name(F.col("text")).alias("full_name"), text.is_serious(F.col("text")).alias("serious"))


@query("""SELECT conv_id, turn, role || '|x ' || turn AS symptoms FROM conversations""")
def symptom_extract(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    said = F.concat(F.lit('Sure: ["'), F.col("role"), F.lit('", "x '), F.col("turn").cast("string"), F.lit('"] and so on'))
    return c.select("conv_id", "turn", F.array_join(text.json_list(said), "|").alias("symptoms"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 8 = 1)")
def anti_missing(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_orderkey % 8 = 1").select(F.col("o_custkey").alias("c_custkey"))
    return preparation.missing(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey")


@query("SELECT s_suppkey AS patient_id, s_name AS patient_name, n_name AS disease, r_name AS treatment FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def star_rows(spark, sf_dir):
    dims = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    dims = dims.select(F.col("n_nationkey").alias("disease"), "n_name", F.col("r_name").alias("treatment"))
    facts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("patient_id"), F.col("s_name").alias("patient_name"), F.col("s_nationkey").alias("disease"))
    return preparation.star_rows(facts, dims).select("patient_id", "patient_name", F.col("n_name").alias("disease"), "treatment")


@query("WITH w AS (SELECT n_name AS item, (n_nationkey + 1)::DOUBLE AS p FROM nation), c AS (SELECT item, sum(p) OVER (ORDER BY item ROWS UNBOUNDED PRECEDING) / sum(p) OVER () AS cdf FROM w), u AS (SELECT c_custkey, ((c_custkey * 7919) % 10007) / 10007.0::DOUBLE AS u FROM customer) SELECT c_custkey, min(item) AS item FROM u JOIN c ON cdf > u GROUP BY c_custkey")
def categorical_assign_u(spark, sf_dir):
    w = table(spark, sf_dir, "nation").select(F.col("n_name").alias("item"), (F.col("n_nationkey") + 1).cast("double").alias("probability"))
    u = F.pmod(F.col("c_custkey") * 7919, F.lit(10007)) / F.lit(10007.0)
    return preparation.categorical(table(spark, sf_dir, "customer").select("c_custkey"), w, u)


@query("WITH e AS (SELECT n_name, -ln(((n_nationkey * 7919 + 17) % 10007 + 0.5) / 10007.0::DOUBLE) AS e FROM nation) SELECT n_name, round(e / sum(e) OVER (), 6) AS probability FROM e")
def dirichlet_weights(spark, sf_dir):
    u = (F.pmod(F.col("n_nationkey") * 7919 + 17, F.lit(10007)) + 0.5) / F.lit(10007.0)
    drawn = preparation.dirichlet(table(spark, sf_dir, "nation").select("n_name", "n_nationkey"), "n_name", seed=5, u=u)
    return drawn.select("n_name", r6("probability").alias("probability"))


def _arithmetic(k: int) -> Column:
    return F.pmod(F.col("id") * 7919 + 104729 * k, F.lit(10007)) / F.lit(10007.0)


def _picked(words: list[str], k: int) -> str:
    return f"([{', '.join(map(_lit, words))}])[1 + floor((range * 7919 + {104729 * k}) % 10007 / 10007.0::DOUBLE * {len(words)})::INT]"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_HAIR = f"h AS (SELECT range AS doc_id, CASE WHEN range < 100 THEN 'Alice' ELSE {_picked(preparation.NAMES, 1)} END || ' has ' || CASE WHEN range < 100 THEN 'blue' ELSE {_picked(preparation.COLORS, 2)} END || ' hair.' AS text FROM range(1000))"


@query(f"WITH {_HAIR} SELECT doc_id, text FROM h")
def hair_colors(spark, sf_dir):
    return preparation.hair_colors(spark, 1000, seed=9, specific=100, draw=_arithmetic)


# --- prompts ---------------------------------------------------------------------------------------------------------
def _chat_sql(system: str, user: str) -> str:
    return f"'system: ' || {system} || chr(10) || 'user: ' || {user}"


def _written(prompt: Column) -> Column:
    """A prompt as one text, for the comparison."""
    return F.array_join(F.transform(prompt, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


@query(f"SELECT item_id AS query_id, 0::BIGINT AS stream_id, {_chat_sql(_lit(prompts.PUBLIC), 'text')} AS prompt FROM benchmark UNION ALL SELECT b.item_id, d.doc_id + 1, {_chat_sql(_lit(prompts.PER_DOCUMENT) + chr(32) + '|| d.text || ' + _lit(chr(34)), 'b.text')} FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id")
def prompt_public_private(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = table(spark, sf_dir, "documents").select(F.pmod("doc_id", F.lit(40)).alias("query_id"), (F.col("doc_id") + 1).alias("place"), "text")
    return prompts.fan_out(asked, found).withColumn("prompt", _written(F.col("prompt")))


@query(f"""WITH l AS (SELECT c.conv_id, string_agg('Document ' || n || ':' || chr(10) || '"' || text || '"', chr(10) || chr(10) ORDER BY n) AS d FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant') c GROUP BY c.conv_id)
SELECT u.conv_id, CASE WHEN l.d IS NULL THEN {_chat_sql(_lit(prompts.PUBLIC), 'u.text')} ELSE {_chat_sql(_lit(prompts.WITH_DOCUMENTS) + ' || chr(10) || l.d', 'u.text')} END AS prompt FROM conversations u LEFT JOIN l ON l.conv_id = u.conv_id WHERE u.turn = 0""")
def prompt_joined_docs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    found = c.filter("role = 'assistant'").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("documents"))
    asked = c.filter("turn = 0").join(found, "conv_id", "left")
    return asked.select("conv_id", _written(prompts.joined_documents(F.col("text"), F.coalesce("documents", F.array().cast("array<string>")))).alias("prompt"))


_WRITER = _lit(prompts.WRITER)


@query(f"""SELECT doc_id, {_chat_sql(_WRITER, "'Can you write a short text about the following topics:' || chr(10) || chr(34) || source || chr(34) || '?'")} AS public, {_chat_sql(_WRITER, "'Can you rephrase this document:' || chr(10) || chr(34) || text || chr(34) || '?' || chr(10) || 'Just output the text.'")} AS private FROM documents""")
def prompt_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", _written(prompts.summary(F.col("source"))).alias("public"), _written(prompts.summary(F.col("source"), F.col("text"))).alias("private"))


def _filled_sql(template: str) -> str:
    return "replace(replace(" + _lit(template) + ", '{c}', d.text), '{q}', 'What is it?')"


@query(" UNION ALL ".join(f"SELECT doc_id, {i}::INT AS variant, {_chat_sql(_filled_sql(s), _filled_sql(u))} AS prompt FROM documents d" for i, (s, u) in enumerate(prompts.VARIANTS)))
def prompt_variants(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("context"), F.lit("What is it?").alias("question"))
    return prompts.variants(p).select("doc_id", "variant", _written(F.col("prompt")).alias("prompt"))


@query(f"WITH {_HAIR} SELECT doc_id, {_chat_sql(_lit(prompts.ON_TEXT + '<text>') + " || text || '<text>'", _lit(prompts.HAIR_QUESTIONS[0]))} AS prompt FROM h")
def prompt_hair_dialogs(spark, sf_dir):
    d = prompts.hair_dialogs(preparation.hair_colors(spark, 1000, seed=9, specific=100, draw=_arithmetic))
    return d.select("doc_id", _written(F.col("prompt")).alias("prompt"))


@query(" UNION ALL ".join(f"SELECT {i}::INT AS dialog, {_chat_sql(_lit(prompts.ON_TEXT + ' ' * 12 + '<text>' + t + '<text>'), _lit(prompts.MEDICAL_QUESTION))} AS prompt" for i, t in enumerate(prompts.MEDICAL_TEXTS)))
def prompt_medical_dialogs(spark, sf_dir):
    return prompts.medical_dialogs(spark).select("dialog", _written(F.col("prompt")).alias("prompt"))


@query(" UNION ALL ".join(f"SELECT item_id, r_regionkey, {i}::INT AS variant, {_chat_sql(_filled_sql(s).replace('d.text', 'b.text').replace(_lit('What is it?'), 'r_name'), _filled_sql(u).replace('d.text', 'b.text').replace(_lit('What is it?'), 'r_name'))} AS prompt FROM benchmark b, region" for i, (s, u) in enumerate(prompts.VARIANTS)))
def prompt_crossed(spark, sf_dir):
    contexts = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("context"))
    asked = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("question"))
    return prompts.crossed(contexts, asked).select("item_id", "r_regionkey", "variant", _written(F.col("prompt")).alias("prompt"))


_SYMPTOMS = "n_name || ' pain, ' || r_name || ' ache'"


@query(f"""SELECT s_suppkey, {_chat_sql(_lit(prompts.REFORMULATE), f"'I am ' || s_name || ', I experience ' || {_SYMPTOMS}")} AS request,
{_chat_sql(_lit(prompts.REFORMULATE), f"'Given the symptoms (' || {_SYMPTOMS} || ') of ' || s_name || '. The diagnosis is ' || n_name || ', the treatment should be ' || r_name || '.'")} AS response
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def prompt_generation(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    symptoms = F.array(F.concat("n_name", F.lit(" pain")), F.concat("r_name", F.lit(" ache")))
    request = prompts.patient_request(F.col("s_name"), symptoms)
    response = prompts.doctor_response(F.col("s_name"), symptoms, F.col("n_name"), F.col("r_name"))
    return rows.select("s_suppkey", _written(request).alias("request"), _written(response).alias("response"))


@query("SELECT conv_id, 'I am experiencing the following symptoms: ' || string_agg(role || turn, ', ' ORDER BY turn, role) || '. What is my disease?' AS question FROM conversations GROUP BY conv_id")
def symptom_question(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("s"))
    return s.select("conv_id", preparation.question(F.transform("s", lambda x: F.concat(x["role"], x["turn"].cast("string")))).alias("question"))


@query("SELECT doc_id, replace(substring(text, 1, 80), chr(10), ' ') AS preview FROM documents")
def preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text"), 80).alias("preview"))


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    from .streaming.ingest import windowed_counts as run

    return run(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour", "10 minutes")
