"""Retrieval and private generation end to end."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.accounting import IDENTITY, PrivacyLoss, pure, token_epsilon
from ..operators.aggregation import AggregationConfig, aggregate_block
from ..operators.embedding import Projection
from ..operators.ordering import settled
from ..operators.prefilter import Strategy
from ..operators.preparation import missing
from ..operators.products import retrieve
from ..operators.retrieval import RetrievalConfig, lacking
from .chain import START, BlockChain, argmax, public_argmax
from .prompts import fan_out, joined_documents, public, summary_fan_out
from .providers import Scorer, embedded, provider


@dataclass(frozen=True)
class GenerationConfig:
    epsilon: float = 5.0
    delta: float = 1e-3
    max_new_tokens: int = 70
    temperature: float = 1.0
    alpha: float = 1.0
    omega: float = 0.01
    differential_privacy: bool = True
    greedy: bool = False

    def aggregation(self) -> AggregationConfig:
        own = token_epsilon(self.epsilon, self.delta, self.max_new_tokens)
        return AggregationConfig(own, self.temperature, self.alpha, self.omega, self.differential_privacy)

    def loss(self, c: AggregationConfig) -> PrivacyLoss:
        return pure(c.token_epsilon, self.max_new_tokens) if self.differential_privacy else IDENTITY


def _said(prompt: list[dict]) -> str:
    return "\n".join(f"{m['role']}: {m['content']}" for m in prompt)


def shipped(spark: SparkSession, model: str | Scorer) -> Callable[[], Scorer]:
    """What gives a task its model: the worker's own one of a name, or one that was trained, sent to each executor once."""
    if isinstance(model, str):
        return lambda: provider(model)
    told = spark.sparkContext.broadcast(model)
    return lambda: told.value


def aggregation_chain(g: GenerationConfig) -> BlockChain:
    """The aggregate alone, with the best tokens before it (of the public stream) and after it on record."""
    c = g.aggregation()
    return BlockChain({"aggregate": lambda block: aggregate_block(block, c)}, {"before": (START, public_argmax), "after": ("aggregate", argmax)})


def generate(prompts: DataFrame, g: GenerationConfig, model: str | Scorer = "hashed-scores", seed: int = 0, chain: BlockChain | None = None) -> DataFrame:
    """query_id, tokens, text, and ``recorded`` if a chain is given: a loop for each query over its streams (query_id,
    stream_id, prompt), at most max_retrieve + 1 of them; the token drawn from what the chain gives, by default the aggregate,
    continues all streams. Seed and query fix every draw.

    recorded is a map from tap to a token for each place of tokens; what taps see when the answer ends isn't kept. A chain is
    as private as its steps; its record isn't private at all, and only for measurements.
    """
    used = chain or BlockChain({"aggregate": aggregation_chain(g).steps["aggregate"]}, {})
    schema = "query_id long, tokens array<int>, text string" + (", recorded map<string, array<int>>" if chain else "")

    model_of_task = shipped(prompts.sparkSession, model)

    def run(key: tuple, streams: pa.Table) -> pa.Table:
        own = model_of_task()
        rows = sorted(zip(streams["stream_id"].to_pylist(), streams["prompt"].to_pylist(), strict=True), key=lambda r: r[0])
        asked = [_said(p) for _, p in rows]
        query = key[0].as_py()
        draws = np.random.default_rng([seed, (-1 if query is None else query) & (2**63 - 1)])
        tokens: list[int] = []
        record: dict[str, list[int]] = {tap: [] for tap in used.taps}
        while len(tokens) < g.max_new_tokens:
            logits = used(np.asarray(own.next_logits(asked, tokens), np.float64), record)
            if g.greedy:
                token = int(logits.argmax())
            else:
                token = int((logits / g.temperature - np.log(-np.log(draws.random(len(logits))))).argmax())
            if token == own.end:
                break
            tokens.append(token)
        out = {"query_id": pa.array([query], pa.int64()), "tokens": pa.array([tokens], pa.list_(pa.int32())), "text": pa.array([" ".join(own.vocabulary[t] for t in tokens)])}
        if chain:
            kept = [(tap, places[: len(tokens)]) for tap, places in record.items()]
            out["recorded"] = pa.array([kept], pa.map_(pa.string(), pa.list_(pa.int32())))
        return pa.table(out)

    return prompts.select(F.col("query_id").cast("long").alias("query_id"), "stream_id", "prompt").groupBy("query_id").applyInArrow(run, schema)


def completed(rows: DataFrame, g: GenerationConfig, model: str | Scorer = "hashed-scores", seed: int = 0) -> DataFrame:
    """query_id, tokens, text for rows (query_id, asked): each prompt by itself, without privacy and without others."""
    model_of_task = shipped(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of_task()
        for batch in batches:
            out: list[tuple] = []
            for query, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                draws, tokens = np.random.default_rng([seed, query & (2**63 - 1)]), []
                while len(tokens) < g.max_new_tokens:
                    logits = np.asarray(own.next_logits([asked], tokens)[0], np.float64)
                    token = int(logits.argmax()) if g.greedy else int((logits / g.temperature - np.log(-np.log(draws.random(len(logits))))).argmax())
                    if token == own.end:
                        break
                    tokens.append(token)
                out.append((query, tokens, " ".join(own.vocabulary[t] for t in tokens)))
            if out:
                kinds = [pa.int64(), pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["query_id", "tokens", "text"])

    return rows.select(F.col("query_id").cast("long").alias("query_id"), "asked").mapInArrow(run, "query_id long, tokens array<int>, text string")


def chat_completion(prompts: DataFrame, g: GenerationConfig, model: str | Scorer = "hashed-scores", seed: int = 0) -> DataFrame:
    """query_id, tokens, text: an answer to each of prompts (query_id, prompt), without what was asked."""
    said = F.array_join(F.transform("prompt", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return completed(prompts.select("query_id", said.alias("asked")), g, model, seed)


def text_completion(prompts: DataFrame, g: GenerationConfig, model: str | Scorer = "hashed-scores", seed: int = 0) -> DataFrame:
    """query_id, tokens, text: each of prompts (query_id, text) and how it goes on."""
    made = completed(prompts.select("query_id", F.col("text").alias("asked")), g, model, seed).withColumnRenamed("text", "more")
    return made.join(prompts.select(F.col("query_id").cast("long").alias("query_id"), "text"), "query_id").select("query_id", "tokens", F.concat_ws(" ", "text", F.expr("nullif(more, '')")).alias("text"))


def generated_until_complete(rows: DataFrame, folder: str, key: str, g: GenerationConfig, batch: int | None = None, model: str | Scorer = "hashed-scores", seed: int = 0) -> DataFrame:
    """rows (key: long, prompt) with the text that was generated for each, kept as Parquet in a folder that all machines
    share. Each round takes the rows that the folder lacks, at most batch of them, and adds their texts, so an
    interrupted run goes on where it was."""
    spark = rows.sparkSession
    empty = spark.createDataFrame([], f"{key} long, text string")
    empty.write.mode("append").parquet(folder)
    while True:
        done = spark.read.schema(empty.schema).parquet(folder)
        left = missing(rows, done, key)
        if left.isEmpty():
            return done
        left = left.orderBy(key).limit(batch) if batch else left
        made = chat_completion(left.select(F.col(key).alias("query_id"), "prompt"), g, model, seed)
        made.select(F.col("query_id").alias(key), "text").write.mode("append").parquet(folder)


def dual_logits(queries: DataFrame, retrieved: DataFrame, steps: int, model: str | Scorer = "hashed-scores", driver: str = "norag") -> DataFrame:
    """query_id, step, logit_rag, logit_norag: scores of a query (query_id, query) with all its retrieved texts and
    without, along the greedy answer of the driver, norag or rag."""
    if driver not in ("norag", "rag"):
        raise ValueError("driver must be norag or rag")
    found = retrieved.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]).alias("documents"))
    asked = queries.join(found, "query_id", "left").withColumn("documents", F.coalesce("documents", F.array().cast("array<string>")))
    asked = asked.select(F.col("query_id").cast("long").alias("query_id"), joined_documents(F.col("query"), F.col("documents")).alias("rag"), public(F.col("query")).alias("norag"))
    model_of_task = shipped(queries.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of_task()
        for batch in batches:
            out: list[tuple] = []
            for query, rag, norag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens: list[int] = []
                for step in range(steps):
                    with_, without = own.next_logits([_said(rag), _said(norag)], tokens)
                    out.append((query, step, with_.tolist(), without.tolist()))
                    token = int((with_ if driver == "rag" else without).argmax())
                    if token == own.end:
                        break
                    tokens.append(token)
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["query_id", "step", "logit_rag", "logit_norag"])

    return asked.mapInArrow(run, "query_id long, step int, logit_rag array<double>, logit_norag array<double>")


class Engine:
    """Documents are added to a store; questions are answered from what is retrieved, at a known loss of privacy each."""

    def __init__(self, store: DataFrame, retrieval: RetrievalConfig, generation: GenerationConfig, embedding: str | Projection = "hashed-words", model: str | Scorer = "hashed-scores", seed: int = 0):
        if retrieval.max_retrieve is None:
            retrieval = replace(retrieval, max_retrieve=100)
        self.store, self.retrieval, self.generation = store, retrieval, generation
        self.embedding, self.model, self.seed = embedding, model, seed
        spent = pure(retrieval.epsilon) if retrieval.differential_privacy else IDENTITY
        self.loss = spent.compose(generation.loss(generation.aggregation()))
        self.answers = 0
        self.vectors: DataFrame | None = None

    def add(self, new: DataFrame) -> None:
        """Adds (doc_id, text) rows whose text isn't in the store yet; only these are embedded."""
        fresh = settled(lacking(self.store, new))
        if self.vectors is not None:
            self.vectors = self.vectors.unionByName(self._embedded(fresh))
        self.store = self.store.select("doc_id", "text").unionByName(fresh)

    def _embedded(self, rows: DataFrame) -> DataFrame:
        return settled(self._vectors(rows, "text", "embedding").select("doc_id", "embedding"))

    def _vectors(self, rows: DataFrame, text: str, name: str) -> DataFrame:
        """rows with vectors of a text, by what was learned or by a provider."""
        if isinstance(self.embedding, Projection):
            return self.embedding.embedded(rows, text, name)
        return rows.withColumn(name, embedded(F.col(text), self.embedding))

    def epsilon_per_answer(self) -> float:
        return self.loss.epsilon(self.generation.delta)

    def epsilon_in_total(self) -> float:
        """By basic composition over the answers given so far."""
        return self.answers * self.epsilon_per_answer()

    def retrieved(self, queries: DataFrame) -> DataFrame:
        """query_id, place, text; texts are joined only to the rows that are left."""
        if self.vectors is None:
            self.vectors = self._embedded(self.store)
        asked = self._vectors(queries, "query", "query_vector").select("query_id", "query_vector")
        found = retrieve(asked, self.vectors, self.retrieval, self.seed)
        return found.join(self.store, "doc_id").select("query_id", "place", "text")

    def chat(self, queries: DataFrame, chain: BlockChain | None = None) -> DataFrame:
        """query_id, tokens, text for queries (query_id, query), and what a chain records. Answers count when they are asked
        for, whether or not they are computed; computed again they are the same, as the draws are."""
        self.answers += queries.count()
        return generate(fan_out(queries, self.retrieved(queries)), self.generation, self.model, self.seed, chain)

    def consistencies(self, queries: DataFrame) -> DataFrame:
        """query_id, n_tokens, sampled, greedy: how often the public stream's best token is the one that was drawn, and the
        aggregate's best. Not private: it tells how much retrieval changes."""
        from ..operators.measurement import consistency

        said = self.chat(queries, aggregation_chain(self.generation)).select("query_id", "tokens", F.col("recorded")["before"].alias("before"), F.col("recorded")["after"].alias("after"))
        return said.select("query_id", F.size("tokens").alias("n_tokens"), consistency(F.col("before"), F.col("tokens")).alias("sampled"), consistency(F.col("before"), F.col("after")).alias("greedy"))

    def summary(self, topics: DataFrame) -> DataFrame:
        """query_id, tokens, text: a private summary of what is retrieved for topics (query_id, query)."""
        self.answers += topics.count()
        return generate(summary_fan_out(topics, self.retrieved(topics)), self.generation, self.model, self.seed)

    def measured(self, queries: DataFrame, steps: int, strategies: dict[str, Strategy], driver: str = "norag") -> DataFrame:
        """Decisions of strategies along each query's answer."""
        from ..operators.measurement import decisions

        return decisions(dual_logits(queries, self.retrieved(queries), steps, self.model, driver), strategies)
