"""Chat prompts as columns: arrays of struct<role, content>."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The wording of the prompts.
PUBLIC = "You give a short response based on a predefined set documents."
PER_DOCUMENT = 'You give a short responses based on this document or a predefined set of similar documents.\nDocument:\n"'
WITH_DOCUMENTS = "You give a short responses based on these documents or a predefined set of similar documents."
WRITER = "You are a rephrasing writer."
TOPIC = 'Can you write a short text about the following topics:\n"{t}"?'
REPHRASE = 'Can you rephrase this document:\n"{t}"?\nJust output the text.'
REFORMULATE = "You reformulate the user sentence."
REQUEST = "I am {p}, I experience {s}"
RESPONSE = "Given the symptoms ({s}) of {p}. The diagnosis is {d}, the treatment should be {t}."
ON_TEXT = "You just give to the point responses and base them on this <text> only:\n"
MEDICAL_QUESTION = "In the <text> when the patient has red eyes. What is he diagnosed with?"
MEDICAL_TEXTS = (
    "The patient has symptoms. It is is diagnosed a Disease.",
    "The patient is Bob. He has empty eyes. He was diagnosed with Blocratis.",
    "The patient is Charles. He has red eyes. He was diagnosed with Avlablatosis.",
    "The patient is Donald. He has red eyes. He was diagnosed with Avlablatosis.",
    "The patient is Eve. She has red eyes. She was diagnosed with Avlablatosis.",
    "The patient is Florian. He has blue lips. He was diagnosed with Comodorosis.",
    "The patient is Gal. She has red eyes. She was diagnosed with Avlablatosis.",
    "The patient is Heidi. She has red eyes. She was diagnosed with Avlablatosis.",
    "The patient is Isabel. She has red eyes. She was diagnosed with Avlablatosis.",
)
HAIR_QUESTIONS = ("In the <text> What is the subject's hair color?", "In the <text> What is the subject's name?")
VARIANTS = (
    ("You are a helpful assistant.", 'Based on this document:\n"{c}"\n{q}'),
    ('You return information based only on this document or a restricted set of similar documents.\nDocument:\n"{c}"', "{q}"),
    ('You are a helpful assistant. You can use this document as context information:\n"{c}"', "{q}"),
    ('Extract and summarize information from this document or a predefined set of similar documents.\nDocument:\n"{c}"', "{q}"),
)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(system: Column, user: Column) -> Column:
    return F.array(message("system", system), message("user", user))


def public(question: Column) -> Column:
    return chat(F.lit(PUBLIC), question)


def per_document(question: Column, document: Column) -> Column:
    return chat(F.concat(F.lit(PER_DOCUMENT), document, F.lit('"')), question)


def joined_documents(question: Column, documents: Column) -> Column:
    """All documents under one system prompt, numbered from 1; the public prompt if there are none."""
    listed = F.array_join(F.transform(documents, lambda d, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(':\n"'), d, F.lit('"'))), "\n\n")
    return F.when(F.size(documents) > 0, chat(F.concat(F.lit(WITH_DOCUMENTS + "\n"), listed), question)).otherwise(public(question))


def _filled(template: str, **values: Column) -> Column:
    """The template with {name} replaced by the named columns."""
    parts = re.split(r"\{(\w)\}", template)
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if x])


def summary(topic: Column, document: Column | None = None) -> Column:
    """A writer's prompt: the public one on a topic, or that of a document."""
    return chat(F.lit(WRITER), _filled(TOPIC, t=topic) if document is None else _filled(REPHRASE, t=document))


def variants(pairs: DataFrame) -> DataFrame:
    """pairs (context, question, ..) with a row for each of the four wordings: variant, prompt."""
    q, c = F.col("question"), F.col("context")
    built = [F.struct(F.lit(i).alias("variant"), chat(_filled(s, q=q, c=c), _filled(u, q=q, c=c)).alias("prompt")) for i, (s, u) in enumerate(VARIANTS)]
    return pairs.select("*", F.explode(F.array(*built)).alias("_v")).select(*pairs.columns, "_v.*")


def crossed(contexts: DataFrame, questions: DataFrame) -> DataFrame:
    """variants() of each of contexts (context, ..) with each of questions (question, ..), which are few: Spark broadcasts
    them only if they are as small as its limit."""
    return variants(contexts.crossJoin(questions))


def patient_request(patient: Column, symptoms: Column) -> Column:
    """The prompt for what a patient with these symptoms (an array) says."""
    return chat(F.lit(REFORMULATE), _filled(REQUEST, p=patient, s=F.array_join(symptoms, ", ")))


def doctor_response(patient: Column, symptoms: Column, disease: Column, treatment: Column) -> Column:
    """The prompt for what the doctor answers."""
    return chat(F.lit(REFORMULATE), _filled(RESPONSE, p=patient, s=F.array_join(symptoms, ", "), d=disease, t=treatment))


def on_text(text: Column, question: Column, indent: str = "") -> Column:
    """A prompt that asks about one text alone."""
    return chat(F.concat(F.lit(f"{ON_TEXT}{indent}<text>"), text, F.lit("<text>")), question)


def medical_dialogs(spark: SparkSession) -> DataFrame:
    """dialog (from 0), prompt: short texts on patients, and the same question to all."""
    rows = F.posexplode(F.array(*[F.lit(t) for t in MEDICAL_TEXTS])).alias("dialog", "text")
    return spark.range(1).select(rows).select("dialog", on_text(F.col("text"), F.lit(MEDICAL_QUESTION), " " * 12).alias("prompt"))


def hair_dialogs(documents: DataFrame, specific: bool = False) -> DataFrame:
    """doc_id, prompt for documents (doc_id, text) on hair: the question is the colour, or the name."""
    return documents.select("doc_id", on_text(F.col("text"), F.lit(HAIR_QUESTIONS[specific])).alias("prompt"))


def summary_fan_out(queries: DataFrame, retrieved: DataFrame) -> DataFrame:
    """fan_out() with the writer's prompts: queries (query_id, query) are topics, and each document is to be rephrased."""
    own = queries.select("query_id", F.lit(0).cast("long").alias("stream_id"), summary(F.col("query")).alias("prompt"))
    private = retrieved.join(queries.select("query_id"), "query_id").select("query_id", F.col("place").cast("long").alias("stream_id"), summary(F.lit(None), F.col("text")).alias("prompt"))
    return own.unionByName(private)


def fan_out(queries: DataFrame, retrieved: DataFrame) -> DataFrame:
    """query_id, stream_id, prompt: stream 0 is the public prompt of each of queries (query_id, query), and each row of
    retrieved (query_id, place from 1, text) has a stream of its own."""
    own = queries.select("query_id", F.lit(0).cast("long").alias("stream_id"), public(F.col("query")).alias("prompt"))
    private = retrieved.join(queries, "query_id").select("query_id", F.col("place").cast("long").alias("stream_id"), per_document(F.col("query"), F.col("text")).alias("prompt"))
    return own.unionByName(private)
