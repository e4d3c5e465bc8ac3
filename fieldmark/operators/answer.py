"""Answers to questions: expansion by the session, retrieval within it or beyond, citations, prompt and generation in one flow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.text import asset_of, exact_terms, expand_query
from ..functions.vector import hash_embed
from ..functions.verdicts import generate_with, grounded_prompt
from .retrieval import LIMIT, citations, retrieve_or_widen
from .session import summary_of
from .term_index import TermIndex


def prepare(questions: DataFrame) -> DataFrame:
    """``questions(query_id, text, vector if known, and the columns of session.states)`` with what they are searched by: ``query`` (expanded), ``terms``,
    ``scope`` (the session's asset, unless the text names another) and ``context`` (the session's summary).

    Without a vector column queries are embedded by the hashing embedder.
    """
    named = asset_of(F.col("text"))
    rows = questions.withColumns({
        "query": expand_query(F.col("text"), F.col("component"), F.col("asset_id")),
        "scope": F.when(named.isNull() | (named == F.col("asset_id")), F.col("asset_id")),
        "context": summary_of(),
    })
    rows = rows.withColumn("terms", exact_terms(F.col("query")))
    return rows if "vector" in questions.columns else rows.withColumn("vector", hash_embed(F.col("query")))


def answer(questions: DataFrame, chunks: DataFrame, provider: Callable[[list[str]], list[str]], *, limit: int = LIMIT, terms: TermIndex | None = None, vectors: DataFrame | None = None, content: bool = True) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """(answers, evidence, citations) of ``questions`` (:func:`prepare`) over ``chunks``, of whose words ``terms`` is an index and whose vectors may be
    a table apart, ``vectors``. Without ``content`` evidence has no texts, and there are no answers, but None.

    Answers: query_id, query, widened (whether the session's scope gave nothing and all chunks were searched), used_context, prompt, answer. A
    question that finds nothing is put without excerpts. Evidence is what :func:`fieldmark.operators.session.kept_evidence` takes into the
    session's next state.
    """
    asked = prepare(questions)
    found = retrieve_or_widen(asked.select("query_id", "vector", "terms", "scope"), chunks, limit=limit, terms=terms, vectors=vectors, content=content)
    if not content:
        return None, found, citations(found)
    kind = "array<struct<source: string, document_id: string, content: string>>"
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "source", "document_id", "content"))), lambda c: F.struct(c["source"].alias("source"), c["document_id"].alias("document_id"), c["content"].alias("content")))
    gathered = found.groupBy("query_id").agg(ordered.alias("chunks"), F.max("widened").alias("widened"))
    rows = asked.select("query_id", "text", "query", "context").join(gathered, "query_id", "left")
    rows = rows.withColumn("prompt", grounded_prompt(F.col("text"), F.coalesce("chunks", F.array().cast(kind)), context=F.col("context")))
    answers = generate_with(rows, "prompt", provider, column="answer")
    return answers.select("query_id", "query", F.coalesce("widened", F.lit(False)).alias("widened"), (F.col("context") != "").alias("used_context"), "prompt", "answer"), found, citations(found)
