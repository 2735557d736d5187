"""Batch answering: all planned queries of all requests, and evidence-only answers."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import paths as P
from ..functions import text as T
from ..operators import evidence as E
from ..operators.embed import embed_documents
from ..operators.hybrid import retrieve
from ..session import settle
from .requests import normalize_query_plan

# --- fixed values: texts given when no model can be asked ---------------------
NO_ANSWER = (
    "The local model is unavailable and no supporting evidence was retrieved "
    "for this request, so a grounded answer cannot be produced. Verify the "
    "repository is indexed and that the Ollama service is reachable, then retry."
)
ANSWER_OPENING = (
    "The local model is currently unavailable, so this is an evidence-only summary "
    "rather than a synthesized answer.\n\n"
    "The most relevant indexed locations for your request are:"
)
ANSWER_CLOSING = "Re-run once Ollama is reachable for a full, cited answer."
RESTORE_ACTION = (
    "Restore the model service",
    "Confirm the Ollama endpoint (OLLAMA_BASE_URL) is up and the configured model is pulled.",
    "The synthesizer requires a reachable local model to produce a grounded answer.",
)
INSPECT_RATIONALE = "It is the most relevant retrieved location for the request."
TRIAGE_OPENING = "The local model is unavailable; this is an evidence-only triage. "
TRIAGE_STEP = "Restore the Ollama model service and re-run the debug investigation."
REVIEW_OPENING = "The local model is unavailable; the diff could not be reviewed automatically."
REVIEW_IMPACT = "Unknown — automated review unavailable."
REVIEW_TEST = "Re-run the review once the model service is reachable."


class Answers(NamedTuple):
    """Tables of all requests: planned queries, merged evidence, numbered citations, packed context."""

    queries: DataFrame
    evidence: DataFrame
    citations: DataFrame
    context: DataFrame


def embed_queries(queries: DataFrame, name: str, on_error: str = "raise") -> DataFrame:
    """Adds ``query_vec`` with the embedder of the corpus; queries of the sparse strategy need none and get NULL."""
    needed = F.coalesce(F.col("strategy"), F.lit("hybrid")) != "sparse"
    dense = embed_documents(queries.where(needed), name, "query", "query_vec", on_error)
    sparse = queries.where(~needed).withColumn("query_vec", F.lit(None).cast(dense.schema["query_vec"].dataType))
    return dense.unionByName(sparse)


def batch_retrieve(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None,
                   max_chars: int = fv.CONTEXT_CHARS, scorer: Callable[[Column, Column], Column] | None = None) -> Answers:
    """Evidence, citations and packed context of every request.

    ``queries`` has request_id, query_id, query_no, query, query_vec, strategy, top_k, filter and, if a ``scorer``
    re-ranks, rerank: one row per planned query.  ``vectors`` has what filters use beside chunk_id and embedding; if
    it is missing, ``chunks`` has the embeddings.
    """
    ranked = settle(retrieve(queries, chunks, vectors, scorer=scorer), "retrieved")  # a few rows per query, read thrice
    found = E.attach_chunks(ranked, chunks).join(queries.select("query_id", "request_id", "query_no"), "query_id")
    evidence = E.merge_evidence(found)
    requests = queries.select("request_id").distinct()
    return Answers(queries, evidence, E.build_citations(evidence), E.pack_context(evidence, max_chars, requests))


def answer_requests(requests: DataFrame, chunks: DataFrame, embedder: str = "hash-32",
                    max_chars: int = fv.CONTEXT_CHARS, scorer: Callable[[Column, Column], Column] | None = None,
                    on_error: str = "raise") -> Answers:
    """From requests and their models' plans to evidence: plan, embed the queries, retrieve, merge, cite and pack.

    ``requests``: request_id, request, repository_ids, branch and plan (JSON text or NULL).  ``chunks``: a chunk
    table, as ``plans.indexing`` keeps it; where it has no embeddings they are made here with the same ``embedder``.
    Every request has a context, also where nothing was found.
    """
    planned = settle(embed_queries(normalize_query_plan(requests), embedder, on_error), "planned-queries")
    if "embedding" not in chunks.columns:
        chunks = settle(embed_documents(chunks, embedder, on_error=on_error), "embedded-chunks")
    return batch_retrieve(planned, chunks, None, max_chars, scorer)


def _with_citations(requests: DataFrame, citations: DataFrame) -> DataFrame:
    return requests.join(E.citation_list(citations), "request_id", "left").withColumn("__n", F.coalesce(F.size("citations"), F.lit(0)))


def evidence_only_answer(requests: DataFrame, citations: DataFrame) -> DataFrame:
    """An answer that only names the places found: request_id, answer, next_actions."""
    cited = _with_citations(requests.select("request_id"), citations)
    lines = F.transform(
        F.slice("citations", 1, 6),
        lambda c, i: F.concat(F.lit("- ["), (i + 1).cast("string"), F.lit("] "), c["repository"], F.lit(" · "),
                              P.location(c["file_path"], c["start_line"], c["end_line"])))
    text = F.concat(F.lit(ANSWER_OPENING + "\n"), F.array_join(lines, "\n"), F.lit("\n\n" + ANSWER_CLOSING))
    action = lambda t, d, r: F.struct(t.alias("title"), d.alias("detail"), r.alias("rationale"))
    restore = action(*[F.lit(x) for x in RESTORE_ACTION])
    top = F.col("citations")[0]
    inspect = action(
        F.concat(F.lit("Inspect "), top["file_path"]),
        F.concat(F.lit("Open "), P.location(top["file_path"], top["start_line"], top["end_line"]),
                 F.lit(" — the top-ranked evidence.")),
        F.lit(INSPECT_RATIONALE))
    some = F.col("__n") > 0
    return cited.select(
        "request_id", F.when(some, text).otherwise(F.lit(NO_ANSWER)).alias("answer"),
        F.when(some, F.array(restore, inspect)).otherwise(F.array(restore)).alias("next_actions"))


def debug_triage(requests: DataFrame, citations: DataFrame) -> DataFrame:
    """Places to look at for a bug report: summary, impacted_files, diagnostic_steps."""
    cited = _with_citations(requests.select("request_id"), citations)
    some = F.col("__n") > 0
    places = F.array_join(E.cited_locations(F.col("citations")), ", ")
    summary = F.when(some, F.concat(F.lit(TRIAGE_OPENING + "Most relevant locations: "), places, F.lit("."))).otherwise(
        F.lit(TRIAGE_OPENING + "No supporting evidence was retrieved."))
    reviews = F.transform(F.slice("citations", 1, 3), lambda c: F.concat(
        F.lit("Review "), P.location(c["file_path"], c["start_line"], c["end_line"]), F.lit(".")))
    return cited.select(
        "request_id", summary.alias("summary"),
        F.coalesce(F.transform(F.slice("citations", 1, 5), lambda c: c["file_path"]), T.empty_strings()).alias("impacted_files"),
        F.concat(F.array(F.lit(TRIAGE_STEP)), F.coalesce(reviews, T.empty_strings())).alias("diagnostic_steps"),
        F.lit("low").alias("confidence"))


def review_triage(requests: DataFrame, citations: DataFrame) -> DataFrame:
    """Areas a change touches: ``requests`` has request_id and diff."""
    cited = _with_citations(requests.select("request_id", "diff"), citations)
    places = F.array_join(E.cited_locations(F.col("citations")), ", ")
    summary = F.when(F.col("__n") > 0, F.concat(
        F.lit(REVIEW_OPENING + " Surrounding code of interest: "), places, F.lit("."))).otherwise(F.lit(REVIEW_OPENING))
    return cited.select(
        "request_id", summary.alias("summary"), F.lit(REVIEW_IMPACT).alias("impact"),
        F.when(~T.is_blank(F.col("diff")), F.lit("medium")).otherwise(F.lit("low")).alias("risk_level"),
        F.coalesce(F.transform(F.slice("citations", 1, 5), lambda c: c["file_path"]), T.empty_strings()).alias("affected_areas"),
        F.array(F.lit(REVIEW_TEST)).alias("suggested_tests"))
