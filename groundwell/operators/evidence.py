"""From ranked rows to merged evidence, citations, packed context and prompts.

Rows per request are capped at twelve by the merge, so the ordered windows and
lists below are small whatever the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import paths as P
from ..functions import text as T

SPAN = ["repository_id", "file_path", "start_line", "end_line"]


def attach_chunks(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add text and place to ranked (query_id, chunk_id) rows."""
    columns = ["chunk_id", "text", "repository_id", "repo_name", "file_path", "symbol", "start_line", "end_line"]
    return ranked.join(chunks.select(*columns), "chunk_id")


def union_query_groups(*groups: DataFrame) -> DataFrame:
    """All rows of all groups, duplicates kept."""
    out = groups[0]
    for group in groups[1:]:
        out = out.unionByName(group)
    return out


def merge_evidence(found: DataFrame, cap: int = fv.MERGED_EVIDENCE_CAP, normalise: bool = False) -> DataFrame:
    """Evidence of a request from all of its queries.

    Per span the best score stays; the rest is ranked by score and cut at
    ``cap``.  Scores of different strategies are compared as they are, or
    scaled per query first with ``normalise``.  Ties go to the earlier query,
    the better rank, then the chunk id.
    """
    rows = found if "query_no" in found.columns else found.withColumn("query_no", F.lit(0))
    if normalise:
        per_query = rows.groupBy("request_id", "query_id").agg(F.min("score").alias("__lo"), F.max("score").alias("__hi"))
        flat = F.when(F.col("__hi") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
        scaled = F.when(F.col("__hi") - F.col("__lo") < fv.FLAT_SCORE_EPSILON, flat).otherwise(
            (F.col("score") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
        rows = rows.join(per_query, ["request_id", "query_id"]).withColumn("score", scaled).drop("__lo", "__hi")
    best = [F.desc("score"), F.asc("query_no"), F.asc("rank"), F.asc("chunk_id")]
    one = Window.partitionBy("request_id", *SPAN).orderBy(*best)
    ranked = rows.withColumn("__n", F.row_number().over(one)).where(F.col("__n") == 1)
    order = Window.partitionBy("request_id").orderBy(*best)
    return (
        ranked.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= cap)
        .withColumn("rank", F.col("__n") - 1).drop("__n")
    )


def build_citations(evidence: DataFrame, max_lines: int = fv.SNIPPET_LINES) -> DataFrame:
    """One numbered citation per distinct span, in rank order, with a short snippet."""
    one = Window.partitionBy("request_id", *SPAN).orderBy("rank")
    first = evidence.withColumn("__n", F.row_number().over(one)).where(F.col("__n") == 1)
    order = Window.partitionBy("request_id").orderBy("rank")
    return first.select(
        "request_id", F.row_number().over(order).alias("index"),
        P.repo_display(F.col("repo_name"), F.col("repository_id")).alias("repository"),
        "file_path", "start_line", "end_line",
        T.trim_snippet(F.col("text"), max_lines).alias("snippet"), F.round("score", 4).alias("score"))


def pack_context(evidence: DataFrame, max_chars: int = fv.CONTEXT_CHARS, requests: DataFrame | None = None) -> DataFrame:
    """One numbered text block per request that stays within a character budget.

    The first block that does not fit ends the text; it is cut to size if a
    meaningful piece still fits.  With ``requests``, requests without evidence
    get a row too.
    """
    budget = max(0, max_chars - fv.CONTEXT_SLACK)
    order = Window.partitionBy("request_id").orderBy("rank")
    header = P.evidence_header(
        F.col("__m"), P.repo_display(F.col("repo_name"), F.col("repository_id")),
        F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("symbol"))
    blocks = (
        evidence.withColumn("__m", F.row_number().over(order)).withColumn("__head", header)
        .withColumn("__body", T.strip_newlines(F.col("text")))
        .withColumn("__len", F.length("__head") + F.length("__body") + 3)
    )
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumn("__sum", F.sum("__len").over(upto))
    blocks = blocks.withColumn("__over", F.sum(F.when(F.col("__sum") > budget, 1).otherwise(0)).over(upto))
    room = budget - (F.col("__sum") - F.col("__len")) - F.length("__head") - 4
    cut = F.concat(F.col("__head"), F.lit("\n"), T.rstrip_space(F.expr("substring(__body, 1, cast(__room as int))")),
                   F.lit("\n… (truncated)"))
    whole = F.concat(F.col("__head"), F.lit("\n"), F.col("__body"))
    part = F.when(F.col("__over") == 0, whole).when(
        (F.col("__over") == 1) & (F.col("__room") > fv.CONTEXT_MIN_TAIL), cut)
    pieces = blocks.withColumn("__room", room).select("request_id", F.col("__m").alias("m"), part.alias("part"))
    packed = pieces.groupBy("request_id").agg(_joined(F.struct("m", "part"), "part", "\n\n").alias("context"))
    if requests is not None:
        packed = requests.select("request_id").join(packed, "request_id", "left")
    return packed.withColumn("context", F.coalesce(F.nullif("context", F.lit("")), F.lit(fv.NO_EVIDENCE)))


def _joined(item: Column, field: str, separator: str) -> Column:
    """Ordered text of a small group: struct items sort by their first field."""
    items = F.array_sort(F.collect_list(item))
    return F.array_join(F.transform(items, lambda x: x[field]), separator)


def evidence_block(citations: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """The numbered evidence part of a prompt, one row per request."""
    place = F.concat(
        F.lit("["), F.col("index").cast("string"), F.lit("] "), F.col("repository"), F.lit(":"), F.col("file_path"),
        F.lit(" (lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")"))
    block = F.concat(F.lit("\n"), place, F.lit("\n```\n"), F.col("snippet"), F.lit("\n```\n"))
    out = citations.select("request_id", "index", block.alias("block")).groupBy("request_id").agg(
        _joined(F.struct("index", "block"), "block", "").alias("evidence"))
    if requests is not None:
        out = requests.select("request_id").join(out, "request_id", "left")
    return out.withColumn("evidence", F.coalesce("evidence", F.lit(fv.NO_EVIDENCE)))


def history_tail(turns: DataFrame, limit: int = 6) -> DataFrame:
    """Last turns of each conversation as ``ROLE: text`` lines.

    ``turns``: conv_id, turn, role, text.  The literal limit lets every task
    drop all but the last turns before the shuffle.
    """
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = turns.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit)
    line = F.concat(F.upper("role"), F.lit(": "), T.oneline(F.col("text")))
    return last.select("conv_id", "turn", line.alias("line")).groupBy("conv_id").agg(
        _joined(F.struct("turn", "line"), "line", "\n").alias("history"))


def citation_list(citations: DataFrame) -> DataFrame:
    """Citations of a request as one ordered array column."""
    item = F.struct("index", "repository", "file_path", "start_line", "end_line", "snippet", "score")
    return citations.groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("citations"))


def ordered_distinct(values: Column, cap: int | None = None) -> Column:
    """First-seen order, optionally cut."""
    unique = F.array_distinct(values)
    return unique if cap is None else F.slice(unique, 1, cap)


def cited_locations(citations: Column, cap: int = 6) -> Column:
    return ordered_distinct(
        F.transform(citations, lambda c: P.location(c["file_path"], c["start_line"], c["end_line"])), cap)
