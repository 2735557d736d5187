"""Registered queries: evidence, citations, context, planned requests, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwell.operators import evidence as E
from groundwell.plans import answers as A
from groundwell.plans import requests as R

from . import inputs as I
from .text import replies

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


# --- every conversation as a request, its turns as evidence of two queries -------
def found(spark, sf):
    c, t = F.col("conv_id"), F.col("turn")
    s = lambda x: x.cast("string")
    return I.table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), s(c)).alias("request_id"), F.concat(F.lit("c"), s(c), F.lit("/"), s(t % 2)).alias("query_id"),
        (t % 2).alias("query_no"), t.alias("rank"), F.concat(F.lit("k"), s(c), F.lit("."), s(t)).alias("chunk_id"), "text",
        F.concat(F.lit("repo"), s(c % 5)).alias("repository_id"),
        F.when(c % 2 == 0, F.concat(F.lit("Name"), s(c % 5))).otherwise(F.lit("")).alias("repo_name"),
        F.concat(F.lit("f"), s(t % 4), F.lit(".md")).alias("file_path"), F.when(t % 3 == 0, F.lit("sym")).alias("symbol"),
        F.lit(1).cast("bigint").alias("start_line"), (t % 2 + 10).alias("end_line"),
        F.round((F.length("text") % 97) / F.lit(97.0), 6).alias("score"))


FOUND = """found AS (SELECT 'c' || conv_id AS request_id, 'c' || conv_id || '/' || (turn % 2) AS query_id, turn % 2 AS query_no, turn AS rank,
  'k' || conv_id || '.' || turn AS chunk_id, text, 'repo' || (conv_id % 5) AS repository_id, CASE WHEN conv_id % 2 = 0 THEN 'Name' || (conv_id % 5) ELSE '' END AS repo_name,
  'f' || (turn % 4) || '.md' AS file_path, CASE WHEN turn % 3 = 0 THEN 'sym' END AS symbol, 1 AS start_line, turn % 2 + 10 AS end_line,
  round(CAST((length(text) % 97) / 97.0 AS DOUBLE), 6) AS score FROM conversations)"""
MERGED = """best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY request_id, repository_id, file_path, start_line, end_line ORDER BY score DESC, query_no, rank, chunk_id) = 1),
merged AS (SELECT * REPLACE (row_number() OVER w - 1 AS rank) FROM best WINDOW w AS (PARTITION BY request_id ORDER BY score DESC, query_no, rank, chunk_id) QUALIFY row_number() OVER w <= 3)"""


def merged(spark, sf):
    return E.merge_evidence(found(spark, sf), 3)


@register("merge_evidence", f"WITH {FOUND}, {MERGED} SELECT request_id, chunk_id, rank, score FROM merged")
def merge_evidence(spark, sf):
    return merged(spark, sf).select("request_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), "score")


@register("union_query_groups", f"WITH {FOUND} SELECT request_id, chunk_id, query_no FROM found")
def union_query_groups(spark, sf):
    rows = found(spark, sf)
    return E.union_query_groups(rows.where("query_no = 0"), rows.where("query_no = 1")).select("request_id", "chunk_id", "query_no")


_SNIP = (f"CASE WHEN len({I.sql_lines('text')}) <= 2 THEN trim(text, chr(10)) ELSE regexp_replace(array_to_string(list_slice({I.sql_lines('text')}, 1, 2), chr(10)), '\\s+$', '')"
         f" || chr(10) || '… (+' || (len({I.sql_lines('text')}) - 2) || ' more lines)' END")
CITED = f"""cited AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS index, coalesce(nullif(repo_name, ''), repository_id) AS repository,
  file_path, start_line, end_line, {_SNIP} AS snippet, round(score, 4) AS score FROM merged)"""


@register("build_citations", f"WITH {FOUND}, {MERGED}, {CITED} SELECT * FROM cited")
def build_citations(spark, sf):
    return E.build_citations(merged(spark, sf), 2).withColumn("index", F.col("index").cast("bigint"))


_HEAD = "'[' || m || '] ' || coalesce(nullif(repo_name, ''), repository_id) || ' · ' || file_path || ':' || start_line || '-' || end_line || CASE WHEN symbol IS NULL THEN '' ELSE ' (' || symbol || ')' END"


@register("pack_context", f"""WITH {FOUND}, {MERGED}, b AS (SELECT *, rank + 1 AS m FROM merged), h AS (SELECT *, {_HEAD} AS head, trim(text, chr(10)) AS body FROM b),
l AS (SELECT *, sum(length(head) + length(body) + 3) OVER (PARTITION BY request_id ORDER BY rank) AS upto FROM h),
o AS (SELECT *, sum(CASE WHEN upto > 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY rank) AS over,
   1000 - (upto - (length(head) + length(body) + 3)) - length(head) - 4 AS room FROM l),
p AS (SELECT request_id, rank, CASE WHEN over = 0 THEN head || chr(10) || body WHEN over = 1 AND room > 80
   THEN head || chr(10) || regexp_replace(left(body, CAST(room AS BIGINT)), '\\s+$', '') || chr(10) || '… (truncated)' END AS part FROM o)
SELECT request_id, coalesce(string_agg(part, chr(10) || chr(10) ORDER BY rank), '(no evidence retrieved)') AS context FROM p GROUP BY 1""")
def pack_context(spark, sf):
    return E.pack_context(merged(spark, sf), 1200)


@register("evidence_block", f"""WITH {FOUND}, {MERGED}, {CITED} SELECT request_id, string_agg(chr(10) || '[' || index || '] ' || repository || ':' || file_path || ' (lines ' || start_line || '-' || end_line || ')'
  || chr(10) || '```' || chr(10) || snippet || chr(10) || '```' || chr(10), '' ORDER BY index) AS evidence FROM cited GROUP BY 1""")
def evidence_block(spark, sf):
    return E.evidence_block(E.build_citations(merged(spark, sf), 2))


@register("history_tail", """SELECT conv_id, string_agg(upper(role) || ': ' || trim(regexp_replace(text, '\\s+', ' ', 'g')), chr(10) ORDER BY turn) AS history
FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) GROUP BY 1""")
def history_tail(spark, sf):
    return E.history_tail(I.table(spark, sf, "conversations"))


LOC = "file_path || ':' || start_line || '-' || end_line"


@register("ordered_distinct", f"""WITH {FOUND}, {MERGED}, f AS (SELECT request_id, {LOC} AS loc, min(rank) AS r FROM merged GROUP BY 1, 2)
SELECT request_id, string_agg(loc, ', ' ORDER BY r) AS locations FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY r) <= 6) GROUP BY 1""")
def ordered_distinct(spark, sf):
    return E.citation_list(E.build_citations(merged(spark, sf))).select(
        "request_id", F.array_join(E.cited_locations(F.col("citations")), ", ").alias("locations"))


# --- answers without a model: requests of odd conversations have no evidence -----
def requests(spark, sf):
    c = F.col("conv_id")
    return I.table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last")).select(
        F.concat(F.lit("c"), c.cast("string")).alias("request_id"),
        F.when(c % 3 == 0, F.lit("diff --git a/x b/x")).when(c % 3 == 1, F.lit(" \n")).alias("diff"), c.alias("conv_id"))


def some_citations(spark, sf):
    odd = F.substring("request_id", 2, 20).cast("bigint") % 7 == 5
    return E.build_citations(merged(spark, sf).where(~odd), 2)


SOME = f"""{FOUND}, {MERGED}, {CITED}, reqs AS (SELECT DISTINCT 'c' || conv_id AS request_id, conv_id, CASE conv_id % 3 WHEN 0 THEN 'diff --git a/x b/x' WHEN 1 THEN ' ' || chr(10) END AS diff FROM conversations),
somec AS (SELECT c.*, {LOC} AS loc FROM cited c WHERE CAST(substr(request_id, 2) AS BIGINT) % 7 <> 5),
agg AS (SELECT request_id, string_agg('- [' || index || '] ' || repository || ' · ' || loc, chr(10) ORDER BY index) AS lines,
  string_agg(loc, ', ' ORDER BY index) AS locs, string_agg(file_path, ',' ORDER BY index) AS paths,
  string_agg('Review ' || loc || '.', '|' ORDER BY index) AS reviews, arg_min(file_path, index) AS top, arg_min(loc, index) AS top_loc FROM somec GROUP BY 1)"""


def _q(text):
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@register("evidence_only_answer", f"""WITH {SOME} SELECT request_id, CASE WHEN lines IS NULL THEN {_q(A.NO_ANSWER)} ELSE {_q(A.ANSWER_OPENING)} || chr(10) || lines || chr(10) || chr(10) || {_q(A.ANSWER_CLOSING)} END AS answer,
  {_q(A.RESTORE_ACTION[0])} || CASE WHEN lines IS NULL THEN '' ELSE '|Inspect ' || top END AS titles,
  CASE WHEN lines IS NULL THEN '' ELSE 'Open ' || top_loc || ' — the top-ranked evidence.' END AS detail FROM reqs LEFT JOIN agg USING (request_id)""")
def evidence_only_answer(spark, sf):
    out = A.evidence_only_answer(requests(spark, sf), some_citations(spark, sf))
    return out.select("request_id", "answer", F.array_join(F.transform("next_actions", lambda a: a["title"]), "|").alias("titles"),
                      F.coalesce(F.get(F.col("next_actions"), F.lit(1))["detail"], F.lit("")).alias("detail"))


@register("debug_triage", f"""WITH {SOME} SELECT request_id, {_q(A.TRIAGE_OPENING)} || CASE WHEN locs IS NULL THEN 'No supporting evidence was retrieved.' ELSE 'Most relevant locations: ' || locs || '.' END AS summary,
  coalesce(paths, '') AS impacted, {_q(A.TRIAGE_STEP)} || coalesce('|' || reviews, '') AS steps, 'low' AS confidence FROM reqs LEFT JOIN agg USING (request_id)""")
def debug_triage(spark, sf):
    return A.debug_triage(requests(spark, sf), some_citations(spark, sf)).select(
        "request_id", "summary", F.array_join("impacted_files", ",").alias("impacted"), F.array_join("diagnostic_steps", "|").alias("steps"), "confidence")


@register("review_triage", f"""WITH {SOME} SELECT request_id, {_q(A.REVIEW_OPENING)} || CASE WHEN locs IS NULL THEN '' ELSE ' Surrounding code of interest: ' || locs || '.' END AS summary,
  CASE WHEN conv_id % 3 = 0 THEN 'medium' ELSE 'low' END AS risk_level, coalesce(paths, '') AS areas FROM reqs LEFT JOIN agg USING (request_id)""")
def review_triage(spark, sf):
    return A.review_triage(requests(spark, sf), some_citations(spark, sf)).select(
        "request_id", "summary", "risk_level", F.array_join("affected_areas", ",").alias("areas"))


# --- planned requests -------------------------------------------------------------
def planned(spark, sf):
    i = F.col("item_id")
    q = lambda text, strategy, k, flt: F.to_json(F.struct(text.alias("query"), F.lit(strategy).alias("strategy"), k.alias("top_k"), flt.alias("filter")))
    none = F.lit(None).cast("struct<file_types:array<string>>")
    own = F.struct(F.array(F.lit("py")).alias("file_types"))
    items = F.concat(F.lit("["), F.concat_ws(",", q(F.col("text"), "Sparse ", F.lit(99), none), q(F.lit("  "), "dense", F.lit(1), none),
                     q(F.concat(F.lit("second "), i.cast("string")), "poetry", (i % 7).cast("int"), own),
                     q(F.lit("third"), "dense", F.lit(None).cast("int"), none), q(F.lit("fifth"), "dense", F.lit(3), none)), F.lit("]"))
    plan = F.when(i % 4 == 3, F.lit(None).cast("string")).when(i % 4 == 2, F.lit('{"queries": []}')).otherwise(
        F.concat(F.lit('{"filter": {"path_prefix": " src/ ", "chunk_types": ["code", "ode"]}, "queries": '), items, F.lit("}")))
    return I.table(spark, sf, "benchmark").select(
        F.concat(F.lit("r"), i.cast("string")).alias("request_id"), F.col("text").alias("request"),
        F.array(F.concat(F.lit("src"), (i % 5).cast("string"))).alias("repository_ids"), F.lit("main").alias("branch"), plan.alias("plan"))


PLANNED = """SELECT 'r' || item_id AS request_id, no AS query_no, CASE no WHEN 0 THEN trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) WHEN 2 THEN 'second ' || item_id WHEN 3 THEN 'third' ELSE 'fifth' END AS query,
  CASE no WHEN 0 THEN 'sparse' WHEN 2 THEN 'hybrid' ELSE 'dense' END AS strategy, CASE no WHEN 0 THEN 99 WHEN 2 THEN greatest(1, item_id % 7) WHEN 3 THEN 8 ELSE 3 END AS top_k,
  'src' || (item_id % 5) AS repos, 'main' AS branch, CASE WHEN no = 2 THEN 'py' END AS file_types, CASE WHEN no <> 2 THEN 'src/' END AS path_prefix,
  CASE WHEN no <> 2 THEN 'code' END AS chunk_types, false AS fallback FROM benchmark, (VALUES (0), (2), (3), (4)) v(no) WHERE item_id % 4 < 2"""
FALLBACK = """SELECT 'r' || item_id AS request_id, 0 AS query_no, text AS query, 'hybrid' AS strategy, 8 AS top_k, 'src' || (item_id % 5) AS repos, 'main' AS branch,
  CAST(NULL AS VARCHAR) AS file_types, CAST(NULL AS VARCHAR) AS path_prefix, CAST(NULL AS VARCHAR) AS chunk_types, true AS fallback FROM benchmark WHERE item_id % 4 >= 2"""


def _plan_rows(df):
    return df.select("request_id", F.col("query_no").cast("bigint").alias("query_no"), "query", "strategy", F.col("top_k").cast("bigint").alias("top_k"),
                     F.array_join("filter.repository_ids", ",").alias("repos"), F.col("filter.branch").alias("branch"),
                     F.array_join("filter.file_types", ",").alias("file_types"), F.col("filter.path_prefix").alias("path_prefix"),
                     F.array_join("filter.chunk_types", ",").alias("chunk_types"), "fallback")


@register("normalize_query_plan", f"{PLANNED} UNION ALL {FALLBACK}")
def normalize_query_plan(spark, sf):
    return _plan_rows(R.normalize_query_plan(planned(spark, sf)))


@register("fallback_query", FALLBACK)
def fallback_query(spark, sf):
    asked = planned(spark, sf)
    return _plan_rows(R.fallback_query(asked, R.normalize_query_plan(asked).where(~F.col("fallback"))))


# --- requests with a model's plan, or none, answered from the windows of all documents ---
def asked(spark, sf):
    """Three planned queries per benchmark text, one per strategy and with filters of their own; every fourth has no plan."""
    i = F.col("item_id")
    plan = lambda strategy, k, flt: F.struct(F.col("text").alias("query"), F.lit(strategy).alias("strategy"), F.lit(k).alias("top_k"), flt.alias("filter"))
    kind = "struct<file_types:array<string>,path_prefix:string,chunk_types:array<string>>"
    flt = lambda types, prefix, kinds: F.struct(types.alias("file_types"), prefix.alias("path_prefix"), kinds.alias("chunk_types")).cast(kind)
    none = F.lit(None)
    queries = F.to_json(F.struct(F.array(
        plan("hybrid", 8, flt(none, none, none)), plan("sparse", 5, flt(F.array(F.lit("md")), none, none)),
        plan("dense", 4, flt(none, F.lit("en/1"), F.array(F.lit("markdown"))))).alias("queries")))
    return I.table(spark, sf, "benchmark").select(
        F.concat(F.lit("r"), i.cast("string")).alias("request_id"), F.col("text").alias("request"),
        F.when(i % 5 == 0, F.array(F.lit("src1"), F.lit("src2"), F.lit("src3"))).alias("repository_ids"), F.lit("main").alias("branch"),
        F.when(i % 4 < 3, queries).alias("plan"))


ASKED = f"""{I.DOC_WINDOWS}, pq AS (SELECT 'r' || item_id || '/' || no AS query_id, 'r' || item_id AS request_id, no AS query_no, text AS query, no, item_id % 5 = 0 AS narrow,
  (item_id % 5 = 0) || '/' || no AS scope_id, CASE no WHEN 0 THEN 'hybrid' WHEN 1 THEN 'sparse' ELSE 'dense' END AS strategy, CASE no WHEN 0 THEN 8 WHEN 1 THEN 5 ELSE 4 END AS k
  FROM benchmark, (VALUES (0), (1), (2)) v(no) WHERE item_id % 4 < 3 OR no = 0),
scopes AS (SELECT DISTINCT scope_id, no, narrow FROM pq),
admitted AS MATERIALIZED (SELECT scope_id, c.chunk_id, c.text FROM scopes, chunks c WHERE (NOT narrow OR repository_id IN ('src1', 'src2', 'src3')) AND branch = 'main'
  AND (no <> 1 OR language = 'markdown') AND (no <> 2 OR (starts_with(file_path, 'en/1') AND chunk_type = 'markdown'))),
sq AS (SELECT query_id, scope_id, query FROM pq WHERE strategy <> 'dense'), {I.sql_bm25('sq', 'admitted', scoped=True)},
dq AS (SELECT * FROM pq WHERE strategy <> 'sparse'),
{I.sql_hash_vectors('dq', 'query_id', 'query', 'qv')}, {I.sql_hash_vectors('chunks', 'chunk_id', 'text', 'cv')},
pairs AS MATERIALIZED (SELECT query_id, chunk_id, strategy, k, {I.sql_cosine('qv.e', 'cv.e')} AS score FROM dq JOIN qv USING (query_id) JOIN admitted USING (scope_id) JOIN cv USING (chunk_id)),
dpool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS dr FROM pairs
          QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= CASE strategy WHEN 'hybrid' THEN 3 * k ELSE k END),
dn AS (SELECT query_id, chunk_id, dr, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN CASE WHEN max(score) OVER w > 0 THEN 1.0 ELSE 0.0 END
          ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS d FROM dpool WHERE strategy = 'hybrid' WINDOW w AS (PARTITION BY query_id)),
sn AS (SELECT query_id, chunk_id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN CASE WHEN max(score) OVER w > 0 THEN 1.0 ELSE 0.0 END
          ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s
       FROM scored JOIN pq USING (query_id) WHERE strategy = 'hybrid' WINDOW w AS (PARTITION BY query_id)),
fused AS (SELECT coalesce(dn.query_id, sn.query_id) AS query_id, coalesce(dn.chunk_id, sn.chunk_id) AS chunk_id, dr, round(0.6 * coalesce(d, 0) + 0.4 * coalesce(s, 0), 9) AS score
          FROM dn FULL OUTER JOIN sn ON dn.query_id = sn.query_id AND dn.chunk_id = sn.chunk_id),
ranked AS (SELECT query_id, chunk_id, score, dr - 1 AS rank FROM dpool WHERE strategy = 'dense'
  UNION ALL SELECT query_id, chunk_id, score, row_number() OVER w - 1 FROM scored JOIN pq USING (query_id) WHERE strategy = 'sparse' WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, chunk_id) QUALIFY row_number() OVER w <= k
  UNION ALL SELECT query_id, chunk_id, round(score, 6), row_number() OVER w - 1 FROM fused JOIN pq USING (query_id) WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, dr NULLS LAST, chunk_id) QUALIFY row_number() OVER w <= k),
found AS (SELECT request_id, query_no, r.rank, r.score, c.* FROM ranked r JOIN pq USING (query_id) JOIN chunks c USING (chunk_id)),
best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY request_id, chunk_id ORDER BY score DESC, query_no, rank) = 1),
merged AS (SELECT * REPLACE (row_number() OVER w - 1 AS rank) FROM best WINDOW w AS (PARTITION BY request_id ORDER BY score DESC, query_no, rank, chunk_id) QUALIFY row_number() OVER w <= 12)"""


@register("batch_retrieve", f"""WITH {ASKED}, b AS (SELECT *, rank + 1 AS m FROM merged), h AS (SELECT *, {_HEAD} AS head, trim(text, chr(10)) AS body FROM b),
l AS (SELECT *, sum(length(head) + length(body) + 3) OVER (PARTITION BY request_id ORDER BY rank) AS upto FROM h),
o AS (SELECT *, sum(CASE WHEN upto > 15800 THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY rank) AS over, 15800 - (upto - (length(head) + length(body) + 3)) - length(head) - 4 AS room FROM l),
p AS (SELECT request_id, rank, CASE WHEN over = 0 THEN head || chr(10) || body WHEN over = 1 AND room > 80
   THEN head || chr(10) || regexp_replace(left(body, CAST(room AS BIGINT)), '\\s+$', '') || chr(10) || '… (truncated)' END AS part FROM o),
packed AS (SELECT request_id, coalesce(string_agg(part, chr(10) || chr(10) ORDER BY rank), '(no evidence retrieved)') AS context FROM p GROUP BY 1)
SELECT request_id, rank + 1 AS index, chunk_id AS place, round(score, 4) AS score, md5(context) AS context FROM merged JOIN packed USING (request_id)""")
def batch_retrieve(spark, sf):
    """Requests through their plans: all strategies, filters, query embedding, merged citations, packed context."""
    from groundwell.session import settle

    found = A.answer_requests(asked(spark, sf), settle(I.doc_windows(spark, sf), "windows"))
    place = F.concat_ws(":", "file_path", "start_line", "end_line")
    cites = found.citations.select("request_id", F.col("index").cast("bigint").alias("index"), place.alias("place"), "score")
    return cites.join(found.context.select("request_id", F.md5(F.col("context").cast("binary")).alias("context")), "request_id")


@register("compose_request", """SELECT conv_id, turn, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || 'Stack trace:' || chr(10) || 'at ' || role ELSE '' END
  || CASE WHEN turn % 3 = 0 THEN '' ELSE chr(10) || chr(10) || 'Reproduction:' || chr(10) || 'run ' || turn END AS debug,
  CASE WHEN turn % 2 = 0 THEN 'Review of: T' || turn ELSE 'Review the proposed change for correctness, impact, and risk.' END || chr(10) || 'Files changed: src/' || conv_id || '.py, b' || turn AS review FROM conversations""")
def compose_request(spark, sf):
    t = F.col("turn")
    s = lambda x: x.cast("string")
    trace = F.when(t % 2 == 0, F.concat(F.lit(" at "), F.col("role"), F.lit("\n"))).otherwise(F.lit(" "))
    repro = F.when(t % 3 != 0, F.concat(F.lit("run "), s(t)))
    diff = F.concat(F.lit("--- a/src/"), s(F.col("conv_id")), F.lit(".py\n+++ b/src/"), s(F.col("conv_id")), F.lit(".py\n+++ b"), s(t), F.lit("\n--- /dev/null\n"))
    return I.table(spark, sf, "conversations").select(
        "conv_id", "turn", R.compose_debug_request(F.col("text"), trace, repro).alias("debug"),
        R.compose_review_request(F.when(t % 2 == 0, F.concat(F.lit(" T"), s(t))), diff).alias("review"))


@register("diff_paths", "SELECT conv_id, turn, 'src/' || conv_id || '.py,b' || turn AS paths FROM conversations")
def diff_paths(spark, sf):
    s = lambda x: F.col(x).cast("string")
    diff = F.concat(F.lit("--- a/src/"), s("conv_id"), F.lit(".py\n+++ b/src/"), s("conv_id"), F.lit(".py\n+++ b"), s("turn"), F.lit("\n--- /dev/null\n+x"))
    return I.table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(R.diff_paths(diff), ",").alias("paths"))


def model_json(spark, sf):
    """Replies of a debug or review model about each turn."""
    t = F.col("turn")
    s = lambda x: x.cast("string")
    cand = F.to_json(F.array(
        F.struct(F.concat(F.lit(" h"), s(t)).alias("hypothesis"), F.lit("HIGH").alias("confidence"), F.array(F.lit("a.py"), F.concat(F.lit("m"), s(t), F.lit(".py"))).alias("impacted_files"),
                 F.array(F.lit(0), t.cast("int"), F.lit(99)).alias("evidence_indices")),
        F.struct(F.lit(" ").alias("hypothesis"), F.lit("low").alias("confidence"), F.array(F.lit("z.py")).alias("impacted_files"), F.array(F.lit(1)).alias("evidence_indices"))))
    raw = F.concat(F.lit('{"summary": "'), F.when(t % 2 == 0, F.lit(" s ")).otherwise(F.lit("")), F.lit('", "root_cause_candidates": '),
                   F.when(t % 3 == 0, F.lit("[]")).otherwise(cand), F.lit(', "diagnostic_steps": ["one", " ", "two", "three", "four"], "fix_plan": {"steps": "only", "rollback": " "}, "risk_level": "'),
                   F.when(t % 4 == 0, F.lit("High")).otherwise(F.lit("huge")), F.lit('", "suggested_tests": ["t1"], "next_actions": [{"title": "A", "detail": " d"}, "B ", {"detail": "x"}, "", "C", "D"]}'))
    return I.table(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw"))


@register("normalize_debug_output", """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 's' ELSE 'The provided evidence does not clearly localize the bug.' END AS summary,
  CASE WHEN turn % 3 = 0 THEN '' ELSE 'h' || turn || '/high/0' || CASE WHEN turn < 4 THEN ' ' || turn ELSE '' END END AS candidates, CASE WHEN turn % 3 = 0 THEN '' ELSE 'a.py,m' || turn || '.py' END AS impacted,
  'one,two,three,four' AS steps, 'only' AS fix, CASE WHEN turn % 3 = 0 THEN 'low' ELSE 'medium' END AS confidence FROM conversations""")
def normalize_debug_output(spark, sf):
    d = model_json(spark, sf).select("conv_id", "turn", R.normalize_debug_output(F.col("raw"), F.lit(4)).alias("d"))
    cand = F.transform("d.root_cause_candidates", lambda c: F.concat_ws("/", c["hypothesis"], c["confidence"], F.array_join(c["evidence_indices"].cast("array<string>"), " ")))
    return d.select("conv_id", "turn", "d.summary", F.array_join(cand, ",").alias("candidates"), F.array_join("d.impacted_files", ",").alias("impacted"),
                    F.array_join("d.diagnostic_steps", ",").alias("steps"), F.array_join("d.fix_plan.steps", ",").alias("fix"), "d.confidence")


@register("normalize_review_output", """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 's' WHEN turn % 5 = 1 THEN 'The change could not be summarized from the available evidence.' ELSE 'No reviewable change was provided.' END AS summary,
  CASE WHEN turn % 4 = 0 THEN 'high' WHEN turn % 5 = 1 THEN 'medium' ELSE 'low' END AS risk_level, 't1' AS tests FROM conversations""")
def normalize_review_output(spark, sf):
    d = model_json(spark, sf).select("conv_id", "turn", R.normalize_review_output(
        F.col("raw"), F.when(F.col("turn") % 5 == 1, F.lit("+x")).otherwise(F.lit(" "))).alias("d"))
    return d.select("conv_id", "turn", "d.summary", "d.risk_level", F.array_join("d.suggested_tests", ",").alias("tests"))


@register("normalize_next_actions", "SELECT conv_id, turn, 'A:d,B:,C:,D:' AS actions, 'one,two,three' AS derived FROM conversations")
def normalize_next_actions(spark, sf):
    a = R.normalize_next_actions(F.col("raw"))
    d = R.diagnostic_actions(R.normalize_debug_output(F.col("raw"), F.lit(4))["diagnostic_steps"])
    return model_json(spark, sf).select(
        "conv_id", "turn", F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["title"], x["detail"])), ",").alias("actions"),
        F.array_join(F.transform(d, lambda x: x["detail"]), ",").alias("derived"))
