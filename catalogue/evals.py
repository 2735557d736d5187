"""Registered queries: metrics, summaries, judges."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwell import fixed_values as fv
from groundwell.functions import paths as P
from groundwell.functions import text as T
from groundwell.operators import evals as V

from . import inputs as I
from .text import CHATS, SANITY, chats

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


# --- responses: each assistant turn, with the turns before it as evidence --------
def responses(spark, sf):
    """Evidence by an equi-join on (conversation, turn): at most three rows per answer."""
    s = lambda x: x.cast("string")
    base = chats(spark, sf)
    turns = I.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("at"), F.col("text").alias("told"), "role")
    near = base.select("conv_id", "turn", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("off")).withColumn("at", F.col("turn") - F.col("off"))
    found = near.join(turns, ["conv_id", "at"]).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("off", "at", "told", "role"))).alias("ev"))
    path = lambda e: F.concat(F.lit("notes/t"), s(e["at"]), F.lit(".md"))
    c, t = F.col("conv_id"), F.col("turn")
    answer = F.concat("answer", F.lit(" See [1] and [3] in notes/t"), s(t - 1), F.lit(".md or `lib/missing"), s(c % 3), F.lit(".py`."))
    tools = F.transform(F.slice(F.array(F.lit(0), F.lit(1)), 1, (c % 3).cast("int")), lambda i: F.struct(
        F.concat(F.lit("tool"), s(i)).alias("tool"), ((i + t) % 2 == 0).alias("ok")))
    return base.join(found, ["conv_id", "turn"]).select(
        F.concat(F.lit("c"), s(c), F.lit("-"), s(t)).alias("example_id"), F.col("question").alias("message"),
        F.when(c % 11 == 10, F.lit(" ")).otherwise(answer).alias("answer"),
        F.when(c % 5 == 0, F.lit("certain")).otherwise(F.lit("high")).alias("confidence"),
        F.when(c % 13 == 12, F.array()).otherwise(F.transform("ev", lambda e: F.struct(
            e["told"].alias("text"), path(e).alias("file_path"), e["role"].alias("symbol"), (1 / (e["off"] + 1)).alias("score")))).alias("evidence"),
        F.when(c % 13 == 12, F.array()).otherwise(F.transform(F.slice("ev", 1, 2), lambda e, i: F.struct(
            (i + 1).alias("index"), path(e).alias("file_path"), F.substring(e["told"], 1, 200).alias("snippet")))).alias("citations"),
        F.when(c % 2 == 0, F.array(F.struct(F.lit("do").alias("title"), F.lit("").alias("detail"), F.lit("").alias("rationale")))).otherwise(F.array()).alias("next_actions"),
        tools.alias("tools_used"),
        F.when(t % 2 == 0, F.array(F.concat(F.lit("a/notes/t"), s(t), F.lit(".md")), F.lit("x/y.py"))).otherwise(F.array().cast("array<string>")).alias("expected_files"),
        F.when(t % 3 == 0, F.array(F.substring_index("question", " ", 2), F.lit("the"))).otherwise(F.array().cast("array<string>")).alias("expected_keywords"),
        "conv_id", "turn")


def _bt(path):
    name = f"lower(regexp_extract({path}, '[^/]*$'))"
    stem = f"regexp_replace({name}, '\\.[^.]*$', '')"
    return f"list_concat([{name}, {stem}], list_filter(string_split_regex({stem}, '[._\\-/]'), lambda p: length(p) >= 3))"


_KW1 = "array_to_string(list_slice(string_split(message, ' '), 1, 2), ' ')"
RESP = f"""{CHATS},
base AS (SELECT 'c' || conv_id || '-' || turn AS example_id, conv_id, turn, question AS message, CASE WHEN conv_id % 11 = 10 THEN ' ' ELSE
   answer || ' See [1] and [3] in notes/t' || (turn - 1) || '.md or `lib/missing' || (conv_id % 3) || '.py`.' END AS answer FROM chats),
ev AS MATERIALIZED (SELECT example_id, o AS off, c.text, 'notes/t' || c.turn || '.md' AS file_path, c.role AS symbol, 1.0 / (o + 1) AS score
   FROM base, (VALUES (0), (1), (2)) v(o), conversations c WHERE c.conv_id = base.conv_id AND c.turn = base.turn - o AND base.conv_id % 13 <> 12),
agg AS (SELECT example_id, count(*) AS n_ev, least(2, count(*)) AS n_cit, avg(score) AS mean_score, count(DISTINCT file_path) AS n_files, list(DISTINCT file_path) AS files FROM ev GROUP BY 1),
supp AS (SELECT example_id, list(DISTINCT t) AS support FROM (SELECT example_id, unnest(list_concat({I.sql_terms('text')}, {_bt('file_path')}, [symbol])) AS t FROM ev
   UNION ALL SELECT example_id, unnest({I.sql_terms('left(text, 200)')}) FROM ev WHERE off < 2) GROUP BY 1),
r AS MATERIALIZED (SELECT base.*, coalesce(n_ev, 0) AS n_ev, coalesce(n_cit, 0) AS n_cit, mean_score, n_files, coalesce(files, []::VARCHAR[]) AS files, coalesce(support, []::VARCHAR[]) AS support,
   {I.sql_terms('answer')} AS aterms, {I.sql_terms('message')} AS qterms, len({I.sql_words('answer')}) AS n_words,
   list_distinct(list_filter(list_transform(regexp_extract_all(answer, '[`''"(]?([A-Za-z0-9_./\\-]+\\.[A-Za-z]{{1,5}})', 1), lambda t: regexp_replace(t, '^\\.+', '')), lambda t: contains(t, '/') OR regexp_matches(t, '\\.[A-Za-z]{{1,5}}$'))) AS mentions
   FROM base LEFT JOIN agg USING (example_id) LEFT JOIN supp USING (example_id)),
m AS (SELECT *, list_filter(mentions, lambda p: len(list_filter(files, lambda c: c = p OR ends_with(c, '/' || p) OR ends_with(p, '/' || c) OR regexp_extract(c, '[^/]*$') = regexp_extract(p, '[^/]*$'))) = 0) AS uncited FROM r),
raw AS (SELECT *, trim(answer) = '' AS blank,
  CASE WHEN trim(answer) = '' OR len(support) = 0 THEN 0.0 ELSE {I.sql_overlap('aterms', 'support')} + CASE WHEN n_cit > 0 THEN 0.15 / n_cit ELSE 0.0 END - least(0.4, 0.1 * len(uncited)) END AS grounding,
  CASE WHEN trim(answer) = '' THEN 0.0 ELSE CAST({SANITY.format(n='n_words')} AS DOUBLE) * (CASE WHEN turn % 3 = 0 THEN 0.5 * qa + 0.5 * cov ELSE qa END) END AS relevance,
  ((CASE WHEN trim(answer) <> '' THEN 1 ELSE 0 END) + (CASE WHEN n_cit > 0 THEN 1 ELSE 0 END) + (CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN conv_id % 5 <> 0 THEN 1 ELSE 0 END)) / 4.0 AS completeness,
  CASE conv_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN CASE WHEN turn % 2 = 0 THEN 1.0 ELSE 0.0 END ELSE 0.5 END AS tool_success,
  CASE WHEN n_ev = 0 THEN 0.0 WHEN turn % 2 = 0 THEN 0.5 * health + 0.25 ELSE health END AS retrieval_quality
 FROM (SELECT *, CASE WHEN len(qterms) > 0 THEN {I.sql_overlap('qterms', 'aterms')} ELSE 0.5 END AS qa, 0.7 * CASE WHEN mean_score > 0 THEN least(1.0, mean_score / 0.5) ELSE 0.0 END + 0.3 * least(1.0, n_files / 3.0) AS health,
   ((CASE WHEN len({I.sql_terms(_KW1, 2)}) > 0 THEN CAST(len(list_filter({I.sql_terms(_KW1, 2)}, lambda t: NOT list_contains(aterms, t))) = 0 AS INT) ELSE CAST(list_contains(aterms, lower({_KW1})) AS INT) END)
     + CAST(list_contains(aterms, 'the') AS INT)) / 2.0 AS cov FROM m)),
scores AS MATERIALIZED (SELECT example_id, metric, least(1.0, greatest(0.0, round(CAST(score AS DOUBLE), 4))) AS score FROM (
  SELECT example_id, 'grounding' AS metric, grounding AS score FROM raw UNION ALL SELECT example_id, 'relevance', relevance FROM raw UNION ALL SELECT example_id, 'completeness', completeness FROM raw
  UNION ALL SELECT example_id, 'tool_success', tool_success FROM raw UNION ALL SELECT example_id, 'retrieval_quality', retrieval_quality FROM raw)),
graded AS MATERIALIZED (SELECT *, score >= CASE metric WHEN 'grounding' THEN 0.45 WHEN 'relevance' THEN 0.40 WHEN 'completeness' THEN 0.75 WHEN 'tool_success' THEN 0.99 ELSE 0.40 END AS passed FROM scores)"""


def scored(spark, sf):
    return V.score_all(responses(spark, sf))


@register("score_all", f"WITH {RESP} SELECT * FROM graded")
def score_all(spark, sf):
    return scored(spark, sf).select("example_id", "metric", "score", "passed")


def one_metric(name):
    @register(name, f"WITH {RESP} SELECT example_id, score, passed FROM graded WHERE metric = '{name}'")
    def run(spark, sf):
        return V.score_all(responses(spark, sf), {name: V.METRICS[name]}).select("example_id", "score", "passed")


for _metric in fv.METRICS:
    one_metric(_metric)


@register("score_finalize", """SELECT event_id, least(1.0, greatest(0.0, round(value / 100 - 0.2, 4))) AS score,
  least(1.0, greatest(0.0, round(value / 100 - 0.2, 4))) >= CASE event_id % 2 WHEN 0 THEN 0.45 ELSE 0.75 END AS passed FROM events""")
def score_finalize(spark, sf):
    metric = F.when(F.col("event_id") % 2 == 0, F.lit("grounding")).otherwise(F.lit("completeness"))
    score = V.finalize(F.col("value") / 100 - 0.2)
    return I.table(spark, sf, "events").select("event_id", score.alias("score"), V.passes(metric, score).alias("passed"))


@register("support_terms", f"WITH {RESP} SELECT example_id, array_to_string(list_sort(support), ' ') AS terms, array_to_string(list_sort(files), ' ') AS files FROM r")
def support_terms(spark, sf):
    return responses(spark, sf).select(
        "example_id", F.array_join(F.sort_array(V.support_terms(F.col("evidence"), F.col("citations"))), " ").alias("terms"),
        F.array_join(F.sort_array(V.cited_files(F.col("citations"), F.col("evidence"))), " ").alias("files"))


@register("uncited_files", f"WITH {RESP} SELECT example_id, array_to_string(list_sort(uncited), ' ') AS uncited FROM m")
def uncited_files(spark, sf):
    bad = V.uncited_files(P.file_mentions(F.col("answer")), V.cited_files(F.col("citations"), F.col("evidence")))
    return responses(spark, sf).select("example_id", F.array_join(F.sort_array(bad), " ").alias("uncited"))


@register("evidence_health", f"WITH {RESP} SELECT example_id, round(mean_score, 6) AS mean_score, coalesce(n_files, 0) AS n_files FROM r")
def evidence_health(spark, sf):
    return responses(spark, sf).select("example_id", F.round(V.mean_evidence_score(F.col("evidence")), 6).alias("mean_score"),
                                       V.distinct_evidence_files(F.col("evidence")).alias("n_files"))


@register("expected_file_hits", f"WITH {RESP} SELECT example_id, CASE WHEN turn % 2 = 0 AND n_ev > 0 THEN 1 ELSE 0 END AS hits FROM r")
def expected_file_hits(spark, sf):
    return responses(spark, sf).select("example_id", V.expected_file_hits(
        F.col("expected_files"), V.cited_files(F.col("citations"), F.col("evidence"))).alias("hits"))


# --- offline runs: every third conversation has no response ------------------------
def examples(spark, sf):
    return responses(spark, sf).select("example_id", F.col("message").alias("question"), "expected_files", "expected_keywords", "conv_id")


JOINED = "joined AS (SELECT g.example_id, g.metric, CASE WHEN b.conv_id % 3 = 2 THEN 0.0 ELSE g.score END AS score, CASE WHEN b.conv_id % 3 = 2 THEN false ELSE passed END AS passed FROM graded g JOIN base b USING (example_id))"


def run_scores(spark, sf):
    answered = responses(spark, sf).where(F.col("conv_id") % 3 != 2)
    return V.eval_join(examples(spark, sf), answered)


@register("eval_join", f"WITH {RESP}, {JOINED} SELECT * FROM joined")
def eval_join(spark, sf):
    return run_scores(spark, sf).select("example_id", "metric", "score", "passed")


@register("failed_example", f"WITH {RESP} SELECT example_id, metric, CAST(0.0 AS DOUBLE) AS score, false AS passed, 'boom' AS rationale FROM graded")
def failed_example(spark, sf):
    return V.failed_example(examples(spark, sf), F.lit("boom")).drop("position")


PER = "per AS (SELECT example_id, round(avg(score), 4) AS overall, bool_and(passed) AS ok FROM joined GROUP BY 1)"


@register("eval_run_summary", f"""WITH {RESP}, {JOINED}, {PER}, t AS (SELECT count(*) AS n, round(avg(CAST(ok AS INT)), 4) AS pass_rate, round(avg(overall), 4) AS o FROM per)
SELECT n, pass_rate, metric, average FROM t, (SELECT metric, round(avg(score), 4) AS average FROM joined GROUP BY 1) UNION ALL SELECT n, pass_rate, 'overall', o FROM t""")
def eval_run_summary(spark, sf):
    return V.eval_run_summary(run_scores(spark, sf))


@register("eval_report", f"""WITH {RESP}, {JOINED}, {PER}, wide AS (SELECT example_id, {', '.join(f"max(score) FILTER (metric = '{m}') AS {m}" for m in fv.METRICS)} FROM joined GROUP BY 1)
SELECT example_id AS example, {', '.join(fv.METRICS)}, overall, CASE WHEN ok THEN 'Y' ELSE 'n' END AS pass FROM wide JOIN per USING (example_id)
UNION ALL SELECT 'AVERAGE', {', '.join(f'round(avg({m}), 4)' for m in fv.METRICS)}, round(avg(overall), 4), NULL FROM wide JOIN per USING (example_id)""")
def eval_report(spark, sf):
    return V.eval_report(run_scores(spark, sf))


# --- labels as stored trace scores -------------------------------------------------
def label_traces(spark, sf):
    return I.table(spark, sf, "labels").select(
        F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("id"),
        F.create_map(F.lit("grounding"), F.col("quality").cast("double"), F.lit("relevance"), F.lit(1.0) - 0.5 * F.col("toxic"),
                     F.lit("tone"), F.lit(0.1), F.lit("completeness"), F.col("doc_id") % 3 - 0.4).alias("scores"))


@register("eval_overview", """WITH s AS (SELECT doc_id, 'grounding' AS metric, CAST(quality AS DOUBLE) AS score FROM labels UNION ALL SELECT doc_id, 'relevance', 1.0 - 0.5 * toxic FROM labels
  UNION ALL SELECT doc_id, 'completeness', least(1.0, greatest(0.0, doc_id % 3 - 0.4)) FROM labels),
p AS (SELECT doc_id, round(avg(score), 4) AS overall, bool_and(score >= 0.6) AS ok FROM s GROUP BY 1), t AS (SELECT count(*) AS n, round(avg(CAST(ok AS INT)), 4) AS pass_rate, round(avg(overall), 4) AS o FROM p)
SELECT n, pass_rate, metric, average FROM t, (SELECT metric, round(avg(score), 4) AS average FROM s GROUP BY 1) UNION ALL SELECT n, pass_rate, 'overall', o FROM t
UNION ALL SELECT n, pass_rate, x, 0.0 FROM t, (VALUES ('tool_success'), ('retrieval_quality')) v(x)""")
def eval_overview(spark, sf):
    return V.eval_overview(label_traces(spark, sf))


# --- judges ------------------------------------------------------------------------
def judged(spark, sf):
    n = F.col("conv_id") + F.col("turn")
    body = F.to_json(F.struct((n % 7 / 5).alias("grounding"), F.when(n % 2 == 0, F.lit("0.75")).otherwise(F.lit("bad")).alias("relevance"),
                              F.array(F.lit("i1"), F.lit("i2"), F.lit("i3"), F.lit("i4")).alias("issues")))
    raw = F.when(n % 4 == 0, F.lit("no idea")).when(n % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("so "), body))
    return responses(spark, sf).select("example_id", "answer", F.size("citations").alias("n_citations"), raw.alias("raw"))


JUDGED = """judged AS (SELECT example_id, metric, round(s, 4) AS score, s >= CASE metric WHEN 'grounding' THEN 0.45 ELSE 0.40 END AS passed FROM (
  SELECT example_id, 'grounding' AS metric, least(1.0, ((conv_id + turn) % 7) / 5.0) AS s FROM raw WHERE NOT blank AND n_cit > 0 AND (conv_id + turn) % 4 <> 0
  UNION ALL SELECT example_id, 'relevance', CASE WHEN (conv_id + turn) % 2 = 0 THEN 0.75 ELSE 0.0 END FROM raw WHERE NOT blank AND n_cit > 0 AND (conv_id + turn) % 4 <> 0))"""


@register("judge_scores", f"WITH {RESP}, {JUDGED} SELECT *, true AS three_issues FROM judged")
def judge_scores(spark, sf):
    return V.judge_scores(judged(spark, sf)).select("example_id", "metric", "score", "passed", F.col("rationale").endswith(" — i1; i2; i3").alias("three_issues"))


@register("judge_override", f"""WITH {RESP}, {JUDGED} SELECT g.example_id, g.metric, coalesce(j.score, g.score) AS score, coalesce(j.passed, g.passed) AS passed FROM graded g LEFT JOIN judged j USING (example_id, metric)""")
def judge_override(spark, sf):
    return V.judge_override(scored(spark, sf), V.judge_scores(judged(spark, sf))).select("example_id", "metric", "score", "passed")


@register("heuristic_judge", f"""WITH {RESP} SELECT example_id, CAST(CASE WHEN n_cit = 0 THEN 0.0 WHEN blank THEN 0.3 ELSE 0.6 END AS DOUBLE) AS grounding,
  CAST(CASE WHEN blank THEN 0.0 ELSE 0.4 END + CASE WHEN n_cit > 0 THEN 0.3 ELSE 0.0 END + CASE WHEN conv_id % 2 = 0 THEN 0.3 ELSE 0.0 END AS DOUBLE) AS completeness, CAST(CASE WHEN blank THEN 0.0 ELSE 0.5 END AS DOUBLE) AS relevance,
  CASE WHEN n_cit = 0 THEN 'no evidence retrieved; ' WHEN blank THEN 'answer does not cite the retrieved evidence; ' ELSE '' END || 'scored heuristically; judge model unavailable' AS issues FROM raw""")
def heuristic_judge(spark, sf):
    return V.heuristic_judge(responses(spark, sf)).withColumn("completeness", F.round("completeness", 6))


@register("metric_plugins", f"WITH {RESP} SELECT example_id, 'brevity' AS metric, least(1.0, greatest(0.0, round(100.0 / greatest(100, n_words), 4))) AS score, round(100.0 / greatest(100, n_words), 4) >= 0.9 AS passed FROM r")
def metric_plugins(spark, sf):
    """A metric of one's own beside the built-in ones."""
    brevity = lambda: F.struct((100.0 / F.greatest(F.lit(100), F.size(T.word_tokens(F.col("answer"))))).alias("score"), F.lit("").alias("rationale"))
    return V.score_all(responses(spark, sf), {"brevity": brevity}, {"brevity": 0.9}).select("example_id", "metric", "score", "passed")
