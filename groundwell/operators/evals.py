"""Evaluation: metrics of responses, thresholds, summaries.

A response row has message, answer, confidence and the arrays evidence
(text, file_path, symbol, score), citations (index, file_path, snippet),
next_actions and tools_used (tool, ok).  Labelled examples add expected_files
and expected_keywords.  Metrics are Columns over that row, so scoring is a map.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import fixed_values as fv
from ..functions import coerce as C
from ..functions import jsontext as J
from ..functions import paths as P
from ..functions import text as T

SCORE_FLOOR = 0.25
MARKER_BONUS = 0.15
UNCITED_PENALTY = 0.1
MAX_PENALTY = 0.4
JUDGED = ["grounding", "relevance"]

Metric = Callable[[], Column]


def _size(array: Column) -> Column:
    return F.coalesce(F.size(array), F.lit(0))


def _answer() -> Column:
    return F.coalesce(F.col("answer"), F.lit(""))


def support_terms(evidence: Column, citations: Column) -> Column:
    """Every term the evidence and citations could support an answer with."""

    def of_evidence(e: Column) -> Column:
        symbol = F.filter(F.array(F.lower(e["symbol"])), lambda s: F.coalesce(s, F.lit("")) != "")
        return F.concat(T.content_terms(e["text"]), P.basename_terms(e["file_path"]), symbol)

    def of_citation(c: Column) -> Column:
        return F.concat(T.content_terms(c["snippet"]), P.basename_terms(c["file_path"]))

    none = T.empty_strings()
    return F.array_distinct(F.concat(
        F.coalesce(F.flatten(F.transform(evidence, of_evidence)), none),
        F.coalesce(F.flatten(F.transform(citations, of_citation)), none)))


def cited_files(citations: Column, evidence: Column) -> Column:
    none = T.empty_strings()
    return F.array_distinct(F.concat(
        F.coalesce(F.transform(citations, lambda c: P.forward_slashes(c["file_path"])), none),
        F.coalesce(F.transform(evidence, lambda e: P.forward_slashes(e["file_path"])), none)))


def uncited_files(mentioned: Column, cited: Column) -> Column:
    return F.filter(mentioned, lambda p: ~P.path_is_cited(p, cited))


def expected_file_hits(expected: Column, cited: Column) -> Column:
    return F.size(F.filter(expected, lambda f: P.path_is_cited(P.forward_slashes(f), cited)))


def _two(x: Column) -> Column:
    return F.format_string("%.2f", x)


def _scored(score: Column, rationale: Column) -> Column:
    return F.struct(score.cast("double").alias("score"), rationale.alias("rationale"))


def grounding() -> Column:
    support = support_terms(F.col("evidence"), F.col("citations"))
    base = T.overlap_ratio(T.content_terms(_answer()), support)
    n = _size(F.col("citations"))
    markers = F.coalesce(F.size(F.filter("citations", lambda c: T.has_marker(_answer(), c["index"]))), F.lit(0))
    bonus = F.when(n > 0, MARKER_BONUS * markers / n).otherwise(F.lit(0.0))
    uncited = F.size(uncited_files(P.file_mentions(_answer()), cited_files(F.col("citations"), F.col("evidence"))))
    penalty = F.least(F.lit(MAX_PENALTY), UNCITED_PENALTY * uncited)
    why = F.concat(F.lit("term-overlap="), _two(base), F.lit(", markers="), markers.cast("string"), F.lit("/"),
                   n.cast("string"), F.lit(", uncited_files="), uncited.cast("string"))
    return (
        F.when(T.is_blank(_answer()), _scored(F.lit(0.0), F.lit("empty answer")))
        .when(F.size(support) == 0, _scored(F.lit(0.0), F.lit("no evidence or citations to ground the answer against")))
        .otherwise(_scored(base + bonus - penalty, why))
    )


def relevance() -> Column:
    asked, given = T.content_terms(F.col("message")), T.content_terms(_answer())
    overlap = F.when(F.size(asked) > 0, T.overlap_ratio(asked, given)).otherwise(F.lit(0.5))
    n_keywords = _size(F.col("expected_keywords"))
    covered = F.size(F.filter("expected_keywords", lambda k: T.keyword_present(k, given)))
    coverage = covered / n_keywords
    length = T.length_sanity(F.size(T.word_tokens(_answer())))
    core = F.when(n_keywords > 0, 0.5 * overlap + 0.5 * coverage).otherwise(overlap)
    why = F.concat(
        F.lit("qa_overlap="), _two(overlap),
        F.when(n_keywords > 0, F.concat(F.lit(", keyword_cov="), _two(coverage))).otherwise(F.lit("")),
        F.lit(", len="), _two(length))
    return F.when(T.is_blank(_answer()), _scored(F.lit(0.0), F.lit("empty answer"))).otherwise(
        _scored(core * length, why))


def completeness() -> Column:
    checks = {
        "answer": ~T.is_blank(_answer()),
        "citation": _size(F.col("citations")) >= 1,
        "next_action": _size(F.col("next_actions")) >= 1,
        "confidence": F.coalesce(F.col("confidence").isin(fv.CONFIDENCES), F.lit(False)),
    }
    score = sum((ok.cast("int") for ok in checks.values()), F.lit(0)) / F.lit(len(checks))
    missing = F.concat_ws(", ", *[F.when(~ok, F.lit(name)) for name, ok in checks.items()])
    why = F.when(missing == "", F.lit("all sections present")).otherwise(F.concat(F.lit("missing: "), missing))
    return _scored(score, why)


def tool_success() -> Column:
    n = _size(F.col("tools_used"))
    ok = F.size(F.filter("tools_used", lambda t: t["ok"]))
    failed = F.array_join(F.array_sort(F.array_distinct(
        F.transform(F.filter("tools_used", lambda t: ~t["ok"]), lambda t: t["tool"]))), ", ")
    why = F.concat(ok.cast("string"), F.lit("/"), n.cast("string"), F.lit(" tools succeeded"),
                   F.when(failed != "", F.concat(F.lit("; failed: "), failed)).otherwise(F.lit("")))
    return F.when(n == 0, _scored(F.lit(1.0), F.lit("no tools invoked"))).otherwise(_scored(ok / n, why))


def mean_evidence_score(evidence: Column) -> Column:
    total = F.aggregate(evidence, F.lit(0.0), lambda acc, e: acc + e["score"].cast("double"))
    return F.when(F.size(evidence) > 0, total / F.size(evidence))


def distinct_evidence_files(evidence: Column) -> Column:
    return F.size(F.array_distinct(F.transform(evidence, lambda e: e["file_path"])))


def retrieval_quality() -> Column:
    mean = mean_evidence_score(F.col("evidence"))
    files = distinct_evidence_files(F.col("evidence"))
    strength = F.when(mean > 0, F.least(F.lit(1.0), mean / (2 * SCORE_FLOOR))).otherwise(F.lit(0.0))
    base = 0.7 * strength + 0.3 * F.least(F.lit(1.0), files / F.lit(3.0))
    n = _size(F.col("expected_files"))
    hits = expected_file_hits(F.col("expected_files"), cited_files(F.col("citations"), F.col("evidence")))
    labelled = n > 0
    shown = F.format_string("%.3f", mean)
    why = F.when(labelled, F.concat(
        F.lit("mean_score="), shown, F.lit(", files="), files.cast("string"), F.lit(", expected_hit="),
        hits.cast("string"), F.lit("/"), n.cast("string"))).otherwise(F.concat(
            F.lit("mean_score="), shown, F.lit(", distinct_files="), files.cast("string")))
    score = F.when(labelled, 0.5 * base + 0.5 * hits / n).otherwise(base)
    return F.when(_size(F.col("evidence")) == 0, _scored(F.lit(0.0), F.lit("no evidence retrieved"))).otherwise(
        _scored(score, why))


# metric name: how to score it; thresholds are by the same name
METRICS: dict[str, Metric] = {
    "grounding": grounding,
    "relevance": relevance,
    "completeness": completeness,
    "tool_success": tool_success,
    "retrieval_quality": retrieval_quality,
}


def finalize(score: Column) -> Column:
    """Clamp to 0..1 after rounding to four places."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(score, 4)))


def passes(metric: Column, score: Column, thresholds: dict[str, float] | None = None) -> Column:
    limits = fv.THRESHOLDS if thresholds is None else thresholds
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[metric]
    return score >= limit


def _with_labels(responses: DataFrame) -> DataFrame:
    for name in ("expected_files", "expected_keywords"):
        if name not in responses.columns:
            responses = responses.withColumn(name, T.empty_strings())
    return responses


def score_all(responses: DataFrame, metrics: dict[str, Metric] | None = None,
              thresholds: dict[str, float] | None = None) -> DataFrame:
    """One row per response and metric: example_id, position, metric, score, passed, rationale."""
    chosen = METRICS if metrics is None else metrics
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("metric"), build().alias("r"))
        for i, (name, build) in enumerate(chosen.items())
    ])
    exploded = _with_labels(responses).select("example_id", F.explode(rows).alias("m"))
    score = finalize(F.col("m.r.score"))
    return exploded.select(
        "example_id", "m.position", "m.metric", score.alias("score"),
        passes(F.col("m.metric"), score, thresholds).alias("passed"), F.col("m.r.rationale").alias("rationale"))


def overall_scores(scores: DataFrame) -> DataFrame:
    """Mean of the metrics of each example, and whether all of them passed."""
    return scores.groupBy("example_id").agg(
        F.round(F.avg("score"), 4).alias("overall"), F.bool_and("passed").alias("all_passed"))


def failed_example(examples: DataFrame, reason: Column) -> DataFrame:
    """Five zero rows for an example that got no answer."""
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric")) for i, m in enumerate(fv.METRICS)])
    return examples.select("example_id", F.explode(rows).alias("m"), reason.alias("rationale")).select(
        "example_id", "m.position", "m.metric", F.lit(0.0).alias("score"), F.lit(False).alias("passed"), "rationale")


def eval_join(examples: DataFrame, responses: DataFrame) -> DataFrame:
    """Scores of every example; examples without a response get zeros."""
    labels = examples.select("example_id", F.col("question").alias("message"), "expected_files", "expected_keywords")
    answered = labels.join(responses.drop("message", "expected_files", "expected_keywords"), "example_id")
    missing = examples.select("example_id").join(responses.select("example_id"), "example_id", "left_anti")
    return score_all(answered).unionByName(failed_example(missing, F.lit("orchestrator error: no response")))


def eval_run_summary(scores: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Mean per metric and overall, with n and the strict pass rate on every row."""
    names = fv.METRICS if metrics is None else metrics
    per_example = scores.groupBy("example_id").agg(
        F.round(F.avg("score"), 4).alias("__overall"), F.bool_and("passed").alias("__passed"),
        *[F.avg(F.when(F.col("metric") == m, F.col("score"))).alias(m) for m in names])
    whole = per_example.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("__passed").cast("int")), 4).alias("pass_rate"),
        *[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 4).alias(m) for m in names],
        F.round(F.avg("__overall"), 4).alias("overall"))
    pairs = ", ".join(f"'{m}', {m}" for m in [*names, "overall"])
    return whole.selectExpr("n", "pass_rate", f"stack({len(names) + 1}, {pairs}) AS (metric, average)")


def trace_scores(traces: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Known metrics stored on traces as score rows (id as example_id)."""
    limits = fv.OVERVIEW_THRESHOLDS if thresholds is None else thresholds
    rows = traces.select(F.col("id").alias("example_id"), F.explode("scores").alias("metric", "value")).where(
        F.col("metric").isin(fv.METRICS))
    score = C.clamp01(F.col("value"))
    return rows.select("example_id", "metric", score.alias("score"),
                       passes(F.col("metric"), score, limits).alias("passed"))


def eval_overview(traces: DataFrame) -> DataFrame:
    """Dashboard numbers from stored traces, all metrics against one pass mark."""
    return eval_run_summary(trace_scores(traces)).where(F.col("average").isNotNull())


def eval_report(scores: DataFrame) -> DataFrame:
    """One wide row per example and an AVERAGE row."""
    wide = scores.groupBy("example_id").agg(
        *[F.first(F.when(F.col("metric") == m, F.col("score")), ignorenulls=True).alias(m) for m in fv.METRICS],
        F.round(F.avg("score"), 4).alias("overall"), F.bool_and("passed").alias("passed"))
    lines = wide.rollup("example_id").agg(
        F.grouping("example_id").alias("__total"),
        *[F.round(F.avg(m), 4).alias(m) for m in [*fv.METRICS, "overall"]],
        F.bool_and("passed").alias("passed"))
    total = F.col("__total") == 1
    return lines.select(
        F.when(total, F.lit("AVERAGE")).otherwise(F.col("example_id")).alias("example"), *fv.METRICS, "overall",
        F.when(~total, F.when(F.col("passed"), F.lit("Y")).otherwise(F.lit("n"))).alias("pass"))


# --- fixed values: how a model client marks a reply that no model gave --------
DEGRADED_START = "[model unavailable"
DEGRADED_KEY = "_warning"


def degraded(reply: Column) -> Column:
    """No reply, a text that says no model was there, or a JSON object with the mark of a stand-in."""
    marked = F.coalesce(F.array_contains(F.json_object_keys(reply), DEGRADED_KEY), F.lit(False))
    return reply.isNull() | F.startswith(reply, F.lit(DEGRADED_START)) | marked


def judge_scores(judged: DataFrame) -> DataFrame:
    """Score rows out of judge model replies; unusable ones give no rows, so that the heuristic scores stay.

    ``judged``: example_id, raw, answer, n_citations and, if some examples are not to be judged, enabled.  Replies
    that a model client marked as a stand-in for a missing model are degraded and unusable.
    """
    wanted = F.coalesce(F.col("enabled"), F.lit(True)) if "enabled" in judged.columns else F.lit(True)
    asked = judged.where(wanted & ~T.is_blank(F.col("answer")) & (F.col("n_citations") > 0))
    usable = asked.where(~degraded(F.col("raw"))).withColumn("__json", J.extract_json(F.col("raw"))).where(
        F.col("__json").isNotNull() & ~degraded(F.col("__json")))
    issues = F.array_join(F.slice(F.coalesce(
        F.from_json(F.get_json_object("__json", "$.issues"), "array<string>"), T.empty_strings()), 1, 3), "; ")
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), C.clamp01(F.get_json_object("__json", f"$.{m}")).alias("raw_score"))
        for m in JUDGED
    ])
    out = usable.select("example_id", issues.alias("__issues"), F.explode(rows).alias("m"))
    why = F.concat(F.lit("LLM judge "), F.col("m.metric"), F.lit("="), _two(F.col("m.raw_score")),
                   F.when(F.col("__issues") != "", F.concat(F.lit(" — "), F.col("__issues"))).otherwise(F.lit("")))
    return out.select(
        "example_id", "m.metric", F.round("m.raw_score", 4).alias("score"),
        passes(F.col("m.metric"), F.col("m.raw_score")).alias("passed"), why.alias("rationale"))


def judge_override(scores: DataFrame, judged: DataFrame) -> DataFrame:
    """Judge scores in place of the heuristic ones where the judge gave any."""
    better = judged.select("example_id", "metric", F.struct("score", "passed", "rationale").alias("__j"))
    joined = scores.join(better, ["example_id", "metric"], "left")
    return joined.select(
        "example_id", "position", "metric",
        *[F.coalesce(F.col(f"__j.{c}"), F.col(c)).alias(c) for c in ("score", "passed", "rationale")])


def heuristic_judge(responses: DataFrame) -> DataFrame:
    """Coarse scores for when no judge model can be asked."""
    cited = _size(F.col("citations")) > 0
    marked = F.coalesce(F.exists("citations", lambda c: T.has_marker(_answer(), c["index"])), F.lit(False))
    answered = ~T.is_blank(_answer())
    add = lambda ok, x: F.when(ok, F.lit(x)).otherwise(F.lit(0.0))
    grounded = F.when(cited & marked, F.lit(0.6)).when(cited, F.lit(0.3)).otherwise(F.lit(0.0))
    issues = F.concat_ws(
        "; ", F.when(~cited, F.lit("no evidence retrieved")),
        F.when(cited & ~marked, F.lit("answer does not cite the retrieved evidence")),
        F.lit("scored heuristically; judge model unavailable"))
    return responses.select(
        "example_id", grounded.alias("grounding"),
        (add(answered, 0.4) + add(cited, 0.3) + add(_size(F.col("next_actions")) > 0, 0.3)).alias("completeness"),
        add(answered, 0.5).alias("relevance"), issues.alias("issues"))


def judge_model(model: Callable) -> Callable[..., Column]:
    """A judge plug-in: ``model`` maps Series of question, evidence, answer to raw replies; failures give NULL."""
    @F.pandas_udf(StringType())
    def ask(question: pd.Series, evidence: pd.Series, answer: pd.Series) -> pd.Series:
        try:
            return pd.Series(list(model(question, evidence, answer)), dtype=object)
        except Exception:
            return pd.Series([None] * len(question), dtype=object)

    return ask
