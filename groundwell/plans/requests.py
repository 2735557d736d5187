"""Planned requests: model plans and answers brought into the shape that is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import coerce as C
from ..functions import text as T
from ..operators.evidence import ordered_distinct
from ..operators.scope import scope_filter

DERIVED_ACTIONS = 3
MOST_INT = (1 << 31) - 1
MAX_TOUCHED_FILES = 20

_FIELD = "struct<repository_ids:array<string>,branch:string,file_types:array<string>,path_prefix:string,chunk_types:array<string>>"


def _planned_filter(document: Column, path: str) -> Column:
    """The narrowing fields of a planned filter, tolerant of scalars."""
    prefix = F.get_json_object(document, path + ".path_prefix")
    return F.struct(
        F.lit(None).cast("array<string>").alias("repository_ids"),
        F.lit(None).cast("string").alias("branch"),
        C.json_str_list(document, path + ".file_types").alias("file_types"),
        prefix.alias("path_prefix"),
        C.json_str_list(document, path + ".chunk_types").alias("chunk_types"),
    ).cast(_FIELD)


def _narrows(flt: Column) -> Column:
    return (F.size(flt["file_types"]) > 0) | (F.coalesce(flt["path_prefix"], F.lit("")) != "") | (
        F.size(flt["chunk_types"]) > 0)


def json_items(document: Column, path: str) -> Column:
    """Items of a JSON array as JSON texts; strings stay quoted-free."""
    return F.coalesce(F.from_json(F.get_json_object(document, path), "array<string>"), T.empty_strings())


def normalize_query_plan(requests: DataFrame, default_top_k: int = fv.DEFAULT_TOP_K) -> DataFrame:
    """All queries of each request's plan, always within the request's scope.

    ``requests``: request_id, request, repository_ids, branch and plan (the
    JSON text of the model's plan, or NULL).  A request without a usable
    planned query searches its own text.
    """
    top = _planned_filter(F.col("plan"), "$.filter")
    planned = (
        requests.withColumn("__top", top)
        .select("*", F.posexplode(json_items(F.col("plan"), "$.queries")).alias("query_no", "__q"))
        .withColumn("query", T.strip_space(F.coalesce(F.get_json_object("__q", "$.query"), F.lit(""))))
        .where(F.col("query") != "")
    )
    own = _planned_filter(F.col("__q"), "$.filter")
    has_top = F.get_json_object("plan", "$.filter").isNotNull()
    chosen = F.when(has_top & ~_narrows(own), F.col("__top")).otherwise(own)
    top_k = F.get_json_object("__q", "$.top_k")
    good = planned.select(
        "request_id", "query_no", "query",
        C.coerce_enum(F.get_json_object("__q", "$.strategy"), fv.STRATEGIES, "hybrid").alias("strategy"),
        C.coerce_int(F.regexp_replace(top_k, r"^(-?\d+)\.\d*$", "$1"), default_top_k, 1, MOST_INT).alias("top_k"),
        scope_filter(chosen, F.col("repository_ids"), F.col("branch")).alias("filter"),
        F.lit(False).alias("fallback"))
    return good.unionByName(fallback_query(requests, good, default_top_k)).withColumn(
        "query_id", F.concat_ws("/", "request_id", F.col("query_no").cast("string")))


def fallback_query(requests: DataFrame, planned: DataFrame, default_top_k: int = fv.DEFAULT_TOP_K) -> DataFrame:
    """The request's own text for requests that no planned query covers."""
    nothing = F.lit(None).cast(_FIELD)
    return requests.join(planned.select("request_id").distinct(), "request_id", "left_anti").select(
        "request_id", F.lit(0).alias("query_no"), F.col("request").alias("query"),
        F.lit("hybrid").alias("strategy"), F.lit(default_top_k).alias("top_k"),
        scope_filter(nothing, F.col("repository_ids"), F.col("branch")).alias("filter"),
        F.lit(True).alias("fallback"))


def compose_debug_request(report: Column, stack_trace: Column, reproduction: Column) -> Column:
    def section(title: str, body: Column) -> Column:
        trimmed = T.strip_space(body)
        return F.when(trimmed != "", F.concat(F.lit(title), trimmed))

    return F.concat_ws("\n\n", F.nullif(T.strip_space(report), F.lit("")),
                       section("Stack trace:\n", stack_trace), section("Reproduction:\n", reproduction))


def compose_review_request(title: Column, diff: Column) -> Column:
    trimmed = T.strip_space(title)
    first = F.when(trimmed != "", F.concat(F.lit("Review of: "), trimmed)).otherwise(
        F.lit("Review the proposed change for correctness, impact, and risk."))
    touched = diff_paths(diff)
    files = F.when(F.size(touched) > 0, F.concat(
        F.lit("Files changed: "), F.array_join(F.slice(touched, 1, MAX_TOUCHED_FILES), ", ")))
    return F.concat_ws("\n", first, files)


def diff_paths(diff: Column) -> Column:
    """Paths a unified diff names, in first-seen order."""
    heads = F.filter(T.split_lines(F.coalesce(diff, F.lit(""))), lambda x: x.rlike(r"\A(?:\+\+\+|---) "))
    names = F.transform(heads, lambda x: T.strip_space(F.substring(x, 5, 1_000_000)))
    real = F.filter(names, lambda p: (p != "") & (p != "/dev/null"))
    return ordered_distinct(F.transform(real, lambda p: F.regexp_replace(p, r"\A[ab]/", "")))


_TEXTS = "array<string>"


def normalize_debug_output(raw: Column, n_evidence: Column) -> Column:
    """A debug answer as a struct: candidates, impacted files, steps, fix plan, confidence."""
    items = json_items(raw, "$.root_cause_candidates")

    def candidate(item: Column) -> Column:
        # evidence indices count from 0, citations from 1
        numbers = F.transform(json_items(item, "$.evidence_indices"), lambda v: v.try_cast("double").try_cast("int"))
        return F.struct(
            T.strip_space(F.coalesce(F.get_json_object(item, "$.hypothesis"), F.lit(""))).alias("hypothesis"),
            C.coerce_confidence(F.get_json_object(item, "$.confidence"), "medium").alias("confidence"),
            C.json_str_list(item, "$.impacted_files").alias("impacted_files"),
            T.strip_space(F.coalesce(F.get_json_object(item, "$.reasoning"), F.lit(""))).alias("reasoning"),
            F.filter(numbers, lambda i: i.isNotNull() & (i >= 0) & (i < n_evidence)).alias("evidence_indices"),
        )

    objects = F.filter(items, lambda i: i.startswith("{"))
    candidates = F.filter(F.transform(objects, candidate), lambda c: c["hypothesis"] != "")
    named = C.json_str_list(raw, "$.impacted_files")
    derived = ordered_distinct(F.flatten(F.transform(candidates, lambda c: c["impacted_files"])))
    summary = T.strip_space(F.coalesce(F.get_json_object(raw, "$.summary"), F.lit("")))
    guess = F.when(F.size(candidates) > 0, F.lit("medium")).otherwise(F.lit("low"))
    band = C.coerce_enum(F.get_json_object(raw, "$.confidence"), fv.CONFIDENCES, None)
    return F.struct(
        F.coalesce(F.nullif(summary, F.lit("")),
                   F.lit("The provided evidence does not clearly localize the bug.")).alias("summary"),
        candidates.alias("root_cause_candidates"),
        F.when(F.size(named) > 0, named).otherwise(derived).alias("impacted_files"),
        C.json_str_list(raw, "$.diagnostic_steps").alias("diagnostic_steps"),
        F.struct(
            C.json_str_list(raw, "$.fix_plan.steps").alias("steps"),
            C.json_str_list(raw, "$.fix_plan.risks").alias("risks"),
            C.json_str_list(raw, "$.fix_plan.test_strategy").alias("test_strategy"),
            F.nullif(T.strip_space(F.get_json_object(raw, "$.fix_plan.rollback")), F.lit("")).alias("rollback"),
        ).alias("fix_plan"),
        F.coalesce(band, guess).alias("confidence"))


def normalize_review_output(raw: Column, diff: Column) -> Column:
    """A review answer as a struct, with defaults that depend on whether a diff exists."""
    has_diff = ~T.is_blank(diff)
    summary = T.strip_space(F.coalesce(F.get_json_object(raw, "$.summary"), F.lit("")))
    default = F.when(has_diff, F.lit("The change could not be summarized from the available evidence.")).otherwise(
        F.lit("No reviewable change was provided."))
    band = C.coerce_enum(F.get_json_object(raw, "$.risk_level"), fv.CONFIDENCES, None)
    return F.struct(
        F.coalesce(F.nullif(summary, F.lit("")), default).alias("summary"),
        T.strip_space(F.coalesce(F.get_json_object(raw, "$.impact"), F.lit(""))).alias("impact"),
        F.coalesce(band, F.when(has_diff, F.lit("medium")).otherwise(F.lit("low"))).alias("risk_level"),
        C.json_str_list(raw, "$.affected_areas").alias("affected_areas"),
        C.json_str_list(raw, "$.suggested_tests").alias("suggested_tests"))


def _action(title: Column, detail: Column, rationale: Column) -> Column:
    return F.struct(title.alias("title"), detail.alias("detail"), rationale.alias("rationale"))


def normalize_next_actions(raw: Column, path: str = "$.next_actions", limit: int | None = None) -> Column:
    """Follow-up actions of an answer: objects need a title, plain strings are titles."""

    def action(item: Column) -> Column:
        def part(name: str) -> Column:
            return T.strip_space(F.coalesce(F.get_json_object(item, "$." + name), F.lit("")))

        as_text = _action(T.strip_space(item), F.lit(""), F.lit(""))
        return F.when(item.startswith("{"), _action(part("title"), part("detail"), part("rationale"))).otherwise(as_text)

    kept = F.filter(F.transform(json_items(raw, path), action), lambda a: a["title"] != "")
    return kept if C.positive(limit, "limit") is None else F.slice(kept, 1, limit)


def derived_actions(steps: Column, title: str, rationale: str) -> Column:
    """Actions out of the first diagnostic steps or suggested tests."""
    return F.transform(F.slice(steps, 1, DERIVED_ACTIONS), lambda s: _action(F.lit(title), s, F.lit(rationale)))


def diagnostic_actions(steps: Column) -> Column:
    return derived_actions(steps, "Run diagnostic", "Confirm or refute a root-cause hypothesis")


def test_actions(tests: Column) -> Column:
    return derived_actions(tests, "Add/run test", "Cover the change and its edge cases")
