import json

import pytest
from conftest import file_rows
from pyspark.sql import functions as F

from groundwell import fixed_values as fv
from groundwell.operators import evals as V
from groundwell.operators import evidence as E
from groundwell.plans import answers as A
from groundwell.plans import requests as R
from groundwell.plans.indexing import index_repository, indexed_chunks

EV = ("request_id string, query_id string, query_no int, rank int, chunk_id string, text string, repository_id string, "
      "repo_name string, file_path string, symbol string, start_line int, end_line int, score double")


def evidence(spark, rows):
    return spark.createDataFrame([("r1", "q", 0, i, c, t, "repo_1", "demo", p, None, s, e, sc) for i, (c, t, p, s, e, sc) in enumerate(rows)], EV)


ROWS = [("a", "one", "a.py", 1, 3, 0.9), ("b", "\n".join(f"l{i}" for i in range(40)), "b.py", 1, 40, 0.8), ("c", "again", "a.py", 1, 3, 0.7)]


def test_citations(spark):
    rows = E.build_citations(evidence(spark, ROWS), 5).orderBy("index").collect()
    assert [(r["index"], r.file_path, r.repository) for r in rows] == [(1, "a.py", "demo"), (2, "b.py", "demo")]
    assert rows[1].snippet == "l0\nl1\nl2\nl3\nl4\n… (+35 more lines)"


def test_merge(spark):
    rows = E.merge_evidence(evidence(spark, ROWS)).orderBy("rank").collect()
    assert [(r.chunk_id, r.rank) for r in rows] == [("a", 0), ("b", 1)]
    many = evidence(spark, [(f"k{i:02}", "x", "f.py", i + 1, i + 1, i / 100) for i in range(30)])
    assert [r.chunk_id for r in E.merge_evidence(many).orderBy("rank").collect()] == [f"k{i:02}" for i in range(29, 17, -1)]


def test_pack_context(spark):
    def pack(rows, limit):
        return E.pack_context(evidence(spark, rows), limit, spark.createDataFrame([("r1",), ("r2",)], "request_id string")).orderBy("request_id").collect()

    both = pack(ROWS[:2], 4000)
    assert both[0].context.startswith("[1] demo · a.py:1-3\none\n\n[2] demo · b.py:1-40\nl0\n")
    assert both[1].context == fv.NO_EVIDENCE
    wide = [("a", "x" * 2000, "a.py", 1, 2, 1.0), ("b", "y" * 2000, "b.py", 1, 2, 0.5)]
    cut = pack(wide, 1200)[0].context
    assert cut.endswith("… (truncated)") and len(cut) <= 1200 and "[2]" not in cut
    assert pack(wide, 250)[0].context == fv.NO_EVIDENCE


def test_empty_evidence(spark):
    none = evidence(spark, ROWS).where("1 = 0")
    assert E.build_citations(none).count() == 0 and E.pack_context(none).count() == 0


def test_batch_retrieve_and_fallback_answer(spark):
    requests = spark.createDataFrame([("r1", "transfer ledger", ["repo_1"], "main", '{"queries": [{"query": "transfer", "strategy": "sparse"}]}'),
                                      ("r2", "nothing", ["repo_9"], "main", None)],
                                     "request_id string, request string, repository_ids array<string>, branch string, plan string")
    chunks = spark.createDataFrame([("a", "transfer money", "repo_1", "demo", "a.py", 1), ("b", "cooking", "repo_1", "demo", "b.py", 1), ("c", "transfer", "repo_2", "x", "c.py", 1)],
                                   "chunk_id string, text string, repository_id string, repo_name string, file_path string, start_line int").select(
        "*", F.lit("main").alias("branch"), F.lit("python").alias("language"), F.lit("code").alias("chunk_type"), F.lit(2).alias("end_line"),
        F.lit(None).cast("string").alias("symbol"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    queries = R.normalize_query_plan(requests).withColumn("query_vec", F.array(F.lit(1.0).cast("float")))
    _, found, cites, context = A.batch_retrieve(queries, chunks)
    assert {r.file_path for r in found.where("request_id = 'r1'").collect()} == {"a.py", "b.py"}
    assert found.where("request_id = 'r2'").count() == 0
    assert {r.request_id: r.context == fv.NO_EVIDENCE for r in context.collect()} == {"r1": False, "r2": True}
    answers = {r.request_id: r for r in A.evidence_only_answer(requests, cites).collect()}
    assert "- [1] demo · a.py:1-2" in answers["r1"].answer and len(answers["r1"].next_actions) == 2
    assert answers["r2"].answer == A.NO_ANSWER and len(answers["r2"].next_actions) == 1


RESPONSE = ("example_id string, message string, answer string, confidence string, "
            "evidence array<struct<text:string,file_path:string,symbol:string,score:double>>, "
            "citations array<struct<index:int,file_path:string,snippet:string>>, "
            "next_actions array<struct<title:string>>, tools_used array<struct<tool:string,ok:boolean>>, "
            "expected_files array<string>, expected_keywords array<string>")
EVIDENCE = [("def transfer(amount): raise ValueError for negative amount", "src/service.py", "transfer", 0.8)]
CITES = [(1, "src/service.py", "def transfer(amount)")]
GOOD = "The transfer function raises ValueError for a negative amount, see service.py [1]."


def response(name, **change):
    base = dict(example_id=name, message="What does transfer raise for a negative amount?", answer=GOOD, confidence="high", evidence=EVIDENCE,
                citations=CITES, next_actions=[("do",)], tools_used=[("read_file", True)], expected_files=[], expected_keywords=[])
    return tuple({**base, **change}.values())


def test_metrics(spark):
    rows = spark.createDataFrame([
        response("good"), response("nocite", citations=[]), response("lies", answer="Bananas orbit Jupiter; see src/banana.py and lib/moon.py."),
        response("blank", answer="  "), response("nothing", evidence=[], citations=[]), response("tools", tools_used=[("a", True), ("b", False), ("b", False)]),
        response("labels", expected_files=["a/src/service.py", "other.py"], expected_keywords=["transfer", "the"]), response("odd", confidence="sure", next_actions=None)], RESPONSE)
    got = {(r.example_id, r.metric): r for r in V.score_all(rows).collect()}
    assert len(got) == 8 * 5 and all(0 <= r.score <= 1 for r in got.values())
    score = lambda e, m: got[(e, m)].score
    assert got[("good", "grounding")].passed and score("good", "completeness") == 1.0
    assert score("nocite", "completeness") == 0.75 and score("odd", "completeness") == 0.5
    assert score("lies", "grounding") < score("good", "grounding")
    assert "uncited_files=2" in got[("lies", "grounding")].rationale
    assert score("blank", "grounding") == score("blank", "relevance") == 0.0
    assert got[("nothing", "grounding")].rationale.startswith("no evidence") and score("nothing", "retrieval_quality") == 0.0
    assert score("tools", "tool_success") == pytest.approx(0.3333) and got[("tools", "tool_success")].rationale == "1/3 tools succeeded; failed: b"
    assert score("good", "retrieval_quality") == pytest.approx(0.7 + 0.1) and score("labels", "retrieval_quality") == pytest.approx(0.5 * 0.8 + 0.25)
    assert "expected_hit=1/2" in got[("labels", "retrieval_quality")].rationale
    assert "keyword_cov=0.50" in got[("labels", "relevance")].rationale


def test_summary_and_missing_response(spark):
    responses = spark.createDataFrame([response("e1")], RESPONSE)
    examples = spark.createDataFrame([("e1", "What does transfer raise?", [], []), ("e2", "q", ["x"], [])],
                                     "example_id string, question string, expected_files array<string>, expected_keywords array<string>")
    scores = V.eval_join(examples, responses)
    table = {r.metric: r for r in V.eval_run_summary(scores).collect()}
    assert table["completeness"].n == 2 and table["completeness"].average == 0.5 and table["overall"].pass_rate == 0.5
    report = {r.example: r for r in V.eval_report(scores).collect()}
    assert report["e2"]["pass"] == "n" and report["e1"]["pass"] == "Y" and report["AVERAGE"]["pass"] is None


def test_judge_failure_gives_null(spark):
    ask = V.judge_model(lambda q, e, a: 1 / 0)
    assert spark.range(2).select(ask(F.lit("q"), F.lit("e"), F.lit("a")).alias("raw")).where("raw is null").count() == 2


def test_requests_are_answered_from_an_index_with_one_embedder(spark, tmp_path):
    """Plan, query embedding, all strategies, filters, re-ranking, citations and context in one call."""
    path = str(tmp_path / "index")
    texts = {f"src/m{i}.py": f"def transfer_{i}(amount):\n    return amount * {i}\n" for i in range(6)} | {
        "docs/a.md": "# Ledger\ntransfers between accounts", "docs/b.md": "# Cooking\nsoup and bread"}
    assert index_repository(spark, path, file_rows(spark, texts)) == 8
    chunks = indexed_chunks(spark, path)
    plan = json.dumps({"queries": [
        {"query": "transfer amount", "strategy": "sparse", "top_k": 2, "filter": {"path_prefix": "src/m"}},
        {"query": "ledger transfers between accounts", "strategy": "dense", "top_k": 1},
        {"query": "soup and bread", "strategy": "hybrid", "top_k": 1, "filter": {"file_types": ["md"]}}]})
    requests = spark.createDataFrame(
        [("r1", "?", ["repo_1"], "main", plan), ("r2", "soup and bread", ["repo_1"], "main", None),
         ("r3", "soup", ["another"], "main", None)],
        "request_id string, request string, repository_ids array<string>, branch string, plan string")
    got = A.answer_requests(requests, chunks)
    vectors = {r.query_id: r.query_vec for r in got.queries.collect()}
    assert set(vectors) == {"r1/0", "r1/1", "r1/2", "r2/0", "r3/0"} and vectors["r1/0"] is None and len(vectors["r1/1"]) == 32
    cited = {}
    for r in got.citations.collect():
        cited.setdefault(r.request_id, set()).add(r.file_path)
    assert {"docs/a.md", "docs/b.md"} < cited["r1"] and len([p for p in cited["r1"] if p.startswith("src/m")]) == 2
    assert "docs/b.md" in cited["r2"] and "r3" not in cited
    context = {r.request_id: r.context for r in got.context.collect()}
    assert "soup and bread" in context["r2"] and context["r3"] == fv.NO_EVIDENCE
    flipped = A.answer_requests(requests.where("request_id = 'r2'"), chunks, scorer=lambda q, t: -F.length(t))
    shortest = flipped.evidence.orderBy("rank").first()
    assert len(shortest.text) == min(len(r.text) for r in flipped.evidence.collect())


def test_disabled_and_degraded_judges_give_no_scores(spark):
    good = '{"grounding": 0.9, "relevance": 0.8, "issues": []}'
    rows = [("ok", good, True), ("null", good, None), ("off", good, False), ("gone", "[model unavailable] " + good, True),
            ("stand-in", '{"_warning": "no model", "grounding": 0.9, "relevance": 0.8}', True), ("none", None, True)]
    judged = spark.createDataFrame([(n, raw, "an answer", 1, on) for n, raw, on in rows],
                                   "example_id string, raw string, answer string, n_citations int, enabled boolean")
    assert {r.example_id for r in V.judge_scores(judged).collect()} == {"ok", "null"}
    assert {r.example_id for r in V.judge_scores(judged.drop("enabled")).collect()} == {"ok", "null", "off"}
