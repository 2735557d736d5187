import ast
import datetime as dt
from pathlib import Path

from conftest import SAMPLE, file_rows
from pyspark.sql import functions as F

from groundwell.operators import catalog as K
from groundwell.operators import codeintel as CI
from groundwell.operators import traces as TR
from groundwell.operators.numbering import numbered_by_range, numbered_within
from groundwell.plans.indexing import indexed_chunks
from groundwell.plans.requests import diff_paths
from groundwell.streaming import streams as S


def test_search(spark):
    files = file_rows(spark, {k: v for k, v in SAMPLE.items() if "\x00" not in v})
    hits = {(r.file_path, r.line) for r in CI.regex_search(files, "load_settings").collect()}
    assert hits == {("config.py", 10), ("service.py", 1)}
    assert {r.file_path for r in CI.regex_search(files, "transfer", glob="*.md").collect()} == {"README.md"}
    assert CI.regex_search(files, "absent pattern").count() == 0
    assert CI.regex_search(files, "(amount", max_results=1).count() == 0
    assert CI.regex_search(files, "transfer(", fixed=True).first().line == 5
    assert CI.regex_search(files, "import a").count() == 0  # skipped folder


def test_search_reads_large_files_whole(spark):
    rows = "\n".join(f"row {i} needle" if i % 1000 == 0 else "hay " * 12 for i in range(60_000)) + "\n" + "z" * 500 + " needle"
    files = file_rows(spark, {"big.txt": rows, "a/b/c/d/e/f/deep.py": "import needle\nprint(needle, print(1))\n"})
    assert len(rows) > 2_000_000
    hits = CI.regex_search(files, "needle").collect()
    assert len(hits) == 63 and {r.remaining for r in hits} == {0} and max(len(r.text) for r in hits) == 507
    cut = CI.regex_search(files, "needle", glob="*.txt", max_results=5, text_chars=9).collect()
    assert {(len(r.text), r.remaining) for r in cut} == {(9, 56)} and len(cut) == 5
    for wrong in ({"max_results": 0}, {"text_chars": -1}):
        try:
            CI.regex_search(files, "x", **wrong)
        except ValueError:
            continue
        raise AssertionError(wrong)
    assert {(r.kind, r.line) for r in CI.ast_findings(files).collect()} == {("print-call", 2)} and CI.ast_findings(files).count() == 2


def test_line_rules_of_python(spark):
    text = '''"""import a_docstring
from b_docstring import x
def (
"""
import os.path as p, sys  # import no
from . import near
from ..up.there import x; import late
if True:
    from deep.er import (
        one,
    )
s = "import in_string"
async def outer(
    a,
):
    try:
        pass

    except :
        return print

    def inner():
        self.print(1); print (2)
# except:
'''
    files = file_rows(spark, {"m.py": text, "async.py": "async def (x):\n    pass\nimport os\n"})
    found = {r.file_path: r for r in CI.python_imports(files).collect()}
    assert found["m.py"].internal == [".", "..up.there"] and found["m.py"].external == ["deep", "late", "os", "sys"]
    assert found["m.py"].warning is None and found["async.py"].external == [] and "line 1" in found["async.py"].warning
    kinds = {(r.file_path, r.kind, r.line, r.message) for r in CI.ast_findings(files, 9).collect()}
    assert {k[:3] for k in kinds} == {("m.py", "bare-except", 19), ("m.py", "print-call", 23), ("m.py", "long-function", 13),
                                      ("async.py", "syntax-error", 1)}
    assert [k[3] for k in kinds if k[1] == "long-function"] == ["function 'outer' is 11 lines (> 9)"]


def imports_by_walk(source):
    """Imports as a visit of the whole tree finds them."""
    internal, external = set(), set()
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.Import):
            external |= {alias.name.split(".")[0] for alias in node.names}
        elif isinstance(node, ast.ImportFrom) and node.level:
            internal.add("." * node.level + (node.module or ""))
        elif isinstance(node, ast.ImportFrom):
            external.add(node.module.split(".")[0])
    return sorted(internal), sorted(external)


WHOLE = {
    "one_line.py": "if x: import a.b\nelse: from c.d import e\n",
    "quotes.py": "s = '\"\"\"'\nimport a\nt = '\"\"\"'\nu = 'x\\'; import no'\n",
    "continued.py": "import a, \\\n    b.c as d, \\\n    e\nfrom \\\n    . import f\n",
    "string.py": 's = "x\\\nimport no"\nimport yes\n',
    "blocks.py": "try:\n    import a\nexcept A:\n    import b\nelse:\n    import c\nfinally:\n    import d\n"
                 "for x in y:\n    import e\nelse:\n    import f\nmatch x:\n    case 1:\n        import g\n"
                 "class H:\n    async def h(self):\n        with i:\n            while 1: from ..j.k import (l, m)\n",
    "open.py": "x = [\n    'import no',\n]\nimport os  # (\n",
    "letters.py": "import \u00e9t\u00e9.x\nfrom \u00f1 import y\n",
    "returns.py": "import a\r\nimport b\rimport c\r",
    "escape.py": "import a\ns = '\\d'\n",
    "future.pyi": "from __future__ import annotations\ndef f(x: int) -> str: ...\n",
    "empty.py": "",
}
BROKEN = {
    "indent.py": "import a\n  import b\n", "colon.py": "import a\nif x\n    pass\n", "bracket.py": "import a\nx = (1,\ny = 2\n",
    "closed.py": "import a\nx = 1)\n", "pair.py": "import a\nx = (1]\n", "quote.py": "import a\ns = 'open\n",
    "long_quote.py": 'import a\ns = """open\n', "target.py": "import a\n1 = x\n", "keyword.py": "import a\nclass = 1\n",
    "body.py": "import a\ndef f():\nx = 1\n", "twice.py": "import a\nx = 1 2\n", "from.py": "import a\nfrom import b\n",
    "zero.py": "import a\nx = '\x00'\n", "print.py": "import a\nprint 'x'\n", "deep.py": f"import a\nx = {'(' * 5000}{')' * 5000}\n",
    "name.py": "import a\ndef (\n",
}


def test_python_imports_follow_the_grammar(spark):
    files = file_rows(spark, WHOLE | BROKEN)
    files = files.unionByName(files.where("file_path = 'empty.py'").withColumns(
        {"file_path": F.lit("null.py"), "text": F.lit(None).cast("string")}))
    found = {r.file_path: r for r in CI.python_imports(files).collect()}
    assert set(found) == set(WHOLE) | set(BROKEN) | {"null.py"}
    for path, text in (WHOLE | {"null.py": ""}).items():
        assert (found[path].internal, found[path].external, found[path].warning) == (*imports_by_walk(text), None), path
    for path in BROKEN:
        assert found[path].internal == found[path].external == [], path
        assert found[path].warning.startswith(f"syntax error in {path}: "), path
    assert found["colon.py"].warning == "syntax error in colon.py: expected ':' (line 2)"


def test_errors_passed_over_are_read_by_line_rules(spark):
    files = file_rows(spark, WHOLE | BROKEN)
    found = {r.file_path: r for r in CI.python_imports(files, passed_over="^expected an indented block").collect()}
    assert {p for p, r in found.items() if r.warning} == set(BROKEN) - {"body.py"}
    assert found["body.py"].external == ["a"] and found["colon.py"].external == []
    every = {r.file_path: r for r in CI.python_imports(files, passed_over=".").collect()}
    assert {p for p, r in every.items() if r.warning} == {"name.py", "keyword.py"} and every["colon.py"].external == ["a"]
    assert {p: every[p][1:] for p in WHOLE} == {p: found[p][1:] for p in WHOLE}


def test_line_slice(spark):
    files = file_rows(spark, {"a": "x\ny\nz", "e": ""})
    rows = {r.file_path: r for r in CI.line_slice(files, F.lit(1), F.lit(1)).collect()}
    assert rows["a"].output == "     1\tx" and rows["a"].truncated and (rows["a"].first_line, rows["a"].last_line) == (1, 1)
    assert rows["e"].output == "(empty file)" and not rows["e"].truncated
    assert {r.output for r in CI.line_slice(files.where("file_path = 'a'"), F.lit(9), F.lit(2)).collect()} == {"(empty file)"}


def test_imports_and_manifests(spark):
    files = file_rows(spark, {
        **{k: v for k, v in SAMPLE.items() if k.endswith(".py")}, "bad.py": "def (", "a/b/c/d/e/deep.py": "import sys",
        "web/a.ts": "import x from './x'; import {y} from '@s/p/q'; require( \"lodash/fp\" )",
        "requirements-dev.txt": "pytest>=8\n# c\n-r base.txt\nRuff ; x\n", "pyproject.toml": '[project]\ndependencies = ["a[b]>1"]\n[tool.poetry.dependencies]\npython = "3"\nz = "1"\n',
        "package.json": '{"dependencies": {"react": "1"}, "devDependencies": {"vite": "2"}}', "broken/package.json": "{"})
    found = {r.file_path: (r.internal, r.external) for r in CI.import_map(files).collect()}
    assert found.pop("a/b/c/d/e/deep.py") == ([], ["sys"])
    assert "a/b/c/d/e/deep.py" not in {r.file_path for r in CI.import_map(files, depth=4).collect()}
    assert found == {"config.py": ([], ["os"]), "service.py": ([".config"], []), "web/a.ts": (["./x"], ["@s/p", "lodash"])}
    deps = {(r.manifest, r.dependency) for r in CI.declared_dependencies(files).collect()}
    assert deps == {("requirements-dev.txt", "pytest"), ("requirements-dev.txt", "Ruff"), ("pyproject.toml", "a"), ("pyproject.toml", "z"),
                    ("package.json", "react"), ("package.json", "vite")}


def test_findings(spark):
    body = "\n".join("    x = 1" for _ in range(70))
    files = file_rows(spark, {"p/__init__.py": "", "p/q/m.py": "try:\n    pass\nexcept:\n    print(1)\n# fixme later", "long.py": f"def f():\n{body}\n", "bad.py": "x = ("})
    found = {(r.kind, r.file_path, r.line) for r in CI.static_findings(files).collect()}
    assert found == {("bare-except", "p/q/m.py", 3), ("print-call", "p/q/m.py", 4), ("marker:FIXME", "p/q/m.py", 5), ("missing-init", "p/q", 0),
                     ("long-function", "long.py", 1), ("syntax-error", "bad.py", 1)}
    assert [r.kind for r in CI.findings_report(CI.static_findings(files)).collect()][:3] == ["syntax-error", "bare-except", "missing-init"]
    report = CI.static_report(files).first()
    assert (report.files_analyzed, report.finding_count, report.clean) == (4, 6, False)


def long_by_loop(text, limit):
    """Sizes of long functions: up to the last line with content before one that is indented as far or less."""
    lines, out = [x.split("#")[0] for x in text.split("\n")], []
    filled = [i for i, x in enumerate(lines) if x.strip()]
    for i in filled:
        if not lines[i].lstrip().startswith("def "):
            continue
        own, last = len(lines[i]) - len(lines[i].lstrip()), i
        for j in filled:
            if j > i:
                if len(lines[j]) - len(lines[j].lstrip()) <= own and lines[j].lstrip()[0] not in ")]}":
                    break
                last = j
        if last - i + 1 > limit:
            out.append((i + 1, last - i + 1))
    return out


def test_findings_are_found_once_before_they_are_sorted(spark):
    files = spark.createDataFrame([("r", "a/b.py", "try:\n    pass\nexcept:\n    print(1)  # TODO\n")],
                                  "repository_id string, file_path string, text string")
    report = CI.findings_report(CI.static_findings(files))
    assert "Generate" not in report._jdf.queryExecution().optimizedPlan().toString()
    assert [r.kind for r in report.collect()] == ["bare-except", "marker:TODO", "print-call"]


def test_function_lengths_in_one_fold(spark):
    import random

    rng = random.Random(4)
    def source(n):
        depth, out = 0, []
        for k in range(n):
            depth = max(0, depth + rng.choice([-2, -1, 0, 0, 0, 1]))
            out.append("    " * depth + rng.choice([f"def f{k}(a):", "x = 1", "x = 1", "", ")", "# c"]))
        return "\n".join(out)
    files = {f"m{i}.py": source(120) for i in range(25)}
    big = "\n".join("\n".join([f"def g{k}(a):"] + ["    y = a"] * 19) for k in range(5_000))  # 100,000 lines
    files["big.py"] = big
    rows = CI._with_code(file_rows(spark, files)).select("file_path", CI._long_functions(6).alias("f"))
    started = dt.datetime.now()
    got = {r.file_path: sorted((f.line, f.size) for f in r.f) for r in rows.collect()}
    assert (dt.datetime.now() - started).total_seconds() < 60
    for path, text in files.items():
        if path != "big.py":
            assert got[path] == long_by_loop(text, 6), path
    assert got["big.py"] == [(20 * k + 1, 20) for k in range(5_000)]


def test_diffs_and_logs(spark):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n+one\n-two\n-three\n--- /dev/null\n+++ b/new.py\n"
    row = spark.createDataFrame([(diff,)], "d string").select(CI.diff_stats(F.col("d")).alias("s"), diff_paths(F.col("d")).alias("p")).first()
    assert tuple(row.s) == (1, 1, 2) and row.p == ["x", "new.py"]
    logs = spark.createDataFrame([("a", 1, "x\n== 2 failed, 3 passed, 1 error in 1s =="), ("b", 5, "no tests ran in 0.1s"), ("c", 0, None)], "run_id string, exit_code int, log string")
    got = {r.run_id: r for r in CI.test_log_summary(logs).collect()}
    assert (got["a"].passed, got["a"].failed, got["a"].errors, got["a"].total, got["a"].all_passed) == (3, 2, 1, 6, False)
    assert got["b"].no_tests_collected and got["c"].all_passed


def test_numbering_and_slugs(spark):
    day = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, "Core" if i % 3 else "Team", day + dt.timedelta(hours=7 * i)) for i in range(40)], "id int, name string, created_at timestamp")
    numbers = {r.id: r.n for r in numbered_within(rows, ["name"], ["created_at"], F.to_date("created_at"), "n").collect()}
    assert sorted(numbers[i] for i in range(40) if i % 3 == 0) == list(range(1, 15))
    taken = spark.createDataFrame([("core",), ("core-3",), ("core-4",), ("other",)], "slug string")
    slugs = {r.id: r.slug for r in K.unique_slugs(rows.where("id < 8"), taken).collect()}
    assert slugs == {0: "team", 3: "team-2", 6: "team-3", 1: "core-2", 2: "core-5", 4: "core-6", 5: "core-7", 7: "core-8"}


def test_slugs_of_one_base_and_one_moment(spark):
    day, n = dt.datetime(2024, 1, 1), 20_000
    rows = spark.range(n).select(F.col("id"), F.lit("Core").alias("name"), F.lit(day).alias("created_at"))
    taken = spark.range(2, 5_000).select(F.concat(F.lit("core-"), F.col("id").cast("string")).alias("slug"))
    slugs = {r.id: r.slug for r in K.unique_slugs(rows, taken).collect()}
    assert slugs[0] == "core" and all(slugs[i] == f"core-{i + 4_999}" for i in range(1, n))


def test_numbers_by_range_split_a_hot_key(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
                                      (F.col("id") % 3).alias("o"), F.col("id"))
    numbered = numbered_by_range(rows, ["k"], ["o"], "n").withColumn("part", F.spark_partition_id())
    by = {}
    for r in numbered.collect():
        by.setdefault(r.k, []).append((r.n, r.o))
    for found in by.values():
        assert [n for n, _ in sorted(found)] == list(range(1, len(found) + 1))
        assert [o for _, o in sorted(found)] == sorted(o for _, o in found)


def test_eval_results_are_stored_once_per_run(spark, tmp_path):
    schema = "run_id string, id string, created_at timestamp, overall double"
    at, path = dt.datetime(2024, 1, 1), str(tmp_path / "evals")
    run = lambda name, scores: spark.createDataFrame([(name, f"{name}-{i}", at + dt.timedelta(minutes=i), x) for i, x in enumerate(scores)], schema)
    for results in (run("a", [0.1, 0.2]), run("b", [0.3, None]), run("b", [0.4]), run("b", [0.4])):  # b is retried
        TR.eval_result_sink(results, path)
    stored = TR.read_eval_results(spark, path, schema)
    assert sorted((r.run_id, r.overall) for r in stored.collect()) == [("a", 0.1), ("a", 0.2), ("b", 0.4)]
    assert [r.id for r in TR.recent_evals(stored, 2).collect()] == ["a-1", "a-0"]


def test_trace_rules(spark):
    now = dt.datetime(2024, 1, 10)
    rows = spark.createDataFrame([("a", "w", now - dt.timedelta(days=1)), ("a", "v", now - dt.timedelta(days=2)), ("b", "w", now - dt.timedelta(days=8)), ("c", "w", now)],
                                 "id string, workflow string, created_at timestamp")
    kept = TR.trace_sink(rows, F.lit(now)).collect()
    assert [(r.id, r.workflow) for r in kept] == [("c", "w"), ("a", "w")]


def test_stream_ingest_from_a_directory(spark, tmp_path):
    root, out = tmp_path / "repo", str(tmp_path / "chunks")
    for name, text in SAMPLE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)

    def ingest(state):
        S.stream_ingest(S.stream_files(spark, str(root), "r1", "demo"), out, str(tmp_path / state)).awaitTermination()
        return sorted(map(str, Path(out).rglob("*.parquet"))), indexed_chunks(spark, out).collect()

    files, stored = ingest("state")
    assert {r.file_path for r in stored} == {"config.py", "service.py", "README.md", "pkg/helpers.py"}
    assert all(len(r.embedding) == 32 and any(r.embedding) for r in stored)
    assert ingest("state") == (files, stored)  # nothing new arrives
    assert ingest("other-state") == (files, stored)  # all files come again: nothing is written
    (root / "config.py").write_text("import sys\n")
    assert ingest("other-state") == (files, stored)  # a stream reads a path once
    more, stored = ingest("third-state")
    assert {r.text for r in stored if r.file_path == "config.py"} == {"import sys"} and len(more) == len(files) + 2


def test_trace_stream_forgets_after_seven_days(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    schema = "id string, workflow string, created_at timestamp"
    src, out = str(tmp_path / "in"), str(tmp_path / "traces")
    rows = [("a", "old", day(1)), ("b", "edge-out", day(3, 5)), ("c", "edge-in", day(3, 7)), ("a", "new", day(4)), ("d", "last", day(9))]
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    S.stream_trace_upsert(stream(), out, str(tmp_path / "s")).awaitTermination()
    assert sorted(p.name for p in Path(out).iterdir() if p.is_dir()) == ["day=2024-01-01", "day=2024-01-03", "day=2024-01-04", "day=2024-01-09"]
    now = day(10, 6)
    want = [("a", "new"), ("c", "edge-in"), ("d", "last")]
    assert sorted((r.id, r.workflow) for r in S.read_traces(spark, out, F.lit(now)).collect()) == want
    S.expire_traces(spark, out, now)
    on_disk = spark.read.parquet(out)
    assert sorted((r.id, r.workflow) for r in on_disk.select("id", "workflow").collect()) == want  # gone from the disk
    assert sorted((r.id, r.workflow) for r in S.read_traces(spark, out, F.lit(now)).collect()) == want
    S.expire_traces(spark, out, now)  # again: nothing to do
    S.expire_traces(spark, out, day(10, 8))  # the last row of a day goes, and its folder
    assert not (Path(out) / "day=2024-01-03").exists()
    want = [("a", "new"), ("d", "last")]
    assert sorted((r.id, r.workflow) for r in spark.read.parquet(out).select("id", "workflow").collect()) == want
    again = [("a", "newest", day(9, 1)), ("a", "newer", day(9, 0))]
    for row in again:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(src)
    S.stream_trace_upsert(stream(), out, str(tmp_path / "s")).awaitTermination()
    want = [("a", "newest"), ("d", "last")]
    assert sorted((r.id, r.workflow) for r in S.read_traces(spark, out, F.lit(now)).collect()) == want
    S.compact_traces(spark, out)
    assert sorted((r.id, r.workflow) for r in S.read_traces(spark, out, F.lit(now)).collect()) == want
    assert len(list((Path(out) / "day=2024-01-09").iterdir())) == 1
    S.stream_trace_upsert(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "t"), now=lambda: now).awaitTermination()
    assert not (Path(out) / "day=2024-01-01").exists()  # expiry after each batch, where a clock is given


def test_stream_jobs_out_of_order(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    schema = "job_id string, status string, progress double, updated_at timestamp"
    src = str(tmp_path / "in")
    spark.createDataFrame([("j", "running", 0.5, at(5)), ("k", "succeeded", 7.0, at(1))], schema).coalesce(1).write.parquet(src)
    spark.createDataFrame([("j", "pending", 0.1, at(2))], schema).coalesce(1).write.mode("append").parquet(src)
    seen = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    query = S.stream_job_progress(stream).writeStream.outputMode("update").foreachBatch(
        lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {r.job_id: (r.status, r.progress, r.terminal) for r in seen}
    assert last == {"j": ("running", 0.5, False), "k": ("succeeded", 1.0, True)}


def _times_read(df, pattern):
    return df._jdf.queryExecution().optimizedPlan().toString().count(pattern)


def test_import_map_reads_a_text_once(spark):
    """The filter on the lists is not moved below them, where it would find all imports a second time."""
    files = file_rows(spark, {"a.py": "import os, b.c as d\nfrom .x import y\n", "b.py": "x = 1\n", "c.ts": "import a from '@s/p/q'\n",
                              "d.py": "import a;import é.f,(g)\nfrom  h.i import *\n"})
    found = CI.import_map(files)
    assert _times_read(found, "import[ \\t]+(") == 1 and _times_read(found, "require") == 1
    assert {r.file_path: (r.internal, r.external) for r in found.collect()} == {
        "a.py": ([".x"], ["b", "os"]), "c.ts": ([], ["@s/p"]), "d.py": ([], ["a", "h"])}


def test_marker_of_a_line_is_searched_once(spark):
    files = file_rows(spark, {"a.py": "x = 1  # todo: é \n\u00a0# FIXME\u2003\nprint(2) # nothing\n"})
    found = CI.marker_findings(files)
    assert _times_read(found, "TODO") == 1
    assert {(r.line, r.kind, r.message) for r in found.collect()} == {
        (1, "marker:TODO", "x = 1  # todo: é"), (2, "marker:FIXME", "# FIXME")}


def test_long_functions_past_lines_that_are_left_out(spark):
    body = "        y = 1\n" * 3
    text = "import os\n\n" * 3 + f"class A:\n    def f(self):\n{body}        def g():\n            return 2\n    )\n{body}\n\nz = 1\ndef h():\n{body}"
    found = CI.ast_findings(file_rows(spark, {"a.py": text, "b.py": "x = 1\n"}), max_function_lines=3)
    assert {(r.line, r.message.split(" (")[0]) for r in found.collect()} == {
        (8, "function 'f' is 10 lines"), (21, "function 'h' is 4 lines")}
