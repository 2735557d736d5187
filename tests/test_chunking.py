import re
from pathlib import Path

import pytest
from conftest import SAMPLE, file_rows
from pyspark.sql import functions as F

from groundwell import fixed_values as fv
from groundwell.operators import chunking as C
from groundwell.operators import corpus as K
from groundwell.operators import embed as E
from groundwell.plans.indexing import index_repository, indexed_chunks
from groundwell.sources import chunk_store as CS
from groundwell.sources import files as FS
from groundwell.sources.datasets import load_eval_dataset


def spans_by_loop(n, window=60, overlap=12):
    out, i = [], 0
    while i < n:
        j = min(i + window, n)
        out.append((i + 1, j))
        if j >= n:
            break
        i += window - overlap
    return out


def test_windows_equal_the_loop(spark):
    sizes = list(range(0, 240))
    df = spark.createDataFrame([(n, "\n".join(["x"] * n)) for n in sizes], "n int, text string")
    got = {n: [] for n in sizes}
    for r in C.window_chunks(df).collect():
        got[r.n].append((r.start_line, r.end_line))
    assert {n: sorted(v) for n, v in got.items()} == {n: spans_by_loop(n) for n in sizes}


def test_blank_windows_go(spark):
    text = "\n".join(["x"] * 10 + [""] * 200)
    rows = C.window_chunks(spark.createDataFrame([(text,)], "text string")).collect()
    assert [(r.start_line, r.end_line) for r in rows] == [(1, 60)]


def test_sample_repository(spark):
    chunks = C.chunk_files(file_rows(spark, {k: v for k, v in SAMPLE.items() if k.endswith(("py", "md"))}))
    rows = chunks.collect()
    symbols = {r.symbol for r in rows}
    assert {"Settings", "load_settings", "TransferService", "slug", "Ledger service", "Setup", "Usage"} <= symbols
    assert "transfer" not in symbols  # methods stay inside their class
    assert not [r for r in rows if r.file_path == "pkg/__init__.py"]
    assert all(r.end_line >= r.start_line >= 1 and r.text.strip() and r.token_estimate >= 1 for r in rows)
    again = {r.chunk_id: r.content_hash for r in chunks.collect()}
    assert again == {r.chunk_id: r.content_hash for r in rows} and len(again) == len(rows)
    readme = {r.symbol: (r.start_line, r.end_line) for r in rows if r.chunk_type == "markdown"}
    assert readme == {"Ledger service": (1, 3), "Setup": (4, 6), "Usage": (7, 8)}


def test_edges(spark):
    big = "class Big:\n" + "\n".join(f"    x{i} = {i}" for i in range(200)) + "\ny = 1"
    rows = C.chunk_files(file_rows(spark, {
        "empty.py": "", "blank.md": " \n\n", "odd.weird": "hello\nworld", "big.py": big,
        "bad.py": "def f(:\n    x\ny = 1", "deco.py": "@d\ndef f():\n    pass\nif 1:\n    def g():\n        pass\n",
        "long.md": "# T\n" + "\n".join(["line"] * 130)})).collect()
    by = {}
    for r in rows:
        by.setdefault(r.file_path, []).append((r.symbol, r.start_line, r.end_line))
    by = {k: sorted(v, key=lambda s: s[1:]) for k, v in by.items()}
    assert "empty.py" not in by and "blank.md" not in by
    assert by["odd.weird"] == [(None, 1, 2)]
    assert by["big.py"][0] == ("Big", 1, 60) and by["big.py"][-1] == (None, 202, 202)
    assert by["bad.py"] == [("f", 1, 2), (None, 3, 3)]
    assert by["deco.py"] == [(None, 1, 3), (None, 4, 4), ("g", 5, 6)]
    assert by["long.md"] == [("T", 1, 60), ("T", 49, 108), ("T", 97, 131)]


def test_long_sections_are_split_into_lines_once(spark):
    pieces = str(C.markdown_pieces(F.split("text", "\n")))
    assert pieces.count("split(text") == 1  # and not again for every section
    assert pieces.count("split(") == 2  # the other one cuts a section, whatever its number of windows


def test_huge_definitions_are_split_into_lines_once(spark):
    assert str(C.definition_pieces(F.col("lines"), F.col("spans"))).count("split(") == 1
    assert str(C.boundary_spans(F.col("lines"))).count("slice(") == 1


def test_own_chunker(spark):
    files = file_rows(spark, {"a.py": "x\ny", "b.py": "z"})

    def halves(text, path):
        if path == "b.py":
            raise ValueError
        return [(1, 1, "first", "x"), (2, 2, None, "y")]

    rows = C.chunk_with(files, halves).orderBy("file_path", "start_line").collect()
    assert [(r.file_path, r.symbol, r.text) for r in rows] == [("a.py", "first", "x"), ("a.py", None, "y"), ("b.py", None, "z")]


def test_scan(spark, repo_dir):
    files = FS.repository_files(spark, repo_dir, "r1", "demo")
    rows = {r.file_path: r.text for r in files.collect()}
    # empty files, lock files, images and skipped folders are out; a binary text has no text
    assert set(rows) == {"config.py", "service.py", "README.md", "pkg/helpers.py", "blob.txt"}
    assert rows["blob.txt"] is None and rows["config.py"] == SAMPLE["config.py"]
    assert {r.file_path for r in FS.scan_repo_files(spark, repo_dir, ["pkg/"]).collect()} == {"pkg/__init__.py", "pkg/helpers.py"}


def test_scan_sees_underscored_names(spark, tmp_path):
    names = ["_a.py", "pkg/__init__.py", "_priv/b.py", ".circleci/c.yml", ".github/d.yml", "x/.cache/_e.py", "plain.py"]
    for name in names:
        path = tmp_path / "t" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x = 1")
    rows = FS.repository_files(spark, str(tmp_path / "t"), "r", "r").collect()
    assert {r.file_path for r in rows} == {"_a.py", "pkg/__init__.py", "_priv/b.py", ".circleci/c.yml", "plain.py"}
    assert len(rows) == 5 and all(r.text == "x = 1" for r in rows)


def test_lenient_decoding(spark):
    raw = [b"ok", b"caf\xc3", b"\xff\xfea", "genuine �".encode() + b"\x80", b"\xe2\x82\xacx\xe2\x82"]
    df = spark.createDataFrame([(bytearray(x),) for x in raw], "content binary")
    got = [r.text for r in FS.read_text_lenient(df).collect()]
    assert got == [x.decode("utf-8", "ignore") for x in raw]


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "chunks")
    first = C.chunk_files(file_rows(spark, {"a.md": "# A\none\n# B\ntwo", "b.md": "# C\nsame"}))
    CS.upsert_chunks(spark, path, first)
    CS.upsert_chunks(spark, path, C.chunk_files(file_rows(spark, {"z.md": "# Z\nx"}, repo="repo_2")))
    stored = CS.read_chunks(spark, path)
    markers = K.file_markers(stored)
    edited = C.chunk_files(file_rows(spark, {"a.md": "# A\nnew", "b.md": "# C\nsame", "n.md": "# N\nx"}))
    states = {r.file_path: r.state for r in K.incremental_diff(K.file_markers(edited), markers).collect()}
    assert states == {"a.md": "changed", "b.md": "unchanged", "n.md": "new"}
    todo = K.files_to_index(edited, markers)
    assert {r.file_path for r in todo.collect()} == {"a.md", "n.md"}
    CS.upsert_chunks(spark, path, todo)
    rows = sorted((r.repository_id, r.file_path, r.symbol) for r in CS.read_chunks(spark, path).collect())
    assert rows == [("repo_1", "a.md", "A"), ("repo_1", "b.md", "C"), ("repo_1", "n.md", "N"), ("repo_2", "z.md", "Z")]
    CS.delete_repository(spark, path, "repo_1")
    assert {r.repository_id for r in CS.read_chunks(spark, path).collect()} == {"repo_2"}


def listing(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*.parquet"))


def test_store_writes_only_what_changed_and_forgets_emptied_files(spark, tmp_path):
    path = str(tmp_path / "chunks")
    none = C.chunk_files(file_rows(spark, {"e.md": ""}))
    assert CS.upsert_chunks(spark, path, none) == 0  # a first batch without chunks leaves a readable table
    assert CS.upsert_chunks(spark, path, none) == 0
    assert CS.read_chunks(spark, path).count() == 0
    for repo in ("repo_1", "repo_2"):
        assert CS.upsert_chunks(spark, path, C.chunk_files(file_rows(spark, {"a.md": "# A\none", "b.md": "# B\ntwo"}, repo=repo))) == 2
    before = listing(path)
    same = C.chunk_files(file_rows(spark, {"a.md": "# A\none", "b.md": "# B\ntwo"}))
    assert CS.upsert_chunks(spark, path, same) == 0 and listing(path) == before  # an identical batch writes nothing
    emptied = file_rows(spark, {"a.md": "", "c.md": "# C\nx", "never.md": ""})
    for written in (2, 0):  # a repeated call changes nothing
        assert CS.upsert_chunks(spark, path, C.chunk_files(emptied), scanned=emptied) == written
        rows = sorted((r.repository_id, r.file_path) for r in CS.read_chunks(spark, path).collect())
        assert rows == [("repo_1", "b.md"), ("repo_1", "c.md"), ("repo_2", "a.md"), ("repo_2", "b.md")]
    gone = file_rows(spark, {"a.md": "", "b.md": ""}, repo="repo_2")
    CS.upsert_chunks(spark, path, C.chunk_files(gone), scanned=gone)
    assert {r.repository_id for r in CS.read_chunks(spark, path).collect()} == {"repo_1"}
    back = file_rows(spark, {"a.md": "# A\none"}, repo="repo_2")
    assert CS.upsert_chunks(spark, path, C.chunk_files(back), scanned=back) == 1
    assert {r.repository_id for r in CS.read_chunks(spark, path).collect()} == {"repo_1", "repo_2"}


def test_a_write_reads_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "chunks")
    CS.upsert_chunks(spark, path, C.chunk_files(file_rows(spark, {f"f{i}.md": f"# T{i}\nx" for i in range(60)})))
    new = C.chunk_files(file_rows(spark, {"f3.md": "# T3\nother"}))
    plan = CS.changed_files(spark, path, new)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket[^\]]* = \d+", plan) and "/chunks]" not in plan


def test_writes_that_were_cut_short_are_never_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "chunks")
    CS.upsert_chunks(spark, path, C.chunk_files(file_rows(spark, {"a.md": "# A\none", "b.md": "# B\ntwo"})))
    edited = C.chunk_files(file_rows(spark, {"a.md": "# A\nnew", "n.md": "# N\nx"}))

    def broken(path, chunks, files, version):  # fails between the chunks and their file rows
        chunks.withColumn("version", F.lit(version)).write.mode("append").partitionBy("bucket", "version").parquet(f"{path}/chunks")
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(CS, "_append", broken)
        with pytest.raises(RuntimeError):
            CS.upsert_chunks(spark, path, edited)
    assert sorted(r.text for r in CS.read_chunks(spark, path).collect()) == ["# A\none", "# B\ntwo"]
    assert CS.upsert_chunks(spark, path, edited) == 2
    assert sorted(r.text for r in CS.read_chunks(spark, path).collect()) == ["# A\nnew", "# B\ntwo", "# N\nx"]


def test_compaction_keeps_the_chunks_and_drops_the_rest(spark, tmp_path):
    path = str(tmp_path / "chunks")
    for i in range(4):
        CS.upsert_chunks(spark, path, C.chunk_files(file_rows(spark, {"a.md": f"# A\n{i}", f"n{i}.md": "# N\nx"})))
    gone = file_rows(spark, {"n0.md": ""})
    CS.upsert_chunks(spark, path, C.chunk_files(gone), scanned=gone)
    before = sorted(map(str, CS.read_chunks(spark, path).collect()))
    files = len(listing(path))
    assert len(CS.compact_chunks(spark, path, few=0)) >= 4
    assert sorted(map(str, CS.read_chunks(spark, path).collect())) == before and len(before) == 4
    assert len(listing(path)) < files and CS.read_files(spark, path).count() == 4
    assert CS.compact_chunks(spark, path, few=1) == []


def test_index_embeds_only_changed_files(spark, tmp_path):
    path, seen = str(tmp_path / "index"), spark.sparkContext.accumulator(0)

    def counted():
        def model(texts):
            seen.add(len(texts))
            return [[float(len(t)), 1.0] for t in texts]
        return model

    E.register_embedder("counted", 2, counted)
    files = file_rows(spark, {f"f{i}.md": f"# T{i}\nbody" for i in range(5)})
    assert index_repository(spark, path, files, "counted") == 5 and seen.value == 5
    assert index_repository(spark, path, files, "counted") == 0 and seen.value == 5
    edited = file_rows(spark, {"f1.md": "# T1\nlonger body", "f2.md": "", "f3.md": "# T3\nbody"})
    assert index_repository(spark, path, edited, "counted") == 2 and seen.value == 6
    rows = {r.file_path: (r.text, list(r.embedding)) for r in indexed_chunks(spark, path).collect()}
    assert set(rows) == {"f0.md", "f1.md", "f3.md", "f4.md"}
    assert all(v == [float(len(t)), 1.0] for t, v in rows.values())


def test_paths_below_roots_whose_name_comes_again(spark, tmp_path, monkeypatch):
    root = tmp_path / "repo"
    for name in ("packages/repo/sub/a.py", "lib/myrepo/b.py", "repo/c.py", "top.py", "_repo/repo/d.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x = 1")
    want = {"packages/repo/sub/a.py", "lib/myrepo/b.py", "repo/c.py", "top.py", "_repo/repo/d.py"}
    assert {r.file_path for r in FS.scan_repo_files(spark, str(root)).collect()} == want
    assert {r.file_path for r in FS.scan_repo_files(spark, f"file://{root}/").collect()} == want
    big = root / "big.py"
    big.write_text("y = 1\n" * 400_000)
    assert "big.py" in {r.file_path for r in FS.repository_files(spark, str(root), "r", "r").collect()}
    assert "big.py" not in {r.file_path for r in FS.repository_files(spark, str(root), "r", "r", max_bytes=1_000_000).collect()}


def test_definitions_of_many_languages(spark):
    sources = {
        "a.c": "#include <x.h>\nstatic int add(int a,\n               int b)\n{\n    return a;\n}\nint x = f(1);\n",
        "b.cpp": "void Box::open() const {\n    go();\n}\n", "c.js": "export const run = async (x) => {\n  y();\n};\nconst n = 3;\n",
        "d.sh": "deploy() {\n  ls\n}\n", "e.ex": "defmodule App.Core do\n  def go, do: 1\nend\n", "f.lua": "local function help(x)\n  return x\nend\n",
        "g.hs": "size :: Int -> Int\nsize x = x\n", "h.sql": "CREATE OR REPLACE VIEW v.totals AS\n  SELECT 1;\n",
        "i.rs": "impl<T> Show for Wrapper {\n    fn x() {}\n}\nfn plain() {\n}\n", "J.java": "@Service\npublic class Store {\n  int x;\n}\n",
    }
    found = {}
    for r in C.chunk_files(file_rows(spark, sources)).collect():
        if r.symbol:
            found.setdefault(r.file_path, []).append((r.symbol, r.start_line, r.end_line))
    want = {"a.c": [("add", 2, 6)], "b.cpp": [("Box::open", 1, 3)], "c.js": [("run", 1, 3)], "d.sh": [("deploy", 1, 3)],
            "e.ex": [("App.Core", 1, 3)], "f.lua": [("help", 1, 3)], "g.hs": [("size", 1, 1)], "h.sql": [("v.totals", 1, 2)],
            "i.rs": [("Wrapper", 1, 3), ("plain", 4, 5)], "J.java": [("Store", 1, 4)]}
    assert {k: sorted(v, key=lambda x: x[1]) for k, v in found.items()} == {
        k: v for k, v in want.items() if detected(k) in fv.PARSED_LANGUAGES}
    assert len(found) >= 8


def detected(path):
    return fv.LANGUAGE_BY_EXTENSION[path.rpartition(".")[2].lower()]


def test_index_stats(spark):
    files = file_rows(spark, {"a.py": "x = 1", "b.md": "# T\né", "c.md": "", "d": "plain"})
    files = files.unionByName(file_rows(spark, {"bin.txt": "x"}).withColumn("text", F.lit(None).cast("string")))
    chunks = C.chunk_files(files.where("text is not null"))
    known = K.file_markers(chunks).where("file_path = 'b.md'")
    r = K.index_stats(files, K.incremental_diff(K.file_markers(chunks), known)).first()
    assert (r.num_files, r.num_chunks, r.num_skipped) == (3, 2, 3)
    assert r.bytes_indexed == 5 + 6 + 5 and r.languages == {"python": 1, "markdown": 1, "other": 1}


def test_dataset_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"examples": [{"id": "1", "question": "q?", "expected_files": ["x.py"]}, {"id": "2"}, {"id": "3", "question": "q", "mode": "bad"}]}')
    (tmp_path / "b.json").write_text('[{"id": "4", "question": "r", "mode": "debug"}]')
    (tmp_path / "c.json").write_text("not json")
    rows = {r.id: r for r in load_eval_dataset(spark, str(tmp_path)).collect()}
    assert set(rows) == {"1", "4"} and rows["1"].expected_files == ["x.py"] and rows["1"].mode == "ask"
