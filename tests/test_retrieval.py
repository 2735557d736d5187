import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text import bag

from groundwell.operators import dense as D
from groundwell.operators import embed as E
from groundwell.operators import hybrid as H
from groundwell.operators import scope as S
from groundwell.operators import sparse as B

TEXTS = {
    "c1": "def transfer(amount): raise ValueError if amount is negative",
    "c2": "README Ledger service transfers money between accounts transfer transfer",
    "c3": "class LedgerStore: def load_balance(self): return balance",
    "c4": "unrelated text about cooking",
    "c5": "the the the transfer",
    "c6": "the loadBalance helper",
    "c7": "the the ledger",
}


def bm25(query, corpus):
    """Scores of the whole corpus by the formula, document by document."""
    docs = {i: Counter(bag(t)) for i, t in corpus.items()}
    n = len(docs)
    mean = sum(sum(d.values()) for d in docs.values()) / n
    df = Counter(t for d in docs.values() for t in d)
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf) if idf else 0.0
    idf = {t: v if v >= 0 else floor for t, v in idf.items()}
    out = {}
    for i, d in docs.items():
        dl = sum(d.values())
        out[i] = round(sum(idf.get(t, 0) * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * dl / mean)) for t in bag(query)), 9)
    return out


def top(scores, k):
    return [(i, s) for i, s in sorted(scores.items(), key=lambda p: (-p[1], p[0]))[:k]]


def chunk_frame(spark, texts=TEXTS, repo="repo_1"):
    rows = [(i, t, repo if i != "c3" else "repo_2", "main", "python" if i < "c3" else "markdown", "code", f"src/{i}.py") for i, t in texts.items()]
    return spark.createDataFrame(rows, "chunk_id string, text string, repository_id string, branch string, language string, chunk_type string, file_path string")


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.chunk_id, r.score, r.rank))
    return out


def same(got, want):
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-8)
    assert [g[2] for g in got] == list(range(len(got)))


QUERIES = {"q1": "transfer amount transfer", "q2": "nothingmatches", "q3": "the", "q4": "load balance ledger", "q5": ""}


@pytest.mark.parametrize("k,options", [(2, {}), (5, {"salt_rows": 1}), (50, {})])
def test_sparse_equals_formula(spark, k, options):
    queries = spark.createDataFrame([(q, t, k) for q, t in QUERIES.items()], "query_id string, query string, top_k int")
    got = by_query(B.sparse_topk(queries, chunk_frame(spark), **options))
    for q, text in QUERIES.items():
        same(got[q], top(bm25(text, TEXTS), k))


@pytest.mark.parametrize("texts", [
    {"a": "x y", "b": "x y", "c": "x y", "d": "z"},  # most terms in over half: negative scores
    {"a": "x"},
    {"a": "x y", "b": "x z"},
    {"c": "x q", "b": "x q", "a": "x q", "d": "x w", "e": "x w q"},
    {"a": "", "b": "!!"},
])
@pytest.mark.parametrize("options", [{}, {"salt_rows": 1}])
def test_sparse_with_negative_idf(spark, texts, options):
    asked = {"q1": "x", "q2": "y z", "q3": "w q x"}
    queries = spark.createDataFrame([(q, t, k, f"{q}-{k}") for q, t in asked.items() for k in (1, 2, 9)], "q string, query string, top_k int, query_id string")
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    got = by_query(B.sparse_topk(queries, chunks, **options))
    for r in queries.collect():
        empty = not any(bag(t) for t in texts.values())
        want = {i: 0.0 for i in texts} if empty else bm25(r["query"], texts)
        same(got[r.query_id], top(want, r.top_k))


def test_pairs_are_summed_where_their_chunk_lies(spark, monkeypatch):
    """No pair of query and chunk is shuffled, and more postings make more tasks."""
    queries = spark.createDataFrame(list(QUERIES.items()), "query_id string, query string")
    monkeypatch.setattr(B, "TASK_ROWS", 1)
    pairs = B.bm25_score(queries, chunk_frame(spark))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk_id" in plan and "hashpartitioning(query_id" not in plan
    assert pairs.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    got = {(r.query_id, r.chunk_id): r.score for r in pairs.collect()}
    for q, text in QUERIES.items():
        want = {i: s for i, s in bm25(text, TEXTS).items() if s}
        assert {c: s for (asked, c), s in got.items() if asked == q} == pytest.approx(want, abs=1e-8)


FILTERS = {
    "q1": (["repo_1"], None, None, None, None),
    "q2": (None, "main", ["py"], None, None),
    "q3": (["repo_1", "repo_2"], None, [".md"], "src/c", ["code", "doc"]),
    "q4": (None, None, None, "src/c3", None),
    "q5": (None, "dev", None, None, None),
}


def admitted(f, r):
    langs = None if not f[2] else [{"py": "python", "md": "markdown"}[x.lstrip(".")] for x in f[2]]
    return ((not f[0] or r.repository_id in f[0]) and (not f[1] or r.branch == f[1]) and (not langs or r.language in langs)
            and (not f[3] or r.file_path.startswith(f[3])) and (not f[4] or r.chunk_type in f[4]))


def test_scopes_and_filtered_statistics(spark):
    chunks = chunk_frame(spark)
    queries = spark.createDataFrame([(q, "ledger transfer the", 3, FILTERS[q]) for q in FILTERS],
                                    f"query_id string, query string, top_k int, filter {S.FILTER}")
    rows = chunks.collect()
    paired = {}
    for r in S.with_scope(queries).join(S.scope_chunks(queries, chunks, ["chunk_id"]), "scope_id").collect():
        paired.setdefault(r.query_id, set()).add(r.chunk_id)
    want = {q: {r.chunk_id for r in rows if admitted(f, r)} for q, f in FILTERS.items()}
    assert paired == {q: v for q, v in want.items() if v}
    for options in ({}, {"salt_rows": 2}):
        got = by_query(B.sparse_topk(queries, chunks, **options))
        assert set(got) == {"q1", "q2", "q3", "q4"}
        for q in got:
            same(got[q], top(bm25("ledger transfer the", {i: TEXTS[i] for i in want[q]}), 3))


def test_many_prefixes_are_looked_up_by_folder(spark):
    paths = [f"src{i % 7}/pkg{i % 11}/mod{i:04}.py" for i in range(400)] + ["top.py", "tool.py", "src1", None, "", "/abs/x.py", "src1//y.py"]
    chunks = spark.createDataFrame([(f"c{i}", "r", "main", "python", "code", p) for i, p in enumerate(paths)],
                                   "chunk_id string, repository_id string, branch string, language string, chunk_type string, file_path string")
    prefixes = [f"src{i % 7}/pkg{i % 11}/mod{i:04}"[: 3 + i % 18] for i in range(990)] + ["t", "to", "top.py", "", "src1/", "src1//", "/", "/abs", "zz", "src1"]
    queries = spark.createDataFrame([(f"q{i}", (None, None, None, p, None)) for i, p in enumerate(prefixes)], f"query_id string, filter {S.FILTER}")
    got = {}
    scoped = S.scope_chunks(queries, chunks, ["chunk_id"])
    for r in S.with_scope(queries).join(scoped, "scope_id").collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    want = {f"q{i}": {f"c{n}" for n, path in enumerate(paths) if path is not None and path.startswith(p)} for i, p in enumerate(prefixes)}
    assert {q: got.get(q, set()) for q in want if prefixes[int(q[1:])]} == {q: v for q, v in want.items() if prefixes[int(q[1:])]}
    plan = scoped._jdf.queryExecution().optimizedPlan().toString()
    assert "__key" in plan and "Cartesian" not in plan
    # no key of the join holds more than the chunks of one folder and three letters
    shapes = chunks.where("file_path is not null").select(F.explode(F.array(*[
        S.path_key(F.col("file_path"), F.lit(d), F.lit(3)) for d in (1, 2)])).alias("k")).where("k is not null")
    assert shapes.groupBy("k").count().agg(F.max("count")).first()[0] < 80


def vectors(spark, n=60, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dim)).round(1)
    data[5] = data[4]
    data[6] = data[4] * 2  # ties
    return data, spark.createDataFrame([(f"v{i:03}", [float(x) for x in v]) for i, v in enumerate(data)], "chunk_id string, embedding array<float>")


def exact(data, q, k):
    data = data.astype(np.float32).astype(float)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    scores = np.round(unit @ unit[q], 9)
    return top({f"v{i:03}": s for i, s in enumerate(scores)}, k)


@pytest.mark.parametrize("options", [
    {}, {"query_block": 7, "chunk_block": 11, "cells": 20, "first_slice": 2}, {"chunk_block": 3, "first_slice": 1}])
def test_dense_is_exact_for_any_blocks(spark, options):
    data, df = vectors(spark)
    top_k = (F.substring("chunk_id", 2, 3).cast("int") % 9 + 1).alias("top_k")  # queries want different numbers
    queries = df.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"), top_k)
    got = by_query(D.dense_topk(queries, df.repartition(4), **options))
    for q in range(len(data)):
        same(got[f"v{q:03}"], exact(data, q, q % 9 + 1))


@pytest.mark.parametrize("shape", [(1, 1), (7, 11), (1000, 4000), (3, 100_000), (5_000, 1)])
@pytest.mark.parametrize("cells", [1, 10, 2_000_000])
def test_products_stay_within_their_cells(shape, cells):
    done = np.zeros(shape, dtype=int) if np.prod(shape) < 100_000 else None
    if done is None and cells < 100:
        return  # too many parts to list
    total = 0
    for q, v in D.cell_slices(*shape, cells):
        size = (q.stop - q.start) * (v.stop - v.start)
        assert 0 < size <= cells
        total += size
        if done is not None:
            done[q, v] += 1
    assert total == np.prod(shape) and (done is None or (done == 1).all())


def test_bounds_leave_little_to_pass_on(spark):
    """Once the last place of a query is known from a slice, a block passes on no more than what can beat it."""
    rng = np.random.default_rng(2)
    units, data = D._unit_rows(rng.normal(size=(20, 16))), D._unit_rows(rng.normal(size=(8_000, 16)))
    ids, seen = np.array([f"c{i:05}" for i in range(len(data))], dtype=object), D.Seen(np.full(20, -np.inf), np.full(20, 5))
    found = [D._candidates(units, data[a : a + 250], ids[a : a + 250], seen, 1_000) for a in range(0, 8_000, 250)]
    assert len(found[0]) >= 100 and (seen.bounds > -1).all()
    assert sum(map(len, found[1:])) < 20 * 5 * np.log(8_000 / 250) * 2  # about k per doubling, not k per block
    best = np.sort(np.round(units @ data.T, 9), axis=1)[:, -5]
    assert (seen.bounds == best).all()


def test_vectors_of_different_lengths_are_refused(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "chunk_id string, embedding array<float>")
    queries = df.where("chunk_id = 'a'").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    with pytest.raises(Exception, match="different lengths|matmul"):
        D.dense_topk(queries, df.coalesce(1)).collect()


def test_cosine_column(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(D.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([math.sqrt(0.5), 0.0])


def norm(scores):
    lo, hi = min(scores.values()), max(scores.values())
    if hi - lo < 1e-9:
        return {i: 1.0 if hi > 0 else 0.0 for i in scores}
    return {i: (s - lo) / (hi - lo) for i, s in scores.items()}


@pytest.mark.parametrize("k,options", [(1, {}), (3, {}), (2, {"salt_rows": 1, "witnesses": 1})])
def test_hybrid_equals_formula(spark, k, options):
    chunks = E.embed_documents(chunk_frame(spark), "hash-32")
    vec = {r.chunk_id: np.asarray(r.embedding) for r in chunks.collect()}
    queries = E.embed_documents(spark.createDataFrame([(q, t, k) for q, t in QUERIES.items()], "query_id string, query string, top_k int"),
                                "hash-32", "query", "query_vec")
    asked = {r.query_id: np.asarray(r.query_vec) for r in queries.collect()}
    got = by_query(H.hybrid_topk(queries, chunks, **options))
    for q, text in QUERIES.items():
        qv = asked[q].astype(np.float32).astype(float)
        cos = {i: round(float(v.astype(np.float32).astype(float) @ qv / ((np.linalg.norm(v.astype(np.float32).astype(float)) * np.linalg.norm(qv)) or 1.0)), 9) for i, v in vec.items()}
        pool = top(cos, 3 * k)
        place = {i: n for n, (i, _) in enumerate(pool)}
        d, s = norm(dict(pool)), norm(bm25(text, TEXTS))
        fused = {i: round(0.6 * d.get(i, 0) + 0.4 * s[i], 6) for i in TEXTS}
        want = sorted(fused, key=lambda i: (-fused[i], place.get(i, 99), i))[:k]
        assert [g[0] for g in got[q]] == want
        assert [g[1] for g in got[q]] == pytest.approx([fused[i] for i in want], abs=1e-6)


def test_hybrid_with_one_leg(spark):
    queries = spark.createDataFrame([("q1", "transfer", 2, None)], "query_id string, query string, top_k int, query_vec array<float>")
    chunks = chunk_frame(spark).withColumn("embedding", F.lit(None).cast("array<float>"))
    rows = H.hybrid_topk(queries, chunks).orderBy("rank").collect()
    assert {r.retriever for r in rows} == {"sparse"}
    assert [(r.chunk_id, r.score) for r in rows] == [(i, pytest.approx(s)) for i, s in top(bm25("transfer", TEXTS), 2)]
    none = chunks.where("1 = 0")
    assert H.retrieve(queries.withColumn("strategy", F.lit("sparse")), none).count() == 0


def test_min_max(spark):
    df = spark.createDataFrame([(2.0, 2.0, 2.0), (0.0, 0.0, 0.0), (-1.0, -1.0, -1.0), (1.0, 0.0, 4.0)], "s double, lo double, hi double")
    assert [r[0] for r in df.select(H.min_max_norm(F.col("s"), F.col("lo"), F.col("hi"))).collect()] == [1.0, 0.0, 0.0, 0.25]


def test_rerank(spark):
    ranked = spark.createDataFrame([("q1", "x", "a", 3.0, 0), ("q1", "x", "b", 2.0, 1), ("q2", "y", "a", 1.0, 0), ("q2", "y", "bad", 0.5, 1)],
                                   "query_id string, query string, chunk_id string, score double, rank int")
    texts = spark.createDataFrame([("a", "1"), ("b", "5"), ("bad", "no")], "chunk_id string, text string")
    out = H.rerank(ranked, texts, lambda q, t: t.try_cast("double")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r.score, r.reranked) for r in out] == [
        ("q1", "b", 5.0, True), ("q1", "a", 1.0, True), ("q2", "a", 1.0, False), ("q2", "bad", 0.5, False)]


def test_failing_embedders(spark):
    texts = spark.createDataFrame([("x",)], "text string")
    E.register_embedder("broken", 3, lambda: lambda texts: 1 / 0)
    E.register_embedder("wide", 3, lambda: lambda texts: [[1.0] * 4 for _ in texts])
    for name in ("broken", "wide"):
        assert E.embed_documents(texts, name, on_error="zeros").first().embedding == [0.0, 0.0, 0.0]
        with pytest.raises(Exception, match="division by zero|not \\(1, 3\\)"):
            E.embed_documents(texts, name).collect()


def test_hashed_words_have_unit_length(spark):
    rows = spark.createDataFrame([("One two two",), ("two ONE two!",), ("",), (None,), ("...",)], "text string")
    a, b, *empty = [r.embedding for r in E.embed_documents(rows, "hash-32").collect()]
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-6
    assert all(e == [0.0] * 32 for e in empty)


def test_hashed_words_are_counted_by_their_slot(spark):
    texts = ["", "One two two", "x_1 \u00e9t\u00e9 " * 50, None, "a b c d e f g"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r.embedding for r in E.embed_documents(rows, "hash-32").orderBy("i").collect()]
    for text, vector in zip(texts, got):
        sums = np.zeros(64)
        for word in (text or "").lower().split():
            sums[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 64] += 1
        want = sums[::2] - sums[1::2]
        assert np.allclose(vector, want / (np.linalg.norm(want) or 1.0), atol=1e-6)
    assert "lambda" not in str(E.signed_buckets(F.col("text"), 32))


def test_more_than_fifty_rows_per_query(spark):
    chunks = spark.createDataFrame([(f"c{i:04}", f"common word{i}") for i in range(400)], "chunk_id string, text string")
    queries = spark.createDataFrame([("q", "common", 200), ("r", "common", 3)], "query_id string, query string, top_k int")
    found = by_query(B.sparse_topk(queries, chunks))
    assert len(found["q"]) == 200 and len(found["r"]) == 3
    vectors = E.embed_documents(chunks, "hash-32")
    asked = E.embed_documents(queries, "hash-32", "query", "query_vec")
    assert len(by_query(D.dense_topk(asked, vectors))["q"]) == 200


def test_blocks_are_dealt_into_a_grid_of_bounded_cells(spark):
    data, df = vectors(spark)
    queries = df.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.lit(5).alias("top_k"))
    got = by_query(D.dense_topk(queries, df.repartition(4), query_block=3, chunk_block=4, cell_rows=9))
    for q in range(len(data)):
        same(got[f"v{q:03}"], exact(data, q, 5))

    def side(n, block):
        return spark.createDataFrame([("everything", i) for i in range(n)], f"scope_id string, {block} long")

    met = D._met(side(200, "block").withColumn("v", F.col("block")), side(300, "q_block"), 200, 300, 40)
    assert met.select("v", "q_block").distinct().count() == met.count() == 200 * 300
    assert met.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 200 * 300 / 4
