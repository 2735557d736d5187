from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from groundwell.llm.decontaminate import tile
from groundwell.llm.wordhash import word_hashes
from tests.llm.test_shingle_dedup import sets_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STEMS = {"aa": ["the", "ing", "wh", "er", "ob"], "bb": ["sch", "ein", "ung", "ü", "ag"]}


def corpus(n=400):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(n):
        lang = ["aa", "bb"][i % 2]
        words = ["".join(rng.choice(STEMS[lang], 4)) for _ in range(int(rng.integers(20, 90)))]
        rows.append((i, " ".join(words), lang, f"s{i % 4}", 0))
    item = " ".join("".join(rng.choice(STEMS["aa"], 3)) for _ in range(24))
    half = len(item.split()) // 2
    moved = " ".join(item.split()[half:] + ["thewhthe"] + item.split()[:half])
    rows += [(1000, rows[10][1], "aa", "s1", 0), (1001, rows[10][1].upper(), "aa", "s1", 0),
             (1002, f"{rows[4][1]} {item} {rows[6][1]}", "aa", "s2", 0), (1003, f"{rows[8][1]} {moved}", "aa", "s2", 0),
             (1004, None, "aa", "s2", 0), (1005, "", None, None, None), (1006, "12 34 !?", "aa", "s3", 0),
             (None, rows[12][1] + " whobing", None, None, None), (1007, "qqxxzz jjkkvv " * 30, None, "s3", 0),
             (12, rows[12][1], "aa", "s0", 0), (1008, "einung " * 20_000, "bb", None, 0)]
    return rows, item


def kept_of_similar(rows):
    """The least row of each component at similarity 0.8, a null doc_id last."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets, root = [sets_of(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            if s == t or 5 * len(s & t) >= 4 * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [r for i, r in enumerate(rows) if find(i) == i]


CLASHING = ["start", "whole", "drawn", "size", "block", "_id", "_h", "_row_key", "_kept", "row", "key", "kept", "gone",
            "id", "h", "src", "bucket", "nth", "fp", "words", "mixed", "band"]


def test_clashing_columns_pass_through_every_stage(spark, tmp_path):
    rows, item = corpus(60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plain = spark.createDataFrame(rows, SCHEMA)
    named = plain.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c)
                                for c in CLASHING])
    stages = dict(corpus_pipeline.STAGES)
    for name in ("language", "near_dedup", "decontaminate", "mix"):
        got = stages[name](spark, named, str(tmp_path))
        assert got.columns == named.columns
        found = got.collect()
        want = stages[name](spark, plain, str(tmp_path)).collect()
        assert sorted(map(str, ((r.doc_id, r.text) for r in found))) == sorted(map(str, ((r.doc_id, r.text) for r in want)))
        assert all(r[c] == f"{c}-{'?' if r.doc_id is None else r.doc_id}" for r in found for c in CLASHING)
    found = stages["tokens"](spark, named, str(tmp_path)).collect()
    assert sorted(map(str, found)) == sorted(map(str, stages["tokens"](spark, plain, str(tmp_path)).collect()))


def test_stages_agree_with_brute_force(spark, tmp_path):
    rows, item = corpus()
    spark.createDataFrame([(1, item), (2, "too short"), (None, None)], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    sf_dir = str(tmp_path)
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)

    spoken = stages["language"](spark, docs, sf_dir)
    assert spoken.columns == docs.columns
    left = {(r.doc_id, r.text) for r in spoken.collect()}
    assert {1004, 1005, 1006, 1007}.isdisjoint({i for i, _ in left}) and (1008, rows[-1][1]) in left
    assert sum(i is not None and i < 400 for i, _ in left) >= 396

    spoken = spark.createDataFrame([r for r in rows if r[0] not in (1004, 1005, 1006, 1007)], SCHEMA)
    unique = stages["near_dedup"](spark, spoken, sf_dir)
    best = kept_of_similar([(r.doc_id, r.text) for r in spoken.collect()])
    assert sorted(map(str, [(r.doc_id, r.text) for r in unique.collect()])) == sorted(map(str, best))

    clean = stages["decontaminate"](spark, unique, sf_dir)
    words = word_hashes([item])[0]
    part = {r: sum(t[0] for t in tile(word_hashes([r[1]])[0], words)) / len(words) for r in best}
    want = {r for r, p in part.items() if p < 0.5}
    assert {(r.doc_id, r.text) for r in clean.collect()} == want
    assert {1002, 1003} & {i for i, _ in want} == set()

    mixed = stages["mix"](spark, clean, sf_dir)
    assert mixed.columns == docs.columns
    got = sorted((r.doc_id, r.text) for r in mixed.where("doc_id is not null").collect())
    total = sum(len(t.split()) for _, t in want)
    assert abs(sum(len(t.split()) for _, t in got) - 1.5 * total) < 64 * 8

    files = stages["tokens"](spark, spark.createDataFrame([(i, t) for i, t in got], "doc_id long, text string"), sf_dir)
    tokenizer, at, want_rows = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, t in got:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        want_rows.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, files.collect())) == want_rows


def test_empty_documents_run_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
