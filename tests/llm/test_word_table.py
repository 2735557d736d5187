"""The table of distinct words against the tokenizers library, whole text by whole text."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from groundwell.llm import packed, word_table
from groundwell.llm.queries import op12_word_bpe
from groundwell.llm.word_table import encode_and_decode

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", None, " ", "  ", "a <|endoftext|> b", "x<|endoftext|>\n y", " \n<|endoftext|>", "don't we'll I.e. 3.14, a.b,c",
    "a b c　 d  e", "中文 字符。 你好!\n\n  x\ty ", "a​ ​b", "\x00 \x01 b\x1c c", "tail ", "tail  ", "\n\nhead",
    "é. ü, x!!  ?! .,", "a" * 30_000, "b c  " * 9_000, "🙂 🙂. a🙂.", "﻿ a", "᠎ a᠎ b", "same words", "same words",
]


@pytest.mark.parametrize("block_bytes, bucket_words", [(16 << 20, 500_000), (64, 5)])
def test_equals_the_library(spark, block_bytes, bucket_words):
    """Texts that are null, empty, odd or long, repeated rows, null and repeated ids, columns with clashing names."""
    rows = [(i, t, "z", 1) for i, t in enumerate(ODD)] + [(None, "no id", "q", 2), (3, "id again", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, ids int")
    found = encode_and_decode(docs, PATH, block_bytes, bucket_words).collect()
    got = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens, r.decoded) for r in found)
    library, want = Tokenizer.from_file(PATH), []
    for doc, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((str(doc), ids, len(ids), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_special_token_is_read_as_the_library_does(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    assert np.frombuffer(encode_and_decode(docs, PATH).first().ids, "<u4").tolist() == [64, 220, 50256, 275]


def test_no_rows(spark):
    assert encode_and_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_each_distinct_word_is_encoded_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the same words, and w{i % 3}.") for i in range(40)], "doc_id long, text string")
    blocks = word_table.blocks_of(docs, 100)
    assert blocks.count() > 4
    asked = [r.asDict() for r in word_table.ask(blocks, 3).orderBy("bucket", "block").collect()]
    where = {}
    for row in asked:
        for w in packed.unpack_words(row["lengths"], row["words"]).to_pylist():
            where.setdefault(w, set()).add(row["bucket"])
    assert all(len(b) == 1 for b in where.values())  # all copies of a word meet in one bucket
    assert {b"the", b" same", b" words", b",", b" and", b" w0."} <= set(where)


def test_places_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"words of text {i}") for i in range(50)], "doc_id long, text string")
    coded = encode_and_decode(docs, PATH, 100)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(block") == 1, plan
    assert coded.count() == 50


def test_numbers_and_words_survive_packing():
    rng = np.random.default_rng(5)
    for numbers in (np.zeros(0, np.uint32), np.array([2**32 - 1, 0, 7]), rng.integers(0, 2**32, 1000)):
        assert packed.unpack(packed.pack(numbers)).tolist() == numbers.tolist()
    words = packed.binary_array(np.array([2, 0, 3]), b"abcde")
    assert packed.unpack_words(*packed.pack_words(words)).to_pylist() == [b"ab", b"", b"cde"]
    assert packed.unpack_words(*packed.pack_words(words.slice(1, 2))).to_pylist() == [b"", b"cde"]


def test_query_over_the_sample_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = op12_word_bpe(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
