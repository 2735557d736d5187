from __future__ import annotations

import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from groundwell.llm.token_counts import UnigramCounter, count_tokens, unigram_vocabulary

SCHEMA = "doc_id long, text string, n_tokens string"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = [(f"<0x{b:02X}>", -9.0) for b in range(256)]
SMALL = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.5), ("ab", -2.5), ("ba", -2.5), ("▁a", -3.0), ("aba", -3.5),
         ("abab", -5.0), ("é", -4.0), ("▁ab", -4.5), ("bb", -3.0)]


def library(vocabulary, by_bytes=True):
    made = Tokenizer(models.Unigram(vocabulary, 0, by_bytes))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return made


def agrees(vocabulary, texts):
    made, counter = library(vocabulary), UnigramCounter(vocabulary)
    want = [len(x.ids) for x in made.encode_batch(texts, add_special_tokens=False)]
    assert counter.of_texts(pa.array(texts))[0].tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aabbé \n▁xя", max_size=30), min_size=1, max_size=8))
def test_ties_go_as_in_the_library(texts):
    agrees(SMALL, texts)
    agrees(SMALL + BYTES, texts)


VOCABULARY = unigram_vocabulary(MODEL)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_any_text_counts_as_in_the_library(texts):
    agrees(VOCABULARY, texts)


def test_table_with_odd_rows(spark):
    texts = [None, "", " ", "  two  blanks ", "the quick brown fox", "the quick brown fox", "x" * 50_000, "я " * 40_000,
             "<0x41> <s> </s> <unk>", "tab\tand\nline"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "a b", "x")]
    got = {r.doc_id: r.n_tokens for r in count_tokens(spark.createDataFrame(rows, SCHEMA), MODEL).collect()}
    made = library(VOCABULARY)
    assert got == {i: len(made.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows}
    assert count_tokens(spark.createDataFrame([], SCHEMA), MODEL).count() == 0
