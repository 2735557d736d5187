from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from groundwell.llm import token_binary as B
from groundwell.llm.bpe_ids import WordMemo

SCHEMA = "doc_id long, text string, start string, shard int"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_blocks_come_back_from_every_checkpoint():
    rng = np.random.default_rng(1)
    for n in (0, 1, B.LANES, B.LANES + 1, 700_000):
        ids = np.minimum(rng.geometric(0.01, n), 5000).astype(np.uint16)
        found, counts = np.unique(ids, return_counts=True)
        table = B.Table(*B.share_out(dict(zip(found.tolist(), counts.tolist()))))
        payload = B.encode_block(ids, table)
        assert np.array_equal(B.decode_block(payload, table), ids)
        marks = int(np.frombuffer(payload, "<u4", 4)[3])
        assert marks == max(1, -(-(-(-n // B.LANES)) // B.CHECKPOINT_STEPS))
        for c in range(marks):
            assert np.array_equal(B.decode_block(payload, table, c), ids[c * B.CHECKPOINT_STEPS * B.LANES :])


def test_frequencies_sum_up_and_leave_none_out():
    counts = {0: 1, 7: 10**12, 50_000: 3, 9: 0}
    ids, freqs = B.share_out(counts)
    assert ids == sorted(counts) and sum(freqs) == 1 << B.SCALE and min(freqs) >= 1
    assert B.share_out({}) == ([], [])
    assert B.share_out({5: 2}) == ([5], [1 << B.SCALE])


def parts_of(ids, cuts):
    return [ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def test_special_tokens_are_read_as_the_library_does():
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\n y <|endoftext|>.", "a <|endoftext|>  b", "word, <|endoftext|>word."]
    library = Tokenizer.from_file(PATH)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    memo = WordMemo(PATH)
    assert parts_of(*memo.encode(pa.array(texts))) == [np.array(w, memo.width).tobytes() for w in want]


@pytest.mark.parametrize("remembered", [3, 400_000])
def test_words_encode_as_the_whole_text(remembered):
    memo = WordMemo(PATH, remembered)
    random.seed(1)
    parts = ["a", "B", "é", " ", " ", "  ", "\n", ".", ",", "'s", "1", "\t", " ", "!", "²", "<|endoftext|>", "…"]
    texts = ["", " ", "a  b", "a \nb", " lead", "trail ", "don't, stop.", None]
    texts += ["".join(random.choice(parts) for _ in range(random.randint(1, 40))) for _ in range(2000)]
    whole = [np.array(memo.tokenizer.encode(t or "", add_special_tokens=False).ids, memo.width).tobytes() for t in texts]
    for size in (1, 50, len(texts)):
        assert [x for a in range(0, len(texts), size) for x in parts_of(*memo.encode(pa.array(texts[a : a + size])))] == whole
        with_end = [x for a in range(0, len(texts), size) for x in parts_of(*memo.encode(pa.array(texts[a : a + size]), 7))]
        assert with_end == [x + np.array([7], memo.width).tobytes() for x in whole]


def test_files_hold_all_documents_in_order(spark, tmp_path):
    rows = [(i, f"Document {i} says: " + "word " * (i % 50), "x", 1) for i in range(200)]
    rows += [(500, None, "x", 1), (501, "", "x", 1), (None, "no id", "x", 1), (7, "same id", "x", 1), (7, "same id", "x", 1),
             (-3, "long text " * 60_000, "x", 1)]
    random.shuffle(rows)
    folder = str(tmp_path / "tokens")
    B.write_tokens(spark.createDataFrame(rows, SCHEMA), folder, PATH, shard_tokens=20_000, block_tokens=3_000)
    got = B.read_tokens(spark, folder).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = {}
    for doc, text, *_ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [B.END_ID], "<u4")
        want.setdefault(doc, []).append((len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
    assert len(got) == len(rows)
    for doc, found in want.items():
        assert sorted((r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got if r.doc_id == doc) == sorted(found)
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert spark.read.parquet(f"{folder}/blocks").select("shard").distinct().count() > 3
    assert B.token_files(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_a_changed_block_is_noticed(spark, tmp_path):
    folder = str(tmp_path / "tokens")
    B.write_tokens(spark.createDataFrame([(1, "some words here", "x", 1)], SCHEMA), folder, PATH)
    blocks = spark.read.parquet(f"{folder}/blocks").toPandas()
    blocks["crc"] += 1
    spark.createDataFrame(blocks, spark.read.parquet(f"{folder}/blocks").schema).write.parquet(f"{folder}x/blocks")
    spark.read.parquet(f"{folder}/ids").write.parquet(f"{folder}x/ids")
    with pytest.raises(Exception, match="checksum"):
        B.read_tokens(spark, f"{folder}x").collect()
