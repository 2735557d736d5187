"""Alignment in lockstep against sets of byte ends, text by text with the two libraries."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from groundwell.llm.alignment import WordPairs, align, align_texts, lockstep
from groundwell.llm.byte_pieces import byte_alphabet
from groundwell.llm.queries import op11_alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "  ", " x", "x ", "x  ", "one two  three\n\nfour", "a▁b", "a <|endoftext|> <s> <0x41> b", "中文 字符。 你好",
    "🙂 naïve ﬁ", "same words here", "same words here", "\x00 a\x1c b", "word" * 3_000, "many short words " * 700, "a　 b​ c",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def whole(text, libraries):
    """(A ids, B ids, [(A ids, B ids) of a group]) by plain loops over one text."""
    a, b = libraries
    if not text:
        return [], [], []
    alphabet = byte_alphabet()
    found = a.encode(" " + text, add_special_tokens=False)
    ids_a, raw_a = found.ids, [bytes(alphabet[c] for c in t) for t in found.tokens]
    ids_b = b.encode(text)
    raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
             for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
    if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return [], [], []
    ends_a, ends_b = np.cumsum([len(r) for r in raw_a]).tolist(), np.cumsum([len(r) for r in raw_b]).tolist()
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append((ids_a[i:x], ids_b[j:y]))
        i, j = x, y
    return ids_a, ids_b, groups


def brute(texts, libraries):
    found = [whole(t, libraries) for t in texts]
    count = Counter((g[0][-1], g[1][-1]) for _, _, groups in found for g in groups)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for ids_a, ids_b, groups in found:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        out.append((len(ids_a), len(ids_b), len(groups), len(links), sum(count[p] == most[p[1]] for p in links),
                    sum(count[p] for p in links),
                    ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)))
    return out


@pytest.mark.parametrize("block_bytes", [16 << 20, 200])
def test_equals_brute_force(spark, libraries, block_bytes):
    """Null, empty, odd, long and repeated texts, null and repeated ids, columns with clashing names."""
    texts = [*ODD, "no id", "an id twice", "an id twice more"]
    ids = [*range(len(ODD)), None, 5, 5]
    docs = spark.createDataFrame(list(zip(ids, texts, ["q"] * len(ids), [1] * len(ids))),
                                 "doc_id long, text string, block string, pair int")
    found = align(docs, A_PATH, B_PATH, block_bytes=block_bytes).collect()
    got = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in found)
    assert got == sorted((str(i), *row) for i, row in zip(ids, brute(texts, libraries)))


def test_words_apart_equal_the_whole_text(libraries):
    rng = np.random.default_rng(3)
    letters = list("ab .,'\n  \t1é中🙂-") + [" the", " ing", "​", " ", "　", "\r\n", "▁"]
    texts = ["".join(rng.choice(letters, size=rng.integers(1, 60))) for _ in range(3_000)]
    got = align_texts(pa.array(texts), WordPairs(A_PATH, B_PATH), stretch=2)
    ends_a, ends_b = np.cumsum(got.n_a).tolist(), np.cumsum(got.n_b).tolist()
    for k, text in enumerate(texts):
        ids_a, ids_b, groups = whole(text, libraries)
        assert got.ids_a[ends_a[k] - got.n_a[k] : ends_a[k]].tolist() == ids_a, text
        assert got.ids_b[ends_b[k] - got.n_b[k] : ends_b[k]].tolist() == ids_b, text
        assert got.n_links[k] == len(groups)


def test_lockstep_over_random_ends():
    rng = np.random.default_rng(11)
    end_a, end_b, at_a, at_b, stop, want, base = [], [], [], [], [], [], 0
    for _ in range(200):
        size = int(rng.integers(1, 50))
        x, y = (sorted({*rng.integers(1, size + 1, size // 2).tolist(), size}) for _ in "ab")
        at_a.append(len(end_a))
        at_b.append(len(end_b))
        want += [(len(end_a) + x.index(e), len(end_b) + y.index(e)) for e in sorted(set(x) & set(y))]
        end_a += [base + e for e in x]
        end_b += [base + e for e in y]
        stop.append(len(end_a))
        base += size
    got = lockstep(*map(np.array, (end_a, end_b, at_a, at_b, stop)))
    assert list(zip(got[0].tolist(), got[1].tolist())) == want


def test_no_rows(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH).collect() == []


def test_query_over_the_sample_table(spark, libraries):
    sf_dir = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: row for r, row in zip(rows, brute([r.text for r in rows], libraries))}
    found = op11_alignment(spark, sf_dir).collect()
    assert len(found) == len(rows)
    for r in found:
        *numbers, groups = want[r.doc_id]
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (*numbers, digest)
