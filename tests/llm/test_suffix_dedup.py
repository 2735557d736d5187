from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from groundwell.llm.suffix_dedup import Q, WINDOW, anchors, without_repeats

SCHEMA = "doc_id long, text string, key int, ranges string"


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + WINDOW] for r in raw for i in range(len(r) - WINDOW + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - WINDOW + 1):
            if seen[r[i : i + WINDOW]] > 1:
                gone[i : i + WINDOW] = True
        spans = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_ranges_have_their_windows_anchors():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 101, n, dtype=np.uint8)) for n in (0, 199, 200, 201, 900, 50)] + [b"a" * 450, b"ab" * 300]
    text, anchor, first, last, _, _ = anchors(texts)
    covered = Counter()
    for t, a, f, l in zip(text.tolist(), anchor.tolist(), first.tolist(), last.tolist()):
        for p in range(f, l + 1):
            covered[t, p] += 1
            assert p <= a <= p + WINDOW - Q
    assert covered == Counter({(t, p): 1 for t, x in enumerate(texts) for p in range(len(x) - WINDOW + 1)})


def corpus():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdeé"), int(rng.integers(2, 8)))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words, n))

    passage, line = prose(70), prose(38)
    texts = [prose(int(rng.integers(1, 300))) for _ in range(60)]
    texts += [f"{prose(20)} {passage} {prose(15)}" for _ in range(40)]
    texts += [f"{prose(5)}\n{line}\n{prose(9)}\n{line}" for _ in range(25)]
    for i in range(8):  # near copies: words changed here and there
        parts = texts[i].split(" ")
        for k in range(10, len(parts), 45):
            parts[k] = "changed"
        texts.append(" ".join(parts))
    exact = prose(60)[:200]
    texts += [exact, f"x{exact}", exact[:199], f"{exact[:199]}?", None, "", "short", "z" * 1000, "z" * 199, "ab " * 200,
              "ab " * 250, texts[3], texts[3], "é" * 150 + texts[5], passage, "lone " + "".join(rng.choice(list("xyz"), 30_000))]
    return texts


@pytest.mark.parametrize("held, pairwise", [(20_000, 16), (8, 3), (2, 2)])
def test_removed_bytes_are_those_of_brute_force(spark, held, pairwise):
    texts = corpus()
    ids = [None if i == 50 else 7 if i in (8, 9) else i for i in range(len(texts))]
    rows = [(i, t, 1, "clash") for i, t in zip(ids, texts)]
    rows[-5] = (rows[-6][0], *rows[-5][1:])  # a row twice
    got = without_repeats(spark.createDataFrame(rows, SCHEMA), held=held, pairwise=pairwise).collect()
    want = sorted(map(str, [(r[0], *b) for r, b in zip(rows, brute(texts))]))
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want
    assert sum(r.n_removed > 0 for r in got) > 70


def test_no_rows(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = without_repeats(spark.createDataFrame([(1, "ab", 1, ""), (2, "q" * 300, 1, "")], SCHEMA), with_text=True)
    assert {r.doc_id: bytes(r.kept) for r in kept.collect()} == {1: b"ab", 2: b""}
