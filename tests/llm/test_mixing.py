from __future__ import annotations

import numpy as np
import pytest

from groundwell.llm.mixing import draw, mix_sources, mixed_documents, permute, targets

SCHEMA = "doc_id long, text string, source string, n_chars long, target string"


def test_targets_share_the_excess():
    assert targets([100, 100, 100], [5, 2, 1]) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert targets([10, 1000], [5, 2]) == [20.0, 1495.0]
    assert targets([0, 10], [5, 2]) == [0.0, 15.0]
    assert sum(targets([7, 90, 3, 800, 51], [5, 2, 1, 5, 2])) == pytest.approx(1.5 * 951)


def test_draws_meet_the_quota_and_permutations_are_permutations():
    quota = np.array([1000, 17, 0, 333])
    counts = draw(quota, 100, 1)
    assert (counts.sum(axis=0) == quota).all() and (counts.sum(axis=1)[:-1] == 100).all()
    for n in (1, 2, 3, 64, 1000):
        for key in (5, 6):
            image = permute(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(image.tolist()) == list(range(n))
    first = [permute(np.arange(1000), np.full(1000, 1000), np.full(1000, k, np.uint64)).tolist() for k in (5, 6)]
    assert first[0] != first[1] and first[0] != list(range(1000))


def rows_of(n=300):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        source = ["b", "a", None, "é", "z"][int(rng.choice(5, p=[0.6, 0.1, 0.1, 0.1, 0.1]))]
        words = [f"w{i}x{k}" for k in range(int(rng.integers(1, 400)))]
        rows.append((i, " ".join(words), source, 0, "clash"))
    return rows + [(None, "no id here", "b", 0, "x"), (7, None, "b", 0, "x"), (8, "", None, 0, "x"),
                   (9, "twice the same", "a", 0, "x"), (9, "twice the same", "a", 0, "x"),
                   (10, "long " * 20_000, "q", 0, "x"), (11, "\x0b\t", "only blanks", 0, "x")]


def test_each_source_comes_near_its_target(spark):
    rows = rows_of()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix_sources(docs, block=16).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    names = sorted({r.source for r in got if r.source is not None}) + [None]
    sizes = [sum(r.size for r in got if r.source == s) for s in names]
    want = targets(sizes, [[5, 2, 1][i % 3] for i in range(len(names))])
    for s, size, t in zip(names, sizes, want):
        mine = [r for r in got if r.source == s]
        assert {r.target for r in mine} == {t} and {r.source_size for r in mine} == {size}
        assert abs(sum(r.taken for r in mine) - t) <= 17
    again = mix_sources(docs.repartition(5), block=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mixed_documents_hold_the_taken_words(spark):
    rows = rows_of(60)
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = {(r.doc_id, r.size): r.taken for r in mix_sources(docs, block=16).collect()}
    out = mixed_documents(docs, block=16)
    assert out.columns == docs.columns
    texts = {i: t for i, t, *_ in rows if i not in (7, 8, 9, 10, 11)}
    got = [r for r in out.collect() if r.doc_id in texts]
    assert {r.doc_id for r in got} == {i for i in texts if taken[(i, len(texts[i].split()))]}
    for r in got:
        assert len(r.text.split()) == taken[(r.doc_id, len(texts[r.doc_id].split()))]
        assert set(r.text.split()) <= set(texts[r.doc_id].split()) and r.n_chars == len(r.text)
    assert len({r.text for r in out.where("text like 'twice%'").collect()}) <= 1
