from __future__ import annotations

import numpy as np
import xxhash

from groundwell.llm import golay
from groundwell.llm.components import components
from groundwell.llm.simhash import fingerprint, fingerprint_links, keys_of, simhash_groups

SCHEMA = "doc_id long, text string, fp string, component_id long"


def test_golay_numbers_are_shared_up_to_two_errors():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300, dtype=np.uint32)
    for weight in (1, 2):
        flips = np.array([sum(1 << int(b) for b in rng.choice(23, weight, replace=False)) for _ in words], np.uint32)
        a, b = golay.nearby(words), golay.nearby(words ^ flips)
        for i in range(len(words)):
            assert set(a[0][i][a[1][i]]) & set(b[0][i][b[1][i]])
    assert {int(n.sum()) for n in golay.nearby(words)[1]} <= {1, 6}


def test_every_pair_up_to_four_bits_shares_a_key():
    rng = np.random.default_rng(2)
    for weight in range(5):
        fp = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, weight, replace=False)) for _ in fp], np.uint64)
        ka, ra = keys_of(fp)
        kb, rb = keys_of(fp ^ flips)
        assert len(set(zip(ka.tolist(), ra.tolist()))) == len(ka)
        met = {r for _, r in set(zip(ka.tolist(), ra.tolist())) & set(zip(kb.tolist(), rb.tolist()))}
        assert met == set(range(500))


def brute(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_links_give_the_components_of_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set()
    for c in centres.tolist():
        for _ in range(int(rng.integers(1, 60))):
            fps.add((c ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 7)), replace=False))) % (1 << 63))
    fps = sorted(fps)
    links = fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = {f: f for f in fps} | {r.node: r.root for r in components(links).collect()}
    assert got == brute(fps)


def test_components_of_long_paths_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 3), (202, 201), (201, 202), (203, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {201: 201, 202: 201, 203: 201}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def reference(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_fingerprints_follow_the_contract(spark):
    texts = [None, "", " \t", "one", "One two", "one  TWO\nthree four five", "É a b c d", "x y z w v", "ab " * 70000,
             "one two", "same words here again", "Same words\there again"]
    for t in texts:
        assert fingerprint((t or "").encode()) == reference(t), t
    rows = [(i, t, "clash", 5) for i, t in enumerate(texts)] + [(None, "one", "x", 1), (3, "one", "x", 1)]
    got = simhash_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert {r.fingerprint for r in got if r.doc_id in (0, 1, 2)} == {"0" * 16}
    roots = sorted((r.doc_id, r.component_id) for r in got if r.doc_id in (0, 1, 2, 10, 11, 4, 9))
    assert roots == [(0, 0), (1, 0), (2, 0), (4, 4), (9, 4), (10, 10), (11, 10)]
    assert [r.component_id for r in got if r.doc_id is None] == [3]
    assert simhash_groups(spark.createDataFrame([], SCHEMA)).count() == 0
