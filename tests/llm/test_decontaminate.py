from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from groundwell.llm.decontaminate import SEED, contamination, tile
from groundwell.llm.wordhash import grams, word_hashes

DOCS = "doc_id long, text string, item_id string, coverage int"
ITEMS = "item_id long, text string, row string"


def brute_tiles(doc, item, least):
    """Greedy string tiling from its definition: the longest match of unmarked words, again and again."""
    doc_free, item_free, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while (i + n < len(item) and d + n < len(doc) and item_free[i + n] and doc_free[d + n]
                       and item[i + n] == doc[d + n]):
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, d)
        if best is None:
            return tiles
        n, i, d = best
        for k in range(n):
            item_free[i + k] = doc_free[d + k] = False
        tiles.append(best)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=30), st.lists(st.integers(0, 2), max_size=20))
def test_tiles_are_valid_and_cover_what_brute_force_covers(doc, item):
    a, b = np.array(doc, np.uint64) + np.uint64(5), np.array(item, np.uint64) + np.uint64(5)
    tiles = tile(a, b, 3)
    seen_a, seen_b = set(), set()
    for n, i, d in tiles:
        assert n >= 3 and doc[d : d + n] == item[i : i + n]
        assert seen_a.isdisjoint(range(d, d + n)) and seen_b.isdisjoint(range(i, i + n))
        seen_a |= set(range(d, d + n))
        seen_b |= set(range(i, i + n))
    want = brute_tiles(doc, item, 3)
    assert bool(tiles) == bool(want)
    free_a = [x for k, x in enumerate(doc)]
    left = brute_tiles([x if k not in seen_a else -1 - k for k, x in enumerate(free_a)],
                       [x if k not in seen_b else -1000 - k for k, x in enumerate(item)], 3)
    assert left == []  # nothing long enough is left unmarked


def test_word_hashes_agree_wherever_a_word_stands():
    words, counts = word_hashes(["Hello, world", "", "well hello WORLD!", "é É x"])
    assert counts.tolist() == [2, 0, 3, 3] and words[0] == words[3] and words[1] == words[4] and words[5] == words[6]
    h, at = grams(words, counts, 2)
    assert at.tolist() == [0, 2, 3, 5, 6] and h[0] == h[2] and len(set(h.tolist())) == 4


def words(rng, n, tag):
    return [f"{tag}{int(k)}" for k in rng.integers(0, 10_000, n)]


def test_copied_and_reordered_passages_are_found(spark):
    rng = np.random.default_rng(3)
    item, other = words(rng, 40, "q"), words(rng, 30, "z")
    moved = item[20:30] + ["cut"] + item[:12] + ["and"] + item[30:]
    prose = lambda n: words(rng, n, "p")
    rows = [(1, prose(50) + item + prose(9)), (2, prose(20) + moved), (3, prose(100)), (4, prose(5) + item[:12] + prose(5)),
            (5, [w.upper() for w in item + other]), (6, prose(30_000) + other), (None, item), (1, prose(4))]
    docs = [(i, ", ".join(w), "x", 1) for i, w in rows] + [(7, None, "x", 1), (8, "", "x", 1), (9, "a b c d", "x", 1)]
    items = [(10, " ".join(item), "x"), (11, " ".join(other), "x"), (12, "a b c d", "x"), (13, None, "x"), (14, "", "x"),
             (9, " ".join(item), "x"), (None, "some thing else in here now", "x")]
    benchmark = spark.createDataFrame(items, ITEMS)
    got = contamination(spark.createDataFrame(docs, DOCS), benchmark).collect()
    assert len(got) == len(docs)
    assert sorted((r.doc_id or -1) for r in got if r.contaminated) == [-1, 1, 2, 5, 6]
    by = {r.doc_id: r for r in got if r.contaminated}
    assert (by[1].item_id, by[1].coverage, by[1].n_items, by[1].n_tiles) == (9, 1.0, 2, 1)
    assert by[2].n_tiles == 3 and by[2].coverage == 32 / 40 and by[5].n_items == 3 and by[6].item_id == 11
    assert all(r.coverage < 0.5 for r in got if not r.contaminated) and SEED == 5
    none = spark.createDataFrame([], ITEMS)
    assert not any(r.contaminated for r in contamination(spark.createDataFrame(docs, DOCS), none).collect())
    assert contamination(spark.createDataFrame([], DOCS), benchmark).count() == 0
