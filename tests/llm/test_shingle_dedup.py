from __future__ import annotations

from pathlib import Path

import numpy as np

import corpus_pipeline
from groundwell.llm import shingle_dedup
from groundwell.session import shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sets_of(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The least doc_id of each component at similarity 0.8."""
    root, sets = {r[0]: r[0] for r in rows}, [(r[0], sets_of(r[1])) for r in rows]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s == t or 5 * len(s & t) >= 4 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x for x in root if find(x) == x}


def test_stage_drops_every_copy_of_similarity_four_fifths(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(25):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(8, 300)))]
        for _ in range(12):  # a word's change costs five shingles
            copy = list(words)
            for at in rng.integers(0, len(words), int(rng.integers(0, 1 + len(words) // 40))):
                copy[at] = f"x{rng.integers(0, 5000)}"
            rows.append((len(rows), " ".join(copy), "aa", "s", 0))
    for text in (None, "", "One two", "one  TWO", "one two three", "same " * 3000, "same " * 9):
        rows.append((len(rows), text, "aa", "s", 0))
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, SCHEMA), "")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in got.collect()} == brute(rows)


def test_candidates_of_golay_keys_lead_to_near_copies(spark):
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 5000, 600)]
    near, far = [*base[:-1], "changed"], [f"v{x}" for x in rng.integers(0, 5000, 600)]
    sets = [shingle_dedup.shingles(" ".join(w).encode()) for w in (base, near, far, base + base[:1])]
    sims = [shingle_dedup.majority(s) for s in sets]
    assert all(int(a ^ sims[0]).bit_count() <= 4 for a in (sims[1], sims[3]))
    rows = [(i, sim - (1 << 64) if sim >> 63 else sim, len(s)) for i, (s, sim) in enumerate(zip(sets, sims))]
    got = shingle_dedup.golay_pairs(spark.createDataFrame(rows, "fp long, sim long, n long")).collect()
    pairs = {(r.a, r.b) for r in got}
    linked = {0}
    for _ in range(3):
        linked |= {x for p in pairs if linked & set(p) for x in p}
    assert linked == {0, 1, 3}


def words_of(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


def test_comparisons_shuffle_the_texts_of_candidates_alone(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = words_of(rng, 400)
    rows = [(i, words_of(rng, 100)) for i in range(40)] + [(50, base), (51, base + " more"), (52, "less " + base)]
    seen, linked = [], shingle_dedup._linked

    def watched(pairs, texts):
        seen.append(sorted(r.text for r in texts.collect()))
        return linked(pairs, texts)

    monkeypatch.setattr(shingle_dedup, "_linked", watched)
    got = shingle_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == {*range(40), 50}
    assert seen and all(s == sorted(t for i, t in rows if i >= 50) for s in seen)


def test_stage_leaves_only_the_kept_keys_in_the_shared_folder(spark):
    folder = Path(shared_folder(spark))
    rng = np.random.default_rng(12)
    rows = [(i, words_of(rng, 60)) for i in range(6)] + [(6, None), (7, "")]
    before = set(folder.iterdir()) if folder.is_dir() else set()
    got = shingle_dedup.near_duplicates(spark.createDataFrame([*rows, rows[2]], "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [*range(7)]
    left = {p.name.rpartition("-")[0] for p in set(folder.iterdir()) - before}
    assert left == {"kept"}
