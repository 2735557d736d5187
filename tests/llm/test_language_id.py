from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from groundwell.llm.language_id import (BLANK, ORDER, LanguageModel, Models, _opened, count_runs, identify, runs,
                                        stored_models, train)

SCHEMA = "doc_id long, text string, lang string, score string"


def letters(text):
    out, seen = [], True
    for c in text.lower():
        if c.isalpha():
            out.append(ord(c))
            seen = False
        elif not seen:
            out.append(BLANK)
            seen = True
    return out + ([BLANK] if out and not seen else [])


def grams_of(text):
    s = [BLANK] * (ORDER - 1) + letters(text)
    return [tuple(s[i : i + ORDER]) for i in range(len(s) - ORDER + 1)]


def packed(gram):
    key = 0
    for s in gram:
        key = key << 12 | s
    return key


def brute(counts, gram):
    """Interpolated Kneser-Ney from its definition; counts: Counter of runs of ORDER symbols."""
    if not gram:
        return 1 / 4096
    m = len(gram)
    level = counts
    for _ in range(ORDER - m):
        level = Counter(g[1:] for g in level)
    ones, twos = sum(v == 1 for v in level.values()), sum(v == 2 for v in level.values())
    d = min(max(ones / max(1.0, ones + 2 * twos) or 0.5, 0.1), 0.95)
    same = {g: v for g, v in level.items() if g[:-1] == gram[:-1]}
    lower = brute(counts, gram[1:])
    if not same:
        return lower
    total = sum(same.values())
    return max(level.get(gram, 0) - d, 0) / total + d * len(same) / total * lower


def test_runs_and_probabilities_follow_their_definition():
    texts = ["Ab, c!", "", "--", "été  ABAB abab", "x\x00y", "a" * 50 + " 1 b"]
    key, counts = runs(texts)
    want = [grams_of(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert key.tolist() == [packed(g) for w in want for g in w]
    languages = {"a": ["abab cab abc", "abacus"], "b": ["xyz zyx yxz xyzzy", "zab"]}
    models = Models({k: np.unique(runs(v)[0], return_counts=True) for k, v in languages.items()})
    for j, lang in enumerate(models.langs):
        counts = Counter(g for t in languages[lang] for g in grams_of(t))
        for g in grams_of("abc xyzzy q abab"):
            got = models._logp_of(np.array([packed(g)]), ORDER)[0, j]
            assert math.isclose(got, math.log(brute(counts, g)), abs_tol=1e-4), (lang, g)


def test_empty_model_and_ties():
    empty = LanguageModel(Models({}), 1.0, [])
    assert [p[0] for p in empty.predict(["abc", ""])] == ["und", "und"]
    same = np.unique(runs(["abc abd"])[0], return_counts=True)
    tied = LanguageModel(Models({"y": same, "x": same}), 1.0, []).predict(["abc"])[0]
    assert tied[0] == "x" and abs(tied[1] - 0.5) < 1e-9


def corpus(n):
    rng = np.random.default_rng(6)
    stems = {"aa": ["the", "ing", "wh", "er"], "bb": ["sch", "ein", "ung", "ü"], "cc": ["eau", "que", "é", "oi"]}
    rows = []
    for i in range(n):
        lang = ["aa", "bb", "cc"][i % 3]
        words = ["".join(rng.choice(stems[lang], 3)) for _ in range(int(rng.integers(3, 40)))]
        rows.append((i, " ".join(words), lang, "clash"))
    return rows


def test_held_out_texts_get_their_language(spark):
    odd = [(9001, None, "aa", "x"), (9002, "", "bb", "x"), (9003, "123 !!", None, "x"), (None, "thering wher", None, "x"),
           (9004, "ungein " * 40_000, None, "x"), (9005, "qqxxzzjj" * 30, None, "x")]
    rows = corpus(900) + odd + corpus(3)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = identify(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (9001, 9002, 9003, None, 9004)] == ["und", "und", "und", "aa", "bb"]
    assert all(by[i].rejected for i in (9001, 9002, 9003, 9005)) and not by[9004].rejected
    truth = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 9000}
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in tested]) > 0.98
    assert np.mean([not r.rejected for r in tested]) > 0.98


def test_counts_match_a_plain_count_and_empty_tables(spark):
    rows = corpus(60)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.lang, r.key): r.n for r in count_runs(docs).collect()}
    want = Counter((lang, packed(g)) for _, t, lang, _ in rows for g in grams_of(t))
    assert got == dict(want)
    none = spark.createDataFrame([], SCHEMA)
    assert identify(none).count() == 0 and train(none).models.langs == []


def test_stored_models_keep_every_run(spark):
    rng = np.random.default_rng(8)
    texts = {lang: ["".join(rng.choice(list(stem), 300)) for _ in range(12)]
             for lang, stem in (("a", "abcdefgh "), ("b", "efghijklé "))}
    docs = spark.createDataFrame([(lang, t) for lang, ts in texts.items() for t in ts], "lang string, text string")
    models = stored_models(count_runs(docs), part_rows=500)
    assert models.langs == ["a", "b"] and len(models.logp[ORDER - 1].held) > 2
    for j, lang in enumerate(models.langs):
        counts = Counter(g for t in texts[lang] for g in grams_of(t))
        asked = [(packed(g), g) for g in [*sorted(counts)[::50], *grams_of("zq hij abx fée")]]
        assert {counts[g] > 0 for _, g in asked} == {True, False}
        got = models._logp_of(np.array([k for k, _ in asked]), ORDER)[:, j]
        for (_, g), p in zip(asked, got):
            assert math.isclose(p, math.log(brute(counts, g)), abs_tol=1e-4), (lang, g)


def test_a_corpus_of_over_a_million_runs_is_kept_whole(spark):
    rng = np.random.default_rng(10)
    rows = [(i, bytes(rng.integers(97, 123, 40_000, dtype=np.uint8)).decode(), "a") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    key = np.unique(runs([t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5 > 1])[0])
    assert len(key) > 1_000_000  # the bound on runs that there was
    held = train(docs).models.logp[ORDER - 1]
    assert np.array_equal(np.concatenate([_opened(uri)[0] for uri in held.held]), key)
