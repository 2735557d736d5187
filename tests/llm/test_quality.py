from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from groundwell.llm.quality import NAMES, _leaves, _quadrants, features, fit, quality_scores

SCHEMA = "doc_id long, text string, score string"
LABELS = "doc_id long, quality int, text string"


def test_features_of_odd_texts():
    x = features(["", "a", "The end.", "no! no! no!", "é" * 100_000, "x\n\nx\ny"])
    assert x.shape == (6, len(NAMES)) and np.isfinite(x).all() and x[0].sum() == 1  # one empty line
    at = {n: i for i, n in enumerate(NAMES)}
    assert x[2][at["capitals"]] == np.float32(1 / 6) and x[3][at["repeats_last"]] == np.float32(2 / 3)
    assert x[3][at["top_word"]] == 1 and x[5][at["distinct_lines"]] == np.float32(3 / 4)
    assert np.array_equal(features(["The end."])[0], x[2])


def test_trees_and_quadrants_find_the_cut():
    h = np.ones(8) * 50
    step = _leaves(np.array([-20.0] * 3 + [20.0] * 5), h, 2)
    assert (step[:3] > 0).all() and (step[3:] < 0).all() and len(set(step)) == 2
    g = np.where(np.add.outer(np.arange(4) < 2, np.arange(4) < 1) == 1, -30.0, 30.0)  # one side or the other
    gain, cells = _quadrants(g, np.full((4, 4), 50.0))
    assert gain > 0 and (np.sign(cells) == -np.sign(g)).all()


def test_interactions_are_learned():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 1] > 0) != (x[:, 2] > 0)).astype(float)  # no single feature tells
    model = fit(x, y, np.arange(3000) % 5 == 1)
    assert (1, 2) in [(i, j) for i, j, _ in model.pairs]
    test = rng.normal(size=(1000, 4)).astype(np.float32)
    assert np.mean((model.scores(test) > 0.5) == ((test[:, 1] > 0) != (test[:, 2] > 0))) > 0.9


def test_held_out_accuracy_and_defined_results(spark):
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(1500):
        words = ["".join(rng.choice(list("etaoinsr"), int(rng.integers(2, 9)))) for _ in range(int(rng.integers(5, 80)))]
        bad = i % 4 == 0
        text = "!! ".join(words).upper() if bad and i % 8 else " ".join(words[:1] * len(words) if bad else words)
        rows.append((i, text, "clash"))
        if i % 3 != 1:
            labels.append((i, int(not bad), "x"))
    odd = [(9001, None, "x"), (9002, "", "x"), (None, "plain words here", "x"), (9003, "long words " * 20_000, "x")]
    docs = spark.createDataFrame(rows + odd + rows[:2], SCHEMA)
    marks = spark.createDataFrame(labels + [(3, None, "x"), (None, 1, "x"), (5, 0, "x")], LABELS)
    got = quality_scores(docs, marks).collect()
    assert len(got) == len(rows) + 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    tested = [r for r in got if r.held_out and r.doc_id < 9000]
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in tested]) > 0.95
    assert not [r for r in got if r.doc_id is None][0].held_out
    none = quality_scores(docs.limit(5), marks.where(F.lit(False))).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    one = quality_scores(docs.limit(50), marks.where("quality = 1")).collect()
    assert len({r.score for r in one}) == 1 and one[0].score > 0.8
    assert quality_scores(docs.where(F.lit(False)), marks).count() == 0
