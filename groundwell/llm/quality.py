"""Quality classifier: a generalised additive model with pairwise interactions over features of the whole text.

Every feature is cut into bins.  Boosting goes round the features in turn; each step fits a tree of at most four
leaves to the bins' gradients and adds it to that feature's lookup table.  Pairs of features that explain most of what
is left then get tables of their own, boosted with one cut on each side.  A score is the sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.common import fold, held_out, slices
from groundwell.llm.wordhash import grams, word_hashes
from groundwell.session import settle

TRAINING_ROWS = 20_000  # labelled rows that the driver fits on, at most
BINS, COARSE = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 8
RATE, RIDGE = 0.15, 1.0
KEEP = 0.3
WORKING_SET = 2 << 20
NAMES = ("log_bytes", "log_words", "letters", "capitals", "digits", "blanks", "marks", "exclamations", "bars", "hashes",
         "newlines", "full_stops", "other_marks", "word_bytes", "repeats_last", "distinct_words", "distinct_pairs",
         "top_word", "distinct_lines", "line_bytes", "marks_after_word")
FEATURES = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float32()))])

_CLASS = {"capitals": range(65, 91), "digits": range(48, 58), "blanks": (32, 9, 10, 11, 12, 13), "exclamations": b"!",
          "bars": b"|", "hashes": b"#*%&$@^~", "newlines": b"\n", "full_stops": b".", "other_marks": b",;:?'\"()-"}


def _table(values) -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    out[list(values)] = 1
    return out


_TABLES = {name: _table(values) for name, values in _CLASS.items()}
_TABLES["letters"] = _table([*range(65, 91), *range(97, 123), *range(128, 256)])
_TABLES["marks"] = _table([i for i in range(33, 128) if not chr(i).isalnum()])


def _distinct(group: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of different values, count of the most frequent) of each group."""
    if not len(values):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, group))
    g, v = group[order], values[order]
    cut = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])]))
    sizes, of = np.diff(np.append(cut, len(g))), g[cut]
    top = np.zeros(n)
    np.maximum.at(top, of, sizes)
    return np.bincount(of, minlength=n).astype(float), top


def features(texts: list[str]) -> np.ndarray:
    """One row of ``NAMES`` per text; shares of nothing are 0, and an empty text has one line."""
    n = len(texts)
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    ends = np.cumsum(sizes)

    def total(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (run[ends] - run[ends - sizes]).astype(float)

    size = np.maximum(sizes, 1)
    count = {name: total(table[data]) for name, table in _TABLES.items()}
    words, counts = word_hashes(texts)
    many = np.maximum(counts, 1)
    text = np.repeat(np.arange(n), counts)
    kinds, top = _distinct(text, words, n)
    same = np.zeros(len(words), dtype=bool)
    same[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    pair, at = grams(words, counts, 2)
    pair_kinds, _ = _distinct(text[at], pair, n)
    lines = [r.split(b"\n") for r in raw]
    line_text = np.repeat(np.arange(n), [len(x) for x in lines])
    line_hash = np.array([hash(x) for group in lines for x in group], dtype=np.int64)
    line_kinds, _ = _distinct(line_text, line_hash, n)
    n_lines = np.bincount(line_text, minlength=n)
    mark, letter = _TABLES["marks"][data], _TABLES["letters"][data]
    after = np.zeros(len(data), dtype=np.uint8)
    after[1:] = mark[1:] & letter[:-1]
    column = {
        "log_bytes": np.log1p(sizes), "log_words": np.log1p(counts), "letters": count["letters"] / size,
        "capitals": count["capitals"] / np.maximum(count["letters"], 1), "word_bytes": count["letters"] / many,
        "repeats_last": np.bincount(text, weights=same, minlength=n) / many, "distinct_words": kinds / many,
        "distinct_pairs": pair_kinds / np.maximum(counts - 1, 1), "top_word": top / many,
        "distinct_lines": line_kinds / np.maximum(n_lines, 1), "line_bytes": np.log1p(sizes / np.maximum(n_lines, 1)),
        "marks_after_word": total(after) / many}
    for name in ("digits", "blanks", "marks", "exclamations", "bars", "hashes", "newlines", "full_stops", "other_marks"):
        column[name] = count[name] / size
    return np.stack([column[name] for name in NAMES], axis=1).astype(np.float32)


def _leaves(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """The step of each bin under the best tree of the given depth over neighbouring bins."""
    def gain(a, b):
        return a * a / (b + RIDGE)

    if depth and len(g) > 1:
        lg, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gains = gain(lg, lh) + gain(g.sum() - lg, h.sum() - lh) - gain(g.sum(), h.sum())
        cut = int(np.argmax(gains))
        if gains[cut] > 1e-9:
            return np.concatenate([_leaves(g[: cut + 1], h[: cut + 1], depth - 1),
                                   _leaves(g[cut + 1 :], h[cut + 1 :], depth - 1)])
    return np.full(len(g), -g.sum() / (h.sum() + RIDGE))


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, step of each cell) of the best pair of cuts, one on each axis."""
    cg = np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    ch = cg.copy()
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    rows, columns = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    if not rows.size or not columns.size:
        return 0.0, np.zeros(g.shape)

    def parts(c):
        ul = c[rows, columns]
        return ul, c[rows, -1] - ul, c[-1, columns] - ul, c[-1, -1] - c[rows, -1] - c[-1, columns] + ul

    gs, hs = parts(cg), parts(ch)
    gains = sum(a * a / (b + RIDGE) for a, b in zip(gs, hs)) - cg[-1, -1] ** 2 / (ch[-1, -1] + RIDGE)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    step = [-a[i, j] / (b[i, j] + RIDGE) for a, b in zip(gs, hs)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = step
    return float(gains[i, j]), out


class AdditiveModel:
    def __init__(self, edges: list[np.ndarray], coarse: list[np.ndarray]):
        self.edges, self.coarse = edges, coarse
        self.start = 0.0
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        fine, coarse = self.bins(x, self.edges), self.bins(x, self.coarse)
        out = np.full(len(x), self.start)
        for table, b in zip(self.tables, fine):
            out += table[b]
        for i, j, table in self.pairs:
            out += table[coarse[i], coarse[j]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins)) if len(values) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, check: np.ndarray) -> AdditiveModel:
    """Fits on the rows where ``check`` is false; on the others, the number of rounds is chosen."""
    model = AdditiveModel([_cuts(x[:, j], BINS) for j in range(x.shape[1])],
                          [_cuts(x[:, j], COARSE) for j in range(x.shape[1])])
    if not len(y):
        return model
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model.start = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return model
    if not check.any() or check.all():
        check = np.arange(len(y)) % 5 == 0
    learn = ~check
    z = np.full(len(y), model.start)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return np.where(learn, p - y, 0.0), np.where(learn, p * (1 - p), 0.0)

    def loss() -> float:
        return float(np.mean(np.logaddexp(0, z[check]) - y[check] * z[check]))

    fine, best = model.bins(x, model.edges), (loss(), [t.copy() for t in model.tables], z.copy())
    for _ in range(ROUNDS):
        for j, b in enumerate(fine):
            g, h = slope()
            size = len(model.tables[j])
            step = RATE * _leaves(np.bincount(b, g, size), np.bincount(b, h, size), 2)
            model.tables[j] += step
            z += step[b]
        if (now := loss()) < best[0] - 1e-6:
            best = now, [t.copy() for t in model.tables], z.copy()
    model.tables, z = best[1], best[2].copy()
    coarse = model.bins(x, model.coarse)
    shape = [len(e) + 1 for e in model.coarse]

    def cells(values, i, j):
        return np.bincount(coarse[i] * shape[j] + coarse[j], values, shape[i] * shape[j]).reshape(shape[i], shape[j])

    g, h = slope()
    ranked = sorted(((-_quadrants(cells(g, i, j), cells(h, i, j))[0], i, j) for i, j in combinations(range(len(shape)), 2)))
    model.pairs = [(i, j, np.zeros((shape[i], shape[j]))) for _, i, j in ranked[:PAIRS]]
    kept = loss(), [t.copy() for _, _, t in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            g, h = slope()
            step = RATE * _quadrants(cells(g, i, j), cells(h, i, j))[1]
            table += step
            z += step[coarse[i], coarse[j]]
        if (now := loss()) < kept[0] - 1e-6:
            kept = now, [t.copy() for _, _, t in model.pairs]
    model.pairs = [(i, j, t) for (i, j, _), t in zip(model.pairs, kept[1])]
    return model


def feature_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, WORKING_SET):
                x = features([t or "" for t in batch.column("text").to_pylist()])
                flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1],
                                                pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), flat], schema=FEATURES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, x array<float>")


def train(rows: DataFrame, labels: DataFrame) -> AdditiveModel:
    """Fits on at most ``TRAINING_ROWS`` labelled rows outside fold 0, chosen by a hash of doc_id.

    A document with several labels counts once, with the largest; null labels are passed over.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(
        "y is not null and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    known = rows.join(marked, "doc_id").where(~held_out(F.col("doc_id"))).select(
        "x", "y", (fold(F.col("doc_id")) == 1).alias("check"), "doc_id")
    table = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS).toArrow()
    n = table.num_rows
    x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False) if n else np.zeros(0, np.float32)
    return fit(x.reshape(n, len(NAMES)), (table["y"].to_numpy() > 0).astype(float) if n else np.zeros(0),
               np.array(table["check"].to_pylist(), dtype=bool))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.3) for every row of ``docs``.

    Null and empty texts are scored by their features: 0, but for their one empty line.  Without usable labels every score is 0.5; with
    one class only, every score is that class's smoothed rate.  Other columns are not looked at.
    """
    rows = settle(feature_rows(docs), "quality-features")
    model = train(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= KEEP).cast("int").alias("predicted"))
