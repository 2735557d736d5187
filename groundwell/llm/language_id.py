"""Language identification with interpolated Kneser-Ney models of characters, one per language.

Texts become runs of lower-case letters with one blank between them.  Spark counts the runs of ``ORDER`` characters
of every training text, and from all of them the discounts, the continuation counts and the interpolated
probabilities of all orders for each language.  Sorted by packed key, they are written to the shared folder: for each
order the log probability of a run, and the log weight that its context leaves for the shorter one.  Tasks map these
files into memory and look keys up in place, so that neither the driver nor a worker holds the model.  A text goes to
the language of lowest cross-entropy per character.  On a fold of the training texts kept apart, the sharpness of the
confidence and the limit for rejection are fitted.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwell.llm.common import fold, lean, parts, slices
from groundwell.session import fresh_folder, scratch, settle

ORDER = 5
SYMBOL_BITS = 12
PART_ROWS = 4_000_000  # about as many rows of a table are sorted and written by one task
CALIBRATION_ROWS = 20_000
CALIBRATION_FOLD = 1
TAIL = 1e-3
WORKING_SET = 1 << 18  # bytes of text scored at once
OPEN_PARTS = 64  # files of a model that a worker keeps mapped
UNKNOWN = "und"
BLANK = 1

COUNTS = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64())])
ROWS = pa.schema([("key", pa.int64()), ("lang", pa.int32()), ("value", pa.float32())])
SCORES = pa.schema([("row", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                    ("entropy", pa.float64()), ("runner_up", pa.float64()), ("n_letters", pa.int64())])

_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])


def _symbols(code: np.ndarray) -> np.ndarray:
    """Letters as numbers from 2 to 4,095: their code point where it is small, else folded."""
    code = code.astype(np.uint64)
    folded = 2048 + (code * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(2048)
    return np.where(code < 2048, code, folded)


def runs(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(packed key of each character with the ``order - 1`` before it, number of keys of each text).

    A text begins with ``order - 1`` blanks, which are context only, and ends with a blank.
    """
    pad = " " * (order - 1)
    raw = "".join([f"{pad}{t.lower()} \x00" for t in texts])  # the zero ends a text
    code = np.frombuffer(raw.encode("utf-32-le", "replace"), dtype=np.uint32)
    low = np.minimum(code, 0xFFFF)
    letter = _LETTER[low]
    far = np.flatnonzero(code > 0xFFFF)
    if len(far):
        known = {c: chr(c).isalpha() for c in np.unique(code[far]).tolist()}
        letter[far] = [known[c] for c in code[far].tolist()]
    ends = np.flatnonzero(code == 0)
    if len(ends) != len(texts):  # texts with zeros of their own
        return runs([t.replace("\x00", " ") for t in texts], order)
    # of other characters, one stays: the first after a letter
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    sizes = np.diff(np.concatenate([[0], ends + 1]))
    keep[ends] = False
    text = np.repeat(np.arange(len(texts)), sizes)
    at = np.flatnonzero(keep)
    counts = np.bincount(text[at], minlength=len(texts))
    symbol = np.where(letter[at], _symbols(code[at]), np.uint64(BLANK))
    # each text's own blanks in front, as context of its first characters
    first = np.cumsum(counts) - counts
    placed = np.arange(len(at)) + (order - 1) * (np.repeat(np.arange(len(texts)), counts) + 1)
    padded = np.full(len(at) + (order - 1) * len(texts), BLANK, dtype=np.uint64)
    padded[placed] = symbol
    key = np.zeros(len(at), dtype=np.uint64)
    for back in range(order - 1, -1, -1):
        key = key << np.uint64(SYMBOL_BITS) | padded[placed - back]
    assert len(first) == len(texts)
    return key.view(np.int64), counts


def count_runs(docs: DataFrame) -> DataFrame:
    """(lang, key, n) over all texts of ``docs`` (lang, text); tasks add up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def emit(lang: str) -> Iterator[pa.RecordBatch]:
            key = np.concatenate([k for k, _ in held[lang]])
            n = np.concatenate([c for _, c in held[lang]])
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            held[lang] = [(key[cut], np.add.reduceat(n, cut))]
            yield from ()

        for whole in batches:
            for batch in slices(whole, WORKING_SET):
                langs = np.array(batch.column("lang").to_pylist(), dtype=object)
                texts = np.array([t or "" for t in batch.column("text").to_pylist()], dtype=object)
                for lang in sorted(set(langs)):
                    key, n = np.unique(runs(texts[langs == lang].tolist())[0], return_counts=True)
                    if len(key):
                        held.setdefault(lang, []).append((key, n))
            for lang in held:
                if sum(len(k) for k, _ in held[lang]) > 1 << 20:
                    list(emit(lang))
                    if len(held[lang][0][0]) > 1 << 20:  # more kinds than a task should hold
                        key, n = held[lang][0]
                        yield from _counted(lang, key, n)
                        held[lang] = [(key[:0], n[:0])]
        for lang in held:
            list(emit(lang)) if any(len(k) for k, _ in held[lang]) else None
            yield from _counted(lang, *held[lang][0])

    found = docs.select("lang", "text").mapInArrow(lean(run), "lang string, key long, n long")
    return found.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _counted(lang: str, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(key), 100_000):
        k = key[a : a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k), pa.array(n[a : a + 100_000])],
                                         schema=COUNTS)


def _low(m: int) -> int:
    """Mask of the last ``m`` symbols of a key."""
    return (1 << SYMBOL_BITS * m) - 1


def _grouped(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, weights=weights, minlength=len(unique))


@lru_cache(maxsize=OPEN_PARTS)
def _opened(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The columns of a file of ``ROWS``, mapped into memory; a file that is not on a mounted folder is copied first."""
    system, path = fs.FileSystem.from_uri(uri)
    copied = not isinstance(system, fs.LocalFileSystem)
    if copied:
        handle, local = tempfile.mkstemp(prefix="groundwell-")
        os.close(handle)
        fs.copy_files(path, local, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
        path = local
    batch = pa.ipc.open_file(pa.memory_map(path)).get_batch(0)
    if copied:
        os.unlink(path)  # the mapping keeps it
    return tuple(c.to_numpy() for c in batch.columns)


class Table:
    """(key, language, value) sorted by key, in parts: arrays, or files that are opened where they are needed."""

    def __init__(self, firsts: np.ndarray, held: list):
        self.firsts, self.held = firsts, held  # the least key of each part

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, int, np.ndarray]]) -> Table:
        key = np.concatenate([np.zeros(0, np.int64), *[k for k, _, _ in rows]])
        lang = np.concatenate([np.zeros(0, np.int32), *[np.full(len(k), j, np.int32) for k, j, _ in rows]])
        value = np.concatenate([np.zeros(0, np.float32), *[v.astype(np.float32) for _, _, v in rows]])
        order = np.argsort(key, kind="stable")
        return cls(key[order][:1], [(key[order], lang[order], value[order])] if len(key) else [])

    def fill(self, out: np.ndarray, wanted: np.ndarray, add: bool = False) -> None:
        """Sets ``out`` (wanted key, language), or adds to it, wherever the table has a row."""
        part = np.searchsorted(self.firsts, wanted, side="right") - 1
        for p in np.unique(part[part >= 0]).tolist():
            keys, lang, value = _opened(self.held[p]) if isinstance(self.held[p], str) else self.held[p]
            live = np.flatnonzero(part == p)
            at = np.searchsorted(keys, wanted[live])
            while len(live):
                hit = at < len(keys)
                hit[hit] = keys[at[hit]] == wanted[live[hit]]
                live, at = live[hit], at[hit]
                if add:
                    out[live, lang[at]] += value[at]
                else:
                    out[live, lang[at]] = value[at]
                at = at + 1


class Models:
    """Kneser-Ney models of several languages: a table of log probabilities and one of weights left for each order."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """From counts that fit in memory; ``stored_models`` does the same from a table."""
        self.langs = sorted(counts)
        own = [self._one(counts[lang][0].astype(np.int64), counts[lang][1].astype(np.float64)) for lang in self.langs]
        self.unseen = np.array([np.log(t[0][3][0] / (1 << SYMBOL_BITS)) if len(t[0][3]) else -np.log(1 << SYMBOL_BITS)
                                for t in own], dtype=np.float32)
        self.logp, self.left, shorter = [], [], [None] * len(own)
        for m in range(1, ORDER + 1):
            logp, left = [], []
            for j, t in enumerate(own):
                key, share, ctx, gamma = t[m - 1]
                low = np.full(len(key), 1.0 / (1 << SYMBOL_BITS)) if m == 1 else np.exp(
                    shorter[j][np.searchsorted(t[m - 2][0], key & _low(m - 1))])
                shorter[j] = np.log(share + gamma[np.searchsorted(ctx, key >> SYMBOL_BITS)] * low)
                logp.append((key, j, shorter[j]))
                left.append((ctx, j, np.log(gamma)))
            self.logp.append(Table.of(logp))
            self.left.append(Table.of(left))  # of contexts one shorter than the runs

    @classmethod
    def stored(cls, langs: list[str], unseen: list[float], logp: list[Table], left: list[Table]) -> Models:
        out = cls({})
        out.langs, out.unseen, out.logp, out.left = langs, np.array(unseen, dtype=np.float32), logp, left
        return out

    @staticmethod
    def _one(key: np.ndarray, n: np.ndarray) -> list[tuple]:
        """Per order: (keys, discounted share of the context, contexts, weight left for the shorter order)."""
        out = []
        for m in range(ORDER, 0, -1):
            ctx_of = key >> SYMBOL_BITS
            d = np.sum(n == 1) / max(1.0, np.sum(n == 1) + 2 * np.sum(n == 2)) or 0.5
            d = min(max(float(d), 0.1), 0.95)
            ctx, total = _grouped(ctx_of, n)
            kinds = _grouped(ctx_of, np.ones(len(n)))[1]
            share = np.maximum(n - d, 0) / total[np.searchsorted(ctx, ctx_of)]
            out.append((key, share, ctx, d * kinds / total))
            # the next shorter order counts in how many kinds of context a run appears
            key, n = _grouped(key & _low(m - 1), np.ones(len(key)))
        return out[::-1]

    def _logp_of(self, key: np.ndarray, m: int) -> np.ndarray:
        """Log probability of the last symbol of each key of ``m`` symbols, for every language."""
        if m == 0:
            return np.tile(self.unseen, (len(key), 1))
        if m == 1:
            out = np.tile(self.unseen, (len(key), 1))
        else:
            short, at = np.unique(key & _low(m - 1), return_inverse=True)
            out = self._logp_of(short, m - 1)[at]
            self.left[m - 1].fill(out, key >> SYMBOL_BITS, add=True)
        self.logp[m - 1].fill(out, key)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character for each text and language, letters and blanks of each text)."""
        key, counts = runs(texts)
        total = np.zeros((len(texts), len(self.langs)))
        if len(key) and self.langs:
            # equal runs are looked up once
            unique, inverse = np.unique(key, return_inverse=True)
            logp = self._logp_of(unique, ORDER)
            start = np.cumsum(counts) - counts
            full = counts > 0
            for j in range(len(self.langs)):
                total[full, j] = -np.add.reduceat(logp[inverse, j].astype(np.float64), start[full])
        return total / np.maximum(counts, 1)[:, None], counts


class LanguageModel:
    """Fitted models, the sharpness of the confidence and the largest cross-entropy that is not rejected."""

    def __init__(self, models: Models, sharpness: float, limits: list[float]):
        self.models, self.sharpness, self.limits = models, sharpness, limits

    def predict(self, texts: list[str]) -> list[tuple[str, float, float, float, int]]:
        h, counts = self.models.entropies(texts)
        out = []
        for i in range(len(texts)):
            if not counts[i] or not self.models.langs:
                out.append((UNKNOWN, 0.0, 0.0, 0.0, int(counts[i])))
                continue
            best = int(np.argmin(h[i]))  # the first of equals, by name
            gap = self.sharpness * np.sqrt(counts[i]) * (h[i] - h[i][best])
            second = float(np.partition(h[i], 1)[1]) if h.shape[1] > 1 else float(h[i][best])
            out.append((self.models.langs[best], float(1 / np.exp(-np.minimum(gap, 700)).sum()), float(h[i][best]),
                        second, int(counts[i])))
        return out


def _write_part(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), schema=ROWS).combine_chunks()  # about PART_ROWS
        if rows.num_rows:
            uri = f"{folder}/{uuid.uuid4().hex}.arrow"  # what a failed attempt leaves is never listed
            system, path = fs.FileSystem.from_uri(uri)
            system.create_dir(path.rpartition("/")[0])
            with system.open_output_stream(path) as sink, pa.ipc.new_file(sink, ROWS) as out:
                out.write_table(rows, max_chunksize=rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows["key"][:1].combine_chunks(), pa.array([uri])], ["first", "uri"])

    return run


def stored_table(rows: DataFrame, label: str, part_rows: int = PART_ROWS) -> Table:
    """Writes ``rows`` (key, lang, value) as sorted files to the shared folder; all rows of a key are in one file."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(fresh_folder(spark, label))
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if folder.startswith("file:"):
        folder = "file:///" + folder[5:].lstrip("/")
    dealt = rows.select("key", F.col("lang").cast("int").alias("lang"), F.col("value").cast("float").alias("value"))
    dealt = dealt.repartitionByRange(parts(rows.count(), part_rows), "key").sortWithinPartitions("key")
    made = sorted(tuple(r) for r in dealt.mapInArrow(_write_part(folder), "first long, uri string").collect())
    return Table(np.array([k for k, _ in made], dtype=np.int64), [uri for _, uri in made])


def stored_models(counted: DataFrame, part_rows: int = PART_ROWS) -> Models:
    """Models of all of ``counted`` (lang, key, n: runs of ``ORDER`` symbols), stored in the shared folder.

    Nothing is left out.  The driver gets the languages, one number for each, and the names of the files.  A context
    has at most ``1 << SYMBOL_BITS`` runs, so no window is larger.
    """
    langs = sorted(r.lang for r in counted.select("lang").distinct().collect())
    if not langs:
        return Models({})
    numbers = counted.sparkSession.createDataFrame(list(enumerate(langs)), "j int, lang string")
    level = settle(counted.join(F.broadcast(numbers), "lang").select(F.col("j").alias("lang"), "key", "n"), "language-5")
    levels = [level]
    for m in range(ORDER - 1, 0, -1):  # the next shorter order counts in how many kinds of context a run appears
        level = settle(level.groupBy("lang", F.col("key").bitwiseAND(F.lit(_low(m))).alias("key")).agg(
            F.count("*").alias("n")), f"language-{m}")
        levels.insert(0, level)
    logp, left, shorter, unseen = [], [], None, []
    for m, level in enumerate(levels, 1):
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        d = ones / F.greatest(F.lit(1), ones + 2 * twos)
        discount = level.groupBy("lang").agg(
            F.least(F.greatest(F.when(d == 0, 0.5).otherwise(d), F.lit(0.1)), F.lit(0.95)).alias("d"))
        context = Window.partitionBy("lang", "ctx")
        rows = level.withColumn("ctx", F.shiftright("key", SYMBOL_BITS)).withColumn(
            "total", F.sum("n").over(context)).withColumn("kinds", F.count("*").over(context))
        rows = rows.join(F.broadcast(discount), "lang").select(
            "lang", "key", "ctx", F.col("key").bitwiseAND(F.lit(_low(m - 1))).alias("short"),
            (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("share"),
            (F.col("d") * F.col("kinds") / F.col("total")).alias("gamma"))
        if m == 1:
            rows = rows.withColumn("low", F.lit(1.0 / (1 << SYMBOL_BITS)))
        else:
            rows = rows.join(shorter.select("lang", F.col("key").alias("short"), F.exp("value").alias("low")),
                             ["lang", "short"])
        rows = settle(rows.select("lang", "key", "ctx", "gamma", F.log(
            F.col("share") + F.col("gamma") * F.col("low")).alias("value")), f"language-logp-{m}")
        weights = rows.groupBy("lang", F.col("ctx").alias("key")).agg(F.log(F.first("gamma")).alias("value"))
        if m == 1:
            bases = {r.lang: r.value for r in weights.collect()}
            unseen = [bases[j] - np.log(1 << SYMBOL_BITS) for j in range(len(langs))]
            left.append(Table.of([]))
        else:
            left.append(stored_table(weights, f"language-left-{m}", part_rows))
        logp.append(stored_table(rows, f"language-table-{m}", part_rows))
        shorter = rows
    return Models.stored(langs, unseen, logp, left)


def train(docs: DataFrame, part_rows: int = PART_ROWS) -> LanguageModel:
    """Fits on ``docs`` (doc_id, text, lang); rows of fold 0 and rows without a language are not used.

    Counts cover all rows of folds 2 to 4, and the models all of their runs; they lie in the shared folder.  Fold 1
    fits the sharpness on at most ``CALIBRATION_ROWS`` rows and the limits on all of its rows.
    """
    with scratch(docs.sparkSession):  # the model's own files are not among what is settled
        return _trained(docs, part_rows)


def _trained(docs: DataFrame, part_rows: int) -> LanguageModel:
    known = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang")).where("lang is not null")
    k = fold(F.col("doc_id"))
    counted = settle(count_runs(known.where(~k.isin(0, CALIBRATION_FOLD))), "language-runs")
    model = LanguageModel(stored_models(counted, part_rows), 1.0, [])
    if not model.models.langs:
        return model
    apart = known.where(k == CALIBRATION_FOLD)
    limits = settle(score_rows(apart.withColumn("row", F.col("doc_id").cast("long")), model).join(
        apart.select(F.col("doc_id").cast("long").alias("row"), "lang"), "row"), "language-calibration")
    right = limits.where("lang = lang_pred").groupBy("lang_pred").agg(
        F.percentile_approx("entropy", 1 - TAIL, 100_000).alias("top"), F.avg("entropy").alias("mean"))
    tops = {r.lang_pred: r.top + 0.5 * (r.top - r.mean) for r in right.collect()}
    rows = limits.select("lang", "lang_pred", "entropy", "runner_up", "n_letters").orderBy(
        F.xxhash64("row")).limit(CALIBRATION_ROWS).collect()
    gap = np.array([np.sqrt(r.n_letters) * (r.runner_up - r.entropy) for r in rows if r.lang_pred != UNKNOWN])
    hit = np.array([r.lang == r.lang_pred for r in rows if r.lang_pred != UNKNOWN], dtype=bool)
    if len(gap):
        tried = np.geomspace(0.01, 10, 60)
        with np.errstate(over="ignore", divide="ignore"):
            loss = [np.mean(np.where(hit, np.log1p(np.exp(-s * gap)), np.log1p(np.exp(np.minimum(s * gap, 700)))))
                    for s in tried]
        model.sharpness = float(tried[int(np.argmin(loss))])
    model.limits = [tops.get(lang, float("inf")) for lang in model.models.langs]
    return model


def score_rows(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(row, lang_pred, score, entropy, runner_up, n_letters) of ``docs`` (row, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the names of its files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for whole in batches:
            for batch in slices(whole, WORKING_SET):
                found = fitted.predict([t or "" for t in batch.column("text").to_pylist()])
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), *[pa.array(c, t.type) for c, t in zip(columns, list(SCORES)[1:])]],
                    schema=SCORES)

    return docs.select("row", "text").mapInArrow(
        lean(run), "row long, lang_pred string, score double, entropy double, runner_up double, n_letters long")


def spoken_rows(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The rows of ``docs`` that ``identify`` does not reject, with all their columns; nothing is shuffled."""
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the names of its files
    limits = dict(zip(model.models.langs, model.limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for whole in batches:
            for batch in slices(whole, WORKING_SET):
                found = fitted.predict([str(t) if t is not None else "" for t in batch.column("text").to_pylist()])
                keep = [lang != UNKNOWN and entropy <= limits[lang] for lang, _, entropy, *_ in found]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, rejected for every row of ``docs``.

    A text that is null or has no letters is ``und`` with score 0 and rejected.  Any other text gets the language of
    lowest cross-entropy per character; it is rejected where that exceeds the language's limit.  With no training
    rows every text is ``und``.  Long texts are read whole.
    """
    model = model or train(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("row"), F.col("text").cast("string").alias("text"))
    limit = F.coalesce(*[F.when(F.col("lang_pred") == lang, F.lit(top)) for lang, top in zip(
        model.models.langs, model.limits)], F.lit(-1.0))
    return score_rows(rows, model).select(
        F.col("row").alias("doc_id"), F.coalesce(fold(F.col("row")) == 0, F.lit(False)).alias("held_out"),
        "lang_pred", "score", "entropy", (F.col("entropy") > limit).alias("beyond")).withColumn(
        "rejected", (F.col("lang_pred") == UNKNOWN) | F.col("beyond")).drop("beyond")
