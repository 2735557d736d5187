"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

1. Tasks look up the runs of ``SEED`` words of every document in a bit table of the benchmark's runs.  The table has
   a fixed size whatever the benchmark; a false hit costs time only.
2. Hits and the benchmark's runs are joined exactly, and (document, item) pairs whose shared runs could cover enough
   of the item go on.
3. Such a pair is tiled: the longest matches of unmarked words are marked first, then shorter ones down to ``SEED``
   words, so that passages whose parts were moved are still covered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.common import lean, slices
from groundwell.llm.wordhash import grams, powers, word_hashes
from groundwell.session import settle

SEED = 5
COVERAGE = 0.5
FILTER_BITS = 22
WORKING_SET = 2 << 20  # bytes of text hashed at once

HITS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()),
                  ("hits", pa.list_(pa.int64()))])
SEEDS = pa.schema([("item_id", pa.int64()), ("item", pa.int64()), ("n_words", pa.int32()), ("h", pa.int64()),
                   ("pos", pa.int32())])
TILED = pa.schema([("row", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()),
                   ("n_items", pa.int32())])


def _windows(words: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rolling hash, start) of every run of ``size`` unmarked words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers(len(words) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    taken = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(taken[size:] == taken[:-size])
    return (total[at + size] - total[at]) * down[at], at


def _matches(doc: np.ndarray, item: np.ndarray, doc_free: np.ndarray, item_free: np.ndarray,
             size: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, item start, doc start) of unmarked words, of ``size`` words or more."""
    dh, dat = _windows(doc, doc_free, size)
    ih, iat = _windows(item, item_free, size)
    if not len(dh) or not len(ih):
        return []
    near = np.isin(dh, ih)
    dh, dat = dh[near], dat[near]
    order = np.argsort(dh, kind="stable")
    dh, dat = dh[order], dat[order]
    lo, hi = np.searchsorted(dh, ih, "left"), np.searchsorted(dh, ih, "right")
    found = []
    for i, a, b in zip(iat.tolist(), lo.tolist(), hi.tolist()):
        for d in dat[a:b].tolist():
            if i and d and item_free[i - 1] and doc_free[d - 1] and item[i - 1] == doc[d - 1]:
                continue  # part of a match that begins earlier
            n = 0
            while (i + n < len(item) and d + n < len(doc) and item_free[i + n] and doc_free[d + n]
                   and item[i + n] == doc[d + n]):
                n += 1
            if n >= size:
                found.append((n, i, d))
    return found


def tile(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (length, item start, doc start), longest first; equal lengths by item start, then doc start.

    Each word of either side belongs to one tile at most.
    """
    doc_free, item_free, tiles = np.ones(len(doc), bool), np.ones(len(item), bool), []
    size = max(least, len(item))
    while True:
        found = sorted(_matches(doc, item, doc_free, item_free, size), key=lambda m: (-m[0], m[1], m[2]))
        cut = False
        for n, i, d in found:
            if item_free[i : i + n].all() and doc_free[d : d + n].all():
                item_free[i : i + n] = doc_free[d : d + n] = False
                tiles.append((n, i, d))
            else:
                cut = True  # what is left of it may still be long enough
        if cut and size > least:
            continue
        if size == least:
            if not cut:
                return tiles
            if not found or all(not item_free[i : i + n].any() or not doc_free[d : d + n].any() for n, i, d in found):
                return tiles
            if not _matches(doc, item, doc_free, item_free, size):
                return tiles
            continue
        size = max(least, size // 2)


def benchmark_seeds(benchmark: DataFrame) -> DataFrame:
    """One row per run of ``SEED`` words of each item; items with fewer words have none and are never matched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = word_hashes([t or "" for t in batch.column("text").to_pylist()])
            h, at = grams(words, counts, SEED)
            first = np.concatenate([[0], np.cumsum(counts)])
            text = np.searchsorted(first, at, side="right") - 1
            ids = batch.column("item_id").to_pylist()
            keys = batch.column("item").to_pylist()
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[i] for i in text], pa.int64()), pa.array([keys[i] for i in text], pa.int64()),
                pa.array(counts[text].astype(np.int32)), pa.array(h.view(np.int64)),
                pa.array((at - first[text]).astype(np.int32))], schema=SEEDS)

    return benchmark.mapInArrow(run, "item_id long, item long, n_words int, h long, pos int")


def _find_hits(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, WORKING_SET):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                words, counts = word_hashes(texts)
                h, at = grams(words, counts, SEED)
                slot = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                near = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                cuts = np.searchsorted(at[near], np.concatenate([[0], np.cumsum(counts)]))
                hits = [h[near[a:b]].view(np.int64) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                n = len(texts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + n)), batch.column("doc_id"),
                    pa.array([t if len(x) else None for t, x in zip(texts, hits)], pa.string()),
                    pa.array([np.unique(x) if len(x) else None for x in hits], pa.list_(pa.int64()))], schema=HITS)
                row += n

    return run


def _tile_rows(coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                doc, _ = word_hashes([batch.column("text")[i].as_py()])
                best, n_items = (0.0, None, 0), 0
                for pair in batch.column("items")[i].as_py():
                    item, _ = word_hashes([pair["text"]])
                    tiles = tile(doc, item)
                    part = sum(n for n, _, _ in tiles) / len(item)
                    n_items += part >= coverage
                    key = (part, -pair["item_id"] if pair["item_id"] is not None else -(1 << 63), len(tiles))
                    if best[1] is None or key > (best[0], -best[1] if best[1] is not None else 0, best[2]):
                        best = (part, pair["item_id"] if pair["item_id"] is not None else -1, len(tiles))
                out.append((batch.column("row")[i].as_py(), best[1], best[0], best[2], n_items))
            yield pa.RecordBatch.from_pylist([dict(zip(TILED.names, o)) for o in out], schema=TILED)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, contaminated, coverage, item_id, n_items, n_tiles for every row of ``docs``.

    ``coverage``: the largest part of an item's words that tiles of ``SEED`` words or more cover in the document;
    ``item_id``: that item (the smallest id of equals, -1 for a null id; null if no item can reach the threshold);
    ``n_items``: items whose coverage reaches the threshold, repeated items counted each.  Pairs that cannot reach
    the threshold are not tiled and count as 0.  Null and empty texts, and empty tables, are clean.  Other columns
    are not looked at.
    """
    spark = docs.sparkSession
    items = settle(benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"),
        F.monotonically_increasing_id().alias("item")), "benchmark")
    seeds = settle(benchmark_seeds(items), "benchmark-seeds")
    table = np.zeros(1 << FILTER_BITS >> 3, dtype=np.uint8)
    slots = seeds.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("slot")).distinct()
    for r in slots.toLocalIterator():  # 1 << FILTER_BITS at most
        table[r.slot >> 3] |= 1 << (r.slot & 7)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = settle(rows.mapInArrow(lean(_find_hits(table)), "row long, doc_id long, text string, hits array<bigint>"), "hits")
    near = found.where("hits is not null")
    met = near.select("row", F.explode("hits").alias("h")).join(seeds.select("item", "n_words", "h", "pos"), "h")
    pairs = met.groupBy("row", "item", "n_words").agg(F.count("*").alias("n")).where(
        F.col("n") * SEED >= F.col("n_words") * F.lit(coverage)).select("row", "item")
    grouped = pairs.join(items, "item").groupBy("row").agg(
        F.collect_list(F.struct("item_id", "text")).alias("items"))
    tiled = near.select("row", "text").join(grouped, "row").mapInArrow(
        lean(_tile_rows(coverage)), "row long, item_id long, coverage double, n_tiles int, n_items int")
    joined = found.select("row", "doc_id").join(tiled, "row", "left")
    zero = F.lit(0)
    return joined.select(
        "doc_id", (F.coalesce("coverage", zero.cast("double")) >= F.lit(coverage)).alias("contaminated"),
        F.coalesce("coverage", zero.cast("double")).alias("coverage"), "item_id",
        F.coalesce("n_items", zero).alias("n_items"), F.coalesce("n_tiles", zero).alias("n_tiles"))
