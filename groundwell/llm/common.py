"""What several operators share: reading, folds, Arrow batches, sizes."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"  # fixed value: what a word is
FOLDS = 5


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """True in the fold that no model learns from; a null id is never held out."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The texts of a column as UTF-8; a null is an empty text. One text is copied at a time."""
    column = column.cast(pa.binary())
    for value in column:
        yield value.as_py() or b""


Batches = Iterator[pa.RecordBatch]
_CACHES: list = []  # what operators keep in a Python worker from task to task


def worker_cache(cached: Callable) -> Callable:
    """Marks a function under ``lru_cache`` whose values are dropped when the worker goes on to another operator."""
    _CACHES.append(cached)
    return cached


def lean(run: Callable[[Batches], Batches], *own: Callable) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow in workers that are used again: before it, all caches but its own are dropped, and after
    it, Arrow's free memory goes back."""

    def wrapped(batches: Batches) -> Batches:
        for cached in _CACHES:
            if cached not in own:
                cached.cache_clear()
        pa.default_memory_pool().release_unused()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return wrapped


def slices(batch: pa.RecordBatch, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that what is worked on at once stays small; one row may exceed the bound."""
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(total: float, each: float, least: int = 1) -> int:
    """How many parts of about ``each`` make up ``total``."""
    return max(least, int(-(-total // each)))


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def signed(value: int) -> int:
    """An unsigned 64-bit value as Spark's bigint holds it."""
    return value - (1 << 64) if value >= 1 << 63 else value
