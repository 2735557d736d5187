"""Embedders as plug-ins: text in, a vector of floats out.

A plug-in is either a model that runs in Python workers, batch by batch, or an expression of built-in functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

# name: (dimension, factory); the factory runs once per Python worker and
# returns a function from a list of texts to a list of vectors
_MODELS: dict[str, tuple[int, Callable[[], Callable[[list[str]], list]]]] = {}
_EXPRESSIONS: dict[str, Callable[[Column], Column]] = {}

EMBED_BATCH = 64
BUCKET_WORDS = 1 << 20  # words that are counted at once


def register_embedder(name: str, dim: int, factory: Callable[[], Callable[[list[str]], list]]) -> None:
    _MODELS[name] = (dim, factory)
    _EXPRESSIONS.pop(name, None)


def register_expression(name: str, build: Callable[[Column], Column]) -> None:
    _EXPRESSIONS[name] = build
    _MODELS.pop(name, None)


def embedder(name: str, on_error: str = "raise") -> Callable[[Column], Column]:
    """The embedder as a Column function.

    A model that fails, or gives another number of vectors or another width than it was registered with, ends the
    job; with ``on_error="zeros"`` the batch gets zero vectors instead.
    """
    if on_error not in ("raise", "zeros"):
        raise ValueError("on_error is 'raise' or 'zeros'")
    if name in _EXPRESSIONS:
        return _EXPRESSIONS[name]
    dim, factory = _MODELS[name]

    def encode(texts: list[str], model) -> list:
        try:
            vectors = np.asarray(model(texts), dtype=np.float32)
            if vectors.shape != (len(texts), dim):
                raise ValueError(f"embedder {name!r} gave {vectors.shape}, not {(len(texts), dim)}")
            return list(vectors)
        except Exception:
            if on_error == "raise":
                raise
        return [np.zeros(dim, np.float32)] * len(texts)

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            values = texts.fillna("").tolist()
            out = []
            for at in range(0, len(values), EMBED_BATCH):
                out.extend(encode(values[at : at + EMBED_BATCH], model))
            yield pd.Series(out)

    return embed


def embed_documents(rows: DataFrame, name: str, text: str = "text", output: str = "embedding",
                    on_error: str = "raise") -> DataFrame:
    return rows.withColumn(output, embedder(name, on_error)(F.col(text)))


def signed_buckets(text: Column, dim: int) -> Column:
    """Feature hashing: each word adds 1 to, or takes 1 from, the place that its hash picks; unit length.

    A text without words, and a null, give zeros.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

    @F.arrow_udf(ArrayType(FloatType()))
    def counted(lists: pa.Array) -> pa.Array:
        offsets = np.asarray(lists.offsets)
        parts, start = [np.zeros((0, dim), np.float32)], 0
        while start < len(lists):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BUCKET_WORDS, side="right")) - 1)
            own = lists.values.slice(offsets[start], offsets[stop] - offsets[start])
            parts.append(_unit_buckets(own, offsets[start : stop + 1], dim))
            start = stop
        flat = pa.array(np.concatenate(parts).ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dim), flat)

    return counted(words)


def _unit_buckets(words: pa.Array, offsets: np.ndarray, dim: int) -> np.ndarray:
    """A row for each run of words between two offsets; each different word is hashed once."""
    coded = words.dictionary_encode()
    slots = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % (2 * dim)
                      for w in coded.dictionary.to_pylist()], dtype=np.int64)
    n = len(offsets) - 1
    cells = np.repeat(np.arange(n) * (2 * dim), np.diff(offsets)) + slots[np.asarray(coded.indices)]
    counts = np.bincount(cells, minlength=n * 2 * dim).reshape(n, dim, 2)
    sums = (counts[:, :, 0] - counts[:, :, 1]).astype(np.float64)
    lengths = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return (sums / np.where(lengths > 0, lengths, 1.0)).astype(np.float32)


register_expression("hash-32", lambda text: signed_buckets(text, 32))
