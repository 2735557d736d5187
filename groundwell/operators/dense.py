"""Dense retrieval: exact cosine top-k of many queries over many vectors.

Both sides are packed into blocks of rows; a block of queries meets every block of vectors of its scope in a join
whose strategy Spark picks by the size of the written query blocks.  Where either side is large, both are dealt into a
grid, so that the work of a scope is many tasks of a bounded number of pairs.  A pair of blocks is scored as products of a
bounded number of cells.  A first slice of the vectors, one in ``FIRST_SLICE``, gives each query a lower bound for its
last place; with it, and with what a task has already seen, tasks pass on little more than the rows that can win.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .scope import scope_chunks, with_scope
from .topk import largest_top_k, top_k_of

QUERY_BLOCK = 1_000
CHUNK_BLOCK = 4_000
# rows of either side that meet in one cell of the grid, about
CELL_ROWS = 8_000
# scores that are held at once (8 bytes each)
CELLS = 2_000_000
# one vector in so many is looked at first
FIRST_SLICE = 32
# best scores of queries that a task remembers (8 bytes each)
REMEMBERED = 4_000_000
# scores closer than this are ties, broken by chunk id
SCORE_DIGITS = 9

_CANDIDATE = "query_id string, chunk_id string, score double"


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays as a Column, for a few pairs at a time."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def _matrix(vectors: pa.Array) -> np.ndarray:
    sizes = np.diff(np.asarray(vectors.offsets))
    if len(sizes) and sizes.min() != sizes.max():
        raise ValueError("vectors of different lengths")
    return np.asarray(vectors.flatten()).reshape(len(vectors), -1)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix.astype(np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return matrix / norms


def blocks(rows: DataFrame, vector: str, others: list[str], size: int) -> DataFrame:
    """``rows`` (scope_id, a vector column, others) as blocks: scope_id, block, lists of others, n, vectors (floats)."""
    kind = rows.schema[vector].dataType.elementType.simpleString()
    width = np.dtype("<f4" if kind == "float" else "<f8")
    lists = [f"{c} array<{rows.schema[c].dataType.simpleString()}>" for c in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            scopes = batch.column("scope_id").dictionary_encode()
            codes = np.asarray(scopes.indices)
            for code, scope in enumerate(scopes.dictionary.to_pylist()):
                mine = np.flatnonzero(codes == code)
                for at in range(0, len(mine), size):
                    part = batch.take(pa.array(mine[at : at + size]))
                    kept = {c: pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c))
                            for c in others}
                    packed = _matrix(part.column(vector)).astype(width).tobytes()
                    yield pa.RecordBatch.from_pydict({
                        "scope_id": pa.array([scope]), "block": pa.array([number], pa.int64()), **kept,
                        "n": pa.array([part.num_rows], pa.int32()), "vectors": pa.array([packed], pa.binary()),
                        "wide": pa.array([width.itemsize == 8])})
                    number += 1

    ddl = ", ".join(["scope_id string", "block long", *lists, "n int", "vectors binary", "wide boolean"])
    return rows.select("scope_id", vector, *others).mapInArrow(run, ddl)


def cell_slices(n_queries: int, n_vectors: int, cells: int) -> Iterator[tuple[slice, slice]]:
    """Cuts a product into parts of at most ``cells`` scores."""
    tall = max(1, min(n_queries, cells))
    broad = max(1, cells // tall)
    for q in range(0, n_queries, tall):
        for v in range(0, n_vectors, broad):
            yield slice(q, min(q + tall, n_queries)), slice(v, min(v + broad, n_vectors))


def _best(frame: pd.DataFrame) -> pd.DataFrame:
    """The first ``pool`` rows of every query by score, then chunk id."""
    ordered = frame.sort_values(["q", "score", "chunk_id"], ascending=[True, False, True], kind="stable")
    return ordered[ordered.groupby("q").cumcount() < ordered["pool"]]


class Seen:
    """For a block of queries: what their last places must reach at least, and the best scores seen so far."""

    def __init__(self, bounds: np.ndarray, pools: np.ndarray):
        self.bounds, self.pools = np.array(bounds, dtype=np.float64), pools
        self.best = np.full((len(pools), int(pools.max())), -np.inf)  # descending

    def add(self, q: slice, scores: np.ndarray) -> np.ndarray:
        """Takes scores in and returns the bounds of these queries."""
        k = min(self.best.shape[1], scores.shape[1])
        top = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k :]
        merged = -np.sort(-np.concatenate([self.best[q], top], axis=1), axis=1)[:, : self.best.shape[1]]
        self.best[q] = merged
        self.bounds[q] = np.maximum(self.bounds[q], merged[np.arange(len(merged)), self.pools[q] - 1])
        return self.bounds[q]


def _candidates(units: np.ndarray, vectors: np.ndarray, ids: np.ndarray, seen: Seen, cells: int) -> pd.DataFrame:
    """Rows of a pair of blocks that can be among the best of their query."""
    held = []
    for q, v in cell_slices(len(units), len(vectors), cells):
        scores = np.round(units[q] @ vectors[v].T, SCORE_DIGITS)
        row, column = np.nonzero(scores >= seen.add(q, scores)[:, None])  # ties stay in
        held.append(pd.DataFrame({"q": row + q.start, "score": scores[row, column], "chunk_id": ids[v][column],
                                  "pool": seen.pools[q][row]}))
    return _best(pd.concat(held))


def _read(packed: bytes, n: int, wide: bool) -> np.ndarray:
    return _unit_rows(np.frombuffer(packed, dtype="<f8" if wide else "<f4").reshape(n, -1))


def _met(vectors: DataFrame, asked: DataFrame, n_vectors: int, n_asked: int, cell_rows: int) -> DataFrame:
    """Every block of ``asked`` beside every block of ``vectors`` of its scope."""
    tall, broad = max(1, -(-n_asked // cell_rows)), max(1, -(-n_vectors // cell_rows))
    if tall * broad == 1:
        return vectors.drop("block").join(asked, "scope_id")

    def dealt(rows: DataFrame, own: str, block: str, n: int, other: str, copies: int) -> DataFrame:
        cells = rows.withColumn(own, F.pmod(F.xxhash64(block), F.lit(n)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        return cells.repartition(tall * broad, "scope_id", "__tall", "__broad")

    return dealt(vectors, "__broad", "block", broad, "__tall", tall).join(
        dealt(asked, "__tall", "q_block", tall, "__broad", broad).hint("shuffle_hash"),
        ["scope_id", "__tall", "__broad"]).drop("__tall", "__broad", "block")


def _scored(asked: DataFrame, vectors: DataFrame, chunk_block: int, cells: int, cell_rows: int) -> DataFrame:
    """Candidates (query_id, chunk_id, score) of written query blocks over all vectors of their scopes."""
    mine = asked.select("scope_id", F.col("block").alias("q_block"), "query_id", "pool", "bound", F.col("n").alias("q_n"),
                        F.col("vectors").alias("q_vectors"), F.col("wide").alias("q_wide"))
    met = _met(blocks(vectors, "embedding", ["chunk_id"], chunk_block), mine, vectors.count(),
               asked.agg(F.sum("n")).first()[0] or 0, cell_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[int, Seen] = OrderedDict()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                block = row["q_block"].as_py()
                if block not in seen:
                    seen[block] = Seen(np.asarray(row["bound"].values), np.asarray(row["pool"].values))
                    while len(seen) > 1 and sum(s.best.size for s in seen.values()) > REMEMBERED:
                        seen.popitem(last=False)  # only its later rows are less well bounded
                found = _candidates(
                    _read(row["q_vectors"].as_py(), row["q_n"].as_py(), row["q_wide"].as_py()),
                    _read(row["vectors"].as_py(), row["n"].as_py(), row["wide"].as_py()),
                    row["chunk_id"].values.to_numpy(zero_copy_only=False), seen[block], cells)
                asked_ids = row["query_id"].values.take(pa.array(found["q"].to_numpy()))
                yield pa.RecordBatch.from_arrays(
                    [asked_ids, pa.array(found["chunk_id"], pa.string()), pa.array(found["score"], pa.float64())],
                    ["query_id", "chunk_id", "score"])

    return met.mapInArrow(run, _CANDIDATE)


def dense_pool(queries: DataFrame, chunks: DataFrame, factor: int = 1, query_block: int = QUERY_BLOCK,
               chunk_block: int = CHUNK_BLOCK, cells: int = CELLS, first_slice: int = FIRST_SLICE,
               cell_rows: int = CELL_ROWS) -> DataFrame:
    """Best ``factor * top_k`` chunks per query: query_id, chunk_id, score, dense_rank.

    ``queries``: query_id, query_vec, optionally top_k and filter.
    ``chunks``: chunk_id, embedding, and the filtered columns if filters are used.
    Queries and chunks without a vector are left out.
    """
    asked = with_scope(queries)
    asked = asked.select("query_id", "scope_id", "query_vec", (top_k_of(asked) * factor).alias("pool")).where(
        F.size("query_vec") > 0)
    # small query tables become one partition, and so full blocks
    asked = asked.repartition("scope_id", F.pmod(F.xxhash64("query_id"), F.lit(1024)))
    most = largest_top_k(queries) * factor
    vectors = scope_chunks(queries, chunks, ["chunk_id", "embedding"]).where(F.size("embedding") > 0)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")

    def ranked(bounds: DataFrame | None, among: DataFrame) -> DataFrame:
        """The literal bound lets Spark drop rows before the shuffle."""
        known = asked.withColumn("bound", F.lit(float("-inf"))) if bounds is None else asked.join(
            bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        # written, so that Spark knows the true size when it plans the join
        packed = settle(blocks(known, "query_vec", ["query_id", "pool", "bound"], query_block), "query-blocks")
        numbered = _scored(packed, among, chunk_block, cells, cell_rows).withColumn("__n", F.row_number().over(order)).where(
            F.col("__n") <= most)
        return numbered.join(asked.select("query_id", "pool"), "query_id")

    first = vectors.where(F.pmod(F.xxhash64("chunk_id"), F.lit(first_slice)) == 0)
    bounds = ranked(None, first).where(F.col("__n") == F.col("pool")).select(
        "query_id", (F.col("score") - 2 * 10.0 ** -SCORE_DIGITS).alias("bound"))  # products may differ in a last digit
    return ranked(bounds, vectors).where(F.col("__n") <= F.col("pool")).select(
        "query_id", "chunk_id", "score", (F.col("__n") - 1).alias("dense_rank"))


def dense_topk(queries: DataFrame, chunks: DataFrame, **options) -> DataFrame:
    """Exact cosine top-k per query: query_id, chunk_id, score, rank (0-based)."""
    return dense_pool(queries, chunks, 1, **options).select(
        "query_id", "chunk_id", "score", F.col("dense_rank").alias("rank"), F.lit("dense").alias("retriever"))
