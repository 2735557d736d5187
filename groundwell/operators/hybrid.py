"""Hybrid retrieval: normalise the dense and the sparse leg, weigh, fuse, rank."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..session import settle
from .dense import dense_pool, dense_topk
from .scope import with_scope
from .sparse import SparseLeg, sparse_topk, token_table
from .topk import largest_top_k, top_k_of


def min_max_norm(score: Column, lo: Column, hi: Column) -> Column:
    """Scale to 0..1; a flat column becomes 1 if positive, else 0."""
    flat = F.when(hi > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(hi - lo < fv.FLAT_SCORE_EPSILON, flat).otherwise((score - lo) / (hi - lo))


def fuse_legs(dense: DataFrame, sparse: DataFrame, alpha: float = fv.HYBRID_ALPHA) -> DataFrame:
    """Full outer join of two normalised legs (column ``norm``); a missing side counts 0."""
    left = dense.select("query_id", "chunk_id", F.col("norm").alias("__d"), "dense_rank")
    right = sparse.select("query_id", "chunk_id", F.col("norm").alias("__s"))
    joined = left.join(right, ["query_id", "chunk_id"], "full_outer")
    fused = alpha * F.coalesce("__d", F.lit(0.0)) + (1.0 - alpha) * F.coalesce("__s", F.lit(0.0))
    return joined.select("query_id", "chunk_id", F.round(fused, 9).alias("fused"), "dense_rank")


def hybrid_topk(queries: DataFrame, chunks: DataFrame, alpha: float = fv.HYBRID_ALPHA,
                pool_factor: int = fv.DENSE_POOL_FACTOR, vectors: DataFrame | None = None,
                **options) -> DataFrame:
    """Weighted fusion top-k: query_id, chunk_id, score, rank, retriever.

    The dense leg is normalised over its pool, the sparse leg over the whole
    scope, zeros included.  Of the sparse leg only the first (1 + factor) * k
    chunks and the dense pool itself can reach the result, so nothing else is
    joined.  If one leg is empty the other is returned with its own scores.
    ``vectors`` holds the embeddings when ``chunks`` does not.
    """
    asked = with_scope(queries).withColumn("top_k", top_k_of(queries))
    # a bounded number of rows per query, read several times below
    pool = settle(dense_pool(queries, chunks if vectors is None else vectors, pool_factor).withColumnRenamed(
        "score", "dense_score"), "dense-pool")
    dense_range = pool.groupBy("query_id").agg(
        F.min("dense_score").alias("d_lo"), F.max("dense_score").alias("d_hi"))
    leg = SparseLeg(queries, chunks, 1 + pool_factor, pool.select("query_id", "chunk_id"), **options)
    ranked = settle(leg.ranked().select("query_id", "chunk_id", "score"), "sparse-ranked")
    sparse_range = leg.ranges(ranked)
    sparse = settle(ranked.unionByName(leg.pair_scores()).dropDuplicates(["query_id", "chunk_id"]), "sparse-pool")

    dense_leg = pool.join(dense_range, "query_id").withColumn(
        "norm", min_max_norm(F.col("dense_score"), F.col("d_lo"), F.col("d_hi")))
    sparse_leg = sparse.join(sparse_range, "query_id").withColumn(
        "norm", min_max_norm(F.col("score"), F.col("s_lo"), F.col("s_hi")))
    fused = fuse_legs(dense_leg, sparse_leg, alpha)
    raw = fused.join(pool.select("query_id", "chunk_id", "dense_score"), ["query_id", "chunk_id"], "left").join(
        sparse.select("query_id", "chunk_id", F.col("score").alias("sparse_score")), ["query_id", "chunk_id"], "left")

    # an empty leg shows as a query without a range on that side
    legs = asked.select("query_id", "top_k").join(
        dense_range.select("query_id", F.lit(True).alias("has_dense")), "query_id", "left").join(
        sparse_range.select("query_id", F.lit(True).alias("has_sparse")), "query_id", "left")
    labelled = raw.join(legs, "query_id").select(
        "query_id", "chunk_id", "dense_rank", "top_k",
        F.when(F.col("has_dense").isNull(), F.col("sparse_score"))
        .when(F.col("has_sparse").isNull(), F.col("dense_score"))
        .otherwise(F.col("fused")).alias("score"),
        F.when(F.col("has_dense").isNull(), F.lit("sparse"))
        .when(F.col("has_sparse").isNull(), F.lit("dense"))
        .otherwise(F.lit("hybrid")).alias("retriever"))
    order = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.asc_nulls_last("dense_rank"), "chunk_id")
    most = largest_top_k(queries)  # the literal bound lets tasks drop rows before the shuffle
    return (
        labelled.withColumn("__n", F.row_number().over(order))
        .where((F.col("__n") <= most) & (F.col("__n") <= F.col("top_k")))
        .select("query_id", "chunk_id",
                F.when(F.col("retriever") == "hybrid", F.round("score", 6)).otherwise(F.col("score")).alias("score"),
                (F.col("__n") - 1).alias("rank"), "retriever")
    )


def rerank(ranked: DataFrame, texts: DataFrame, scorer) -> DataFrame:
    """Re-order already cut rows by a scorer of (query, text).

    ``ranked`` has query_id, query, chunk_id, rank.  ``scorer`` is a Column
    function.  Should it fail on any row of a query (NULL), that query keeps its
    order and scores.
    """
    scored = ranked.join(texts.select("chunk_id", "text"), "chunk_id").withColumn(
        "__score", scorer(F.col("query"), F.col("text")).cast("double"))
    per_query = Window.partitionBy("query_id")
    usable = F.count_if(F.col("__score").isNull()).over(per_query) == 0
    keyed = scored.withColumn("reranked", usable)
    new = F.when(F.col("reranked"), F.col("__score"))
    order = per_query.orderBy(F.desc_nulls_last("__new"), "rank")
    out = keyed.withColumn("__new", new).withColumn("__n", F.row_number().over(order))
    return out.select(
        *[c for c in ranked.columns if c not in ("score", "rank")],
        F.coalesce("__new", F.col("score")).alias("score"), (F.col("__n") - 1).alias("rank"), "reranked")


def retrieve(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None,
             alpha: float = fv.HYBRID_ALPHA, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Run every query with its own strategy; one table of ranked rows comes back.

    Only legs that some query asks for are built, and they share one token table.  With a ``scorer``, the rows of
    queries whose ``rerank`` is true are re-ordered by it; without that column, those of all queries.
    """
    strategy = F.coalesce(F.col("strategy"), F.lit("hybrid"))
    kind = F.when(strategy.isin("dense", "sparse"), strategy).otherwise(F.lit("hybrid"))
    asked = {r[0] for r in queries.select(kind).distinct().collect()}  # three at the most
    vectors = chunks if vectors is None else vectors
    tokens = token_table(chunks) if asked - {"dense"} else chunks
    legs = {
        "dense": lambda mine: dense_topk(mine, vectors),
        "sparse": lambda mine: sparse_topk(mine, tokens),
        "hybrid": lambda mine: hybrid_topk(mine, tokens, alpha, vectors=vectors),
    }
    columns = ["query_id", "chunk_id", "score", "rank", "retriever"]
    found = [legs[name](queries.where(kind == name)).select(columns) for name in sorted(asked)]
    if not found:  # no queries
        return queries.sparkSession.createDataFrame(
            [], "query_id string, chunk_id string, score double, rank int, retriever string")
    ranked = reduce(DataFrame.unionByName, found)
    if scorer is None:
        return ranked
    flag = F.coalesce(F.col("rerank"), F.lit(False)) if "rerank" in queries.columns else F.lit(True)
    ranked = settle(ranked.join(queries.select("query_id", "query", flag.alias("__again")), "query_id"), "ranked")
    again = rerank(ranked.where("__again"), chunks, scorer)
    return ranked.where("not __again").select(columns).unionByName(again.select(columns))
