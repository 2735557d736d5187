"""Registered queries: dense, sparse and hybrid retrieval, scopes, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwell.operators import dense as D
from groundwell.operators import embed as E
from groundwell.operators import hybrid as H
from groundwell.operators import scope as S
from groundwell.operators import sparse as B
from groundwell.session import settle

from . import inputs as I

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


# --- vectors ----------------------------------------------------------------
def vectors(spark, sf):
    return I.table(spark, sf, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("chunk_id"), "embedding", "label", "vec_id")


def vector_queries(spark, sf):
    """Every vector asks for its neighbours."""
    return vectors(spark, sf).select(
        F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"), "label")


VECTORS = ("vecs AS (SELECT 'v' || vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS e, label, vec_id "
           "FROM embeddings)")
PAIRS = ("pairs AS MATERIALIZED (SELECT q.chunk_id AS query_id, c.chunk_id, "
         "round(list_cosine_similarity(q.e, c.e), 9) AS score FROM vecs q, vecs c)")


@register("dense_topk", f"""WITH {VECTORS}, {PAIRS}
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({I.sql_top('pairs')})""")
def dense_topk(spark, sf):
    return D.dense_topk(vector_queries(spark, sf), vectors(spark, sf)).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("query_x_chunk", f"""WITH {VECTORS}, {PAIRS}
SELECT query_id, chunk_id, round(score, 6) AS score, rank AS dense_rank FROM ({I.sql_top('pairs', '24')})""")
def query_x_chunk(spark, sf):
    """The candidate pool: three times top_k per query."""
    return D.dense_pool(vector_queries(spark, sf), vectors(spark, sf), 3).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("dense_rank").cast("bigint").alias("dense_rank"))


@register("min_max_norm", f"""WITH {VECTORS}, {PAIRS}, pool AS ({I.sql_top('pairs', '24')}),
r AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM pool GROUP BY 1)
SELECT query_id, chunk_id, round(CASE WHEN hi - lo < 1e-9 THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END
       ELSE (score - lo) / (hi - lo) END, 6) AS norm FROM pool JOIN r USING (query_id)""")
def min_max_norm(spark, sf):
    pool = D.dense_pool(vector_queries(spark, sf), vectors(spark, sf), 3)
    lim = pool.groupBy("query_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return pool.join(lim, "query_id").select(
        "query_id", "chunk_id", F.round(H.min_max_norm(F.col("score"), F.col("lo"), F.col("hi")), 6).alias("norm"))


# --- sparse -----------------------------------------------------------------
@register("sparse_topk", f"""WITH {I.DOC_WINDOWS}, {I.QUESTIONS}, {I.sql_bm25('questions', 'chunks')}
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({I.sql_top('scored')})""")
def sparse_topk(spark, sf):
    return B.sparse_topk(I.questions(spark, sf), I.doc_windows(spark, sf)).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("bm25_stats", f"""WITH {I.DOC_WINDOWS}, {I.QUESTIONS}, {I.sql_bm25('questions', 'chunks')}
SELECT term, df, n AS n_chunks, round(avgdl, 6) AS mean_length, round(idf, 6) AS idf FROM idfs""")
def bm25_stats(spark, sf):
    return B.bm25_stats(I.doc_windows(spark, sf)).select(
        "term", "df", "n_chunks", F.round("mean_length", 6).alias("mean_length"), F.round("idf", 6).alias("idf"))


@register("bm25_score", f"""WITH {I.DOC_WINDOWS}, {I.QUESTIONS}, {I.sql_bm25('questions', 'chunks')}
SELECT query_id, chunk_id, round(score, 6) AS score FROM matches""")
def bm25_score(spark, sf):
    return B.bm25_score(I.questions(spark, sf), I.doc_windows(spark, sf)).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"))


@register("query_terms_x_postings", f"""WITH {I.DOC_WINDOWS}, {I.QUESTIONS}, {I.sql_bm25('questions', 'chunks')}
SELECT qt.query_id, count(*) AS postings, count(DISTINCT term) AS terms, sum(w * tf) AS weighted
FROM qt JOIN tf USING (scope_id, term) GROUP BY 1""")
def query_terms_x_postings(spark, sf):
    queries, chunks = I.questions(spark, sf), I.doc_windows(spark, sf)
    joined = B.query_terms(queries).join(B.postings(queries, B.token_rows(queries, chunks)), ["scope_id", "term"])
    return joined.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("postings"), F.countDistinct("term").alias("terms"),
        F.sum(F.col("weight") * F.col("tf")).alias("weighted"))


# --- hybrid: questions and whole documents, embedded by the same rule ----------
def hybrid_queries(spark, sf):
    return E.embed_documents(I.questions(spark, sf), "hash-32", "query", "query_vec")


def hybrid_chunks(spark, sf):
    docs = I.documents(spark, sf).select(
        F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("chunk_id"), "text")
    return settle(E.embed_documents(docs, "hash-32"), "embedded")  # read by both legs


HYBRID_IN = f"""{I.QUESTIONS}, chunks AS (SELECT 'v' || doc_id AS chunk_id, text FROM documents),
{I.sql_hash_vectors('questions', 'query_id', 'query', 'qv')}, {I.sql_hash_vectors('chunks', 'chunk_id', 'text', 'cv')},
pairs AS MATERIALIZED (SELECT query_id, chunk_id, {I.sql_cosine('qv.e', 'cv.e')} AS score FROM qv, cv),
{I.sql_bm25('questions', 'chunks')}"""
FUSED = """
dpool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS dr FROM pairs
          QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 24),
dn AS (SELECT query_id, chunk_id, dr, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9
          THEN CASE WHEN max(score) OVER w > 0 THEN 1.0 ELSE 0.0 END
          ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS d
       FROM dpool WINDOW w AS (PARTITION BY query_id)),
sn AS (SELECT query_id, chunk_id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9
          THEN CASE WHEN max(score) OVER w > 0 THEN 1.0 ELSE 0.0 END
          ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s
       FROM scored WINDOW w AS (PARTITION BY query_id)),
fused AS (SELECT coalesce(dn.query_id, sn.query_id) AS query_id, coalesce(dn.chunk_id, sn.chunk_id) AS chunk_id, dr,
          round(0.6 * coalesce(d, 0) + 0.4 * coalesce(s, 0), 9) AS score
          FROM dn FULL OUTER JOIN sn ON dn.query_id = sn.query_id AND dn.chunk_id = sn.chunk_id)"""


@register("hybrid_topk", f"""WITH {HYBRID_IN}, {FUSED}
SELECT query_id, chunk_id, round(score, 6) AS score, rank
FROM ({I.sql_top('fused', '8', 'score DESC, dr NULLS LAST, chunk_id')})""")
def hybrid_topk(spark, sf):
    return H.hybrid_topk(hybrid_queries(spark, sf), hybrid_chunks(spark, sf)).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("finalize_rank", f"""WITH {HYBRID_IN}, {FUSED},
h AS (SELECT query_id || '/hybrid' AS query_id, chunk_id, rank FROM ({I.sql_top('fused', '8', 'score DESC, dr NULLS LAST, chunk_id')})),
s AS (SELECT query_id || '/sparse' AS query_id, chunk_id, rank FROM ({I.sql_top('scored')})),
d AS (SELECT query_id || '/dense' AS query_id, chunk_id, rank FROM ({I.sql_top('pairs')}))
SELECT * FROM h UNION ALL SELECT * FROM s UNION ALL SELECT * FROM d""")
def finalize_rank(spark, sf):
    """One table of queries, each with its own strategy, ranked together."""
    asked = hybrid_queries(spark, sf).withColumn(
        "strategy", F.explode(F.array(F.lit("dense"), F.lit("sparse"), F.lit("hybrid")))).withColumn(
        "query_id", F.concat_ws("/", "query_id", "strategy"))
    return H.retrieve(asked, hybrid_chunks(spark, sf)).select(
        "query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


# the legs are cut out of one pool, so that every fused row is a row of the pool
@register("fuse_legs", f"""WITH {VECTORS}, {PAIRS}, pool AS ({I.sql_top('pairs', '24')})
SELECT query_id, chunk_id, round(round(0.6 * CASE WHEN rank < 16 THEN score ELSE 0 END
       + 0.4 * CASE WHEN rank >= 8 THEN 1 - score ELSE 0 END, 9), 6) AS fused FROM pool""")
def fuse_legs(spark, sf):
    pool = D.dense_pool(vector_queries(spark, sf), vectors(spark, sf), 3)
    left = pool.where(F.col("dense_rank") < 16).withColumn("norm", F.col("score"))
    right = pool.where(F.col("dense_rank") >= 8).select("query_id", "chunk_id", (1 - F.col("score")).alias("norm"))
    return H.fuse_legs(left, right).select("query_id", "chunk_id", F.round("fused", 6).alias("fused"))


# --- filters ----------------------------------------------------------------
def filtered_questions(spark, sf):
    """Questions with five kinds of filter, repository scope among them."""
    n = F.col("item_id") % 5
    return I.questions(spark, sf).withColumn("filter", F.struct(
        F.when(n.isin(0, 4), F.array(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")),
                                     F.lit("src3"))).alias("repository_ids"),
        F.when(n.isin(0, 1), F.lit("main")).alias("branch"),
        F.when(n == 1, F.array(F.lit(".MD"), F.lit("yml"))).alias("file_types"),
        F.when(n == 4, F.lit("en/1")).alias("path_prefix"),
        F.when(n == 2, F.array(F.lit("code"), F.lit("doc"))).alias("chunk_types"),
    ).cast(S.FILTER))


FILTERED = f"""{I.DOC_WINDOWS}, fq AS (SELECT 'q' || item_id AS query_id, 'q' || item_id AS scope_id, item_id, text AS query FROM benchmark),
admitted AS MATERIALIZED (SELECT fq.query_id, fq.scope_id, c.chunk_id, c.text FROM fq, chunks c WHERE CASE item_id % 5
   WHEN 0 THEN c.repository_id IN ('src' || (item_id % 20), 'src3') AND c.branch = 'main'
   WHEN 1 THEN c.language IN ('markdown', 'yaml') AND c.branch = 'main'
   WHEN 2 THEN c.chunk_type IN ('code', 'doc')
   WHEN 3 THEN true
   ELSE c.repository_id IN ('src' || (item_id % 20), 'src3') AND starts_with(c.file_path, 'en/1') END)"""


@register("retrieval_filter", f"WITH {FILTERED} SELECT query_id, chunk_id FROM admitted")
def retrieval_filter(spark, sf):
    queries = filtered_questions(spark, sf)
    admitted = S.scope_chunks(queries, I.doc_windows(spark, sf), ["chunk_id"])
    return S.with_scope(queries).select("query_id", "scope_id").join(admitted, "scope_id").select("query_id", "chunk_id")


@register("filtered_sparse_topk", f"""WITH {FILTERED}, {I.sql_bm25('fq', 'admitted', scoped=True)}
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ({I.sql_top('scored')})""")
def filtered_sparse_topk(spark, sf):
    return B.sparse_topk(filtered_questions(spark, sf), I.doc_windows(spark, sf)).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("scope_filter", """SELECT 'q' || item_id AS query_id, 'src' || (item_id % 7) AS repos, 'dev' AS branch,
  CASE WHEN item_id % 2 = 0 THEN 'py,go' END AS file_types, CASE WHEN item_id % 3 = 0 THEN 'src/' || (item_id % 4) END AS path_prefix,
  CASE WHEN item_id % 4 < 2 THEN 'code' END AS chunk_types FROM benchmark""")
def scope_filter(spark, sf):
    i = F.col("item_id")
    planned = F.struct(
        F.array(F.lit("other")).alias("repository_ids"), F.lit("planned").alias("branch"),
        F.when(i % 2 == 0, F.array(F.lit(" py"), F.lit(""), F.lit("go"))).alias("file_types"),
        F.when(i % 3 == 0, F.concat(F.lit(" src/"), (i % 4).cast("string"), F.lit(" "))).otherwise(F.lit("  ")).alias("path_prefix"),
        F.when(i % 4 < 2, F.array(F.lit("code"), F.lit("poem"))).otherwise(F.array(F.lit("song"))).alias("chunk_types"))
    out = I.questions(spark, sf).withColumn("f", S.scope_filter(
        planned, F.array(F.concat(F.lit("src"), (i % 7).cast("string"))), F.lit("dev")))
    return out.select("query_id", F.array_join("f.repository_ids", ",").alias("repos"), F.col("f.branch").alias("branch"),
                      F.array_join("f.file_types", ",").alias("file_types"), F.col("f.path_prefix").alias("path_prefix"),
                      F.array_join("f.chunk_types", ",").alias("chunk_types"))


@register("rerank", f"""WITH {I.DOC_WINDOWS}, {I.QUESTIONS}, {I.sql_bm25('questions', 'chunks')},
top AS ({I.sql_top('scored')}), s AS (SELECT top.query_id, top.chunk_id, top.rank AS r0,
   {I.sql_overlap(I.sql_terms('q.query'), I.sql_terms('c.text'))} AS sc
   FROM top JOIN questions q USING (query_id) JOIN chunks c USING (chunk_id))
SELECT query_id, chunk_id, round(sc, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, r0) - 1 AS rank FROM s""")
def rerank(spark, sf):
    from groundwell.functions import text as T

    queries, chunks = I.questions(spark, sf), I.doc_windows(spark, sf)
    top = B.sparse_topk(queries, chunks).join(queries.select("query_id", "query"), "query_id")
    out = H.rerank(top, chunks, lambda q, t: T.overlap_ratio(T.content_terms(q), T.content_terms(t)))
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))
