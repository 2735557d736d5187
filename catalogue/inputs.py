"""Inputs shared by the registered queries, in Spark and as SQL.

The given tables are read whole.  Where an operator needs something they lack
(paths, headings, markers, diffs) it is derived from them, in the same way on
both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


# --- files: one per document ------------------------------------------------
_EXT = {"en": "md", "fr": "txt", "de": "yaml", "es": "go"}


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as source files of twenty repositories."""
    ext = F.coalesce(F.create_map(*[F.lit(x) for kv in _EXT.items() for x in kv])[F.col("lang")], F.lit("rst"))
    return documents(spark, sf).select(
        F.col("source").alias("repository_id"),
        F.concat(F.lit("repo-"), F.col("source")).alias("repo_name"),
        F.lit("main").alias("branch"),
        F.lit(None).cast("string").alias("commit_hash"),
        F.concat_ws("", F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("file_path"),
        F.col("n_chars").alias("length"),
        "text", "doc_id", "lang",
    )


FILES = f"""files AS (
  SELECT source AS repository_id, 'repo-' || source AS repo_name, 'main' AS branch,
         lang || '/' || CAST(doc_id AS VARCHAR) || '.' ||
           CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _EXT.items())} ELSE 'rst' END AS file_path,
         n_chars AS length, text, doc_id, lang
  FROM documents)"""

LANGUAGE = "CASE lang WHEN 'en' THEN 'markdown' WHEN 'fr' THEN 'text' WHEN 'de' THEN 'yaml' WHEN 'es' THEN 'go' ELSE 'rst' END"
CHUNK_TYPE = "CASE lang WHEN 'en' THEN 'markdown' WHEN 'fr' THEN 'doc' WHEN 'de' THEN 'config' WHEN 'es' THEN 'code' ELSE 'doc' END"


# --- text rules in SQL ------------------------------------------------------
def sql_lines(x: str) -> str:
    """Lines of a text that breaks only at newlines."""
    return (f"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split("
            f"CASE WHEN right({x}, 1) = chr(10) THEN left({x}, length({x}) - 1) ELSE {x} END, chr(10)) END)")


def sql_words(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[A-Za-z0-9_]+'), lambda w: lower(w))"


def sql_code_tokens(x: str) -> str:
    camel = ("string_split(regexp_replace(regexp_replace(p, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), "
             "'([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), ' ')")
    return f"""flatten(list_transform(regexp_extract_all({x}, '[A-Za-z0-9_]+'), lambda w: list_concat([lower(w)],
      flatten(list_transform(list_filter(string_split(w, '_'), lambda p: p <> ''), lambda p: list_concat(
        CASE WHEN lower(p) <> lower(w) THEN [lower(p)] ELSE []::VARCHAR[] END,
        list_filter(list_transform({camel}, lambda s: lower(s)),
                    lambda s: s <> '' AND s <> lower(w) AND s <> lower(p))))))))"""


def sql_terms(x: str, min_len: int = 3) -> str:
    from groundwell.fixed_values import STOPWORDS

    stop = ", ".join(f"'{w}'" for w in sorted(set(STOPWORDS)))
    return (f"list_distinct(list_filter({sql_words(x)}, "
            f"lambda t: length(t) >= {min_len} AND NOT list_contains([{stop}], t)))")


def sql_blank(x: str) -> str:
    return f"(NOT regexp_matches({x}, '[^\\s]'))"


def sql_strip_newlines(x: str) -> str:
    return f"trim({x}, chr(10))"


def sql_overlap(claim: str, support: str) -> str:
    return (f"(CASE WHEN len({claim}) > 0 THEN CAST(len(list_intersect({claim}, {support})) AS DOUBLE) "
            f"/ len({claim}) ELSE 0.0 END)")


def sql_basename(x: str) -> str:
    return f"regexp_extract({x}, '[^/]*$')"


# --- line windows of the documents: the main retrieval corpus ---------------
def doc_windows(spark: SparkSession, sf: str) -> DataFrame:
    from groundwell.functions import paths as P
    from groundwell.functions import text as T
    from groundwell.operators.chunking import window_chunks

    windows = window_chunks(files(spark, sf).drop("length"))
    out = windows.withColumn("text", F.col("chunk_text")).drop("chunk_text").withColumn(
        "language", P.detect_language(F.col("file_path"))).withColumn(
        "chunk_type", P.classify_chunk(F.col("language"))).withColumn(
        "content_hash", T.content_hash(F.col("text")))
    return out.withColumn("symbol", F.lit(None).cast("string")).withColumn(
        "chunk_id", F.concat_ws(":", F.col("file_path"), F.col("start_line"), F.col("end_line")))


def sql_window_starts(n: str) -> str:
    return (f"CASE WHEN {n} <= 0 THEN []::BIGINT[] WHEN {n} <= 60 THEN [0::BIGINT] "
            f"ELSE range(0, CAST(ceil(({n} - 60) / 48.0) AS BIGINT) * 48 + 1, 48) END")


def sql_windows(source: str, name: str = "windows", lines: str = "lines") -> str:
    """Window rows over a CTE that has a lines column."""
    return f"""{name} AS (
  SELECT *, CAST(s AS BIGINT) + 1 AS start_line, least(CAST(s AS BIGINT) + 60, len({lines})) AS end_line,
         array_to_string(list_slice({lines}, CAST(s AS BIGINT) + 1, CAST(s AS BIGINT) + 60), chr(10)) AS chunk_text
  FROM (SELECT *, unnest({sql_window_starts(f'len({lines})')}) AS s FROM {source})
  WHERE regexp_matches(array_to_string(list_slice({lines}, CAST(s AS BIGINT) + 1, CAST(s AS BIGINT) + 60), chr(10)), '[^\\s]'))"""


DOC_WINDOWS = f"""{FILES},
filelines AS (SELECT *, {sql_lines('text')} AS lines, {LANGUAGE} AS language, {CHUNK_TYPE} AS chunk_type FROM files),
{sql_windows('filelines')},
chunks AS (
  SELECT repository_id, repo_name, branch, file_path, language, chunk_type, start_line, end_line,
         CAST(NULL AS VARCHAR) AS symbol, chunk_text AS text, sha1(chunk_text) AS content_hash,
         file_path || ':' || start_line || ':' || end_line AS chunk_id
  FROM windows)"""


# --- questions --------------------------------------------------------------
def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text as a question."""
    return table(spark, sf, "benchmark").select(
        F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"),
        F.col("item_id"), F.col("text").alias("query"))


QUESTIONS = "questions AS (SELECT 'q' || item_id AS query_id, item_id, text AS query FROM benchmark)"


def sql_bm25(queries: str, chunks: str, scoped: bool = False) -> str:
    """CTEs ``matches`` and ``scored`` (zeros included) for (scope,) queries and chunks.

    ``queries`` and ``chunks`` are CTE names; with scopes both have scope_id and
    ``chunks`` may repeat a chunk per scope.
    """
    q = f"SELECT query_id, {'scope_id' if scoped else 'CAST(0 AS VARCHAR)'} AS scope_id, query FROM {queries}"
    c = f"SELECT chunk_id, {'scope_id' if scoped else 'CAST(0 AS VARCHAR)'} AS scope_id, text FROM {chunks}"
    return f"""
bq AS ({q}), bc AS MATERIALIZED (SELECT chunk_id, scope_id, {sql_code_tokens('text')} AS toks FROM ({c})),
corpus AS (SELECT scope_id, count(*) AS n, sum(len(toks)) / count(*) AS avgdl FROM bc GROUP BY 1),
tf AS MATERIALIZED (SELECT scope_id, chunk_id, len(toks) AS dl, term, count(*) AS tf
       FROM (SELECT scope_id, chunk_id, toks, unnest(toks) AS term FROM bc) GROUP BY ALL),
dfs AS MATERIALIZED (SELECT scope_id, term, count(*) AS df FROM tf GROUP BY ALL),
rawidf AS MATERIALIZED (SELECT d.*, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS ri FROM dfs d JOIN corpus USING (scope_id)),
floors AS (SELECT scope_id, 0.25 * avg(ri) AS fl FROM rawidf GROUP BY 1),
idfs AS MATERIALIZED (SELECT scope_id, term, df, n, avgdl, CASE WHEN ri < 0 THEN fl ELSE ri END AS idf
         FROM rawidf JOIN floors USING (scope_id)),
qt AS (SELECT query_id, scope_id, term, count(*) AS w FROM
        (SELECT query_id, scope_id, unnest({sql_code_tokens('query')}) AS term FROM bq) GROUP BY ALL),
matches AS MATERIALIZED (SELECT query_id, scope_id, chunk_id,
        round(sum(w * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 9) AS score
      FROM qt JOIN idfs USING (scope_id, term) JOIN tf USING (scope_id, term) GROUP BY ALL),
scored AS MATERIALIZED (SELECT b.query_id, c.chunk_id, coalesce(m.score, 0.0) AS score
      FROM bq b JOIN bc c USING (scope_id) LEFT JOIN matches m
        ON m.query_id = b.query_id AND m.chunk_id = c.chunk_id AND m.scope_id = b.scope_id)"""


def sql_top(source: str, k: str = "8", order: str = "score DESC, chunk_id") -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) - 1 AS rank "
            f"FROM {source} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {order}) <= {k}")


def sql_hash_vectors(source: str, key: str, text: str, name: str) -> str:
    """CTEs ending in ``name`` (key, e): texts as unit vectors by feature hashing, as the embedder ``hash-32`` does."""
    return f"""{name}_w AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {source}),
{name}_s AS (SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS slot, count(*) AS c FROM {name}_w GROUP BY ALL),
{name}_v AS (SELECT {key}, i, CAST(coalesce(sum(CASE WHEN slot = 2 * i THEN c WHEN slot = 2 * i + 1 THEN -c END), 0) AS DOUBLE) AS v
   FROM (SELECT {key} FROM {source}) CROSS JOIN range(0, 32) r(i) LEFT JOIN {name}_s USING ({key}) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {key}, list_transform(list(v ORDER BY i), lambda x: CAST(CAST(CASE WHEN sqrt(sum(v * v)) > 0 THEN x / sqrt(sum(v * v)) ELSE 0 END AS FLOAT) AS DOUBLE)) AS e
   FROM {name}_v GROUP BY 1)"""


def sql_cosine(a: str, b: str) -> str:
    """A zero vector is like nothing."""
    return f"round(coalesce(nullif(list_cosine_similarity({a}, {b}), CAST('NaN' AS DOUBLE)), 0.0), 9)"
