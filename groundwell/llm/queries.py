"""The registered query of each operator, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.llm.alignment import align
from groundwell.llm.common import documents
from groundwell.llm.decontaminate import contamination
from groundwell.llm.exact_dedup import exact_duplicates
from groundwell.llm.language_id import identify
from groundwell.llm.mixing import mix_sources
from groundwell.llm.prefix_trie import prefix_trie
from groundwell.llm.quality import quality_scores
from groundwell.llm.secret_scan import secret_spans
from groundwell.llm.simhash import simhash_groups
from groundwell.llm.suffix_dedup import without_repeats
from groundwell.llm.token_binary import token_files
from groundwell.llm.token_counts import count_tokens
from groundwell.llm.word_table import encode_and_decode


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                    public_tokenizers.path("piece_bpe_32k.model"), written=False)
    return aligned.withColumnRenamed("groups", "groups_sha256")


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_and_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP6_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

# CRC-32 by its table, over the decimal digits; node: (smallest member, depth), found level by level
OP13_SQL = """
WITH RECURSIVE tabs AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i, coalesce(role, '') AS role,
         coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
h AS (
  SELECT conv_id, n, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: xor(a >> 8, tab[CAST(xor(a, b) & 255 AS INTEGER) + 1]))) % 9 AS h
  FROM c, tabs),
k AS (SELECT h.conv_id, h.base, h.h, least(h.h, coalesce(b.n, 0)) AS taken FROM h LEFT JOIN c b ON b.conv_id = h.base),
r AS (
  SELECT k.conv_id, t.i + 1 AS d, role, text FROM k JOIN t ON t.conv_id = k.base AND t.i < k.taken
  UNION ALL
  SELECT k.conv_id, k.taken + t.i + 1 - k.h, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND t.i >= k.h),
p AS (
  SELECT conv_id, 0::BIGINT AS d, (SELECT min(conv_id) FROM c) AS node, NULL::BIGINT AS parent, 0::BIGINT AS bytes FROM c
  UNION ALL
  SELECT r.conv_id, CAST(r.d AS BIGINT), min(r.conv_id) OVER (PARTITION BY p.node, r.role, r.text), p.node, strlen(r.text)
  FROM p JOIN r ON r.conv_id = p.conv_id AND r.d = p.d + 1),
whole AS (SELECT conv_id, max(d) AS d FROM p GROUP BY 1),
nodes AS (SELECT node AS conv_id, d AS depth, any_value(parent) AS parent_conv_id, count(*) AS n_convs, max(bytes) AS bytes
          FROM p GROUP BY 1, 2),
ends AS (SELECT node AS conv_id, d AS depth, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
         FROM p JOIN whole USING (conv_id, d) GROUP BY 1, 2),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
own AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf,
               (n_convs - 1) * bytes AS saved
        FROM nodes LEFT JOIN kids USING (conv_id, depth)),
sub AS (SELECT p.node AS conv_id, p.d AS depth, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
        FROM own JOIN p ON p.conv_id = own.conv_id AND p.d <= own.depth GROUP BY 1, 2)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM own JOIN sub USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)
"""

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_secret_scan": op2_secret_scan,
    "op3_simhash": op3_simhash,
    "op4_token_binary": op4_token_binary,
    "op5_decontaminate": op5_decontaminate,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality": op7_quality,
    "op8_mix_sources": op8_mix_sources,
    "op9_token_counts": op9_token_counts,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_alignment": op11_alignment,
    "op12_word_bpe": op12_word_bpe,
    "op13_prefix_trie": op13_prefix_trie,
}
SQL = {
    "op6_exact_dedup": OP6_SQL,
    "op13_prefix_trie": OP13_SQL,
}
