"""Keeping a corpus up to date: fingerprints, changes, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P

FILE_KEY = ["repository_id", "file_path"]


def file_markers(chunks: DataFrame) -> DataFrame:
    """One fingerprint per file over all of its chunks: repository_id, file_path, marker, n_chunks.

    The hashes gathered per file are bounded by the file size rule.
    """
    parts = F.collect_list(F.struct("start_line", "end_line", "content_hash"))
    joined = F.array_join(F.transform(F.array_sort(parts), lambda p: p["content_hash"]), ",")
    return chunks.groupBy(*FILE_KEY).agg(F.sha1(joined).alias("marker"), F.count(F.lit(1)).alias("n_chunks"))


def incremental_diff(current: DataFrame, stored: DataFrame) -> DataFrame:
    """State of every current file against the stored markers: unchanged, changed or new."""
    known = stored.select(*FILE_KEY, F.col("marker").alias("__stored"))
    state = (
        F.when(F.col("__stored").isNull(), F.lit("new"))
        .when(F.col("__stored") == F.col("marker"), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )
    return current.join(known, FILE_KEY, "left").withColumn("state", state).drop("__stored")


def files_to_index(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks of files that are new or changed; the others never reach the embedder."""
    same = incremental_diff(file_markers(chunks), stored).where(F.col("state") == "unchanged")
    return chunks.join(same.select(*FILE_KEY), FILE_KEY, "left_anti")


def index_stats(files: DataFrame, states: DataFrame) -> DataFrame:
    """Counters per repository: files, chunks, skipped, bytes and a language histogram.

    ``files`` has text (NULL for binary files); ``states`` comes from
    ``incremental_diff``.  A file without chunks is only skipped; an unchanged
    one counts as a file and as skipped, and its chunks do not count.
    """
    sized = files.select(
        *FILE_KEY, F.octet_length("text").alias("bytes"),
        F.coalesce(P.detect_language(F.col("file_path")), F.lit("other")).alias("language"))
    joined = sized.join(states.select(*FILE_KEY, "state", "n_chunks"), FILE_KEY, "left")
    indexed = F.col("state").isNotNull()
    unchanged = F.coalesce(F.col("state") == "unchanged", F.lit(False))
    # per language first, so that the map is built from a few rows
    by_language = joined.groupBy("repository_id", "language").agg(
        F.count_if(indexed).alias("files"),
        F.sum(F.when(indexed & ~unchanged, F.col("n_chunks")).otherwise(F.lit(0))).alias("chunks"),
        F.count_if(~indexed | unchanged).alias("skipped"),
        F.sum(F.when(indexed, F.col("bytes")).otherwise(F.lit(0))).alias("bytes"))
    entry = F.when(F.col("files") > 0, F.struct("language", "files"))
    return by_language.groupBy("repository_id").agg(
        F.sum("files").alias("num_files"), F.sum("chunks").alias("num_chunks"),
        F.sum("skipped").alias("num_skipped"), F.sum("bytes").alias("bytes_indexed"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("languages"))


def language_share(counts: DataFrame, legend: int = 6) -> DataFrame:
    """Share of each language of a repository, most files first; the legend shows six.

    ``counts``: repository_id, language, files.  Rows per repository are
    bounded by the number of languages.
    """
    own = Window.partitionBy("repository_id")
    ranked = counts.where(F.col("files") > 0).withColumn("total", F.sum("files").over(own)).withColumn(
        "position", F.row_number().over(own.orderBy(F.desc("files"), "language")))
    n = F.count(F.lit(1)).over(own)
    return ranked.select(
        "repository_id", "language", "files", "position",
        (F.col("files") / F.col("total") * 100).alias("pct"),
        (F.col("position") <= legend).alias("in_legend"),
        F.greatest(F.lit(0), n - legend).alias("hidden"))
