"""The chunk table: appended versions of files, in hash buckets of the file.

A table is two Parquet folders.  ``files`` has a row for every file and version: its marker (a fingerprint over its
chunks) and how many chunks it has; a file with none is gone.  ``chunks`` has the chunks under the same bucket and
version.  A write appends one version with the files that differ from what is stored, and nothing at all if none
does; what it reads are the file rows of the buckets it touches, never stored chunks.  Chunks are written before their
file rows, and count only where a file row of their version exists, so a write that was cut short is never seen.

One writer at a time; readers see whole versions.  ``compact_chunks`` rewrites buckets of many versions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from ..operators.scope import retrieval_filter
from ..schemas import CHUNKS
from ..session import settle

FILE_KEY = ["repository_id", "branch", "file_path"]
# a property of every stored table: changing it needs a new table
BUCKETS = 256
FILES = "repository_id string, branch string, file_path string, marker string, n_chunks bigint, bucket int, version string"
# versions of a bucket that are left alone by compaction
FEW_VERSIONS = 8


def pair_with_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks that have a vector; a chunk or vector without its other half is dropped."""
    return chunks.join(vectors.select("chunk_id", "embedding"), "chunk_id")


def merge_chunks(old: DataFrame, new: DataFrame, key: list[str] | None = None,
                 scanned: DataFrame | None = None) -> DataFrame:
    """Insert-or-replace of one DataFrame into another.

    By default a file's chunks are replaced together, so a file that shrank
    leaves nothing behind; ``key=["chunk_id"]`` replaces single chunks.
    ``scanned`` names all files that were looked at (the columns of
    ``FILE_KEY``): those that have no chunks any more lose their old ones.
    """
    keys = key or FILE_KEY
    replaced = new.select(*keys)
    if scanned is not None:
        if key:
            raise ValueError("files are scanned, so they are replaced as files")
        replaced = replaced.unionByName(scanned.select(*keys))
    return old.join(replaced.distinct(), keys, "left_anti").unionByName(new)


def file_bucket() -> Column:
    return F.pmod(F.xxhash64(*FILE_KEY), F.lit(BUCKETS)).cast("int")


def _same_file(a: str, b: str) -> Column:
    """Keys agree, also where a branch is null."""
    return F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in FILE_KEY))


def _folder(spark: SparkSession, path: str):
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), location


def _read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    system, location = _folder(spark, path)
    reader = spark.read.schema(schema)
    return reader.parquet(path) if system.exists(location) else spark.createDataFrame([], schema)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Every stored version of every file."""
    return _read(spark, f"{path}/files", FILES)


def current_files(files: DataFrame) -> DataFrame:
    """The last version of every file; files that are gone have no chunks."""
    last = F.max_by(F.struct("marker", "n_chunks", "bucket", "version"), "version")
    return files.groupBy(*FILE_KEY).agg(last.alias("last")).select(*FILE_KEY, "last.*")


def read_chunks(spark: SparkSession, path: str, schema: str | StructType = CHUNKS) -> DataFrame:
    """The current chunks as declared, also where none has been written yet.

    Only what is out of date is looked up, which is little between compactions; chunks themselves need no shuffle
    while Spark finds the list of it small.
    """
    declared = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
    stored = StructType(declared.fields).add("bucket", IntegerType()).add("version", StringType())
    files = read_files(spark, path)
    newest = Window.partitionBy(*FILE_KEY).orderBy(F.desc("version"))
    stale = files.withColumn("n", F.row_number().over(newest)).where("n > 1").select(*FILE_KEY, "version")
    versions = files.select("version").distinct()
    chunks = _read(spark, f"{path}/chunks", stored)
    whole = chunks.join(versions, "version", "left_semi").alias("c")
    current = whole.join(stale.alias("s"), _same_file("c", "s") & F.expr("c.version = s.version"), "left_anti")
    return current.select(*declared.names)


def chunk_markers(chunks: DataFrame) -> DataFrame:
    """One row per file with a fingerprint over all of its chunks; the hashes of one file are gathered."""
    parts = F.collect_list(F.struct("start_line", "end_line", "content_hash"))
    joined = F.array_join(F.transform(F.array_sort(parts), lambda p: F.concat_ws(
        ":", p["start_line"], p["end_line"], p["content_hash"])), ",")
    return chunks.groupBy(*FILE_KEY).agg(F.sha1(joined).alias("marker"), F.count(F.lit(1)).alias("n_chunks"))


def changed_files(spark: SparkSession, path: str, chunks: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """``FILES`` without a version: files that a write has to store, by an anti join against the stored markers.

    ``scanned`` names all files that were looked at; those without chunks are stored as gone if they are known.  The
    driver gets the numbers of the touched buckets.
    """
    files = chunk_markers(chunks)
    if scanned is not None:
        empty = scanned.select(*FILE_KEY).distinct().alias("a").join(files.alias("b"), _same_file("a", "b"), "left_anti")
        files = files.unionByName(empty.withColumns({"marker": F.lit(""), "n_chunks": F.lit(0).cast("bigint")}))
    files = settle(files.withColumn("bucket", file_bucket()), "files-seen")
    touched = [r.bucket for r in files.select("bucket").distinct().collect()]
    known = current_files(read_files(spark, path).where(F.col("bucket").isin(touched))).select(
        *FILE_KEY, F.struct("marker", "n_chunks").alias("known"))
    differs = F.when(F.col("b.known").isNull(), F.col("a.n_chunks") > 0).otherwise(F.col("a.marker") != F.col("b.known.marker"))
    return files.alias("a").join(known.alias("b"), _same_file("a", "b"), "left").where(differs).select("a.*")


def _next_version(files: DataFrame) -> str:
    """Versions sort as text; the tail keeps what a broken write left under a number apart."""
    last = files.agg(F.max("version")).first()[0]
    return f"{int(last.split('-')[0]) + 1 if last else 0:012d}-{uuid.uuid4().hex[:12]}"


def _append(path: str, chunks: DataFrame, files: DataFrame, version: str) -> None:
    """Each bucket is written by one task, so that small writes leave few files."""
    stamp = F.lit(version)
    for rows, name in ((chunks, "chunks"), (files, "files")):  # the file rows last: they make the chunks count
        rows.withColumn("version", stamp).repartition("bucket").write.mode("append").partitionBy(
            "bucket", "version").parquet(f"{path}/{name}")


def upsert_chunks(spark: SparkSession, path: str, new: DataFrame, scanned: DataFrame | None = None,
                  prepare: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Store the files of ``new`` that are new or changed; gives how many files were written.

    A file's chunks are replaced together.  ``scanned`` names all files that were looked at: those that have no chunks
    any more lose their old ones.  ``prepare`` is applied to the chunks that are written and to no others (an
    embedder, for one).  A repeated call writes nothing, and a write costs what it brings.
    """
    new = settle(new, "chunks-new")
    changed = settle(changed_files(spark, path, new, scanned), "files-changed")
    n = changed.count()
    if n:
        fresh = new.alias("a").join(changed.where("n_chunks > 0").alias("b"), _same_file("a", "b"), "left_semi")
        fresh = fresh if prepare is None else prepare(fresh)
        _append(path, fresh.withColumn("bucket", file_bucket()), changed, _next_version(read_files(spark, path)))
    elif not _exists(spark, f"{path}/chunks"):  # a first write without chunks leaves a readable table
        new.limit(0).write.parquet(f"{path}/chunks")
    return n


def _exists(spark: SparkSession, path: str) -> bool:
    system, location = _folder(spark, path)
    return system.exists(location)


def compact_chunks(spark: SparkSession, path: str, schema: str | StructType = CHUNKS,
                   few: int = FEW_VERSIONS) -> list[int]:
    """Rewrite buckets of more than ``few`` versions as one, without what is out of date or gone; gives these buckets.

    The new version is complete before the old ones are removed, so readers and a retry after a failure see the same
    chunks at any time.
    """
    files = read_files(spark, path)
    many = files.groupBy("bucket").agg(F.count_distinct("version").alias("n")).where(F.col("n") > few)
    buckets = sorted(r.bucket for r in many.collect())
    if not buckets:
        return []
    inside = F.col("bucket").isin(buckets)
    kept = settle(current_files(files.where(inside)).where("n_chunks > 0").drop("version"), "files-kept")
    chunks = read_chunks(spark, path, schema).withColumn("bucket", file_bucket()).where(inside)
    old = [(r.bucket, r.version) for r in files.where(inside).select("bucket", "version").distinct().collect()]
    _append(path, settle(chunks, "chunks-kept"), kept, _next_version(files))
    for name in ("files", "chunks"):  # without their file rows the old chunks do not count
        for bucket, version in old:
            system, location = _folder(spark, f"{path}/{name}/bucket={bucket}/version={version}")
            system.delete(location, True)
    return buckets


def without_repository(chunks: DataFrame, repository_id: str) -> DataFrame:
    return chunks.where(F.col("repository_id") != repository_id)


def delete_repository(spark: SparkSession, path: str, repository_id: str) -> None:
    """Mark every file of one repository as gone; compaction frees the space."""
    files = read_files(spark, path)
    mine = settle(current_files(files.where(F.col("repository_id") == repository_id)).where("n_chunks > 0").withColumns(
        {"marker": F.lit(""), "n_chunks": F.lit(0).cast("bigint")}).drop("version"), "files-gone")
    if not mine.isEmpty():
        mine.withColumn("version", F.lit(_next_version(files))).repartition("bucket").write.mode("append").partitionBy(
            "bucket", "version").parquet(f"{path}/files")


def chunk_scan(chunks: DataFrame, flt, limit: int | None = None) -> DataFrame:
    """Filtered chunks without their vectors, optionally the first ``limit`` by id."""
    admitted = chunks.where(retrieval_filter(
        flt, F.col("repository_id"), F.col("branch"), F.col("language"), F.col("chunk_type"), F.col("file_path")))
    payload = admitted.drop("embedding")
    return payload if limit is None else payload.orderBy("chunk_id").limit(limit)


def chunk_count(chunks: DataFrame, by_repository: bool = True) -> DataFrame:
    grouped = chunks.groupBy("repository_id") if by_repository else chunks.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("n_chunks"))
