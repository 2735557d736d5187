"""Reading a directory tree of source files as a table."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import paths as P

FRAME_BYTES = 32 << 20  # of file contents handed on at once
# two non-characters that stand in for a genuine U+FFFD while bad bytes are dropped
_STAND_IN = "\ufdd0\ufdd1"


def scan_repo_files(spark: SparkSession, root: str, prefixes: list[str] | None = None) -> DataFrame:
    """Files below ``root``: file_path (relative), length, modified, content.

    Skipped directories and unwanted prefixes go before any content is read,
    and ``content`` is read only if a later step asks for it.
    """
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    files = found.select(
        below_root(spark, base, F.col("path")).alias("file_path"), "length", F.col("modificationTime").alias("modified"), "content")
    every = files.unionByName(_underscored_files(spark, base))
    return every.where(
        ~P.in_skipped_dir(F.col("file_path"), fv.EXCLUDE_DIRS)
        & P.scope_paths(F.col("file_path"), prefixes or []))


def below_root(spark: SparkSession, root: str, path: Column) -> Column:
    """The part of a path below ``root``, whose full name the file system gives."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = system.makeQualified(location).toString().rstrip("/")
    return F.substring(path, len(full) + 2, 1 << 30)


_FILE = "file_path string, length bigint, modified timestamp, content binary"


def _underscored_files(spark: SparkSession, base: str) -> DataFrame:
    """Files Spark's own listing passes over: ``__init__.py`` and other ``_`` or ``.`` names.

    The folders right below the root are walked in parallel tasks.
    """
    filesystem, top = _open_fs(base)
    from pyarrow.fs import FileSelector, FileType

    entries = filesystem.get_file_info(FileSelector(top, recursive=False))
    seeds = [(base, e.base_name) for e in entries if e.type == FileType.Directory] + [(base, "")]
    frame = spark.createDataFrame(seeds, "base string, folder string").repartition(
        min(len(seeds), 4 * spark.sparkContext.defaultParallelism), "folder")
    return frame.mapInPandas(_walk_underscored, _FILE)


def _open_fs(base: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(base if "://" in base or base.startswith("/") else os.path.abspath(base))


def _walk_underscored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow.fs import FileSelector, FileType

    for batch in batches:
        for base, folder in zip(batch["base"], batch["folder"]):
            filesystem, top = _open_fs(base)
            start = f"{top}/{folder}" if folder else top
            held, size = [], 0
            for info in filesystem.get_file_info(FileSelector(start, recursive=bool(folder))):
                relative = info.path[len(top) + 1 :]
                parts = relative.split("/")
                hidden = any(p[:1] in ("_", ".") for p in parts) and not any(
                    p in fv.EXCLUDE_DIRS or p.startswith(".git") for p in parts[:-1])
                if info.type != FileType.File or not hidden:
                    continue
                with filesystem.open_input_stream(info.path) as stream:
                    content = stream.read()
                held.append((relative, info.size, info.mtime, content))
                size += len(content)
                if len(held) >= 500 or size >= FRAME_BYTES:
                    yield _file_frame(held)
                    held, size = [], 0
            if held:
                yield _file_frame(held)


def _file_frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["file_path", "length", "modified", "content"])


def write_files(files: DataFrame, root: str) -> None:
    """Writes ``text`` of every row to ``root``/``file_path`` through the root's own file system."""

    def write(rows) -> None:
        filesystem, top = _open_fs(root)
        for row in rows:
            path = f"{top}/{row.file_path}"
            filesystem.create_dir(path.rpartition("/")[0], recursive=True)
            with filesystem.open_output_stream(path) as stream:
                stream.write((row.text or "").encode("utf-8"))

    files.select("file_path", "text").foreachPartition(write)


def decode_lenient(content: Column) -> Column:
    """UTF-8 text with invalid bytes dropped; a genuine U+FFFD survives."""
    raw = content.cast("string")
    kept = F.replace(raw, F.lit("\ufffd"), F.lit(_STAND_IN))
    dropped = F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(dropped, F.lit(_STAND_IN), F.lit("\ufffd")))


def looks_binary(content: Column) -> Column:
    return F.position(F.lit(b"\x00"), F.substring(content, 1, fv.BINARY_SNIFF_BYTES)) > 0


def read_text_lenient(files: DataFrame) -> DataFrame:
    """Replace ``content`` by ``text``; binary files get NULL."""
    return files.withColumn(
        "text", F.when(~looks_binary(F.col("content")), decode_lenient(F.col("content")))).drop("content")


def repository_files(spark: SparkSession, root: str, repository_id: str, repo_name: str, branch: str = "main",
                     commit_hash: str | None = None, prefixes: list[str] | None = None,
                     max_bytes: int | None = None) -> DataFrame:
    """All indexable files of one working tree, ready for ``chunk_files``; ``max_bytes`` leaves larger ones out."""
    files = scan_repo_files(spark, root, prefixes).where(
        P.is_indexable(F.col("file_path"), F.col("length"), max_bytes))
    return read_text_lenient(files).select(
        F.lit(repository_id).alias("repository_id"), F.lit(repo_name).alias("repo_name"),
        F.lit(branch).alias("branch"), F.lit(commit_hash).cast("string").alias("commit_hash"),
        "file_path", "length", "text")
