"""From source files to a searchable chunk table: chunk, skip what is unchanged, embed the rest, store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.chunking import chunk_files
from ..operators.embed import embed_documents
from ..schemas import CHUNKS
from ..sources.chunk_store import compact_chunks, read_chunks, upsert_chunks

INDEXED = f"{CHUNKS}, embedding array<float>"


def index_repository(spark: SparkSession, path: str, files: DataFrame, embedder: str | None = "hash-32",
                     on_error: str = "raise") -> int:
    """Bring the chunk table at ``path`` up to date with ``files``; gives how many files were written.

    ``files``: repository_id, repo_name, branch, commit_hash, file_path, text, as ``sources.files`` reads them.  Only
    chunks of files that are new or changed reach the embedder; without one no vectors are stored.  Files that were
    scanned but have no chunks any more lose theirs.
    """
    def embed(chunks: DataFrame) -> DataFrame:
        return chunks if embedder is None else embed_documents(chunks, embedder, on_error=on_error)

    return upsert_chunks(spark, path, chunk_files(files), scanned=files, prepare=embed)


def indexed_chunks(spark: SparkSession, path: str, schema: str | StructType = INDEXED) -> DataFrame:
    """The chunks of a table that ``index_repository`` keeps, with their vectors."""
    return read_chunks(spark, path, schema)


def compact_index(spark: SparkSession, path: str, schema: str | StructType = INDEXED, **options) -> list[int]:
    return compact_chunks(spark, path, schema, **options)
