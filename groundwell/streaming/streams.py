"""Structured Streaming forms of scoring, trace keeping, job state and ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import fixed_values as fv
from ..functions import paths as P
from ..functions.coerce import clamp01
from ..operators.evals import score_all
from ..operators.traces import latest_by_id, trace_sink
from ..plans.indexing import index_repository
from ..session import settle
from ..sources.files import below_root, read_text_lenient


def stream_eval(responses: DataFrame, **options) -> DataFrame:
    """Score each new response once: a stateless map, so output mode is append."""
    return score_all(responses, **options)


def stream_dedup(rows: DataFrame, key: str = "id", time: str = "created_at", delay: str = "1 hour") -> DataFrame:
    """Drop repeats of a key that arrive within the delay; older keys leave the state."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need a zoned type
    return timed.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def write_append(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return (
        rows.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


# --- traces ------------------------------------------------------------------------
def stream_trace_upsert(traces: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                        now: Callable[[], datetime] | None = None) -> StreamingQuery:
    """Keep traces so that the last record of an id wins.

    Each batch is reduced to one record per id and appended under its day; the reader picks the last record.  A batch
    costs what it brings, however large the store is.  A batch that is repeated after a failure overwrites its own
    folders, so nothing is stored twice.  With a clock ``now``, what is past its time is removed after each batch;
    ``expire_traces`` does the same as a job of its own.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        latest = latest_by_id(batch, [F.desc("created_at")])
        latest.withColumn("day", F.to_date("created_at")).withColumn("batch", F.lit(batch_id)).write.mode(
            "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
        if now is not None:
            expire_traces(batch.sparkSession, path, now())

    return (
        traces.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_traces(spark: SparkSession, path: str, now, cap: int | None = None) -> DataFrame:
    """Current traces: days before the TTL are pruned, then the last record per id."""
    stored = spark.read.parquet(path)
    first_day = F.to_date(now - F.expr(f"INTERVAL {fv.TRACE_TTL_DAYS} DAYS"))
    order = [F.desc("created_at"), F.desc("batch")]
    recent = latest_by_id(stored.where(F.col("day") >= first_day), order)
    return trace_sink(recent, now, cap=cap).drop("day", "batch")


def _day_folders(spark: SparkSession, path: str) -> list[str]:
    """Stored days; one name per day reaches the driver, and no data is read."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(location):
        return []
    names = [f.getPath().getName() for f in system.listStatus(location)]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith("day="))


def _delete(spark: SparkSession, path: str) -> None:
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(location, True)


def expire_traces(spark: SparkSession, path: str, now: datetime, ttl_days: int = fv.TRACE_TTL_DAYS) -> None:
    """Remove traces older than the TTL from the store: whole days as folders, the day it ends in by rewriting it.

    ``now`` is in UTC, as the session's days are.  A retry after a failure finds less to do.
    """
    end = now - timedelta(days=ttl_days)
    for day in _day_folders(spark, path):
        if day < end.strftime("%Y-%m-%d"):
            _delete(spark, f"{path}/day={day}")
    last = end.strftime("%Y-%m-%d")
    if last in _day_folders(spark, path):
        rows = spark.read.option("basePath", path).parquet(f"{path}/day={last}")
        old = F.col("created_at") < F.lit(end)
        if not rows.where(old).isEmpty():
            kept = settle(rows.where(~old), "traces-kept")
            batches = [r.batch for r in rows.where(old).select("batch").distinct().collect()]
            kept.where(F.col("batch").isin(batches)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
            left = {r.batch for r in kept.select("batch").distinct().collect()}
            # an overwrite does not touch folders that have become empty
            for gone in [f"/batch={b}" for b in set(batches) - left] if left else [""]:
                _delete(spark, f"{path}/day={last}{gone}")


def compact_traces(spark: SparkSession, path: str, few: int = 1) -> list[str]:
    """Rewrite days of more than ``few`` batches as one folder, the last record of an id staying; gives these days.

    A day is written under its last batch, and only then are its other batches removed.
    """
    done = []
    for day in _day_folders(spark, path):
        rows = spark.read.option("basePath", path).parquet(f"{path}/day={day}")
        batches = sorted(r.batch for r in rows.select("batch").distinct().collect())
        if len(batches) > few:
            kept = settle(latest_by_id(rows, [F.desc("created_at"), F.desc("batch")]).withColumn(
                "batch", F.lit(batches[-1])), "traces-compact")
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
            for batch in batches[:-1]:
                _delete(spark, f"{path}/day={day}/batch={batch}")
            done.append(day)
    return done


# --- jobs ----------------------------------------------------------------------------
_JOB = "job_id string, status string, progress double, updated_at timestamp, terminal boolean"
_JOB_STATE = "status string, progress double, updated_at timestamp"


def _keep_latest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    status, progress, updated_at = state.get if state.exists else (None, None, None)
    updated_at = None if updated_at is None else pd.Timestamp(updated_at)
    for batch in batches:
        last = batch.sort_values("updated_at", kind="stable").iloc[-1]
        if updated_at is None or last["updated_at"] >= updated_at:
            status, progress, updated_at = last["status"], float(last["progress"]), last["updated_at"]
    state.update((status, progress, updated_at.to_pydatetime()))
    expiry = int(updated_at.timestamp() * 1000) + fv.JOB_TTL_DAYS * 86_400_000
    if expiry > state.getCurrentWatermarkMs():
        state.setTimeoutTimestamp(expiry)
    else:
        state.remove()
    yield pd.DataFrame({"job_id": [key[0]], "status": [status], "progress": [progress],
                        "updated_at": [updated_at], "terminal": [status in fv.TERMINAL_JOB_STATUSES]})


def stream_job_progress(updates: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Latest state per job (update mode); a job is forgotten a day after its last update.

    ``updates``: job_id, status, progress, updated_at.  Out-of-order updates
    lose against newer ones.
    """
    tidy = updates.select("job_id", "status", clamp01(F.col("progress")).alias("progress"),
                          F.col("updated_at").cast("timestamp").alias("updated_at"))
    return tidy.withWatermark("updated_at", delay).groupBy("job_id").applyInPandasWithState(
        _keep_latest, _JOB, _JOB_STATE, "update", GroupStateTimeout.EventTimeTimeout)


# --- ingestion ------------------------------------------------------------------------
def stream_files(spark: SparkSession, root: str, repository_id: str, repo_name: str, branch: str = "main",
                 files_per_batch: int = 1000) -> DataFrame:
    """Files below ``root`` as they appear.

    A stream reads a path once; an edited file arrives with the next stream, whose unchanged files cost a comparison.
    """
    base = root.rstrip("/")
    found = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(base)
    )
    named = found.select(below_root(spark, base, F.col("path")).alias("file_path"), "length", "content",
                         F.col("modificationTime").alias("modified"))
    wanted = named.where(
        ~P.in_skipped_dir(F.col("file_path"), fv.EXCLUDE_DIRS) & P.is_indexable(F.col("file_path"), F.col("length")))
    return read_text_lenient(wanted).select(
        F.lit(repository_id).alias("repository_id"), F.lit(repo_name).alias("repo_name"), F.lit(branch).alias("branch"),
        F.lit(None).cast("string").alias("commit_hash"), "file_path", "length", "text", "modified")


def stream_ingest(files: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                  embedder: str | None = "hash-32") -> StreamingQuery:
    """Chunk and embed files as they arrive and store what changed in the chunk table at ``path``.

    A batch is compared with the stored markers of its own buckets.  Unchanged files are neither embedded nor
    written, so a batch that comes again, after a failure or from a new stream, writes nothing.  Of a file that comes
    more than once in a batch the last modification counts, if ``files`` has a ``modified`` column.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        index_repository(batch.sparkSession, path, latest_files(batch), embedder)

    return (
        files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def latest_files(batch: DataFrame) -> DataFrame:
    """One row per file: the one modified last, where the batch says when."""
    if "modified" not in batch.columns:
        return batch
    last = F.max_by(F.struct(*batch.columns), "modified")
    return batch.groupBy("repository_id", "branch", "file_path").agg(last.alias("__last")).select("__last.*").drop("modified")
