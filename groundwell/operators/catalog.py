"""Workspaces, repositories and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import schemas
from ..functions.coerce import coerce_enum, parse_iso_ts
from ..functions.paths import repo_display
from ..functions.text import slugify
from .numbering import numbered_by_range, numbered_within


def parse_stats(raw: Column) -> Column:
    """Indexing counters from JSON; anything unreadable counts as zero."""
    s = F.from_json(raw, schemas.STATS)
    zero = F.lit(0).cast("bigint")
    return F.struct(
        *[F.coalesce(s[n], zero).alias(n) for n in ("num_files", "num_chunks", "num_skipped", "bytes_indexed")],
        F.coalesce(s["languages"], F.create_map().cast("map<string,bigint>")).alias("languages"))


def hydrate_workspaces(raw: DataFrame) -> DataFrame:
    return raw.withColumn("created_at", parse_iso_ts(F.col("created_at")))


def hydrate_repositories(raw: DataFrame) -> DataFrame:
    """Text columns of the repository table as typed ones."""
    return (
        raw.withColumn("branch", F.coalesce(F.nullif("branch", F.lit("")), F.lit("main")))
        .withColumn("status", coerce_enum(F.col("status"), fv.REPOSITORY_STATUSES, "registered"))
        .withColumn("stats", parse_stats(F.col("stats")))
        .withColumn("last_indexed_at", parse_iso_ts(F.col("last_indexed_at")))
        .withColumn("created_at", parse_iso_ts(F.col("created_at")))
    )


def hydrate_jobs(raw: DataFrame) -> DataFrame:
    return (
        raw.withColumn("status", coerce_enum(F.col("status"), fv.JOB_STATUSES, "pending"))
        .withColumn("message", F.coalesce("message", F.lit("")))
        .withColumn("stats", parse_stats(F.col("stats")))
        .withColumn("created_at", parse_iso_ts(F.col("created_at")))
        .withColumn("updated_at", parse_iso_ts(F.col("updated_at")))
    )


def workspaces_with_counts(workspaces: DataFrame, repositories: DataFrame) -> DataFrame:
    counts = repositories.groupBy(F.col("workspace_id").alias("id")).agg(F.count(F.lit(1)).alias("repository_count"))
    return workspaces.join(counts, "id", "left").withColumn("repository_count", F.coalesce("repository_count", F.lit(0)))


def newest_first(rows: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = rows.orderBy(F.desc("created_at"), "id")
    return ordered if limit is None else ordered.limit(limit)


def list_workspaces(workspaces: DataFrame, repositories: DataFrame) -> DataFrame:
    return newest_first(workspaces_with_counts(workspaces, repositories))


def list_repositories(repositories: DataFrame, workspace_id: str) -> DataFrame:
    return newest_first(repositories.where(F.col("workspace_id") == workspace_id))


def list_jobs(jobs: DataFrame, repository_id: str) -> DataFrame:
    return newest_first(jobs.where(F.col("repository_id") == repository_id))


def latest_job(jobs: DataFrame) -> DataFrame:
    """The newest job of every repository; older ones are dropped before the shuffle."""
    order = Window.partitionBy("repository_id").orderBy(F.desc("created_at"), F.desc("id"))
    return jobs.withColumn("__n", F.row_number().over(order)).where(F.col("__n") == 1).drop("__n")


def repo_status(repositories: DataFrame, stored_jobs: DataFrame, live_jobs: DataFrame | None = None) -> DataFrame:
    """Every repository with its newest job.

    Of a stored and a live copy the one updated last counts, the live one on a tie.
    """
    jobs = latest_job(stored_jobs).withColumn("__live", F.lit(0))
    if live_jobs is not None:
        jobs = jobs.unionByName(latest_job(live_jobs).withColumn("__live", F.lit(1)))
    order = Window.partitionBy("repository_id").orderBy(F.desc("updated_at"), F.desc("__live"))
    newest = jobs.withColumn("__n", F.row_number().over(order)).where(F.col("__n") == 1)
    job = newest.select(
        F.col("repository_id").alias("id"), F.col("id").alias("job_id"), F.col("status").alias("job_status"),
        F.col("progress").alias("job_progress"), F.col("updated_at").alias("job_updated_at"))
    return repositories.join(job, "id", "left")


def workspace_totals(repositories: DataFrame) -> DataFrame:
    """Summed counters per workspace; ``stats`` is the typed struct."""
    s = F.col("stats")
    return repositories.groupBy("workspace_id").agg(
        F.sum(s["num_files"]).alias("files"), F.sum(s["num_chunks"]).alias("chunks"),
        F.sum(s["bytes_indexed"]).alias("bytes"), F.count_if(F.col("status") == "indexed").alias("indexed"))


def unique_slugs(names: DataFrame, taken: DataFrame) -> DataFrame:
    """A free slug for every new name: base, base-2, base-3 and so on.

    ``names``: id, name, created_at; ``taken``: slug.  New names of one base
    are numbered by creation and numbers already taken are stepped over: the
    j-th taken number t shifts every name whose place is above t - j.
    """
    based = names.withColumn("base", slugify(F.col("name")))
    placed = numbered_by_range(based, ["base"], ["created_at", "id"], "place")
    bases = based.select("base").distinct()
    slug = F.col("slug")
    stem = F.regexp_replace(slug, r"-[1-9][0-9]*$", "")
    number = F.regexp_extract(slug, r"-([1-9][0-9]*)$", 1).try_cast("bigint")
    numbers = taken.select(slug.alias("base"), F.lit(1).cast("bigint").alias("t")).unionByName(
        taken.where(number >= 2).select(stem.alias("base"), number.alias("t"))).distinct()
    numbers = numbers.join(bases, "base", "left_semi")
    shift = numbered_within(numbers, ["base"], ["t"], F.floor(F.col("t") / 10_000), "j").withColumn(
        "threshold", F.col("t") - F.col("j"))
    # names and taken numbers on one axis: how many thresholds lie below a place; equal thresholds are one point
    shift = shift.groupBy("base", F.col("threshold").alias("x")).agg(F.count(F.lit(1)).alias("mark"))
    axis = placed.select("base", F.col("place").alias("x"), F.lit(0).alias("mark"), "id").unionByName(
        shift.withColumn("id", F.lit(None).cast(names.schema["id"].dataType)))
    steps = _count_below(axis)
    out = placed.join(steps, ["base", "id"]).withColumn("n", F.col("place") + F.col("below"))
    return out.select("id", "name", "base", F.when(F.col("n") == 1, F.col("base")).otherwise(
        F.concat_ws("-", F.col("base"), F.col("n").cast("string"))).alias("slug"))


def _count_below(axis: DataFrame, width: int = 10_000) -> DataFrame:
    """For each point with an id, the marks of the points strictly below it, per base."""
    cut = axis.withColumn("__b", F.floor(F.col("x") / width))
    mark = F.col("mark")
    before = Window.partitionBy("base").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("base", "__b").agg(F.sum(mark).alias("__m")).withColumn(
        "__offset", F.coalesce(F.sum("__m").over(before), F.lit(0))).drop("__m")
    inside = Window.partitionBy("base", "__b").orderBy("x").rangeBetween(Window.unboundedPreceding, -1)
    counted = cut.withColumn("__in", F.coalesce(F.sum(mark).over(inside), F.lit(0))).where(F.col("id").isNotNull())
    return counted.join(offsets, ["base", "__b"]).select(
        "base", "id", (F.col("__in") + F.col("__offset")).alias("below"))


def with_repo_names(rows: DataFrame, repositories: DataFrame) -> DataFrame:
    """Add the display name of a repository; its id where the name is unknown."""
    names = repositories.select(F.col("id").alias("repository_id"), F.col("name").alias("__name"))
    return rows.join(names, "repository_id", "left").withColumn(
        "repository", repo_display(F.col("__name"), F.col("repository_id"))).drop("__name")
