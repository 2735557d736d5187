"""Traces: keeping, listing, summarising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.coerce import positive
from ..functions.text import preview


def latest_by_id(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The last record per id, of equal ones the largest as JSON; copies are cut down in every task before they move."""
    window = Window.partitionBy("id").orderBy(*order, F.desc(F.to_json(F.struct(*rows.columns))))
    return rows.withColumn("__n", F.row_number().over(window)).where(F.col("__n") == 1).drop("__n")


def trace_sink(traces: DataFrame, now: Column, ttl_days: int = fv.TRACE_TTL_DAYS,
               cap: int | None = None) -> DataFrame:
    """What the store holds: last record per id, no older than the TTL; all, or the newest ``cap``."""
    positive(cap, "cap")
    fresh = traces.where(F.col("created_at") >= now - F.expr(f"INTERVAL {int(ttl_days)} DAYS"))
    kept = latest_by_id(fresh, [F.desc("created_at")])
    ordered = kept.orderBy(F.desc("created_at"), "id")
    return ordered if cap is None else ordered.limit(cap)


def trace_lookup(traces: DataFrame, trace_id: str) -> DataFrame:
    return traces.where(F.col("id") == trace_id)


def trace_list(traces: DataFrame, limit: int | None = None, workflow: str | None = None) -> DataFrame:
    """Traces from the newest on, of one workflow if asked; a limit is a distributed top-n."""
    positive(limit, "limit")
    chosen = traces if workflow is None else traces.where(F.col("workflow") == workflow)
    ordered = chosen.orderBy(F.desc("created_at"), "id")
    return ordered if limit is None else ordered.limit(limit)


def trace_summaries(traces: DataFrame, limit: int | None = None, workflow: str | None = None) -> DataFrame:
    return trace_list(traces, limit, workflow).select(
        "id", "name", "workflow", "status", "latency_ms", preview(F.col("input")).alias("input_preview"),
        preview(F.col("output")).alias("output_preview"), "scores", "metadata")


def span_share(traces: DataFrame) -> DataFrame:
    """Each span with its duration and the width of its bar in percent."""
    spans = traces.select(F.col("id").alias("trace_id"), "latency_ms", F.posexplode("spans").alias("position", "s"))
    duration = F.greatest(F.lit(0.0), F.col("s.end_ms") - F.col("s.start_ms"))
    total = F.coalesce(F.nullif("latency_ms", F.lit(0.0)), F.nullif("duration_ms", F.lit(0.0)), F.lit(1.0))
    width = F.least(F.lit(100.0), F.greatest(F.lit(2.0), F.col("duration_ms") / total * 100))
    return spans.withColumn("duration_ms", duration).select(
        "trace_id", "position", F.col("s.id").alias("span_id"), F.col("s.name").alias("name"), "duration_ms",
        width.alias("width_pct"), ((F.col("s.status") == "error") | F.col("s.error").isNotNull()).alias("failed"))


def merge_scores_onto_traces(traces: DataFrame, scores: DataFrame) -> DataFrame:
    """Evaluation scores overwrite the same names on the trace and add ``overall``.

    ``scores``: trace_id, metric, score.
    """
    pairs = scores.groupBy(F.col("trace_id").alias("id")).agg(
        F.map_from_entries(F.collect_list(F.struct("metric", F.round("score", 4)))).alias("__new"),
        F.round(F.avg("score"), 4).alias("__overall"))
    added = F.map_concat(F.col("__new"), F.create_map(F.lit("overall"), F.col("__overall")))
    kept = F.map_filter(
        F.coalesce("scores", F.create_map().cast("map<string,double>")),
        lambda name, _: ~F.map_contains_key(F.col("__new"), name) & (name != "overall"))
    merged = F.map_concat(kept, added)
    return traces.join(pairs, "id", "left").withColumn(
        "scores", F.when(F.col("__new").isNotNull(), merged).otherwise(F.col("scores"))).drop("__new", "__overall")


def recent_evals(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Evaluation results from the newest on; those without a score are not usable and go."""
    positive(limit, "limit")
    usable = results.where(F.col("overall").isNotNull()).orderBy(F.desc("created_at"), "id")
    return usable if limit is None else usable.limit(limit)


def eval_result_sink(results: DataFrame, path: str) -> None:
    """Store evaluation results below ``path``, one folder per ``run_id``.

    A run that is written again replaces itself and no other, so a retry after a failure leaves the same table.
    """
    results.repartition("run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "run_id").parquet(path)


def read_eval_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored results of all runs as declared (run_id among the columns)."""
    return spark.read.schema(schema).parquet(path)
