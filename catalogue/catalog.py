"""Registered queries: catalog tables, jobs, traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwell.operators import catalog as K
from groundwell.operators import traces as TR

from groundwell.session import fresh_folder

from . import inputs as I

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def s(x):
    return F.col(x).cast("string") if isinstance(x, str) else x.cast("string")


# --- nations as workspaces, customers as repositories, orders as jobs --------------
def raw_workspaces(spark, sf):
    return I.table(spark, sf, "nation").select(
        F.concat(F.lit("w"), s("n_nationkey")).alias("id"), F.col("n_name").alias("name"), F.lower("n_name").alias("slug"),
        F.lit(None).cast("string").alias("description"),
        F.concat(F.lit("2024-01-"), F.lpad(s(F.col("n_nationkey") + 1), 2, "0"), F.lit("T00:00:00")).alias("created_at"))


def raw_repositories(spark, sf):
    k = F.col("c_custkey")
    stats = F.when(k % 7 == 6, F.lit("{broken")).otherwise(F.to_json(F.struct(
        (k % 50).alias("num_files"), (k % 90).alias("num_chunks"), F.create_map(F.lit("go"), k % 5).alias("languages"), (k * 10).alias("bytes_indexed"))))
    return I.table(spark, sf, "customer").select(
        F.concat(F.lit("r"), s(k)).alias("id"), F.concat(F.lit("w"), s("c_nationkey")).alias("workspace_id"),
        F.when(k % 9 == 8, F.lit("")).otherwise(F.col("c_name")).alias("name"), F.lit(None).cast("string").alias("local_path"),
        F.lit(None).cast("string").alias("git_url"), F.when(k % 2 == 0, F.lit("dev")).otherwise(F.lit("")).alias("branch"),
        F.when(k % 3 == 0, F.lit("indexed")).when(k % 3 == 1, F.lit("error")).otherwise(F.lit("lost")).alias("status"),
        F.lit(None).cast("string").alias("head_commit"), F.lit("never").alias("last_indexed_at"), stats.alias("stats"),
        F.lit(None).cast("string").alias("error"),
        F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + k * 60), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))


def workspaces(spark, sf):
    return K.hydrate_workspaces(raw_workspaces(spark, sf))


def repositories(spark, sf):
    return K.hydrate_repositories(raw_repositories(spark, sf))


def jobs(spark, sf):
    st = F.col("o_orderstatus")
    return I.table(spark, sf, "orders").select(
        F.concat(F.lit("j"), F.lpad(s("o_orderkey"), 12, "0")).alias("id"), F.concat(F.lit("r"), s("o_custkey")).alias("repository_id"),
        F.when(st == "F", F.lit("succeeded")).when(st == "P", F.lit("running")).otherwise(F.lit("pending")).alias("status"),
        F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("progress"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"))


REPOS = """repos AS (SELECT 'r' || c_custkey AS id, 'w' || c_nationkey AS workspace_id, CASE WHEN c_custkey % 9 = 8 THEN '' ELSE c_name END AS name,
  CASE WHEN c_custkey % 2 = 0 THEN 'dev' ELSE 'main' END AS branch, CASE c_custkey % 3 WHEN 0 THEN 'indexed' WHEN 1 THEN 'error' ELSE 'registered' END AS status,
  CASE WHEN c_custkey % 7 = 6 THEN 0 ELSE c_custkey % 50 END AS num_files, CASE WHEN c_custkey % 7 = 6 THEN 0 ELSE c_custkey % 90 END AS num_chunks,
  CASE WHEN c_custkey % 7 = 6 THEN 0 ELSE c_custkey * 10 END AS bytes, 1700000000 + c_custkey * 60 AS created FROM customer)"""
JOBS = """jobs AS (SELECT 'j' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id, 'r' || o_custkey AS repository_id,
  CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'running' ELSE 'pending' END AS status, least(1.0, o_totalprice / 500000) AS progress, o_orderdate AS created_at FROM orders)"""
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


@register("catalog_tables", f"WITH {REPOS} SELECT id, workspace_id, branch, status, num_files, num_chunks, bytes, strftime(make_timestamp(created * 1000000), '%Y-%m-%d %H:%M:%S') AS created_at, CAST(NULL AS VARCHAR) AS indexed_at FROM repos")
def catalog_tables(spark, sf):
    r = repositories(spark, sf)
    return r.select("id", "workspace_id", "branch", "status", "stats.num_files", "stats.num_chunks", F.col("stats.bytes_indexed").alias("bytes"),
                    stamp("created_at").alias("created_at"), stamp("last_indexed_at").alias("indexed_at"))


@register("parse_stats_json", f"WITH {REPOS} SELECT id, num_files, num_chunks, CAST(0 AS BIGINT) AS num_skipped, bytes FROM repos")
def parse_stats_json(spark, sf):
    return raw_repositories(spark, sf).select("id", K.parse_stats(F.col("stats")).alias("s")).select(
        "id", "s.num_files", "s.num_chunks", "s.num_skipped", F.col("s.bytes_indexed").alias("bytes"))


@register("workspaces_with_counts", "SELECT 'w' || n_nationkey AS id, n_name AS name, count(c_custkey) AS repository_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def workspaces_with_counts(spark, sf):
    return K.workspaces_with_counts(workspaces(spark, sf), repositories(spark, sf)).select("id", "name", "repository_count")


@register("list_workspaces", """SELECT 'w' || n_nationkey AS id, '2024-01-' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || ' 00:00:00' AS created_at, count(c_custkey) AS repository_count
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def list_workspaces(spark, sf):
    return K.list_workspaces(workspaces(spark, sf), repositories(spark, sf)).select("id", stamp("created_at").alias("created_at"), "repository_count")


@register("list_repositories", f"WITH {REPOS} SELECT id, name FROM repos WHERE workspace_id = 'w3'")
def list_repositories(spark, sf):
    return K.list_repositories(repositories(spark, sf), "w3").select("id", "name")


LATEST = f"{JOBS}, latest AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, id DESC) = 1)"


@register("latest_job", f"WITH {LATEST} SELECT id, repository_id, status, {STAMP.format('created_at')} AS created_at FROM latest")
def latest_job(spark, sf):
    return K.latest_job(jobs(spark, sf)).select("id", "repository_id", "status", stamp("created_at").alias("created_at"))


@register("list_jobs", f"WITH {JOBS} SELECT id, status, {STAMP.format('created_at')} AS created_at FROM jobs WHERE repository_id = 'r3'")
def list_jobs(spark, sf):
    return K.list_jobs(jobs(spark, sf), "r3").select("id", "status", stamp("created_at").alias("created_at"))


@register("repo_status", f"""WITH {REPOS}, {LATEST} SELECT r.id, r.status, j.id AS job_id, CASE WHEN j.status = 'running' THEN 'failed' ELSE j.status END AS job_status
FROM repos r LEFT JOIN latest j ON j.repository_id = r.id""")
def repo_status(spark, sf):
    """Live copies exist of running jobs and say that they failed; pending ones are stale."""
    stored = jobs(spark, sf)
    live = K.latest_job(stored).where(F.col("status").isin("running", "pending")).withColumn(
        "updated_at", F.when(F.col("status") == "pending", F.col("updated_at") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("updated_at"))).withColumn("status", F.lit("failed"))
    return K.repo_status(repositories(spark, sf), stored, live).select("id", "status", "job_id", "job_status")


@register("workspace_totals", f"WITH {REPOS} SELECT workspace_id, CAST(sum(num_files) AS BIGINT) AS files, CAST(sum(num_chunks) AS BIGINT) AS chunks, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (status = 'indexed') AS indexed FROM repos GROUP BY 1")
def workspace_totals(spark, sf):
    return K.workspace_totals(repositories(spark, sf))


@register("repo_display_name", f"WITH {REPOS}, {JOBS} SELECT j.id, coalesce(nullif(r.name, ''), j.repository_id) AS repository FROM jobs j LEFT JOIN repos r ON r.id = j.repository_id AND r.workspace_id <> 'w1'")
def repo_display_name(spark, sf):
    return K.with_repo_names(jobs(spark, sf), repositories(spark, sf).where(F.col("workspace_id") != "w1")).select("id", "repository")


@register("unique_slug", """WITH RECURSIVE n AS (SELECT p_partkey AS id, replace(p_name, ' ', '-') AS base, row_number() OVER (PARTITION BY p_name ORDER BY p_size, p_partkey) AS place FROM part),
taken AS (SELECT DISTINCT base, t FROM (SELECT base, id % 6 + 1 AS t FROM n WHERE id % 3 = 0)),
free AS (SELECT b.base, k, row_number() OVER (PARTITION BY b.base ORDER BY k) AS place FROM (SELECT DISTINCT base FROM n) b, range(1, (SELECT max(place) + 20 FROM n)) r(k)
  WHERE NOT EXISTS (SELECT 1 FROM taken WHERE taken.base = b.base AND taken.t = k))
SELECT id, CASE WHEN k = 1 THEN n.base ELSE n.base || '-' || k END AS slug FROM n JOIN free ON free.base = n.base AND free.place = n.place""")
def unique_slug(spark, sf):
    parts = I.table(spark, sf, "part")
    names = parts.select(F.col("p_partkey").alias("id"), F.initcap("p_name").alias("name"),
                         (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("p_size"))).alias("created_at"))
    k = F.col("p_partkey")
    base = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    n = k % 6 + 1
    taken = parts.where(k % 3 == 0).select(F.when(n == 1, base).otherwise(F.concat_ws("-", base, s(n))).alias("slug"))
    return K.unique_slugs(names, taken).select("id", "slug")


# --- events as traces: repeated ids, several days ----------------------------------
def traces(spark, sf):
    e, v = F.col("event_id"), F.col("value")
    span = lambda i, a, b, st: F.struct(F.concat(F.lit(f"s{i}-"), s(e)).alias("id"), F.lit(f"step{i}").alias("name"), F.lit("span").alias("type"), F.lit(st).alias("status"),
                                        F.lit(None).cast("string").alias("error"), a.alias("start_ms"), b.alias("end_ms"))
    return I.table(spark, sf, "events").select(
        F.concat(F.lit("t"), s(e - e % 3)).alias("id"), F.concat(F.lit("run "), F.col("event_type")).alias("name"), F.col("event_type").alias("workflow"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        F.concat(F.lit(" in\n"), F.col("props")).alias("input"), F.lit(None).cast("string").alias("output"), F.col("ts").alias("created_at"),
        F.when(e % 4 == 0, F.lit(0.0)).otherwise(v).alias("latency_ms"),
        F.array(span(1, F.lit(0.0), v / 2, "ok"), span(2, v, v / 4, "error"), span(3, F.lit(0.0), v * 3, "ok")).alias("spans"),
        F.create_map(F.lit("grounding"), F.lit(0.1), F.lit("tone"), F.lit(0.5)).alias("scores"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("metadata"), e.alias("event_id"))


NOW = "(SELECT max(ts) FROM events)"


def now_of(spark, sf):
    """The latest event time, as a one-row subquery value."""
    return I.table(spark, sf, "events").agg(F.max("ts").alias("now"))


KEPT = f"""tr AS (SELECT 't' || (event_id - event_id % 3) AS id, * FROM events), fresh AS (SELECT * FROM tr WHERE ts >= {NOW} - INTERVAL 7 DAY),
kept AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC) = 1)"""


@register("trace_sink", f"WITH {KEPT} SELECT id, event_type AS workflow, {STAMP.format('ts')} AS created_at FROM kept")
def trace_sink(spark, sf):
    return TR.trace_sink(traces(spark, sf), now_of(spark, sf).scalar()).select("id", "workflow", stamp("created_at").alias("created_at"))


@register("trace_lookup", "SELECT 't42' AS id, event_type AS workflow, value FROM events WHERE event_id BETWEEN 42 AND 44")
def trace_lookup(spark, sf):
    return TR.trace_lookup(traces(spark, sf).withColumn("value", F.col("spans")[1]["start_ms"]), "t42").select("id", "workflow", "value")


@register("trace_list", f"SELECT 't' || (event_id - event_id % 3) AS id, {STAMP.format('ts')} AS created_at FROM events WHERE event_type = 'click' ORDER BY ts DESC LIMIT 50")
def trace_list(spark, sf):
    return TR.trace_list(traces(spark, sf), 50, "click").select("id", stamp("created_at").alias("created_at"))


@register("trace_summaries", "SELECT 't' || (event_id - event_id % 3) AS id, 'run ' || event_type AS name, CASE event_type WHEN 'error' THEN 'error' ELSE 'ok' END AS status, 'in ' || props AS input_preview, '' AS output_preview FROM events ORDER BY ts DESC LIMIT 100")
def trace_summaries(spark, sf):
    return TR.trace_summaries(traces(spark, sf), 100).select("id", "name", "status", "input_preview", "output_preview")


_DUR = "CASE p WHEN 0 THEN value / 2 WHEN 1 THEN 0.0 ELSE value * 3 END"
_LAT = "CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE value END"


@register("span_share", f"""SELECT event_id, p AS position, round({_DUR}, 6) AS duration_ms, p = 1 AS failed,
  round(least(100.0, greatest(2.0, {_DUR} / coalesce(nullif({_LAT}, 0.0), nullif({_DUR}, 0.0), 1.0) * 100)), 6) AS width_pct FROM events, (VALUES (0), (1), (2)) v(p)""")
def span_share(spark, sf):
    return TR.span_share(traces(spark, sf)).select(
        F.regexp_extract("span_id", "-(.*)", 1).cast("bigint").alias("event_id"), F.col("position").cast("bigint").alias("position"),
        F.round("duration_ms", 6).alias("duration_ms"), "failed", F.round("width_pct", 6).alias("width_pct"))


@register("merge_scores_onto_traces", f"""WITH {KEPT}, m AS (SELECT id, event_id, CAST(event_id % 10 / 10.0 AS DOUBLE) AS g FROM tr QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC) = 1)
SELECT id, CASE WHEN event_id % 2 = 0 THEN round(g, 4) ELSE CAST(0.1 AS DOUBLE) END AS grounding, CAST(0.5 AS DOUBLE) AS tone, CASE WHEN event_id % 2 = 0 THEN round((g + 0.25) / 2, 4) END AS overall FROM m""")
def merge_scores_onto_traces(spark, sf):
    rows = TR.latest_by_id(traces(spark, sf), [F.desc("created_at")])
    e = F.col("event_id")
    scores = rows.where(e % 2 == 0).select(F.col("id").alias("trace_id"), F.explode(F.array(
        F.struct(F.lit("grounding").alias("metric"), (e % 10 / 10).alias("score")), F.struct(F.lit("relevance").alias("metric"), F.lit(0.25).alias("score")))).alias("x")).select("trace_id", "x.*")
    out = TR.merge_scores_onto_traces(rows, scores)
    return out.select("id", F.col("scores")["grounding"].alias("grounding"), F.col("scores")["tone"].alias("tone"), F.col("scores")["overall"].alias("overall"))


@register("recent_evals", f"SELECT 'e' || event_id AS id, {STAMP.format('ts')} AS created_at, round(value, 6) AS overall FROM events WHERE event_type <> 'error' ORDER BY ts DESC LIMIT 1000")
def recent_evals(spark, sf):
    """Results of many runs, stored, one run stored again, and read back from the newest on."""
    e = F.col("event_id")
    rows = I.table(spark, sf, "events").select(F.concat(F.lit("e"), s("event_id")).alias("id"), F.col("ts").cast("timestamp").alias("created_at"),
                                               F.when(F.col("event_type") != "error", F.col("value")).alias("overall"), s(e % 10).alias("run_id"))
    path = fresh_folder(spark, "eval-results")
    TR.eval_result_sink(rows.withColumn("overall", F.when(F.col("run_id") == "3", -1.0).otherwise(F.col("overall"))), path)
    TR.eval_result_sink(rows.where("run_id = '3'"), path)  # the run that went wrong, again
    stored = TR.read_eval_results(spark, path, "id string, created_at timestamp, overall double, run_id string")
    return TR.recent_evals(stored, 1000).select("id", stamp("created_at").alias("created_at"), F.round("overall", 6).alias("overall"))
