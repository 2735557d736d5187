"""Registered queries: scanning, chunking, incremental maintenance, embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwell.functions import text as T
from groundwell.operators import chunking as C
from groundwell.operators import corpus as K
from groundwell.operators import embed as E
from groundwell.operators import scope as S
from groundwell.sources import chunk_store as CS
from groundwell.sources import datasets as DS
from groundwell.sources import files as FS

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


@register("scan_repo_files", """SELECT 'r' || page_id % 7 || '/r' || page_id % 7 || '/' || CASE page_id % 3 WHEN 0 THEN '_' ELSE '' END || 'page' || page_id || '.txt' AS file_path,
  strlen(html) AS length FROM pages WHERE page_id % 7 <> 6""")
def scan_repo_files(spark, sf):
    """Pages written out as files, some under names that Spark's listing passes over, in nested folders of one name."""
    root = fresh_folder(spark, "tree") + "/r0"
    pages = I.table(spark, sf, "pages")
    group = F.concat(F.lit("r"), (F.col("page_id") % 7).cast("string"))
    name = F.concat(F.when(F.col("page_id") % 3 == 0, F.lit("_")).otherwise(F.lit("")), F.lit("page"), F.col("page_id").cast("string"), F.lit(".txt"))
    folder = F.when(F.col("page_id") % 7 == 6, F.lit("node_modules/x")).otherwise(F.concat_ws("/", group, group))
    FS.write_files(pages.select(F.concat_ws("/", folder, name).alias("file_path"), F.col("html").alias("text")), root)
    return FS.scan_repo_files(spark, root).select("file_path", "length")


@register("scope_paths", f"WITH {I.FILES} SELECT repository_id, file_path FROM files WHERE starts_with(file_path, 'en/1') OR starts_with(file_path, 'fr')")
def scope_paths(spark, sf):
    from groundwell.functions.paths import scope_paths as scoped

    return I.files(spark, sf).where(scoped(F.col("file_path"), ["/en/1", " fr/ ", ""])).select("repository_id", "file_path")


@register("read_text_lenient", "SELECT doc_id, CASE WHEN lang = 'fr' THEN NULL WHEN lang = 'de' THEN chr(65533) || text ELSE text END AS text FROM documents")
def read_text_lenient(spark, sf):
    """Documents as bytes: French ones hold a NUL, all others end in a cut character."""
    raw = F.encode("text", "UTF-8")
    content = F.when(F.col("lang") == "fr", F.concat(F.lit(b"\x00"), raw)).when(
        F.col("lang") == "de", F.concat(F.lit(b"\xef\xbf\xbd"), raw, F.lit(b"\xc3"))).otherwise(F.concat(raw, F.lit(b"\xe2\x82")))
    return FS.read_text_lenient(I.documents(spark, sf).select("doc_id", content.alias("content")))


@register("load_eval_dataset", """SELECT 'ex' || item_id AS id, text AS question, CASE WHEN item_id % 3 = 0 THEN 'debug' ELSE 'ask' END AS mode,
  'a.py,b' || item_id || '.py' AS files FROM benchmark WHERE item_id % 7 <> 6""")
def load_eval_dataset(spark, sf):
    """Each benchmark text as a dataset document, some of them not usable."""
    i = F.col("item_id")
    example = F.struct(
        F.concat(F.lit("ex"), i.cast("string")).alias("id"), F.when(i % 14 != 6, F.col("text")).alias("question"),
        F.when(i % 14 == 13, F.lit("sing")).when(i % 3 == 0, F.lit("debug")).alias("mode"),
        F.array(F.lit("a.py"), F.concat(F.lit("b"), i.cast("string"), F.lit(".py"))).alias("expected_files"))
    doc = F.when(i % 2 == 0, F.to_json(F.struct(F.array(example).alias("examples")))).otherwise(F.to_json(F.array(example)))
    out = DS.valid_examples(I.table(spark, sf, "benchmark").select(doc.alias("value")))
    return out.select("id", "question", "mode", F.array_join("expected_files", ",").alias("files"))


# --- chunking -----------------------------------------------------------------
@register("window_chunks", f"WITH {I.DOC_WINDOWS} SELECT file_path, start_line, end_line, sha1(text) AS hash FROM chunks")
def window_chunks(spark, sf):
    return C.window_chunks(I.files(spark, sf)).select(
        "file_path", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"),
        F.sha1("chunk_text").alias("hash"))


@register("nonblank", """SELECT doc_id, trim(t, chr(10)) AS text FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN chr(10) || ' ' || chr(10) ELSE chr(10) || text || chr(10) || chr(10) END AS t FROM documents)
WHERE regexp_matches(t, '[^\\s]')""")
def nonblank(spark, sf):
    t = F.when(F.col("doc_id") % 5 == 0, F.lit("\n \n")).otherwise(F.concat(F.lit("\n"), F.col("text"), F.lit("\n\n")))
    return I.documents(spark, sf).select("doc_id", T.strip_newlines(t).alias("text")).where(~T.is_blank(F.col("text")))


def with_lines(spark, sf, rule, unit="text"):
    """Files whose text is rebuilt line by line by an SQL rule over l and i (0-based)."""
    lines = T.split_lines(F.col("text") if unit == "text" else F.replace("text", F.lit(" "), F.lit("\n")))
    return I.files(spark, sf).withColumn("__l", lines).withColumn(
        "text", F.expr(f"array_join(transform(__l, (l, i) -> {rule}), '\n')")).drop("__l")


def sql_with_lines(rule, unit="text"):
    source = "text" if unit == "text" else "replace(text, ' ', chr(10))"
    return f"""{I.FILES}, raw AS (SELECT *, {I.sql_lines(source)} AS l0 FROM files),
lined AS (SELECT * REPLACE (list_transform(l0, lambda l, j: {rule.replace(' i ', ' (j - 1) ').replace('(i)', 'CAST(j - 1 AS VARCHAR)')}) AS l0) FROM raw),
numbered AS (SELECT repository_id, file_path, unnest(l0) AS line, generate_subscripts(l0, 1) AS n FROM lined)"""


_MD_RULE = "CASE WHEN i % 5 = 2 THEN concat('## ', l) ELSE l END"
_ISLANDS = """marked AS (SELECT *, regexp_matches(line, '^#{1,6}\\s+') AS head FROM numbered),
sectioned AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY n) AS sec FROM marked),
sections AS (SELECT file_path, sec, min(n) AS start_line, max(n) AS end_line, string_agg(line, chr(10) ORDER BY n) AS body,
   arg_min(CASE WHEN head THEN regexp_replace(regexp_replace(line, '^#{1,6}\\s+', ''), '^\\s+|\\s+$', '', 'g') END, n) AS t0,
   bool_or(head) AS titled FROM sectioned GROUP BY 1, 2)"""


@register("markdown_sections", f"""WITH {sql_with_lines(_MD_RULE)}, {_ISLANDS}
SELECT file_path, start_line, end_line, t0 AS symbol, sha1(body) AS hash FROM sections WHERE regexp_matches(body, '[^\\s]')""")
def markdown_sections(spark, sf):
    return C.markdown_sections(with_lines(spark, sf, _MD_RULE)).select(
        "file_path", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"),
        "symbol", F.sha1("chunk_text").alias("hash"))


_LONG_RULE = "CASE WHEN i % 200 = 0 THEN concat('# s', l) ELSE concat('w', l) END"


@register("split_long_sections", f"""WITH {sql_with_lines(_LONG_RULE, 'words')}, {_ISLANDS},
cut AS (SELECT *, {I.sql_lines('body')} AS lines FROM sections),
long AS (SELECT file_path, start_line AS base, t0, lines FROM cut WHERE len(lines) > 120),
{I.sql_windows('long')}
SELECT file_path, start_line, end_line, t0 AS symbol, sha1(body) AS hash FROM cut WHERE len(lines) <= 120
UNION ALL SELECT file_path, base + start_line - 1, base + end_line - 1, t0, sha1(chunk_text) FROM windows""")
def split_long_sections(spark, sf):
    files = with_lines(spark, sf, _LONG_RULE, "words")
    pieces = files.select("file_path", F.explode(C.markdown_pieces(T.split_lines(F.col("text")))).alias("p"))
    return pieces.select("file_path", F.col("p.start").cast("bigint").alias("start_line"),
                         F.col("p.end").cast("bigint").alias("end_line"), F.col("p.symbol").alias("symbol"), F.sha1("p.body").alias("hash"))


_DEF_RULE = "CASE WHEN i % 8 = 0 THEN concat('func f', (i), '() {') WHEN i % 8 < 3 THEN concat('  ', l) WHEN i % 8 = 3 THEN '}' ELSE concat('% ', l) END"
_DEF_SPARK = _DEF_RULE.replace("(i)", "cast(i as string)")


@register("definition_chunks", f"""WITH {sql_with_lines(_DEF_RULE)},
parts AS (SELECT *, (n - 1) // 8 AS g, (n - 1) % 8 >= 4 AS gap FROM numbered),
spans AS (SELECT file_path, g, gap, min(n) AS start_line, CASE WHEN gap THEN max(n) ELSE max(n) FILTER (regexp_matches(line, '[^\\s]')) END AS end_line FROM parts GROUP BY 1, 2, 3)
SELECT s.file_path, start_line, end_line, CASE WHEN NOT s.gap THEN 'f' || (start_line - 1) END AS symbol,
   sha1(string_agg(line, chr(10) ORDER BY n)) AS hash
FROM spans s JOIN parts p ON p.file_path = s.file_path AND p.n BETWEEN start_line AND end_line GROUP BY ALL""")
def definition_chunks(spark, sf):
    lines = T.split_lines(F.col("text"))
    files = with_lines(spark, sf, _DEF_SPARK).withColumn("lines", lines).withColumn("spans", C.boundary_spans(F.col("lines")))
    pieces = files.select("file_path", F.explode(C.definition_pieces(F.col("lines"), F.col("spans"))).alias("p"))
    return pieces.select("file_path", F.col("p.start").cast("bigint").alias("start_line"),
                         F.col("p.end").cast("bigint").alias("end_line"), F.col("p.symbol").alias("symbol"), F.sha1("p.body").alias("hash"))


_HUGE_RULE = "CASE WHEN i % 250 = 0 THEN concat('class K', (i)) ELSE concat('  .', l) END"


@register("split_huge_definitions", f"""WITH {sql_with_lines(_HUGE_RULE, 'words')},
defs AS (SELECT file_path, (n - 1) // 250 AS g, min(n) AS base, list(line ORDER BY n) AS lines FROM numbered GROUP BY 1, 2),
huge AS (SELECT * FROM defs WHERE len(lines) > 180), {I.sql_windows('huge')}
SELECT file_path, base AS start_line, base + len(lines) - 1 AS end_line, 'K' || (base - 1) AS symbol, sha1(array_to_string(lines, chr(10))) AS hash FROM defs WHERE len(lines) <= 180
UNION ALL SELECT file_path, base + start_line - 1, base + end_line - 1, 'K' || (base - 1), sha1(chunk_text) FROM windows""")
def split_huge_definitions(spark, sf):
    files = with_lines(spark, sf, _HUGE_RULE.replace("(i)", "cast(i as string)"), "words").withColumn(
        "lines", T.split_lines(F.col("text"))).withColumn("spans", C.boundary_spans(F.col("lines")))
    pieces = files.select("file_path", F.explode(C.definition_pieces(F.col("lines"), F.col("spans"))).alias("p"))
    return pieces.select("file_path", F.col("p.start").cast("bigint").alias("start_line"),
                         F.col("p.end").cast("bigint").alias("end_line"), F.col("p.symbol").alias("symbol"), F.sha1("p.body").alias("hash"))


CHUNKED = f"""{I.FILES},
fl AS (SELECT *, {I.sql_lines('text')} AS lines, {I.LANGUAGE} AS language, {I.CHUNK_TYPE} AS chunk_type FROM files WHERE regexp_matches(text, '[^\\s]')),
split_files AS (SELECT * FROM fl WHERE chunk_type <> 'markdown' OR len(lines) > 120), {I.sql_windows('split_files')},
pieces AS (SELECT repository_id, file_path, language, chunk_type, start_line, end_line, chunk_text FROM windows
  UNION ALL SELECT repository_id, file_path, language, chunk_type, 1, len(lines), array_to_string(lines, chr(10)) FROM fl WHERE chunk_type = 'markdown' AND len(lines) <= 120),
chunks AS (SELECT repository_id, file_path, language, chunk_type, start_line, end_line, trim(chunk_text, chr(10)) AS text,
  sha1(trim(chunk_text, chr(10))) AS content_hash FROM pieces)"""


def chunked(spark, sf):
    return C.chunk_files(I.files(spark, sf))


@register("chunk_files", f"""WITH {CHUNKED} SELECT 'chunk_' || sha256(repository_id || '|main|' || file_path || '|' || start_line || '|' || end_line || '|' || content_hash) AS chunk_id,
 file_path, language, chunk_type, start_line, end_line, content_hash, greatest(1, CAST(floor(length(text) / 4) AS BIGINT)) AS tokens FROM chunks""")
def chunk_files(spark, sf):
    return chunked(spark, sf).select(
        "chunk_id", "file_path", "language", "chunk_type", F.col("start_line").cast("bigint").alias("start_line"),
        F.col("end_line").cast("bigint").alias("end_line"), "content_hash", F.col("token_estimate").cast("bigint").alias("tokens"))


# --- store and incremental maintenance -------------------------------------------
MARKERS = """markers AS (SELECT repository_id, file_path, sha1(string_agg(content_hash, ',' ORDER BY start_line)) AS marker, count(*) AS n_chunks FROM chunks GROUP BY 1, 2)"""


@register("file_markers", f"WITH {CHUNKED}, {MARKERS} SELECT * FROM markers")
def file_markers(spark, sf):
    return K.file_markers(chunked(spark, sf))


def stored_markers(spark, sf):
    """What an earlier run knew: German files differ, Spanish ones are missing."""
    old = K.file_markers(chunked(spark, sf))
    lang = F.substring("file_path", 1, 2)
    return old.where(lang != "es").withColumn("marker", F.when(lang == "de", F.lit("old")).otherwise(F.col("marker")))


STATE = "CASE left(file_path, 2) WHEN 'es' THEN 'new' WHEN 'de' THEN 'changed' ELSE 'unchanged' END"


@register("incremental_diff", f"WITH {CHUNKED}, {MARKERS} SELECT repository_id, file_path, {STATE} AS state FROM markers")
def incremental_diff(spark, sf):
    return K.incremental_diff(K.file_markers(chunked(spark, sf)), stored_markers(spark, sf)).select(
        "repository_id", "file_path", "state")


@register("index_stats", f"""WITH {CHUNKED}, {MARKERS}, f AS (SELECT files.repository_id, files.file_path, strlen(files.text) AS bytes, n_chunks,
   CASE WHEN n_chunks IS NULL THEN NULL ELSE {STATE.replace('file_path', 'files.file_path')} END AS state FROM files LEFT JOIN markers m ON m.repository_id = files.repository_id AND m.file_path = files.file_path)
SELECT repository_id, CAST(count(n_chunks) AS BIGINT) AS num_files, CAST(coalesce(sum(n_chunks) FILTER (state <> 'unchanged'), 0) AS BIGINT) AS num_chunks,
  CAST(count(*) FILTER (state IS NULL OR state = 'unchanged') AS BIGINT) AS num_skipped, CAST(coalesce(sum(bytes) FILTER (state IS NOT NULL), 0) AS BIGINT) AS bytes_indexed,
  CAST(count(n_chunks) FILTER (left(file_path, 2) = 'en') AS BIGINT) AS markdown_files FROM f GROUP BY 1""")
def index_stats(spark, sf):
    files = I.files(spark, sf)
    states = K.incremental_diff(K.file_markers(chunked(spark, sf)), stored_markers(spark, sf))
    return K.index_stats(files, states).select(
        "repository_id", "num_files", "num_chunks", "num_skipped", "bytes_indexed",
        F.coalesce(F.col("languages")["markdown"], F.lit(0)).cast("bigint").alias("markdown_files"))


@register("language_share", f"""WITH {I.FILES}, c AS (SELECT repository_id, {I.LANGUAGE} AS language, count(*) AS files FROM files GROUP BY 1, 2)
SELECT repository_id, language, files, round(files / sum(files) OVER (PARTITION BY repository_id) * 100, 6) AS pct,
  row_number() OVER (PARTITION BY repository_id ORDER BY files DESC, language) <= 2 AS in_legend,
  greatest(0, count(*) OVER (PARTITION BY repository_id) - 2) AS hidden FROM c""")
def language_share(spark, sf):
    from groundwell.functions.paths import detect_language

    counts = I.files(spark, sf).groupBy("repository_id", detect_language(F.col("file_path")).alias("language")).agg(
        F.count(F.lit(1)).alias("files"))
    return K.language_share(counts, 2).select("repository_id", "language", "files", F.round("pct", 6).alias("pct"), "in_legend", "hidden")


@register("upsert_chunks", f"""WITH {CHUNKED} SELECT repository_id, file_path, start_line, CASE WHEN left(file_path, 2) IN ('es', 'de') THEN 'new' ELSE content_hash END AS content_hash
FROM chunks WHERE NOT (left(file_path, 2) IN ('es', 'de') AND start_line > 1)""")
def upsert_chunks(spark, sf):
    """Spanish and German files come again with only their first chunk, edited."""
    old = chunked(spark, sf)
    new = old.where(F.substring("file_path", 1, 2).isin("es", "de") & (F.col("start_line") == 1)).withColumn(
        "content_hash", F.lit("new"))
    path = fresh_folder(spark, "chunk-table")
    CS.upsert_chunks(spark, path, old)
    CS.upsert_chunks(spark, path, new)
    return CS.read_chunks(spark, path, old.schema).select(
        "repository_id", "file_path", F.col("start_line").cast("bigint").alias("start_line"), "content_hash")


@register("delete_repository", f"WITH {CHUNKED} SELECT repository_id, count(*) AS n_chunks FROM chunks WHERE repository_id <> 'src3' GROUP BY 1")
def delete_repository(spark, sf):
    path = fresh_folder(spark, "chunk-table")
    chunks = chunked(spark, sf)
    CS.upsert_chunks(spark, path, chunks)
    CS.delete_repository(spark, path, "src3")
    return CS.chunk_count(CS.read_chunks(spark, path, chunks.schema))


@register("chunk_count", f"WITH {CHUNKED} SELECT repository_id, count(*) AS n_chunks FROM chunks GROUP BY 1")
def chunk_count(spark, sf):
    return CS.chunk_count(chunked(spark, sf))


@register("chunk_scan", f"""WITH {CHUNKED} SELECT file_path, start_line FROM chunks WHERE repository_id IN ('src1', 'src2', 'src3') AND language IN ('markdown', 'yaml') AND starts_with(file_path, 'en/')""")
def chunk_scan(spark, sf):
    flt = F.struct(F.array(F.lit("src1"), F.lit("src2"), F.lit("src3")).alias("repository_ids"), F.lit("main").alias("branch"),
                   F.array(F.lit("md"), F.lit(".yml")).alias("file_types"), F.lit("en/").alias("path_prefix"),
                   F.lit(None).alias("chunk_types")).cast(S.FILTER)
    return CS.chunk_scan(chunked(spark, sf), flt).select("file_path", F.col("start_line").cast("bigint").alias("start_line"))


_HASHED = """words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents),
slots AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS slot, count(*) AS c FROM words GROUP BY 1, 2),
vecs AS (SELECT doc_id, i, CAST(coalesce(sum(CASE WHEN slot = 2 * i THEN c WHEN slot = 2 * i + 1 THEN -c END), 0) AS DOUBLE) AS v FROM documents CROSS JOIN range(0, 32) r(i) LEFT JOIN slots USING (doc_id) GROUP BY 1, 2),
norms AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM vecs GROUP BY 1)"""


@register("embed_documents", f"WITH {_HASHED} SELECT doc_id, CAST(i AS BIGINT) AS dim, round(CASE WHEN n = 0 THEN 0 ELSE v / n END, 3) AS value FROM vecs JOIN norms USING (doc_id)")
def embed_documents(spark, sf):
    out = E.embed_documents(I.documents(spark, sf).select("doc_id", "text"), "hash-32")
    return out.select("doc_id", F.posexplode("embedding").alias("dim", "value")).select(
        "doc_id", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("value").cast("double"), 3).alias("value"))
