"""Registered queries: scalar functions over text, paths and loose values."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwell import fixed_values as fv
from groundwell.functions import coerce as C
from groundwell.functions import jsontext as J
from groundwell.functions import paths as P
from groundwell.functions import text as T

from . import inputs as I

QUERIES, SQL = {}, {}


def register(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def docs(spark, sf):
    return I.documents(spark, sf)


def on_docs(name, column, sql, alias, columns=()):
    """Register a one-expression query over all documents."""
    cols = "".join(f"{c}, " for c in columns)

    @register(name, f"SELECT doc_id, {cols}{sql} AS {alias} FROM documents")
    def run(spark, sf):
        return docs(spark, sf).select("doc_id", *columns, column().alias(alias))

    return run


text = lambda: F.col("text")

# --- T1 / T2: language and chunk type by path --------------------------------
_EXTS = ["py", "Dockerfile", "tsx", "md", "txt", "YML", "env", "unknown", "go.mod", "html", "rs", ".gitignore"]
_PICK = f"list_extract([{', '.join(repr(e) for e in _EXTS)}], CAST(page_id % {len(_EXTS)} AS INT) + 1)"
PAGE_PATHS = (f"SELECT page_id, CASE WHEN {_PICK} IN ('Dockerfile', 'go.mod', '.gitignore') THEN 'd/' || {_PICK} "
              f"ELSE 'src/page' || page_id || '.' || {_PICK} END AS path, length(html) AS length FROM pages")


def page_paths(spark, sf):
    pick = F.array(*[F.lit(e) for e in _EXTS])[(F.col("page_id") % len(_EXTS)).cast("int")]
    path = F.when(pick.isin("Dockerfile", "go.mod", ".gitignore"), F.concat(F.lit("d/"), pick)).otherwise(
        F.concat(F.lit("src/page"), F.col("page_id").cast("string"), F.lit("."), pick))
    return I.table(spark, sf, "pages").select("page_id", path.alias("path"), F.length("html").cast("bigint").alias("length"))


_LANGS = {"py": "python", "Dockerfile": "dockerfile", "tsx": "tsx", "md": "markdown", "txt": "text", "YML": "yaml",
          "env": "ini", "go.mod": "go", "html": "html", "rs": "rust"}
_LANG_SQL = f"CASE {_PICK} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LANGS.items()) + " END"
_KIND_SQL = (f"CASE WHEN {_LANG_SQL} IS NULL THEN 'unknown' WHEN {_LANG_SQL} = 'markdown' THEN 'markdown' "
             f"WHEN {_LANG_SQL} = 'text' THEN 'doc' WHEN {_LANG_SQL} IN ('yaml', 'ini', 'dockerfile') THEN 'config' ELSE 'code' END")


@register("detect_language", f"SELECT page_id, path, {_LANG_SQL} AS language FROM ({PAGE_PATHS})")
def detect_language(spark, sf):
    return page_paths(spark, sf).select("page_id", "path", P.detect_language(F.col("path")).alias("language"))


@register("classify_chunk", f"SELECT page_id, {_KIND_SQL} AS chunk_type FROM pages")
def classify_chunk(spark, sf):
    return page_paths(spark, sf).select("page_id", P.classify_chunk(P.detect_language(F.col("path"))).alias("chunk_type"))


@register("is_indexable", f"""SELECT page_id, length BETWEEN 1 AND 1000000 AND {_PICK} NOT IN ('unknown', '.gitignore') AS keep
FROM ({PAGE_PATHS})""")
def is_indexable(spark, sf):
    return page_paths(spark, sf).select("page_id", P.is_indexable(F.col("path"), F.col("length"), 1_000_000).alias("keep"))


# --- T3 / T4 / T5 ----------------------------------------------------------
on_docs("content_hash", lambda: T.content_hash(text()), "sha1(text)", "hash")
on_docs("token_estimate", lambda: T.token_estimate(text()).cast("bigint"),
        "greatest(1, CAST(floor(length(text) / 4) AS BIGINT))", "tokens")


@register("split_lines", f"""SELECT doc_id, len(lines) AS n_lines, array_to_string(lines, '|') AS joined
FROM (SELECT doc_id, {I.sql_lines('text')} AS lines FROM documents)""")
def split_lines(spark, sf):
    return docs(spark, sf).select("doc_id", T.split_lines(text()).alias("l")).select(
        "doc_id", F.size("l").cast("bigint").alias("n_lines"), F.array_join("l", "|").alias("joined"))


# --- T6 / T7 / T8: tokens, with compound words made of neighbouring words ----
_CODEY = "regexp_replace(regexp_replace(text, '([a-z]) ([a-z])', '\\1_\\2', 'g'), '([a-z])\\. ([A-Z])', '\\1\\2', 'g')"


def codey(column):
    once = F.regexp_replace(column, "([a-z]) ([a-z])", "$1_$2")
    return F.regexp_replace(once, r"([a-z])\. ([A-Z])", "$1$2")


@register("code_tokens", f"""SELECT doc_id, len(t) AS n, array_to_string(list_sort(t), ' ') AS tokens
FROM (SELECT doc_id, {I.sql_code_tokens(_CODEY)} AS t FROM documents)""")
def code_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", T.code_tokens(codey(text())).alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("n"), F.array_join(F.sort_array("t"), " ").alias("tokens"))


on_docs("word_tokens", lambda: F.array_join(T.word_tokens(text()), " "), f"array_to_string({I.sql_words('text')}, ' ')", "words")
on_docs("content_terms", lambda: F.array_join(F.sort_array(T.content_terms(text())), " "),
        f"array_to_string(list_sort({I.sql_terms('text')}), ' ')", "terms")


# --- T9 and set functions over conversations ---------------------------------
CHATS = """chats AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def chats(spark, sf):
    """A user turn and the assistant turn right after it."""
    turns = I.table(spark, sf, "conversations")
    users = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    answers = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return users.join(answers, ["conv_id", "turn"])


@register("overlap_ratio", f"""WITH {CHATS} SELECT conv_id, turn,
  round({I.sql_overlap(I.sql_terms('question'), I.sql_terms('answer'))}, 6) AS ratio FROM chats""")
def overlap_ratio(spark, sf):
    q, a = T.content_terms(F.col("question")), T.content_terms(F.col("answer"))
    return chats(spark, sf).select("conv_id", "turn", F.round(T.overlap_ratio(q, a), 6).alias("ratio"))


_QT, _AT = I.sql_terms("question"), I.sql_terms("answer")


@register("term_intersect", f"WITH {CHATS} SELECT conv_id, turn, array_to_string(list_sort(list_intersect({_QT}, {_AT})), ' ') AS terms FROM chats")
def term_intersect(spark, sf):
    q, a = T.content_terms(F.col("question")), T.content_terms(F.col("answer"))
    return chats(spark, sf).select("conv_id", "turn", F.array_join(F.sort_array(F.array_intersect(q, a)), " ").alias("terms"))


@register("term_union", f"WITH {CHATS} SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_concat({_QT}, {_AT}))), ' ') AS terms FROM chats")
def term_union(spark, sf):
    q, a = T.content_terms(F.col("question")), T.content_terms(F.col("answer"))
    return chats(spark, sf).select("conv_id", "turn", F.array_join(F.sort_array(F.array_union(q, a)), " ").alias("terms"))


@register("term_subset", f"WITH {CHATS} SELECT conv_id, turn, len(list_filter({_QT}, lambda t: NOT list_contains({_AT}, t))) = 0 AS inside FROM chats")
def term_subset(spark, sf):
    q, a = T.content_terms(F.col("question")), T.content_terms(F.col("answer"))
    return chats(spark, sf).select("conv_id", "turn", (F.size(F.array_except(q, a)) == 0).alias("inside"))


# --- T10..T12: page urls as paths ---------------------------------------------
_NAME = "lower(regexp_extract(url, '[^/]*$'))"
_STEM = f"regexp_replace({_NAME}, '\\.[^.]*$', '')"


@register("basename_terms", f"""SELECT page_id, array_to_string(list_sort(list_distinct(list_concat([{_NAME}, {_STEM}],
  list_filter(string_split_regex({_STEM}, '[._\\-/]'), lambda p: length(p) >= 3)))), ' ') AS terms FROM pages""")
def basename_terms(spark, sf):
    return I.table(spark, sf, "pages").select(
        "page_id", F.array_join(F.sort_array(P.basename_terms(F.col("url"))), " ").alias("terms"))


@register("file_mentions", """SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(
   regexp_extract_all(html, '[`''"(]?([A-Za-z0-9_./\\-]+\\.[A-Za-z]{1,5})', 1), lambda t: regexp_replace(t, '^\\.+', '')),
   lambda t: contains(t, '/') OR regexp_matches(t, '\\.[A-Za-z]{1,5}$')))), ' ') AS files FROM pages""")
def file_mentions(spark, sf):
    return I.table(spark, sf, "pages").select(
        "page_id", F.array_join(F.sort_array(P.file_mentions(F.col("html"))), " ").alias("files"))


_CITED = "['en/' || (page_id % 9) || '.md', 'src/app/' || page_id || '.html', 'fr/x.txt']"


@register("path_is_cited", f"""SELECT page_id, len(list_filter({_CITED}, lambda c: c = p OR ends_with(c, '/' || p)
   OR ends_with(p, '/' || c) OR regexp_extract(c, '[^/]*$') = regexp_extract(p, '[^/]*$'))) > 0 AS cited
FROM (SELECT *, CASE page_id % 4 WHEN 0 THEN 'a/en/' || (page_id % 9) || '.md' WHEN 1 THEN 'app/' || page_id || '.html'
   WHEN 2 THEN 'other/x.txt' ELSE url END AS p FROM pages)""")
def path_is_cited(spark, sf):
    n = F.col("page_id")
    s = lambda c: c.cast("string")
    cited = F.array(F.concat(F.lit("en/"), s(n % 9), F.lit(".md")), F.concat(F.lit("src/app/"), s(n), F.lit(".html")), F.lit("fr/x.txt"))
    path = (F.when(n % 4 == 0, F.concat(F.lit("a/en/"), s(n % 9), F.lit(".md")))
            .when(n % 4 == 1, F.concat(F.lit("app/"), s(n), F.lit(".html")))
            .when(n % 4 == 2, F.lit("other/x.txt")).otherwise(F.col("url")))
    return I.table(spark, sf, "pages").select("page_id", P.path_is_cited(path, cited).alias("cited"))


# --- T13 / T14 --------------------------------------------------------------
_KW = "list_extract(string_split(question, ' '), 1) || ' ' || list_extract(string_split(question, ' '), 2)"
_KWT = I.sql_terms(_KW, 2)


@register("keyword_present", f"""WITH {CHATS} SELECT conv_id, turn, CASE WHEN len({_KWT}) > 0
  THEN len(list_filter({_KWT}, lambda t: NOT list_contains({_AT}, t))) = 0 ELSE list_contains({_AT}, lower({_KW})) END AS present FROM chats""")
def keyword_present(spark, sf):
    words = F.split(F.col("question"), " ")
    kw = F.concat(F.get(words, F.lit(0)), F.lit(" "), F.get(words, F.lit(1)))
    return chats(spark, sf).select("conv_id", "turn", T.keyword_present(kw, T.content_terms(F.col("answer"))).alias("present"))


_N = f"len({I.sql_words('text')})"
SANITY = "CASE WHEN {n} <= 5 THEN 0.3 WHEN {n} < 20 THEN 0.7 + 0.3 * ({n} - 5) / 15.0 WHEN {n} <= 600 THEN 1.0 WHEN {n} <= 1200 THEN 1.0 - 0.3 * ({n} - 600) / 600.0 ELSE 0.7 END"
on_docs("length_sanity", lambda: F.round(T.length_sanity(F.size(T.word_tokens(text()))), 6),
        f"CAST(round(CAST({SANITY.format(n=_N)} AS DOUBLE), 6) AS DOUBLE)", "factor")

# --- T15..T17: loose values from the event properties ------------------------
_LOOSE = """CASE event_id % 6 WHEN 0 THEN '0.' || (event_id % 97) WHEN 1 THEN ' High ' WHEN 2 THEN 'yes'
 WHEN 3 THEN CAST(event_id % 90 AS VARCHAR) WHEN 4 THEN NULL ELSE '' END"""


def loose(spark, sf):
    n = F.col("event_id")
    value = (F.when(n % 6 == 0, F.concat(F.lit("0."), (n % 97).cast("string"))).when(n % 6 == 1, F.lit(" High "))
             .when(n % 6 == 2, F.lit("yes")).when(n % 6 == 3, (n % 90).cast("string"))
             .when(n % 6 == 4, F.lit(None).cast("string")).otherwise(F.lit("")))
    return I.table(spark, sf, "events").select("event_id", value.alias("v"))


@register("clamp01", f"""SELECT event_id, round(CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL THEN 0.25
  ELSE least(1.0, greatest(0.0, TRY_CAST(v AS DOUBLE))) END, 6) AS score FROM (SELECT event_id, {_LOOSE} AS v FROM events)""")
def clamp01(spark, sf):
    return loose(spark, sf).select("event_id", F.round(C.clamp01(F.col("v"), 0.25), 6).alias("score"))


@register("coerce_enum", f"""SELECT event_id, CASE WHEN lower(trim(coalesce(v, ''))) IN ('low', 'medium', 'high') THEN lower(trim(v)) ELSE 'medium' END AS band
FROM (SELECT event_id, {_LOOSE} AS v FROM events)""")
def coerce_enum(spark, sf):
    return loose(spark, sf).select("event_id", C.coerce_confidence(F.col("v")).alias("band"))


@register("coerce_bool", f"""SELECT event_id, coalesce(lower(trim(v)) IN ('true', 'yes', '1', 'y'), false) AS flag,
 least(50, greatest(1, CASE WHEN regexp_full_match(trim(v), '-?[0-9]+') THEN CAST(trim(v) AS INT) ELSE 8 END)) AS top_k,
 coalesce(v, 'none') AS label, CASE WHEN trim(coalesce(v, '')) = '' THEN 0 ELSE 1 END AS items
FROM (SELECT event_id, {_LOOSE} AS v FROM events)""")
def coerce_bool(spark, sf):
    v = F.col("v")
    return loose(spark, sf).select(
        "event_id", C.coerce_bool(v).alias("flag"), C.coerce_int(v, 8, 1, 50).alias("top_k"),
        C.coerce_str(v, "none").alias("label"), F.size(C.coerce_str_list(F.array(v))).alias("items"))


# --- T18..T20 ----------------------------------------------------------------
_LN = I.sql_lines("text")
on_docs("trim_snippet", lambda: T.trim_snippet(text(), 3),
        f"CASE WHEN len({_LN}) <= 3 THEN trim(text, chr(10)) ELSE regexp_replace(array_to_string(list_slice({_LN}, 1, 3), chr(10)), '\\s+$', '') "
        f"|| chr(10) || '… (+' || (len({_LN}) - 3) || ' more lines)' END", "snippet")


@register("evidence_header", f"""WITH {I.FILES} SELECT doc_id, '[' || (doc_id % 12 + 1) || '] ' || CASE WHEN doc_id % 3 = 0 THEN repository_id ELSE repo_name END
  || ' · ' || file_path || ':' || 1 || '-' || (doc_id % 40 + 1) || CASE WHEN doc_id % 2 = 0 THEN ' (sym' || doc_id || ')' ELSE '' END AS header FROM files""")
def evidence_header(spark, sf):
    n = F.col("doc_id")
    repo = P.repo_display(F.when(n % 3 == 0, F.lit("")).otherwise(F.col("repo_name")), F.col("repository_id"))
    symbol = F.when(n % 2 == 0, F.concat(F.lit("sym"), n.cast("string")))
    return I.files(spark, sf).select("doc_id", P.evidence_header(
        n % 12 + 1, repo, F.col("file_path"), F.lit(1), n % 40 + 1, symbol).alias("header"))


on_docs("oneline", lambda: T.oneline(text()), "trim(regexp_replace(text, '[\\s]+', ' ', 'g'))", "line")
on_docs("indent_block", lambda: T.indent_block(text()), f"array_to_string(list_transform({_LN}, lambda l: '  ' || l), chr(10))", "block")
on_docs("preview", lambda: T.preview(text()), "left(replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' '), 280)", "preview")


# --- T21..T24 ----------------------------------------------------------------
@register("slugify", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'workspace' ELSE
  trim(regexp_replace(lower(trim(p_name || ' #' || p_brand || '!')), '[^a-z0-9]+', '-', 'g'), '-') END AS slug FROM part""")
def slugify(spark, sf):
    name = F.when(F.col("p_partkey") % 5 == 0, F.lit(" --! ")).otherwise(F.concat(F.col("p_name"), F.lit(" #"), F.col("p_brand"), F.lit("!")))
    return I.table(spark, sf, "part").select("p_partkey", T.slugify(name).alias("slug"))


@register("repo_name_from_url", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(rtrim(url, '/'), '[^/]*$') || '' ELSE regexp_extract(rtrim(url, '/'), '[^/]*$') END AS name FROM pages""")
def repo_name_from_url(spark, sf):
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.regexp_replace("url", "/+$", ""), F.lit(".git/"))).otherwise(F.col("url"))
    return I.table(spark, sf, "pages").select("page_id", P.repo_name_from_url(url).alias("name"))


@register("stable_id", f"WITH {I.FILES} SELECT doc_id, 'chunk_' || sha256(repository_id || '|main|' || file_path || '|1|' || doc_id || '|' || sha1(text)) AS chunk_id FROM files")
def stable_id(spark, sf):
    return I.files(spark, sf).select("doc_id", P.stable_chunk_id(
        F.col("repository_id"), F.col("branch"), F.col("file_path"), F.lit(1), F.col("doc_id"), F.sha1("text")).alias("chunk_id"))


_MARKED = "regexp_replace(text, '([a-z])\\. ', '\\1 [' || (doc_id % 9) || ']. ', 'g')"
on_docs("citation_markers",
        lambda: F.array_join(T.citation_markers(F.expr("regexp_replace(text, '([a-z])[.] ', concat('$1 [', doc_id % 9, ']. '))"), F.lit(6)), ","),
        f"array_to_string(list_filter(list_transform(regexp_extract_all({_MARKED}, '\\[(\\d{{1,3}})\\]', 1), lambda d: CAST(d AS INT)), lambda d: d >= 1 AND d <= 6), ',')",
        "markers")


# --- T25 / T28..T30 -----------------------------------------------------------
def replies(spark, sf):
    """Assistant turns wrapped as the ways a model returns JSON."""
    n = F.col("conv_id") + F.col("turn")
    body = F.to_json(F.struct(F.col("conv_id").alias("id"), F.length("text").alias("len"), F.lit("a } b {").alias("note")))
    raw = (F.when(n % 5 == 0, body).when(n % 5 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
           .when(n % 5 == 2, F.concat(F.lit("Sure: "), body, F.lit(" done")))
           .when(n % 5 == 3, F.concat(F.lit("x "), F.regexp_replace(body, r"\}$", ", }")))
           .otherwise(F.concat(F.lit("["), body)))
    return I.table(spark, sf, "conversations").select("conv_id", "turn", "text", raw.alias("raw"))


@register("extract_json", "SELECT conv_id, turn, conv_id AS id, length(text) AS len, 'a } b {' AS note FROM conversations")
def extract_json(spark, sf):
    out = replies(spark, sf).withColumn("j", J.extract_json(F.col("raw")))
    obj = F.from_json("j", "id bigint, len bigint, note string")
    return out.withColumn("o", obj).select("conv_id", "turn", "o.id", "o.len", "o.note")


@register("parse_iso_ts", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM events""")
def parse_iso_ts(spark, sf):
    iso = F.when(F.col("event_id") % 4 == 3, F.lit("not a time")).when(
        F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return I.table(spark, sf, "events").select(
        "event_id", F.date_format(C.parse_iso_ts(iso), "yyyy-MM-dd HH:mm:ss").alias("at"))


@register("mode_to_intent", """SELECT event_id, CASE WHEN m IN ('debug', 'change_review') AND coalesce(i, '') NOT IN ('debugging', 'change_review')
   THEN CASE m WHEN 'debug' THEN 'debugging' ELSE 'change_review' END
   ELSE coalesce(i, CASE m WHEN 'ask' THEN 'question' WHEN 'onboard' THEN 'onboarding' WHEN 'debug' THEN 'debugging'
     WHEN 'change_review' THEN 'change_review' WHEN 'fix_plan' THEN 'fix_plan' ELSE 'question' END) END AS intent
FROM (SELECT event_id, list_extract(['ask', 'onboard', 'debug', 'change_review', 'fix_plan', 'other'], CAST(event_id % 6 AS INT) + 1) AS m,
  list_extract(['question', NULL, 'smalltalk', 'debugging'], CAST(user_id % 4 AS INT) + 1) AS i FROM events)""")
def mode_to_intent(spark, sf):
    mode = F.array(*[F.lit(m) for m in [*fv.MODES, "other"]])[(F.col("event_id") % 6).cast("int")]
    cand = F.array(F.lit(" Question"), F.lit("dance"), F.lit("smalltalk"), F.lit("DEBUGGING"))[(F.col("user_id") % 4).cast("int")]
    return I.table(spark, sf, "events").select("event_id", C.mode_to_intent(mode, cand).alias("intent"))
