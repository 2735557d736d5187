import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundwell import fixed_values as fv
from groundwell.functions import coerce as C
from groundwell.functions import jsontext as J
from groundwell.functions import paths as P
from groundwell.functions import text as T


def values(spark, column, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, t string")
    return [r[0] for r in df.select("i", column.alias("v")).orderBy("i").select("v").collect()]


def random_texts(alphabet, n=150):
    found = []

    @settings(max_examples=n, deadline=None, derandomize=True, database=None)
    @given(st.text(alphabet=alphabet, max_size=25))
    def gather(x):
        found.append(x)

    gather()
    return found


def test_split_lines_is_splitlines(spark):
    texts = random_texts("ab \n\r\x0b\x0c\x1c\x1d\x1e\x85  ") + ["", "\n", "a\n\n", "\r\n"]
    assert values(spark, T.split_lines(F.col("t")), texts) == [x.splitlines() for x in texts]


def test_strip_and_blank(spark):
    texts = random_texts("ab\t \n   \x1f​")
    assert values(spark, T.strip_space(F.col("t")), texts) == [x.strip() for x in texts]
    assert values(spark, T.is_blank(F.col("t")), texts) == [not x.strip() for x in texts]
    assert values(spark, T.strip_newlines(F.col("t")), texts) == [x.strip("\n") for x in texts]
    assert values(spark, T.oneline(F.col("t")), texts) == [" ".join(x.split()) for x in texts]


def bag(text):
    """The token rules said again, word by word."""
    out = []
    for word in re.findall("[A-Za-z0-9_]+", text):
        whole = word.lower()
        out.append(whole)
        for part in filter(None, word.split("_")):
            if part.lower() != whole:
                out.append(part.lower())
            marked = re.sub("([A-Z])([A-Z][a-z])", r"\1 \2", re.sub("([a-z0-9])([A-Z])", r"\1 \2", part))
            out += [h for h in marked.lower().split() if h not in (whole, part.lower())]
    return sorted(out)


def test_code_tokens(spark):
    texts = random_texts("aBCd_9 é-İK") + ["fetchData_helper", "HTTPServerError", "__init__", "a_b_aB", "___"]
    got = [sorted(x) for x in values(spark, T.code_tokens(F.col("t")), texts)]
    assert got == [bag(x) for x in texts]


def test_code_tokens_of_long_texts_need_no_lambda(spark):
    texts = ["plain words, " * 20_000, "fetchData_helper " * 10_000, "A" * 50_000 + "b_" + "c" * 50_000, "aB" * 20_000]
    got = [sorted(x) for x in values(spark, T.code_tokens(F.col("t")), texts)]
    assert got == [bag(x) for x in texts]
    assert "lambda" not in str(T.code_tokens(F.col("t")))


def test_content_terms(spark):
    texts = ["The quick_Fox and a db of getUser 42 404", "", "is it"]
    want = [{w.lower() for w in re.findall(r"[A-Za-z0-9_]+", x) if len(w) >= 3 and w.lower() not in fv.STOPWORDS} for x in texts]
    assert [set(x) for x in values(spark, T.content_terms(F.col("t")), texts)] == want


def test_languages(spark):
    paths = ["a/b.py", "Dockerfile", "x/.env", "x/.env.py", "a.TSX", "go.mod", "noext", "..hidden", "a.b.md", "x.weird", "requirements.txt"]
    want = ["python", "dockerfile", None, "python", "tsx", "go", None, None, "markdown", None, "text"]
    assert values(spark, P.detect_language(F.col("t")), paths) == want


def test_indexable(spark):
    paths = ["a.py", "yarn.lock", "x.lock", "a.min.js", "a.png", "LICENSE", "x.weird", "notes.txt", ".env", "a.parquet"]
    assert values(spark, P.is_indexable(F.col("t"), F.lit(10)), paths) == [True, False, False, False, False, True, False, True, False, False]
    assert values(spark, P.is_indexable(F.lit("a.py"), F.length("t")), ["", "x"]) == [False, True]


def test_file_mentions(spark):
    texts = ["see `src/app.py`, and ./lib/x.ts. Version 3.11 or e.g. main.go.", "..py no", "a/b.c/d"]
    got = [set(x) for x in values(spark, P.file_mentions(F.col("t")), texts)]
    assert got[0] == {"src/app.py", "/lib/x.ts", "main.go", "e.g"}
    assert got[1] == set()


def test_glob(spark):
    import fnmatch

    names = ["a.md", "b.mdx", "README.md", "x[1].py", "ab.py", "a+b.txt", ".md"]
    for pattern in ["*.md", "?.m*", "[!a]*", "[ab]*.p?", "a+b.*", "*[[]1].py"]:
        want = [fnmatch.fnmatchcase(n, pattern) for n in names]
        assert values(spark, F.col("t").rlike(P.glob_regex(pattern)), names) == want, pattern


def test_extract_json(spark):
    raw = ['{"a": 1}', '```json\n{"a": 2}\n```', 'well {"a": "}"} and {"b": 1}', '{"a": [1,2,],}', "[1]", "none", None, '"text"', '{"a": {"b": "\\"{"}} x']
    got = values(spark, F.get_json_object(J.extract_json(F.col("t")), "$.a"), raw)
    assert got == ["1", "2", "}", "[1,2]", None, None, None, None, '{"b":"\\"{"}']


def test_coercion(spark):
    texts = ["0.5", "x", None, "-1", "7"]
    assert values(spark, C.clamp01(F.col("t"), 0.2), texts) == [0.5, 0.2, 0.2, 0.0, 1.0]
    assert values(spark, C.coerce_int(F.col("t"), 8, 1, 5), ["3", "x", None, "99", "-4", "3.7"]) == [3, 5, 5, 5, 1, 5]
    assert values(spark, C.coerce_bool(F.col("t")), ["Yes ", "0", None, "y"]) == [True, False, False, True]
    assert values(spark, C.coerce_confidence(F.col("t")), [" HIGH", "none", None]) == ["high", "medium", "medium"]


def test_snippets(spark):
    texts = ["\na\n", "1\n2\n3\n4", "1\n \n3\n4"]
    assert values(spark, T.trim_snippet(F.col("t"), 2), texts) == ["a", "1\n2\n… (+2 more lines)", "1\n… (+2 more lines)"]


def test_slugs_and_urls(spark):
    assert values(spark, T.slugify(F.col("t")), ["Platform Core", " --", "A&B!"]) == ["platform-core", "workspace", "a-b"]
    assert values(spark, P.repo_name_from_url(F.col("t")), ["https://x/y/z.git", "git@h:a/b/", "/"]) == ["z", "b", "repository"]
