"""Chunking: one file row becomes line-addressed chunk rows.

Every rule works on the array of lines inside the row, so chunking is a map:
no shuffle, no window, and it also runs on a stream.  A file is bounded by the
size rule of ``is_indexable``.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .. import fixed_values as fv
from ..functions import paths as P
from ..functions import text as T

PIECE = "array<struct<start:int,end:int,symbol:string,body:string>>"
SPAN = ArrayType(StructType([
    StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("symbol", StringType()),
]))

HEADING = rf"\A#{{1,6}}{T.SPACE}+"

# How a definition begins at the left margin, and where its name is (group 1).
# Python goes through its own grammar first and only falls back to this.
_NAME = r"([A-Za-z_$][\w$]*)"
_MODIFIERS = (
    r"(?:(?:export|default|public|private|protected|internal|static|final|abstract|sealed|open|"
    r"async|pub(?:\([a-z]+\))?|unsafe|extern|inline|override|virtual|data|case|partial|const)\s+)*"
)
DEFINITION = (
    rf"\A{_MODIFIERS}(?:def|class|func|fn|function\*?|interface|trait|impl(?:<[^>]*>)?|struct|enum|"
    rf"mod|module|object|record|protocol|namespace|type|fun|sub)\s+(?:\([^)]*\)\s*)?{_NAME}"
)
# What else begins a definition in some languages, one rule each; the first rule that gives a name wins.
_C_LIKE = (
    r"\A(?!(?:return|else|if|for|while|switch|case|goto|using|typedef|new|delete|throw)\b)"
    r"[A-Za-z_][\w \t:<>,*&\[\]]*[ \t*&]([A-Za-z_~][\w:~]*)[ \t]*\([^;]*\z"
)
_ARROW = (
    rf"\A(?:export\s+(?:default\s+)?)?(?:const|let|var)\s+{_NAME}\s*(?::[^=]+)?=\s*(?:async\s*)?"
    r"(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)"
)
LANGUAGE_DEFINITIONS = [
    (["rust"], rf"\A(?:unsafe\s+)?impl(?:<[^>]*>)?\s+\S.*\sfor\s+{_NAME}"),
    (["c", "cpp", "objc", "java", "csharp", "dart", "groovy"], _C_LIKE),
    (["javascript", "typescript", "tsx", "vue", "svelte"], _ARROW),
    (["bash"], r"\A(?:function\s+)?([A-Za-z_][\w:-]*)\s*\(\s*\)"),
    (["elixir"], r"\Adef(?:module|protocol|impl|macro|macrop|p)?\s+([\w.?!]+)"),
    (["lua"], r"\A(?:local\s+)?function\s+([\w.:]+)"),
    (["haskell"], r"\A(?:(?:data|newtype|class|type)\s+([A-Z][\w']*))"),
    (["haskell"], r"\A([a-z_][\w']*)\s*::"),
    (["sql"], r"(?i)\Acreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:materialized\s+)?(?:unique\s+)?"
              r"(?:table|view|function|procedure|index|trigger|type)\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)"),
]
ANNOTATION = r"\A@[A-Za-z_]"  # belongs to the definition below it
# left-margin lines that still belong to the definition above them
CONTINUATION = r"\A(?:[\s})\]{]|end\b|\z)"


def _continues(line: Column) -> Column:
    """``CONTINUATION``, decided without a regular expression where the first character is enough."""
    return (line == "") | F.ascii(line).isin([ord(c) for c in "\t\n\x0b\f\r })]{"]) | (
        F.startswith(line, F.lit("end")) & line.rlike(CONTINUATION))


def _is_annotation(line: Column) -> Column:
    return F.startswith(line, F.lit("@")) & line.rlike(ANNOTATION)


def _is_filled(line: Column) -> Column:
    return F.ascii(F.ltrim(line)).between(33, 126) | ~T.is_blank(line)


def _line(lines: Column, index: Column) -> Column:
    return F.element_at(lines, (index + 1).cast("int"))


def _body(lines: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` (0-based) up to and without ``end``."""
    return F.array_join(F.slice(lines, (start + 1).cast("int"), (end - start).cast("int")), "\n")


def _piece(start: Column, end: Column, symbol: Column, body: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        symbol.cast("string").alias("symbol"),
        body.alias("body"),
    )


def _window_starts(n: Column, window: int, overlap: int) -> Column:
    """Offsets of the windows over ``n`` lines: the last one reaches the end."""
    step = max(1, window - overlap)
    last = F.greatest(F.lit(0), F.ceil((n - window) / step) * step).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), last, F.lit(step)))


def window_pieces(
    lines: Column,
    start: Column,
    end: Column,
    symbol: Column | None = None,
    window: int = fv.WINDOW_LINES,
    overlap: int = fv.WINDOW_OVERLAP,
) -> Column:
    """Overlapping line windows over a stretch of lines; blank windows go."""
    symbol = F.lit(None).cast("string") if symbol is None else symbol

    def cut(offset: Column) -> Column:
        first = start + offset
        stop = F.least(first + window, end)
        return _piece(first + 1, stop, symbol, _body(lines, first, stop))

    starts = F.coalesce(_window_starts(end - start, window, overlap), F.array().cast("array<int>"))
    return F.filter(F.transform(starts, cut), lambda p: ~T.is_blank(p["body"]))


def window_chunks(files: DataFrame, text: str = "text", window: int = fv.WINDOW_LINES,
                  overlap: int = fv.WINDOW_OVERLAP) -> DataFrame:
    """Line windows of every row: adds start_line, end_line and chunk_text."""
    lined = files.withColumn("__lines", T.split_lines(F.col(text)))
    pieces = window_pieces(F.col("__lines"), F.lit(0), F.size("__lines"), None, window, overlap)
    return (
        lined.select(*files.columns, F.explode(pieces).alias("__p"))
        .select(*files.columns, F.col("__p.start").alias("start_line"),
                F.col("__p.end").alias("end_line"), F.col("__p.body").alias("chunk_text"))
    )


def _sections(lines: Column) -> Column:
    """Heading-to-heading stretches, blank ones dropped."""
    n = F.size(lines)
    headings = F.filter(
        F.transform(lines, lambda line, i: F.when(F.startswith(line, F.lit("#")) & line.rlike(HEADING), i)),
        lambda i: i.isNotNull())
    starts = F.array_distinct(F.concat(F.array(F.lit(0)), headings))

    def cut(known: Column) -> Column:
        def section(start: Column, i: Column) -> Column:
            stop = F.coalesce(F.get(known, i + 1), n)
            first = _line(lines, start)
            title = F.when(first.rlike(HEADING), T.strip_space(F.regexp_replace(first, HEADING, "")))
            return _piece(start + 1, stop, title, _body(lines, start, stop))

        return F.transform(known, section)

    return F.when(
        n > 0, F.filter(T.let(starts, cut), lambda p: ~T.is_blank(p["body"]))
    ).otherwise(F.array().cast(PIECE))


def markdown_sections(files: DataFrame, text: str = "text") -> DataFrame:
    """One row per heading section, before long ones are split."""
    lined = files.withColumn("__lines", T.split_lines(F.col(text)))
    return (
        lined.select(*files.columns, F.explode(_sections(F.col("__lines"))).alias("__p"))
        .select(*files.columns, F.col("__p.start").alias("start_line"), F.col("__p.end").alias("end_line"),
                F.col("__p.symbol").alias("symbol"), F.col("__p.body").alias("chunk_text"))
    )


def split_long(pieces: Column, max_lines: int) -> Column:
    """Window-split the pieces that are longer than ``max_lines``."""

    def split(piece: Column) -> Column:
        def cut(inner: Column) -> Column:
            windows = F.transform(
                window_pieces(inner, F.lit(0), F.size(inner), piece["symbol"]),
                lambda w: _piece(piece["start"] + w["start"] - 1, piece["start"] + w["end"] - 1, w["symbol"], w["body"]),
            )
            return F.when(F.size(inner) <= max_lines, F.array(piece)).otherwise(windows)

        # the body may end in an empty line, which counts when re-split
        return T.let(T.split_lines(piece["body"]), cut)

    return F.flatten(F.transform(pieces, split))


def markdown_pieces(lines: Column) -> Column:
    return T.let(lines, lambda known: split_long(_sections(known), fv.MAX_SECTION_LINES))


def definition_name(head: Column, language: Column | None = None) -> Column:
    """The name of the definition that a left-margin line begins, or NULL."""
    own = [] if language is None else [
        F.when(language.isin(names), F.nullif(F.regexp_extract(head, rule, 1), F.lit("")))
        for names, rule in LANGUAGE_DEFINITIONS]
    return F.coalesce(*own, F.nullif(F.regexp_extract(head, DEFINITION, 1), F.lit("")))


def boundary_spans(lines: Column, language: Column | None = None) -> Column:
    """Definitions that begin at the left margin, up to the next left-margin line; annotations go with them."""
    n = F.size(lines)
    tops = F.filter(F.transform(lines, lambda line, i: F.when(
        ~_continues(line) & ~F.coalesce(_is_annotation(F.get(lines, i - 1)), F.lit(False)), i)),
        lambda i: i.isNotNull())

    def span(known: Column, start: Column, i: Column) -> Column:
        stop = F.coalesce(F.get(known, i + 1), n)

        def named(mine: Column) -> Column:
            filled = F.filter(
                F.transform(mine, lambda line, j: F.when(_is_filled(line), start + j + 1)), lambda j: j.isNotNull())
            head = F.get(F.filter(mine, lambda x: ~_is_annotation(x)), F.lit(0))
            return T.let(T.let(head, lambda x: definition_name(x, language)), lambda name: F.when(
                name.isNotNull(), F.struct(
                    (start + 1).cast("int").alias("start"), F.element_at(filled, -1).cast("int").alias("end"),
                    name.alias("symbol"))))

        return T.let(F.slice(lines, start + 1, stop - start), named)

    return T.let(tops, lambda known: F.filter(
        F.transform(known, lambda start, i: span(known, start, i)), lambda s: s.isNotNull()))


def _outermost(nodes) -> list[tuple[int, int, str | None]]:
    """Function and class spans that lie in no other function or class."""
    spans = []
    pending = list(nodes)
    while pending:
        node = pending.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = min([node.lineno, *[d.lineno for d in node.decorator_list]])
            # a decorated definition is one unit without a name of its own
            spans.append((first, node.end_lineno, None if node.decorator_list else node.name))
        else:
            pending.extend(ast.iter_child_nodes(node))
    return sorted(spans, key=lambda s: s[0])


@F.pandas_udf(SPAN)
def python_spans(texts: pd.Series) -> pd.Series:
    """Definition spans of Python sources; NULL when a source does not parse."""

    def spans(source):
        if source is None:
            return None
        try:
            found = _outermost(ast.iter_child_nodes(ast.parse(source)))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None
        return [{"start": s, "end": e, "symbol": name} for s, e, name in found]

    return texts.map(spans, na_action=None)


def definition_pieces(lines: Column, spans: Column) -> Column:
    """Definitions as pieces, the code around them as windows."""
    n = F.size(lines)

    def with_gap(span: Column, i: Column) -> Column:
        previous = F.when(i > 0, F.array_max(F.transform(F.slice(spans, 1, i), lambda s: s["end"])))
        gap_start = F.coalesce(previous, F.lit(0))
        body = _body(lines, span["start"] - 1, span["end"])
        own = split_long(F.array(_piece(span["start"], span["end"], span["symbol"], body)),
                         fv.MAX_DEFINITION_LINES)
        return F.concat(
            window_pieces(lines, gap_start, F.greatest(gap_start, span["start"] - 1)),
            F.filter(own, lambda p: ~T.is_blank(p["body"])),
        )

    tail_start = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
    return F.concat(
        F.flatten(F.transform(spans, with_gap)), window_pieces(lines, tail_start, F.greatest(tail_start, n))
    )


def _finish(pieces: DataFrame, keep: list[str]) -> DataFrame:
    """Common columns of a chunk from an exploded piece ``p``."""
    body = T.strip_newlines(F.col("p.body"))
    out = pieces.select(
        *keep, "language", "chunk_type", F.col("p.symbol").alias("symbol"),
        F.greatest(F.lit(1), F.col("p.start")).alias("start_line"),
        F.greatest(F.col("p.start"), F.col("p.end")).alias("end_line"),
        body.alias("text"),
    ).where(~T.is_blank(F.col("text")))
    out = out.withColumn("content_hash", T.content_hash(F.col("text"))).withColumn(
        "token_estimate", T.token_estimate(F.col("text")))
    return out.withColumn("chunk_id", P.stable_chunk_id(
        F.col("repository_id"), F.col("branch"), F.col("file_path"), F.col("start_line"),
        F.col("end_line"), F.col("content_hash")))


FILE_KEYS = ["repository_id", "repo_name", "branch", "commit_hash", "file_path"]


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of every file: sections, definitions or windows by language.

    ``files`` has repository_id, repo_name, branch, commit_hash, file_path and
    text.  The scan is read once: the three rules are branches of one
    expression, and only Python sources travel to a Python worker.
    """
    language = P.detect_language(F.col("file_path"))
    typed = (
        files.where(~T.is_blank(F.col("text")))
        .withColumn("language", language)
        .withColumn("chunk_type", P.classify_chunk(F.col("language")))
        .withColumn("__lines", T.split_lines(F.col("text")))
    )
    is_python = F.col("language") == "python"
    python = typed.where(is_python).withColumn(
        "__spans", F.coalesce(python_spans(F.col("text")), boundary_spans(F.col("__lines"))))
    other_code = (F.col("chunk_type") == "code") & F.col("language").isin(fv.PARSED_LANGUAGES) & ~is_python
    rest = typed.where(F.coalesce(~is_python, F.lit(True))).withColumn(
        "__spans", F.when(other_code, boundary_spans(F.col("__lines"), F.col("language"))).otherwise(F.array().cast(SPAN)))
    lines, spans = F.col("__lines"), F.col("__spans")
    pieces = F.when(F.col("chunk_type") == "markdown", markdown_pieces(lines)).otherwise(
        definition_pieces(lines, spans))
    both = python.unionByName(rest)
    return _finish(both.select(*FILE_KEYS, "language", "chunk_type", F.explode(pieces).alias("p")), FILE_KEYS)


def chunk_with(files: DataFrame, chunker) -> DataFrame:
    """Chunks by a chunker of one's own.

    ``chunker(text, file_path)`` returns (start_line, end_line, symbol, text)
    tuples; a file it fails on becomes one whole-file chunk.
    """

    def cut(text: str, path: str) -> list[dict]:
        try:
            pieces = list(chunker(text, path))
        except Exception:
            pieces = [(1, max(1, len(text.splitlines())), None, text)]
        return [{"start": s, "end": e, "symbol": name, "body": body} for s, e, name, body in pieces]

    @F.pandas_udf(ArrayType(StructType([*SPAN.elementType.fields, StructField("body", StringType())])))
    def run(texts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([cut(t, p) for t, p in zip(texts, paths)], dtype=object)

    language = P.detect_language(F.col("file_path"))
    typed = files.where(~T.is_blank(F.col("text"))).withColumn("language", language).withColumn(
        "chunk_type", P.classify_chunk(F.col("language")))
    pieces = typed.select(*FILE_KEYS, "language", "chunk_type", F.explode(run("text", "file_path")).alias("p"))
    return _finish(pieces, FILE_KEYS)
