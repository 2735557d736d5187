"""Text functions as Column builders: lines, tokens, terms, snippets.

All of them stay inside the JVM.  Where a rule can be written as one regular
expression over the whole text it is, because the array lambdas of Spark are
interpreted while the regex and array built-ins are generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv

# line breaks and white space as understood by text tools that follow Unicode
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
_SPACE_SET = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACE = f"[{_SPACE_SET}]"
NON_SPACE = f"[^{_SPACE_SET}]"

# Each match passes over what gives nothing and takes the next part or hump (group 1), or nothing at the end; what
# is possessive neither recurses nor tries again.
# Parts of words that hold an underscore:
_PARTS = r"(?:[^A-Za-z0-9_]++|_++|(?<!_)[A-Za-z0-9]++(?!_))*+([A-Za-z0-9]++|\z)"
# Humps of parts that hold a boundary, which is before the last capital of a run or after a letter that is none:
_ONE_HUMP = r"(?<![A-Za-z0-9])(?:[A-Z]?[a-z0-9]++|[A-Z]++(?![a-z])[a-z0-9]*+)(?![A-Za-z0-9])"
_BOUNDARY = r"[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"
_HUMPS = (rf"(?:[^A-Za-z0-9]++|{_ONE_HUMP})*+"
          r"([A-Z]++(?![a-z])[a-z0-9]*+|[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]++|\z)")


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def ascii_lower(text: Column) -> Column:
    """Lower case in which no other letter turns into an ASCII one.

    U+0130 and U+212A are the only letters whose lower case is ASCII; words
    are ASCII, so both are separators and a blank stands in for them.
    """
    return F.lower(F.replace(F.replace(text, F.lit("\u0130"), F.lit(" ")), F.lit("\u212a"), F.lit(" ")))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` and its lambdas name it."""
    return F.transform(F.array(value), use)[0]


def strip_space(text: Column) -> Column:
    """Trim Unicode white space; the look-behind keeps long runs linear."""
    return F.regexp_replace(text, rf"\A{SPACE}+|(?<!{SPACE}){SPACE}+\z", "")


def strip_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\n+|(?<!\n)\n+\z", "")


def rstrip_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!{SPACE}){SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(NON_SPACE)


def split_lines(text: Column) -> Column:
    """Lines without their breaks; a final break opens no extra line."""

    def drop_last_empty(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    return let(F.split(text, LINE_BREAK), drop_last_empty)


def word_tokens(text: Column) -> Column:
    """Lower-case ``[A-Za-z0-9_]+`` words, duplicates kept."""
    return F.regexp_extract_all(ascii_lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def code_tokens(text: Column) -> Column:
    """Words plus the snake_case parts and camelCase humps of compound words.

    The result is a bag.  Each kind is one regex pass over a whole text that has any.
    """
    found = [F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(1))) for some, pattern in (
        (F.contains(text, F.lit("_")), _PARTS), (text.rlike(_BOUNDARY), _HUMPS))]
    extra = F.split(F.lower(F.concat_ws(" ", *found)), " ")  # ASCII letters and digits alone
    return F.concat(word_tokens(text), F.array_remove(extra, ""))


def content_terms(text: Column, min_len: int = 3) -> Column:
    """Distinct words of at least ``min_len`` characters that are no stop words."""
    words = F.regexp_extract_all(
        ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z0-9_]{{{int(min_len)},}}"), F.lit(0)
    )
    return F.array_except(words, F.array(*[F.lit(w) for w in sorted(set(fv.STOPWORDS))]))


def overlap_ratio(claim: Column, support: Column) -> Column:
    """Share of ``claim`` found in ``support``; 0 for an empty claim."""
    found = F.size(F.array_intersect(claim, support)).cast("double")
    return F.when(F.size(claim) > 0, found / F.size(claim)).otherwise(F.lit(0.0))


def keyword_present(keyword: Column, answer_terms: Column) -> Column:
    terms = content_terms(keyword, min_len=2)
    return F.when(
        F.size(terms) > 0, F.size(F.array_except(terms, answer_terms)) == 0
    ).otherwise(F.array_contains(answer_terms, F.lower(keyword)))


def length_sanity(n_tokens: Column) -> Column:
    """Length factor: short answers and walls of text count less."""
    n = n_tokens.cast("double")
    return (
        F.when(n <= 5, F.lit(0.3))
        .when(n < 20, 0.7 + 0.3 * (n - 5) / 15.0)
        .when(n <= 600, F.lit(1.0))
        .when(n <= 1200, 1.0 - 0.3 * (n - 600) / 600.0)
        .otherwise(F.lit(0.7))
    )


def content_hash(text: Column) -> Column:
    return F.sha1(text)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / fv.CHARS_PER_TOKEN)).cast("int")


def trim_snippet(text: Column, max_lines: int = fv.SNIPPET_LINES) -> Column:
    """First lines of a text and how many more there are."""
    lines = split_lines(text)
    n = F.size(lines)
    head = rstrip_space(F.array_join(F.slice(lines, 1, max_lines), "\n"))
    more = F.concat(head, F.lit("\n… (+"), (n - max_lines).cast("string"), F.lit(" more lines)"))
    return F.when(n <= max_lines, strip_newlines(text)).otherwise(more)


def oneline(text: Column) -> Column:
    return F.regexp_replace(strip_space(F.coalesce(text, F.lit(""))), f"{SPACE}+", " ")


def indent_block(text: Column, width: int = 2) -> Column:
    pad = F.lit(" " * width)
    lines = split_lines(F.coalesce(text, F.lit("")))
    return F.array_join(F.transform(lines, lambda line: F.concat(pad, line)), "\n")


def preview(text: Column, chars: int = 280) -> Column:
    flat = F.replace(strip_space(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" "))
    return F.substring(flat, 1, chars)


def slugify(name: Column) -> Column:
    dashed = F.regexp_replace(F.lower(strip_space(name)), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(dashed, r"\A-+|-+\z", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("workspace"))


def citation_markers(answer: Column, n_citations: Column) -> Column:
    """The ``[d]`` markers of an answer that name one of ``n_citations`` sources."""
    numbers = F.transform(
        F.regexp_extract_all(answer, F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda d: d.cast("int")
    )
    return F.filter(numbers, lambda d: (d >= 1) & (d <= n_citations))


def has_marker(answer: Column, index: Column) -> Column:
    return F.contains(answer, F.concat(F.lit("["), index.cast("string"), F.lit("]")))
