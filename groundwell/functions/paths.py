"""Path functions: language, chunk type, selection rules, file mentions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .coerce import positive


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[key]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Directory part without the final slash; empty at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def file_extension(path: Column) -> Column:
    """Last suffix in lower case; names such as ``.env`` have none."""
    return F.regexp_extract(F.lower(basename(path)), r"^\.*[^.].*\.([^.]*)$", 1)


def detect_language(path: Column) -> Column:
    base = F.lower(basename(path))
    return F.coalesce(
        _lookup(fv.SPECIAL_FILENAMES, base), _lookup(fv.LANGUAGE_BY_EXTENSION, file_extension(path))
    )


def extension_language(file_type: Column) -> Column:
    """Language of a requested file type such as ``py`` or ``.py``; itself if unknown."""
    lowered = F.lower(file_type)
    return F.coalesce(
        _lookup(fv.LANGUAGE_BY_EXTENSION, F.regexp_replace(lowered, r"^\.+", "")), lowered
    )


def classify_chunk(language: Column) -> Column:
    return (
        F.when(language.isNull(), F.lit("unknown"))
        .when(language.isin(fv.MARKDOWN_LANGUAGES), F.lit("markdown"))
        .when(language.isin(fv.DOC_LANGUAGES), F.lit("doc"))
        .when(language.isin(fv.CONFIG_LANGUAGES), F.lit("config"))
        .otherwise(F.lit("code"))
    )


def in_skipped_dir(path: Column, names: list[str], git_prefix: bool = True) -> Column:
    """Whether a directory on the path is one that is never walked."""
    dirs = F.split(dirname(path), "/")
    skipped = F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in names]))
    if git_prefix:
        skipped = skipped | dirname(path).rlike(r"(^|/)\.git")
    return skipped


def scope_paths(path: Column, prefixes: list[str]) -> Column:
    """True when the path starts with one of the prefixes (plain string prefixes)."""
    wanted = [p.strip().strip("/") for p in prefixes if p.strip()]
    if not wanted:
        return F.lit(True)
    hit = F.lit(False)
    for prefix in wanted:
        hit = hit | path.startswith(prefix)
    return hit


def is_indexable(path: Column, length: Column, max_bytes: int | None = None) -> Column:
    """Whether a file is worth indexing, from its name and size alone; without ``max_bytes`` any size above 0 is."""
    positive(max_bytes, "max_bytes")
    name = F.lower(basename(path))
    last = F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(F.lit(""))
    suffixes = "|".join(s.replace(".", r"\.") for s in fv.EXCLUDE_SUFFIXES)
    return (
        ~name.isin(fv.EXCLUDE_FILES)
        & ~name.rlike(f"(?:{suffixes})$")
        & ~last.isin(fv.EXCLUDE_EXTENSIONS)
        & (detect_language(path).isNotNull() | last.isin("", "txt"))
        & (length.between(1, max_bytes) if max_bytes is not None else length >= 1)
    )


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename_terms(path: Column) -> Column:
    """Name, stem and the longer parts of the stem, in lower case."""
    name = F.lower(basename(forward_slashes(path)))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    parts = F.filter(F.split(stem, r"[._\-/]"), lambda p: F.length(p) >= 3)
    return F.array_distinct(F.concat(F.array(name, stem), parts))


def file_mentions(answer: Column) -> Column:
    """Path-like tokens an answer names."""
    raw = F.regexp_extract_all(
        answer, F.lit(r"[`'\"(]?([A-Za-z0-9_./\-]+\.[A-Za-z]{1,5})"), F.lit(1)
    )
    tokens = F.transform(raw, lambda t: F.regexp_replace(t, r"^\.+", ""))
    keep = F.filter(
        tokens, lambda t: F.contains(t, F.lit("/")) | t.rlike(r"\.[A-Za-z]{1,5}$")
    )
    return F.array_distinct(keep)


def path_is_cited(path: Column, cited: Column) -> Column:
    """Equal, a suffix either way at a slash, or the same file name."""
    slash = F.lit("/")
    return F.exists(
        cited,
        lambda c: (c == path)
        | F.endswith(c, F.concat(slash, path))
        | F.endswith(path, F.concat(slash, c))
        | (basename(c) == basename(path)),
    )


def repo_name_from_url(url: Column) -> Column:
    tail = F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1)
    name = F.regexp_replace(tail, r"\.git$", "")
    return F.when(tail == "", F.lit("repository")).otherwise(name)


def repo_display(repo_name: Column, repository_id: Column) -> Column:
    return F.coalesce(F.nullif(repo_name, F.lit("")), repository_id)


def location(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def evidence_header(marker: Column, repo: Column, path: Column, start: Column, end: Column, symbol: Column) -> Column:
    named = F.when(
        F.coalesce(symbol, F.lit("")) != "", F.concat(F.lit(" ("), symbol, F.lit(")"))
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("["), marker.cast("string"), F.lit("] "), repo, F.lit(" · "), location(path, start, end), named
    )


def stable_chunk_id(repository_id, branch, file_path, start_line, end_line, text_hash) -> Column:
    """The same chunk gets the same id on every run."""
    key = F.concat_ws(
        "|", repository_id, branch, file_path, start_line.cast("string"), end_line.cast("string"), text_hash
    )
    return F.concat(F.lit("chunk_"), F.sha2(key, 256))


def glob_regex(pattern: str) -> str:
    """A file-name glob as a regular expression."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            inner = pattern[i + 1 : close]
            negated, inner = inner.startswith("!"), inner.removeprefix("!")
            for special in "\\[&^":
                inner = inner.replace(special, "\\" + special)
            out.append("[" + ("^" if negated else "") + inner + "]")
            i = close
        else:
            out.append("\\" + ch if not ch.isalnum() and ch != "_" else ch)
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"
