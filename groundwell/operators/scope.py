"""Which chunks a question may see.

A question carries a filter: repositories, branch, file types, chunk types and
a path prefix, each optional.  Distinct filters become *scopes*; a chunk is
paired with every scope that admits it by an equi-join, never by comparing
every chunk with every filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import paths as P
from ..functions import text as T
from ..functions.coerce import coerce_str_list
from ..session import settle

FILTER = (
    "struct<repository_ids:array<string>,branch:string,file_types:array<string>,"
    "path_prefix:string,chunk_types:array<string>>"
)
ANY = "\u0001"
EVERYTHING = "everything"
# letters of the name a path prefix ends in that are part of a key
NAME_LETTERS = 3


def _or_null(values: Column) -> Column:
    """NULL for a missing or empty list: no constraint."""
    return F.when(F.size(values) > 0, values)


def retrieval_filter(flt: Column, repository_id: Column, branch: Column, language: Column,
                     chunk_type: Column, file_path: Column) -> Column:
    """The filter as a predicate over one chunk; unset parts admit everything."""

    def member(values: Column, value: Column) -> Column:
        return F.coalesce(F.size(values) < 1, F.lit(True)) | F.coalesce(
            F.array_contains(values, value), F.lit(False))

    languages = F.transform(flt["file_types"], P.extension_language)
    wanted_branch = F.coalesce(flt["branch"], F.lit(""))
    return (
        member(flt["repository_ids"], repository_id)
        & ((wanted_branch == "") | (wanted_branch == branch))
        & member(languages, language)
        & member(flt["chunk_types"], chunk_type)
        & F.startswith(file_path, F.coalesce(flt["path_prefix"], F.lit("")))
    )


def scope_filter(planned: Column, repository_ids: Column, branch: Column) -> Column:
    """A planner may narrow a request, never widen it."""
    kinds = F.filter(coerce_str_list(planned["chunk_types"]), lambda c: c.isin(fv.CHUNK_TYPES))
    prefix = F.nullif(T.strip_space(planned["path_prefix"]), F.lit(""))
    return F.struct(
        _or_null(repository_ids).alias("repository_ids"),
        branch.cast("string").alias("branch"),
        _or_null(coerce_str_list(planned["file_types"])).alias("file_types"),
        prefix.alias("path_prefix"),
        _or_null(kinds).alias("chunk_types"),
    ).cast(FILTER)


def scope_id(flt: Column) -> Column:
    """One id per distinct filter; no filter at all is ``everything``."""
    tidy = F.struct(
        F.array_sort(F.array_distinct(_or_null(flt["repository_ids"]))).alias("r"),
        F.nullif(flt["branch"], F.lit("")).alias("b"),
        F.array_sort(F.array_distinct(F.transform(_or_null(flt["file_types"]), P.extension_language))).alias("l"),
        F.nullif(flt["path_prefix"], F.lit("")).alias("p"),
        F.array_sort(F.array_distinct(_or_null(flt["chunk_types"]))).alias("c"),
    )
    text = F.to_json(tidy)
    return F.when(F.coalesce(text, F.lit("{}")) == "{}", F.lit(EVERYTHING)).otherwise(F.sha2(text, 256))


def with_scope(queries: DataFrame) -> DataFrame:
    """Queries with their scope_id; queries without a filter column see everything."""
    if "scope_id" in queries.columns:
        return queries
    if "filter" not in queries.columns:
        return queries.withColumn("scope_id", F.lit(EVERYTHING))
    return queries.withColumn("scope_id", scope_id(F.col("filter")))


def prefix_place(prefix: Column) -> tuple[Column, Column]:
    """(folders above the end of a path prefix, how many letters of the name below them count as a key)."""
    name = F.substring_index(prefix, "/", -1)
    return F.size(F.split(prefix, "/")) - 1, F.least(F.length(name), F.lit(NAME_LETTERS))


def path_key(path: Column, folders: Column, letters: Column) -> Column:
    """A path's first ``folders`` folders and the first ``letters`` letters of what comes next; NULL if it has fewer.

    Equal for a path and for every prefix of it that ends at or after this point.
    """
    parts = F.split(path, "/")
    above = F.array_join(F.slice(parts, F.lit(1), folders), "/")
    next_part = F.get(parts, folders)
    return F.when(F.size(parts) > folders, F.concat_ws("/", above, F.substring(next_part, F.lit(1), letters)))


def scope_chunks(queries: DataFrame, chunks: DataFrame, keep: list[str]) -> DataFrame:
    """(scope_id, chunk) rows for every chunk a scope admits.

    Each filter constrains some of repository, branch, language, chunk type and path.  A chunk looks filters up by
    the values of exactly those columns, once per combination in use, so the join has a key whatever the filter is.
    A path prefix is looked up by its folders, and by the first letters of the name it ends in; prefixes of one depth
    are one combination, and what is left of a prefix is checked after the join.
    """
    if "filter" not in queries.columns:
        return chunks.select(F.lit(EVERYTHING).alias("scope_id"), *keep)

    def parts(values: Column) -> Column:
        return F.coalesce(_or_null(values), F.array(F.lit(ANY)))

    flt = F.col("filter")
    prefix = F.coalesce(flt["path_prefix"], F.lit(""))
    folders, letters = prefix_place(prefix)
    filters = (
        with_scope(queries).select("scope_id", "filter").dropDuplicates(["scope_id"])
        .select("scope_id", prefix.alias("__prefix"), folders.alias("__folders"), letters.alias("__letters"),
                parts(flt["repository_ids"]).alias("r"),
                F.coalesce(F.nullif(flt["branch"], F.lit("")), F.lit(ANY)).alias("b"),
                parts(F.transform(flt["file_types"], P.extension_language)).alias("l"),
                parts(flt["chunk_types"]).alias("c"))
        .withColumn("r", F.explode("r")).withColumn("l", F.explode("l")).withColumn("c", F.explode("c"))
    )
    below = path_key(F.col("__prefix"), F.col("__folders"), F.col("__letters"))
    key = F.concat_ws("\u0002", "r", "b", "l", "c", below)
    mask = sum((F.when(F.col(n) != ANY, F.lit(1 << i)).otherwise(F.lit(0)) for i, n in enumerate("rblc")), F.lit(0))
    # written, so that Spark knows the true size when it plans the join
    filters = settle(filters.select(
        "scope_id", "__prefix", F.struct(mask.cast("int").alias("mask"), F.col("__folders").alias("folders"),
                                         F.col("__letters").alias("letters")).alias("__shape"),
        key.alias("__key")).distinct(), "scopes")
    # sixteen for each depth of a prefix and number of letters, however many filters there are
    shapes = [tuple(r[0]) for r in filters.select("__shape").distinct().collect()]
    shape = F.col("__shape")

    def part(bit: int, column: str) -> Column:
        on = shape["mask"].bitwiseAND(F.lit(1 << bit)) != 0
        return F.when(on, F.coalesce(F.col(column), F.lit("\u0003"))).otherwise(F.lit(ANY))

    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("mask", "folders", "letters"), s)]) for s in shapes])
    listed = listed.cast("array<struct<mask:int,folders:int,letters:int>>")
    place = path_key(F.col("file_path"), shape["folders"], shape["letters"])
    looked_up = (
        chunks.withColumn("__shape", F.explode(listed)).withColumn("__place", place).where("__place is not null")
        .withColumn("__key", F.concat_ws("\u0002", part(0, "repository_id"), part(1, "branch"), part(2, "language"),
                                         part(3, "chunk_type"), F.col("__place")))
    )
    return (
        looked_up.join(filters, ["__shape", "__key"])
        .where(F.startswith(F.col("file_path"), F.col("__prefix")))
        .select("scope_id", *keep)
    )
