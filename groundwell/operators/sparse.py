"""Sparse retrieval: BM25 over code-aware tokens, statistics per scope.

The text is tokenised once into a token table (one row per chunk, no shuffle) that is written to the shared folder;
everything after reads its columns.  Term statistics need one shuffle of (term, count) rows.  Postings of the terms
that queries ask for are written with their impact, the part of a score that does not depend on the query.  Chunks are
dealt by their id to as many tasks as their tokens, and later the pairs they form, call for: a pair of query and chunk
is summed up where the chunk's postings lie, and no task holds more than about a fixed number of either.  A ranking
keeps each task's best rows per query, and only these are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as T
from ..session import settle
from .scope import scope_chunks, with_scope
from .topk import largest_top_k, top_k_of

# sums of floats depend on row order; scores are rounded to this, so that ties are ties
SCORE_DIGITS = 9
# postings of one term under one key of a join, about
SALT_ROWS = 200_000
# postings that one task tallies, and rows of (query, chunk, term) that one task adds up, about
TASK_ROWS = 250_000
# short chunks of a scope that are tried as proof that a query does not match everything
WITNESSES = 64

FILTERED = ["repository_id", "branch", "language", "chunk_type", "file_path"]


def token_table(chunks: DataFrame) -> DataFrame:
    """One row per chunk: chunk_id, tokens, length and the columns filters use.

    Pass a stored token table instead of chunks wherever chunks are expected to
    search the same corpus again.
    """
    if "tokens" in chunks.columns:
        return chunks
    keys = [c for c in FILTERED if c in chunks.columns]
    tokens = T.code_tokens(F.coalesce(F.col("text"), F.lit("")))
    return settle(chunks.select("chunk_id", *keys, tokens.alias("tokens")), "tokens")


def token_rows(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(scope_id, chunk_id, tokens, length) of every chunk a scope admits."""
    scoped = scope_chunks(queries, token_table(chunks), ["chunk_id", "tokens"])
    return scoped.withColumn("length", F.size("tokens"))


def term_counts(rows: DataFrame) -> DataFrame:
    """(scope_id, term, df, total): chunks per term.

    The empty term stands for "any chunk": its df is the corpus size and its
    total the summed length, so one pass over the text gives all statistics.
    """
    seen = F.explode(F.concat(F.array_distinct("tokens"), F.array(F.lit("")))).alias("term")
    return rows.select("scope_id", "length", seen).groupBy("scope_id", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("length").alias("total"))


def corpus_stats(counts: DataFrame) -> DataFrame:
    """(scope_id, n_chunks, mean_length, floor_idf).

    The mean idf is taken over a histogram of df values, which is far smaller
    than the vocabulary.  Conditional sums instead of filters keep the one
    shuffle of ``term_counts`` shared by all its readers.
    """
    whole = F.col("term") == ""
    corpus = counts.groupBy("scope_id").agg(
        F.max(F.when(whole, F.col("df"))).alias("n_chunks"), F.max(F.when(whole, F.col("total"))).alias("length"))
    histogram = counts.groupBy("scope_id", "df").agg(F.count_if(~whole).alias("n_terms"))
    idf = F.col("n_terms") * _raw_idf()
    floor = histogram.join(corpus, "scope_id").groupBy("scope_id").agg(
        (fv.BM25_EPSILON * F.try_divide(F.sum(idf), F.sum("n_terms"))).alias("floor_idf"))
    return corpus.join(floor, "scope_id").select(
        "scope_id", "n_chunks", (F.col("length") / F.col("n_chunks")).alias("mean_length"), "floor_idf")


def _raw_idf():
    return F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def with_idf(counted: DataFrame, corpus: DataFrame) -> DataFrame:
    """Add idf and mean_length to rows that have scope_id and df.

    A term in more than half of the chunks has a negative idf, which is
    replaced by epsilon times the mean idf of all terms.
    """
    return counted.join(corpus, "scope_id").withColumn(
        "idf", F.when(_raw_idf() < 0, F.col("floor_idf")).otherwise(_raw_idf()))


def bm25_stats(chunks: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Term statistics of a corpus: scope_id, term, df, idf, n_chunks, mean_length."""
    rows = token_rows(chunks.select("chunk_id") if queries is None else queries, chunks)
    counts = settle(term_counts(rows), "terms")
    return with_idf(counts.where(F.col("term") != ""), corpus_stats(counts)).select(
        "scope_id", "term", "df", "idf", "n_chunks", "mean_length")


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, scope_id, term, weight): a repeated query word weighs more."""
    return (
        with_scope(queries)
        .select("query_id", "scope_id", F.explode(T.code_tokens(F.col("query"))).alias("term"))
        .groupBy("query_id", "scope_id", "term").agg(F.count(F.lit(1)).alias("weight"))
    )


def postings(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(scope_id, chunk_id, length, term, tf), only for terms that some query holds."""
    wanted = query_terms(queries).select("scope_id", "term").distinct()
    tokens = rows.select("scope_id", "chunk_id", "length", F.explode("tokens").alias("term"))
    return _tally_terms(tokens.join(wanted, ["scope_id", "term"], "left_semi"))


def _tally_terms(tokens: DataFrame, *along: str) -> DataFrame:
    """Term frequencies per chunk; ``along`` are columns that the term decides."""
    return tokens.groupBy("scope_id", "chunk_id", "term").agg(
        F.max("length").alias("length"), *[F.max(c).alias(c) for c in along], F.count(F.lit(1)).alias("tf"))


def _weighted_terms(queries: DataFrame, counts: DataFrame, corpus: DataFrame) -> DataFrame:
    """Query terms with what they multiply an impact by: (query_id, scope_id, term, df, mean_length, gain)."""
    joined = with_idf(query_terms(queries).join(counts, ["scope_id", "term"]), corpus)
    gain = F.coalesce(F.col("weight") * F.col("idf") * (fv.BM25_K1 + 1), F.lit(0.0))
    return joined.select("query_id", "scope_id", "term", "df", "mean_length", gain.alias("gain"))


class SparseIndex:
    """What queries and chunks have in common: weighted query terms and the postings of these terms.

    ``weighted``: query_id, scope_id, term, df, gain, salts.  ``postings``: scope_id, term, salt, chunk_id, impact.
    A term of many chunks is several keys (``salts`` of them), so that no join meets all its postings in one task.
    """

    def __init__(self, queries: DataFrame, chunks: DataFrame, salt_rows: int = SALT_ROWS):
        self.tokens = token_table(chunks)
        self.rows = token_rows(queries, self.tokens)
        counts = settle(term_counts(self.rows), "terms")
        self.corpus = corpus_stats(counts)  # a row per scope
        weighted = _weighted_terms(queries, counts, self.corpus).withColumn(
            "salts", F.ceil(F.col("df") / salt_rows).cast("int"))
        # written, so that Spark knows its true size when it plans the joins
        self.weighted = settle(weighted, "query-terms")
        wanted = self.weighted.select("scope_id", "term", "df", "mean_length", "salts").distinct()
        # dealt before a chunk is repeated for each scope
        dealt = token_rows(queries, self._dealt(self.tokens, wanted))
        tokens = dealt.select("scope_id", "chunk_id", "length", F.explode("tokens").alias("term"))
        tallied = _tally_terms(tokens.join(wanted.drop("df"), ["scope_id", "term"]), "mean_length", "salts")
        norm = fv.BM25_K1 * (1 - fv.BM25_B + fv.BM25_B * F.col("length") / F.col("mean_length"))
        self.postings = settle(tallied.select(
            "scope_id", "term", F.pmod(F.xxhash64("chunk_id"), F.col("salts")).cast("int").alias("salt"), "chunk_id",
            (F.col("tf") / (F.col("tf") + norm)).alias("impact")), "postings")

    @staticmethod
    def _dealt(rows: DataFrame, terms: DataFrame) -> DataFrame:
        """``rows`` by chunk, in as many tasks as the rows call for that they share with ``terms`` (df)."""
        total = terms.agg(F.sum("df")).first()[0] or 0
        return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_ROWS)), "chunk_id")

    def matches(self, terms: DataFrame) -> DataFrame:
        """(query_id, scope_id, chunk_id, score) for every pair that shares one of ``terms`` (rows of ``weighted``).

        Where the terms are few enough to be sent to all tasks, no pair is shuffled.
        """
        if terms.isEmpty():  # nothing is read
            return terms.sparkSession.createDataFrame(
                [], "query_id string, scope_id string, chunk_id string, score double")
        salted = terms.select("query_id", "scope_id", "term", "gain",
                              F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        return self._dealt(self.postings, terms).join(salted, ["scope_id", "term", "salt"]).groupBy(
            "query_id", "scope_id", "chunk_id").agg(F.sum(F.col("gain") * F.col("impact")).alias("score"))

    def completed(self, pairs: DataFrame, terms: DataFrame) -> DataFrame:
        """(query_id, chunk_id, score) of those of ``pairs`` (query_id, scope_id, chunk_id) that share a term."""
        asked = pairs.join(terms.select("query_id", "scope_id", "term", "gain"), ["query_id", "scope_id"])
        return asked.join(self.postings.drop("salt"), ["scope_id", "term", "chunk_id"]).groupBy(
            "query_id", "chunk_id").agg(F.sum(F.col("gain") * F.col("impact")).alias("score"))


def bm25_score(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) for every pair that shares a term; all other pairs score 0."""
    index = SparseIndex(queries, chunks)
    return index.matches(index.weighted).select("query_id", "chunk_id", F.round("score", SCORE_DIGITS).alias("score"))


class SparseLeg:
    """BM25 ranking of all queries, with the zero-score chunks that may be needed.

    A chunk without a match scores 0 and still ranks.  Fewer than k chunks score above 0 only for some queries, and
    the zero rows they need lie among the first 2k chunk ids of the scope, which are carried along.  Where the mean
    idf of a scope is negative a match may score below 0 and zero rows may lie anywhere: a query with such a term is
    scored against every chunk of its scope.

    ``pairs`` (query_id, chunk_id) names chunks whose scores are wanted too.
    """

    def __init__(self, queries: DataFrame, chunks: DataFrame, factor: int = 1, pairs: DataFrame | None = None,
                 salt_rows: int = SALT_ROWS, witnesses: int = WITNESSES):
        self.most = largest_top_k(queries) * factor
        self.witnesses = witnesses
        self.pairs = pairs
        self.asked = with_scope(queries).select("query_id", "scope_id", (top_k_of(queries) * factor).alias("pool"))
        self.index = SparseIndex(queries, chunks, salt_rows)
        # ``safe``: a query without a negative gain
        safe = F.min("gain").over(Window.partitionBy("query_id")) >= 0
        self.terms = settle(self.index.weighted.withColumn("safe", safe), "sparse-terms")

    @property
    def scores(self) -> DataFrame:
        """(query_id, chunk_id, score) of all pairs that share a term, and of chunks without a match that may rank."""
        full = self.index.matches(self.terms).select("query_id", "chunk_id", F.round("score", SCORE_DIGITS).alias("score"))
        return full.unionByName(self._unmatched().withColumn("score", F.lit(0.0)))

    def _unmatched(self) -> DataFrame:
        """(query_id, chunk_id): the zero rows that a query may need."""
        ids = self.index.rows.select("scope_id", "chunk_id")
        by_id = Window.partitionBy("scope_id").orderBy("chunk_id")
        # the literal bound drops rows before the shuffle
        first = ids.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= 2 * self.most)
        # both written, so that Spark knows their true sizes when it plans the joins
        few = settle(first.join(self.asked, "scope_id").where(F.col("n") <= 2 * F.col("pool")).select(
            "query_id", "scope_id", "chunk_id").distinct(), "sparse-first")
        tried = settle(few.join(self.terms.select("query_id", "scope_id", "term"), ["query_id", "scope_id"]), "sparse-tried")
        matched = tried.join(self.index.postings.select("scope_id", "term", "chunk_id"), ["scope_id", "term", "chunk_id"])
        zeros = few.join(matched.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti").select(
            "query_id", "chunk_id")
        unsafe = self.terms.where(~F.col("safe"))
        if unsafe.isEmpty():
            return zeros
        every = ids.join(unsafe.select("query_id", "scope_id").distinct(), "scope_id").select("query_id", "chunk_id")
        return zeros.unionByName(every.join(
            self.index.matches(unsafe), ["query_id", "chunk_id"], "left_anti")).distinct()

    def ranked(self) -> DataFrame:
        """query_id, chunk_id, score, rank: the first ``factor * top_k`` of each query."""
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        limited = self.scores.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= self.most)
        return (
            limited.join(self.asked.select("query_id", "pool"), "query_id").where(F.col("__n") <= F.col("pool"))
            .select("query_id", "chunk_id", "score", (F.col("__n") - 1).alias("rank"))
        )

    def ranges(self, ranked: DataFrame) -> DataFrame:
        """query_id, s_lo, s_hi: score range of each query over its whole scope; ``ranked`` is this leg's ranking.

        A query with no negative gain that leaves one chunk unmatched has 0 for its least score.  The shortest chunks
        of the scope show that for most queries; the others are scored against all chunks.
        """
        shortest = Window.partitionBy("scope_id").orderBy("length", "chunk_id")
        tried = self.index.rows.withColumn("n", F.row_number().over(shortest)).where(F.col("n") <= self.witnesses)
        held = tried.select("scope_id", "chunk_id", F.explode(F.array_distinct("tokens")).alias("term")).join(
            self.terms.select("query_id", "scope_id", "term"), ["scope_id", "term"]).groupBy("query_id").agg(
            F.countDistinct("chunk_id").alias("hit"))
        n_tried = tried.groupBy("scope_id").agg(F.count(F.lit(1)).alias("tried"))
        safe = self.terms.groupBy("query_id").agg(F.min("safe").alias("safe"))
        sized = settle(
            self.asked.select("query_id", "scope_id").join(self.index.corpus.select("scope_id", "n_chunks"), "scope_id")
            .join(n_tried, "scope_id").join(held, "query_id", "left").join(safe, "query_id", "left").select(
                "query_id", "n_chunks", (F.coalesce("safe", F.lit(True)) & (F.coalesce("hit", F.lit(0)) < F.col("tried")))
                .alias("open")), "sparse-ranges")
        needy = self.terms.join(sized.where(~F.col("open")).select("query_id"), "query_id", "left_semi")
        least = self.index.matches(needy).groupBy("query_id").agg(
            F.round(F.min("score"), SCORE_DIGITS).alias("lo"), F.count(F.lit(1)).alias("matched"))
        top = ranked.groupBy("query_id").agg(F.max("score").alias("s_hi"))
        all_matched = ~F.col("open") & (F.coalesce("matched", F.lit(0)) == F.col("n_chunks"))
        return sized.join(least, "query_id", "left").join(top, "query_id").select(
            "query_id", F.when(all_matched, F.col("lo")).otherwise(
                F.least(F.coalesce("lo", F.lit(0.0)), F.lit(0.0))).alias("s_lo"), "s_hi")

    def pair_scores(self) -> DataFrame:
        """Scores of the given pairs that lie in the scope of their query."""
        mine = self.pairs.select("query_id", "chunk_id").join(self.asked.select("query_id", "scope_id"), "query_id")
        # only the chunks named are looked at
        admitted = mine.join(self.index.rows.select("scope_id", "chunk_id"), ["scope_id", "chunk_id"])
        return admitted.join(self.index.completed(mine, self.index.weighted), ["query_id", "chunk_id"], "left").select(
            "query_id", "chunk_id", F.round(F.coalesce("score", F.lit(0.0)), SCORE_DIGITS).alias("score"))


def sparse_topk(queries: DataFrame, chunks: DataFrame, **options) -> DataFrame:
    """BM25 top-k per query: query_id, chunk_id, score, rank (0-based), retriever.

    ``queries``: query_id, query, optionally top_k and filter.
    ``chunks``: chunk_id, text, and the filtered columns if filters are used.
    """
    return SparseLeg(queries, chunks, **options).ranked().withColumn("retriever", F.lit("sparse"))
