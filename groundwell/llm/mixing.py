"""Mixing sources to target weights by drawing fixed-length blocks of words.

Every source is one long sequence of words, cut into blocks of ``BLOCK`` words.  The mix consists of output shards of
``SHARD_SLOTS`` slots.  For each shard, multinomial draws say how many slots each source fills; a source's slots are
numbered through all shards, and slot k takes the block at place k of a pseudorandom permutation of the source's
block numbers (a fresh one for each pass over the source).  Slots and blocks are joined by the block's number.  All
draws and permutations follow from the seed, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.llm.common import WORD, parts
from groundwell.llm.wordhash import mix
from groundwell.session import settle

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL = 1.5  # words of the mix for each word of the input
MOST = 2.0  # words of a source that the mix takes, at most, for each word that it has
BLOCK = 64
SHARD_SLOTS = 1 << 16
BUCKET_ROWS = 20_000
SEED = 8

SLOTS = pa.schema([("src", pa.int64()), ("shard", pa.int64()), ("block", pa.int64())])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float = TOTAL, most: float = MOST) -> list[float]:
    """Shares of ``total`` times all words by weight; what exceeds a source's bound goes to the others by weight."""
    size, weight = np.array(sizes, dtype=np.float64), np.array(weights, dtype=np.float64)
    bound, out = most * size, np.zeros(len(size))
    free = np.ones(len(size), dtype=bool)
    left = total * size.sum()
    while free.any():
        share = np.where(free, weight, 0) / weight[free].sum() * left
        over = free & (share > bound)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = bound[over]
        left -= bound[over].sum()
        free &= ~over
    return out.tolist()


def draw(quota: np.ndarray, slots: int, seed: int) -> np.ndarray:
    """Slots of each source in each shard (shards x sources); over all shards they sum to the quota.

    A shard's counts are multinomial by what is left of the quotas; counts beyond a quota are drawn anew among the
    other sources.
    """
    rng, left = np.random.default_rng(seed), quota.astype(np.int64).copy()
    rows = []
    while left.sum():
        todo = min(slots, int(left.sum()))
        got = np.zeros_like(left)
        while todo:
            open_ = left - got
            more = np.minimum(rng.multinomial(todo, open_ / open_.sum()), open_)
            got += more
            todo -= int(more.sum())
        rows.append(got)
        left -= got
    return np.array(rows).reshape(-1, len(quota))


def permute(place: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The image of each place (0 to n - 1) under a pseudorandom permutation chosen by key: a four-round Feistel
    network on the least even number of bits that holds n, walked until it lands below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, out = place.astype(np.uint64), np.full(len(place), -1, dtype=np.int64)
    todo = np.arange(len(place))
    while len(todo):
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for r in range(4):
            f = mix(right * np.uint64(0x9E3779B97F4A7C15) + key[todo] + np.uint64(r << 32)) & mask[todo]
            left, right = right, left ^ f
        x[todo] = left << half[todo] | right
        done = x[todo] < n[todo].astype(np.uint64)
        out[todo[done]] = x[todo[done]].astype(np.int64)
        todo = todo[~done]
    return out


def _slots(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for at in range(0, row["slots"], 100_000):
                    k = np.arange(row["first"] + at, row["first"] + min(row["slots"], at + 100_000))
                    n = np.full(len(k), row["blocks"], dtype=np.int64)
                    key = mix(np.full(len(k), seed * 1_000_003 + row["src"], np.uint64) + ((k // n).astype(np.uint64) << np.uint64(40)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(k), row["src"])), pa.array(np.full(len(k), row["shard"])),
                        pa.array(permute(k % n, n, key))], schema=SLOTS)

    return run


class Mix:
    """The mix of a table of documents: ``sources``, ``pieces`` (documents cut by block) and ``slots``."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, seed: int = SEED):
        spark = docs.sparkSession
        self.block = block
        sized = settle(docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            word_count(F.col("text").cast("string")).alias("size"),
            F.xxhash64(F.col("text").cast("string")).alias("h")), "sizes")
        self.sized = sized
        # one row per source reaches the driver
        found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
        found.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8")))
        sizes = [r["size"] for r in found]
        weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))]
        goal = targets(sizes, weights) if sum(sizes) else [0.0] * len(found)
        blocks = [parts(s, block, 0) for s in sizes]
        quota = np.array([min(int(MOST) * b, round(t * b / s)) if s else 0 for s, t, b in zip(sizes, goal, blocks)],
                         dtype=np.int64)
        counts = draw(quota, SHARD_SLOTS, seed) if quota.sum() else np.zeros((0, len(found)), np.int64)
        firsts = np.cumsum(counts, axis=0) - counts
        plan = [(int(i), int(j), int(firsts[i, j]), int(counts[i, j]), blocks[j]) for i, j in zip(*np.nonzero(counts))]
        self.sources = spark.createDataFrame(
            [(i, r.source, s, g, b) for i, (r, s, g, b) in enumerate(zip(found, sizes, goal, blocks))],
            "src long, source string, source_size long, target double, blocks long")
        shards = spark.createDataFrame(plan, "shard long, src long, first long, slots long, blocks long")
        spread = shards.repartition(parts(len(plan), 64), "shard", "src")
        self.slots = spread.mapInArrow(_slots(seed), "src long, shard long, block long")
        keyed = sized.join(self.sources.select("src", "source", "source_size", "target"),
                           sized.source.eqNullSafe(self.sources.source)).select(
            "doc_id", sized.source, "size", "h", "src", "source_size", "target")
        # places within a source in two steps, so that no window holds a whole source
        buckets = parts(sum(r["rows"] for r in found), BUCKET_ROWS)
        keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)))
        inner = Window.partitionBy("src", "bucket").orderBy("doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
        number = Window.partitionBy("src", "bucket").orderBy("doc_id", "h")
        outer = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        base = keyed.groupBy("src", "bucket").agg(F.sum("size").alias("words")).select(
            "src", "bucket", F.coalesce(F.sum("words").over(outer), F.lit(0)).alias("base"))
        placed = keyed.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0))).withColumn(
            "nth", F.row_number().over(number)).join(base, ["src", "bucket"])
        self.placed = settle(placed.select(
            "doc_id", "source", "size", "h", "src", "source_size", "target", "bucket", "nth",
            (F.col("base") + F.col("before")).alias("start")), "placed")

    def pieces(self) -> DataFrame:
        """One row per document and block that it lies in, with how often the mix takes that block."""
        first, last = F.expr(f"start div {self.block}"), F.expr(f"(start + size - 1) div {self.block}")
        cut = self.placed.where("size > 0").select(
            "src", "bucket", "nth", "doc_id", "h", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
        drawn = self.slots.groupBy("src", "block").agg(F.count("*").alias("times"))
        words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * self.block) - F.greatest(
            F.col("start"), F.col("block") * self.block)
        return cut.join(drawn, ["src", "block"]).withColumn("words", words)

    def taken(self) -> DataFrame:
        got = self.pieces().groupBy("src", "bucket", "nth").agg(F.sum(F.col("times") * F.col("words")).alias("taken"))
        return self.placed.join(got, ["src", "bucket", "nth"], "left").select(
            "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mix_sources(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words that the mix takes, repeats counted) for every row.

    Sources are ordered by code point, null last, and weigh 5, 2, 1, repeating.  A null text has no words, and such
    rows are returned with taken = 0.  Rows that share id, source and text are each placed.  No rows give no rows.
    """
    return Mix(docs, block, seed).taken()


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix as documents: columns of ``docs``, one row for each document that the mix takes words of.

    A document all of whose blocks are taken once is returned as it is.  Otherwise its text holds its taken words,
    in order and joined by spaces, and after them those of blocks that are taken a second time; ``n_chars`` is set
    anew.  Rows that agree in doc_id, source and text are placed apart but returned with the same text each.
    """
    mixed = Mix(docs, block, seed)
    got = mixed.pieces().groupBy("src", "bucket", "nth").agg(
        F.max("doc_id").alias("id"), F.max("h").alias("h"), F.max("start").alias("start"), F.max("size").alias("size"),
        F.min("block").alias("b0"), F.sort_array(F.collect_list(F.struct("block", "times"))).alias("drawn"))
    # a document spans at most its own number of blocks
    full = (F.size("drawn") == F.expr(f"(start + size - 1) div {block} - start div {block} + 1")) & F.forall(
        "drawn", lambda d: d["times"] == 1)
    got = got.join(mixed.sources.select("src", F.col("source").alias("src_name")), "src").withColumn("whole", full)
    copies = Window.partitionBy("id", "h", "src_name").orderBy("bucket", "nth")
    got = got.withColumn("copy", F.row_number().over(copies))
    # the row is one column, so that no column of ``docs`` meets one of the mix
    text = F.col("text").cast("string")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("row_id"),
                        F.xxhash64(text).alias("row_h"), F.col("source").cast("string").alias("row_source"))
    text = F.col("row").getField("text").cast("string")
    # rows equal in all three share one number each: the first of them stands for all
    one = got.where("copy = 1").drop("copy")
    joined = keyed.join(one, keyed.row_id.eqNullSafe(one.id) & (keyed.row_h == one.h)
                        & keyed.row_source.eqNullSafe(one.src_name))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))

    def of(times: int) -> Column:
        blocks = F.transform(F.filter("drawn", lambda d: d["times"] >= times), lambda d: d["block"])
        return F.flatten(F.transform(blocks, lambda b: F.slice(
            F.col("words"), (F.greatest(b * block - F.col("start"), F.lit(0)) + 1).cast("int"),
            (F.least((b + 1) * block, F.col("start") + F.col("size")) - F.greatest(b * block, F.col("start"))).cast(
                "int"))))

    taken = F.array_join(F.concat(of(1), of(2)), " ")
    made = joined.withColumn("words", F.when(~F.col("whole"), words)).withColumn(
        "mixed", F.when(F.col("whole"), text).otherwise(taken))
    return made.select(*[F.col("mixed").alias("text") if c == "text" else
                         F.length("mixed").cast("long").alias("n_chars") if c == "n_chars" else
                         F.col("row").getField(c).alias(c) for c in docs.columns])
