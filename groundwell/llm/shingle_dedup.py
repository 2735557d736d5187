"""Near duplicates by similarity of five-word shingles: SimHash with Golay keys, then bands of minima, exact at 0.8.

Equal sets of shingles meet by their hash.  Each distinct set has a 64-bit SimHash; fingerprints that differ in up to 4
bits meet under their Golay keys, and sets they lead to are the first candidates.  At a similarity of 0.8 fingerprints
differ in about 10 bits, more than such keys reach, so the rest is found by minima: each distinct set gives ``BANDS`` keys of ``BAND_ROWS`` minima under random
multipliers, and sets that share a key are candidates.  A bucket's members are first compared with one of them, its
centre, and what is linked is joined into components; ``ROUNDS`` of centres, each another member, bring a large group
of near copies together without its pairs.  Then all candidates that are still in different components are compared.
Every comparison counts the shingles of the two whole texts, so links are exact; a pair of similarity s is missed as
a candidate with probability (1 - s ** BAND_ROWS) ** BANDS: 1.3e-5 at 0.8, 1e-8 at 0.85.  Sets of half the similarity
of a link share a key with a probability of 8 %, so that texts with a common passage seldom meet.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.llm.common import lean, utf8
from groundwell.llm.components import components
from groundwell.llm.simhash import fingerprint_links, majority
from groundwell.session import scratch, settle

SEED = 42
SHINGLE = 5
LEAST = (4, 5)  # the similarity of a link, as a fraction
BANDS, BAND_ROWS = 48, 7
ROUNDS = 3
REMEMBERED = 256  # sets of shingles that are not made anew for the next pair
AT_ONCE = 1 << 12  # shingles whose minima are taken at once
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SETS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64()), ("sim", pa.int64()),
                  ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingles as sorted hashes; fewer words than a shingle make one, and no words none."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    n = max(1, len(words) - SHINGLE + 1)
    ends = (starts + sizes)[-n:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends.tolist())),
                                 dtype=np.uint64, count=n))


def band_keys(own: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles; an empty set has none."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(len(_FACTORS), np.uint64((1 << 64) - 1))
    for at in range(0, len(own), AT_ONCE):
        least = np.minimum(least, (own[at : at + AT_ONCE] * _FACTORS[:, None]).min(axis=1))
    raw = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(raw[i].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * LEAST[1] >= (len(a) + len(b) - shared) * LEAST[0]


def row_key() -> Column:
    """Tells rows apart that share a doc_id but not a text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps, sims, sizes, bands = [], [], [], []
        for text in utf8(batch.column("text")):
            own = shingles(text)
            fps.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
            sims.append(majority(own))
            sizes.append(len(own))
            bands.append(band_keys(own))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array(np.array(fps, np.uint64).view(np.int64)),
             pa.array(np.array(sims, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], schema=SETS)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: OrderedDict[int, np.ndarray] = OrderedDict()

    def of(fp: int, text: bytes) -> np.ndarray:
        if fp in known:
            known.move_to_end(fp)
        else:
            known[fp] = shingles(text)
            if len(known) > REMEMBERED:
                known.popitem(last=False)
        return known[fp]

    for batch in batches:
        pairs = zip(batch.column("a").to_pylist(), utf8(batch.column("text_a")), batch.column("b").to_pylist(),
                    utf8(batch.column("text_b")))
        near = pa.array([similar(of(a, x), of(b, y)) for a, x, b, y in pairs], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near)], schema=LINKS)


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    a = texts.select(F.col("fp").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("fp").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(lean(_compare), "a long, b long")


def _near_size(n: str, m: str) -> Column:
    """Sets of more different sizes cannot be similar enough."""
    return F.least(n, m) * LEAST[1] >= F.greatest(n, m) * LEAST[0]


def golay_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): candidates among ``sets`` (fp, sim, n) by SimHash: one set of each fingerprint stands for it, meets the
    others that have it, and those of fingerprints linked to it through Golay keys."""
    firsts = settle(sets.groupBy("sim").agg(F.min(F.struct("fp", "n")).alias("c")), "shingle-simhash")
    same = sets.join(firsts, "sim").where(F.col("fp") != F.col("c.fp")).select(
        "fp", "n", F.col("c.fp").alias("fp_c"), F.col("c.n").alias("n_c"))
    links = fingerprint_links(firsts.select(F.col("sim").alias("fp")))
    near = links.join(firsts.select(F.col("sim").alias("a"), F.col("c").alias("c_a")), "a").join(
        firsts.select(F.col("sim").alias("b"), F.col("c").alias("c_b")), "b").select(
        "c_a.fp", "c_a.n", F.col("c_b.fp").alias("fp_c"), F.col("c_b.n").alias("n_c"))
    return same.unionByName(near).where(_near_size("n", "n_c")).select(
        F.least("fp", "fp_c").alias("a"), F.greatest("fp", "fp_c").alias("b")).distinct()


def _candidate_texts(sets: DataFrame, rows: DataFrame, fps: DataFrame) -> DataFrame:
    """(fp, text) of the sets in ``fps``, written once: of all texts, these alone are shuffled again for each
    comparison, and the rest travel to this one join."""
    wanted = sets.select("fp", "key").join(fps.distinct(), "fp", "left_semi")
    texts = rows.select("key", "text").join(wanted, "key").dropDuplicates(["fp"])
    return settle(texts.select("fp", "text"), "shingle-texts")


def similar_links(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): links that join all candidates among ``sets`` (fp, key, sim, n, bands; distinct) that are similar
    enough; ``rows`` (key, text) has a text of each."""
    keys = sets.select("fp", "n", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.count("*").alias("k")).where("k > 1")
    open_ = settle(keys.join(shared.select("band"), "band").withColumn("root", F.col("fp")), "shingle-buckets")
    tried = settle(golay_pairs(sets), "shingle-golay")
    texts = _candidate_texts(sets, rows, open_.select("fp").union(tried.select("a")).union(tried.select("b")))
    links = settle(_linked(tried, texts), "shingle-links")

    def still_open(found: DataFrame) -> DataFrame:
        """Of the buckets, those whose members are not all in one component yet."""
        if found.isEmpty():
            return open_
        roots = settle(components(links), "shingle-roots")
        rooted = open_.select("band", "fp", "n").join(
            roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        mixed = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
        return settle(rooted.join(mixed.select("band"), "band", "left_semi"), "shingle-open")

    open_ = still_open(links)
    for centre in range(ROUNDS):
        # one member of each bucket, another in each round: of a large component rather than of a small one
        order = F.struct(F.xxhash64(F.lit(centre), "fp").alias("place"), "fp", "n", "root")
        centres = open_.groupBy("band").agg(F.min(order).alias("c"))
        pairs = open_.join(centres, "band").where((F.col("root") != F.col("c.root")) & _near_size("n", "c.n")).select(
            F.least("fp", "c.fp").alias("a"), F.greatest("fp", "c.fp").alias("b")).distinct()
        pairs = settle(pairs.join(tried, ["a", "b"], "left_anti"), "shingle-stars")
        tried = tried.unionByName(pairs)
        found = settle(_linked(pairs, texts), "shingle-links")
        links = links.unionByName(found)
        open_ = still_open(found)
    one = open_.select("band", F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"))
    two = open_.select("band", F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"))
    rest = one.join(two, "band").where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b"))
                                       & _near_size("n_a", "n_b")).select("a", "b").distinct()
    rest = rest.join(tried, ["a", "b"], "left_anti")  # compared already
    return links.unionByName(settle(_linked(rest, texts), "shingle-rest"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id, a null one last, any of repeated rows.

    All columns are returned.  A null text is empty; texts without words are alike.  Of rows that share doc_id and
    text but differ elsewhere, any one stays.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"),
                       F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession):
        marked = settle(rows.mapInArrow(lean(_sets), "doc_id long, key long, fp long, sim long, n long, bands array<bigint>"),
                        "shingle-sets")
        order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
        sets = settle(marked.groupBy("fp").agg(F.min(order).alias("first"), F.first("sim").alias("sim"),
                                               F.first("n").alias("n"), F.first("bands").alias("bands")), "shingle-distinct")
        roots = components(similar_links(sets.select("fp", F.col("first.key").alias("key"), "sim", "n", "bands"), rows))
        rooted = sets.select("fp", "first").join(roots, sets.fp == roots.node, "left").select(
            "first", F.coalesce("root", "fp").alias("root"))
        kept = settle(rooted.groupBy("root").agg(F.min("first").alias("first")).select(
            F.col("first.key").alias("kept")), "kept", lasting=True)
        repeated = marked.join(kept, marked.key == kept.kept, "left_semi").groupBy("key").count().where("count > 1")
        has_repeated = not repeated.isEmpty()
    # the row is one column, so that no column of ``docs`` meets the keys
    chosen = docs.select(F.struct("*").alias("row"), row_key().alias("key")).join(
        kept, F.col("key") == F.col("kept"), "left_semi")
    if has_repeated:
        chosen = chosen.dropDuplicates(["key"])
    return chosen.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
