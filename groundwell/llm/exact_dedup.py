"""Exact duplicates through an extendible-hash index on shared files.

1. Tasks collapse equal normalised texts within an Arrow batch, so that a text held by a third of all rows leaves
   each batch once.  The entries (hash, digest, text, doc_ids) are written to the shared folder.
2. The directory is an array of pointers to buckets, as many as its depth in bits can tell apart, and is looked up by
   the top bits of a hash.  It is grown from a histogram of hash prefixes: while a bucket is overfull, it is split by
   one more bit of the hash, and the directory doubles when that bucket is already as deep as the directory.
3. Each bucket is owned by one task, which reads its entries in order of the hash and chains those that collide,
   comparing bytes.  Only entries travel, and only one text of a chain is held per distinct text of one hash.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.common import signed, utf8
from groundwell.session import settle

BUCKET_BYTES = 16 << 20
HISTOGRAM_BITS = 12
DEEPEST = 26  # bits; a bucket of more bytes that agrees in as many is read by its owner as it is
MEMBERS = 1_000  # doc_ids in one entry

ENTRIES = pa.schema([("h", pa.int64()), ("sha", pa.string()), ("n_bytes", pa.int64()),
                     ("doc_ids", pa.list_(pa.int64())), ("text", pa.binary())])
CLASSES = pa.schema([("h", pa.int64()), ("link", pa.int32()), ("sha", pa.string()),
                     ("doc_ids", pa.list_(pa.int64()))])


def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for each distinct normalised text of a batch; more where it has over ``MEMBERS`` copies."""
    for batch in batches:
        held: dict[bytes, list] = defaultdict(list)
        for doc, raw in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
            held[raw.lower()].append(doc)  # bytes.lower changes A-Z only
        rows = [(text, ids[a : a + MEMBERS]) for text, ids in held.items() for a in range(0, len(ids), MEMBERS)]
        yield pa.RecordBatch.from_arrays([
            pa.array([signed(xxhash.xxh64_intdigest(t, 42)) for t, _ in rows], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t, _ in rows], pa.string()),
            pa.array([len(t) for t, _ in rows], pa.int64()), pa.array([i for _, i in rows], pa.list_(pa.int64())),
            pa.array([t for t, _ in rows], pa.binary())], schema=ENTRIES)


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by hash: those of one hash form a chain of distinct texts, told apart byte by byte."""
    at, links = None, []
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            h, text = batch.column("h")[i].as_py(), batch.column("text")[i].as_py()
            if h != at:
                at, links = h, []
            if text not in links:
                links.append(text)
            out.append(links.index(text))
        yield pa.RecordBatch.from_arrays(
            [batch.column("h"), pa.array(out, pa.int32()), batch.column("sha"), batch.column("doc_ids")],
            schema=CLASSES)


class Directory:
    """Pointers to buckets by the top ``depth`` bits of a hash; a bucket of fewer bits has several pointers."""

    def __init__(self):
        self.depth, self.pointers = 0, np.zeros(1, dtype=np.int32)
        self.bits, self.prefix = [0], [0]  # of each bucket: the bits that its hashes share

    def split(self, bucket: int) -> int:
        """Parts a bucket by its next bit and returns the new bucket, which gets the hashes where that bit is set."""
        if self.bits[bucket] == self.depth:  # no pointer is left to give away: the directory doubles
            self.pointers, self.depth = np.repeat(self.pointers, 2), self.depth + 1
        bits, prefix, new = self.bits[bucket] + 1, self.prefix[bucket] << 1, len(self.bits)
        self.bits[bucket], self.prefix[bucket] = bits, prefix
        self.bits.append(bits)
        self.prefix.append(prefix + 1)
        width = 1 << (self.depth - bits)
        self.pointers[(prefix + 1) * width : (prefix + 2) * width] = new
        return new

    def find(self, h: np.ndarray) -> np.ndarray:
        """The bucket of each (signed) hash."""
        if not self.depth:
            return np.zeros(len(h), dtype=np.int32)
        return self.pointers[(h.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)]


def grow(found: Directory, bucket: int, weights: dict[int, tuple[int, int]], bits: int, bucket_bytes: int) -> list[int]:
    """Splits a bucket until no part of it is overfull; gives the parts for which the histogram knows too few bits.

    ``weights``: prefix of ``bits`` bits to (bytes, distinct hashes), of the hashes of this bucket.
    """
    todo, short = [(bucket, sorted(weights))], []
    while todo:
        b, cells = todo.pop()
        size, kinds = sum(weights[c][0] for c in cells), sum(weights[c][1] for c in cells)
        if size <= bucket_bytes or kinds <= 1:  # the copies of one hash form a chain, which no split can part
            continue
        if found.bits[b] == bits:
            short.append(b)
            continue
        bit = 1 << (bits - found.bits[b] - 1)
        upper = found.split(b)
        todo += [(b, [c for c in cells if not c & bit]), (upper, [c for c in cells if c & bit])]
    return short


def directory(entries: DataFrame, bucket_bytes: int) -> Directory:
    """The directory of all ``entries`` (h, n_bytes).

    Each histogram has ``1 << HISTOGRAM_BITS`` cells for each overfull bucket, so what the driver gets is bounded
    by the number of buckets that the directory needs.
    """
    found, overfull, bits = Directory(), [0], HISTOGRAM_BITS
    while overfull:
        rows = entries.select("h", "n_bytes").withColumn("cell", F.shiftrightunsigned("h", 64 - bits))
        depth = found.bits[overfull[0]]  # all of them are as deep as the last histogram
        if depth:
            wanted = entries.sparkSession.createDataFrame([(found.prefix[b],) for b in overfull], "top long")
            rows = rows.join(wanted, F.shiftrightunsigned("h", 64 - depth) == F.col("top"), "left_semi")
        counted = rows.groupBy("cell").agg(F.sum("n_bytes").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        by_top: dict[int, dict[int, tuple[int, int]]] = defaultdict(dict)
        for r in counted.collect():
            by_top[r.cell >> (bits - depth)][r.cell] = (r.b, 1 if r.lo == r.hi else 2)
        again = [b for bucket in overfull for b in grow(found, bucket, by_top[found.prefix[bucket]], bits, bucket_bytes)]
        overfull, bits = again if bits < DEEPEST else [], min(DEEPEST, bits + HISTOGRAM_BITS)
    return found


def bucket_of(found: Directory):
    """A function of the hash: the number of the bucket that owns it."""

    @F.arrow_udf("int")
    def owner(h: pa.Array) -> pa.Array:
        return pa.array(found.find(h.to_numpy(zero_copy_only=False)))

    return owner


def exact_duplicates(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, for every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z.  A null text is empty.  Of equal texts the row with the
    largest doc_id stays; a null doc_id stays only where the group has no other, and of rows that also share the
    doc_id every one is marked as kept.  No rows give no rows.  Other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    entries = settle(rows.mapInArrow(collapse, "h long, sha string, n_bytes long, doc_ids array<bigint>, text binary"),
                     "exact-entries")
    found = directory(entries, bucket_bytes)
    owned = entries.select("h", "sha", "doc_ids", "text").withColumn("bucket", bucket_of(found)("h"))
    owned = owned.repartitionById(len(found.bits), F.col("bucket")).sortWithinPartitions("h")
    classes = settle(owned.select("h", "sha", "doc_ids", "text").mapInArrow(
        chain, "h long, link int, sha string, doc_ids array<bigint>"), "exact-classes")
    groups = classes.groupBy("h", "link").agg(
        F.max(F.array_max("doc_ids")).alias("keep_id"), F.sum(F.size("doc_ids")).cast("long").alias("group_size"))
    members = classes.join(groups, ["h", "link"])
    return members.select(
        F.explode("doc_ids").alias("doc_id"), "keep_id", "group_size", F.col("sha").alias("text_sha256")).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
