"""Near duplicates by 64-bit SimHash, linked exactly at up to 4 differing bits through Golay codewords.

A fingerprint is cut into segments A and B of 23 bits and C of 18.  With at most 4 errors, the pigeonhole leaves
these cases, and each has a family of keys that both fingerprints of a linked pair share:

* A has none: A itself.  B has none: B itself.
* C has none: A or B has at most 2, so C with a nearby codeword of A, or of B.
* Each has at least one: either A and B have one each: the nearest codeword of one with a nearby one of the other;
  or A and C have one each: a nearby codeword of A with the half of C that has none; or B and C, likewise.

All distinct fingerprints meet under their keys, and every meeting is verified bit by bit, so links are exact.  Only
8 bytes of each travel.  A bucket gives its links as such or, if large, as stars of its components, so what leaves
it is in proportion to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.llm import golay
from groundwell.llm.common import lean, utf8
from groundwell.llm.components import components
from groundwell.session import settle

SEED = 42
BITS = 4
SHINGLE = 4
AT_ONCE = 1 << 15  # shingles whose bits are counted at once
SMALL_BUCKET = 16
FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64())])
KEYS = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: bytes, words_each: int = SHINGLE) -> int:
    """Bit i is set where over half of the shingles' hashes have it; no words give 0."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    n = max(1, len(words) - words_each + 1)
    ends = (starts + sizes)[-n:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, AT_ONCE):
        pairs = zip(starts[at : min(n, at + AT_ONCE)].tolist(), ends[at : at + AT_ONCE].tolist())
        h = np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """Bit i is set where over half of the hashes (uint64) have it; none give 0."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        own = np.ascontiguousarray(hashes[at : at + AT_ONCE], dtype="<u8")
        counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_each: int = SHINGLE) -> DataFrame:
    """(doc_id, key, fp) of every whole text; a null text is empty, and its fingerprint 0.

    ``key`` tells rows apart that share a doc_id but not a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words_each) for t in utf8(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(found.view(np.int64))], schema=FINGERPRINTS)

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, fp long")


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row number) pairs of an array of fingerprints (uint64)."""
    a = (fp & np.uint64(0x7FFFFF)).astype(np.int64)
    b = (fp >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
    c = (fp >> np.uint64(46)).astype(np.int64)
    halves = (c & 511, c >> 9)
    near_a, new_a = golay.nearby(a)
    near_b, new_b = golay.nearby(b)
    own_a, own_b = golay.index(a).astype(np.int64), golay.index(b).astype(np.int64)
    (row_a, col_a), (row_b, col_b) = np.nonzero(new_a), np.nonzero(new_b)
    ka, kb = near_a[row_a, col_a].astype(np.int64), near_b[row_b, col_b].astype(np.int64)
    every = np.arange(len(fp))
    mixed_a, mixed_b = ka << 12 | own_b[row_a], own_a[row_b] << 12 | kb
    other = kb != own_b[row_b]  # else the same key as from A's side
    families = [(a, every), (b, every), (c[row_a] << 12 | ka, row_a),
                (c[row_b] << 12 | kb, row_b),
                (np.concatenate([mixed_a, mixed_b[other]]), np.concatenate([row_a, row_b[other]])),
                (halves[0][row_a] << 12 | ka, row_a), (halves[1][row_a] << 12 | ka, row_a),
                (halves[0][row_b] << 12 | kb, row_b), (halves[1][row_b] << 12 | kb, row_b)]
    return (np.concatenate([k | n << 40 for n, (k, _) in enumerate(families)]),
            np.concatenate([rows for _, rows in families]))


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        key, row = keys_of(fp)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64))], schema=KEYS)


def links_of_bucket(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the components that a large bucket's fingerprints form; each row found leaves the rest smaller."""
    rest, a, b = fp, [], []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        root = front[0]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= bits
            if near.any():
                found = rest[near]
                a.append(np.full(len(found), root, dtype=np.uint64))
                b.append(found)
                front.extend(found)
                rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a) if a else none), (np.concatenate(b) if b else none)


def _verify(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The links among rows sorted by key."""
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(cuts, len(key)))
    out_a, out_b = [], []
    small = np.repeat(sizes <= SMALL_BUCKET, sizes)
    i, step = np.flatnonzero(small), 1
    while len(i):
        i = i[i + step < len(key)]
        i = i[key[i + step] == key[i]]
        near = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= bits]
        out_a.append(fp[near])
        out_b.append(fp[near + step])
        step += 1
    for at, size in zip(cuts[sizes > SMALL_BUCKET].tolist(), sizes[sizes > SMALL_BUCKET].tolist()):
        a, b = links_of_bucket(fp[at : at + size], bits)
        out_a.append(a)
        out_b.append(b)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _links(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), [np.zeros(0, np.uint64)]

        def done(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(k):
                a, b = _verify(k, f, bits)
                for at in range(0, len(a), 100_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x[at : at + 100_000].view(np.int64)) for x in (a, b)], schema=LINKS)

        held_k, held_f = key, fp[0]
        for batch in batches:
            k = np.concatenate([held_k, batch.column("key").to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last key may go on in the next batch
            yield from done(k[:cut], f[:cut])
            held_k, held_f = k[cut:], f[cut:]
        yield from done(held_k, held_f)

    return run


def fingerprint_links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): links that join all fingerprints (column fp, distinct) that differ in ``bits`` (up to 4) or fewer."""
    if not 0 <= bits <= BITS:
        raise ValueError("keys are complete up to 4 bits")
    keys = distinct.select("fp").mapInArrow(lean(_emit_keys), "key long, fp long")
    met = keys.repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(lean(_links(bits)), "a long, b long").distinct()


def _rooted(marked: DataFrame, bits: int) -> DataFrame:
    """(fp, root) of every distinct fingerprint of ``marked``: root is the same throughout a component."""
    distinct = settle(marked.select("fp").distinct(), "distinct-fingerprints")
    roots = components(fingerprint_links(distinct, bits))
    return distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, bits: int = BITS, words_each: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that can be reached) for every row.

    Text: null is empty; texts without words have fingerprint zero and are linked like any other.  Fewer words than
    a shingle make one shingle.  Rows that share a doc_id are each returned.  A null doc_id is never a component_id
    unless its component has no other.  Other columns are not looked at.  No rows give no rows.
    """
    marked = settle(fingerprints(docs, words_each), "fingerprints")
    rooted = settle(_rooted(marked, bits), "rooted")
    per_fp = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(rooted, "fp")
    least = per_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(labelled, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
