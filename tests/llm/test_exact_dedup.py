from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from groundwell.llm import exact_dedup
from groundwell.llm.exact_dedup import Directory, bucket_of, chain, directory, exact_duplicates, grow

SCHEMA = "doc_id long, text string, keep_id string, h int"


def test_groups_of_odd_texts(spark):
    rows = [(1, "Same", "x", 1), (2, "sAME", "x", 1), (9, "same", None, 1), (3, None, "x", 1), (4, "", "x", None),
            (5, "É", "x", 1), (6, "é", "x", 1), (7, "Z" * 300_000, "x", 1), (8, "z" * 300_000, "x", 1),
            (None, "same", "x", 1), (None, "alone", "x", 1), (9, "same", "x", 2)]
    got = exact_duplicates(spark.createDataFrame(rows, SCHEMA), bucket_bytes=64).collect()
    assert len(got) == len(rows)
    by = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in got)
    assert by == sorted([(1, 9, 5, False), (2, 9, 5, False), (9, 9, 5, True), (9, 9, 5, True), (-1, 9, 5, False),
                         (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 8, 2, False),
                         (8, 8, 2, True), (-1, -1, 1, True)])
    assert {r.text_sha256 for r in got if r.doc_id == 8} == {hashlib.sha256(b"z" * 300_000).hexdigest()}
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_whose_hashes_collide_are_told_apart():
    batch = pa.RecordBatch.from_arrays([
        pa.array([5, 5, 5, 7]), pa.array(["a", "b", "a", "a"]), pa.array([[1], [2], [3, 4], [5]], pa.list_(pa.int64())),
        pa.array([b"a", b"b", b"a", b"a"])], ["h", "sha", "doc_ids", "text"])
    halves = [batch.slice(0, 2), batch.slice(2)]  # a chain may go on in the next batch
    assert [x for b in chain(iter(halves)) for x in b.column("link").to_pylist()] == [0, 1, 0, 0]


def test_overfull_buckets_are_split_and_single_hashes_are_not():
    weights = {c: (10, 2) for c in range(8)} | {3: (100, 1)}
    found = Directory()
    assert grow(found, 0, weights, 3, 25) == []
    sizes = {(d, p): sum(weights[c][0] for c in range(8) if c >> (3 - d) == p) for d, p in zip(found.bits, found.prefix)}
    assert all(s <= 25 for k, s in sizes.items() if k != (3, 3)) and sum(2.0 ** -d for d in found.bits) == 1


def test_directory_doubles_when_a_full_bucket_is_as_deep():
    found, sizes = Directory(), []
    rng = np.random.default_rng(7)
    h = rng.integers(-(1 << 63), 1 << 63, 5_000)
    for _ in range(60):
        held = np.bincount(found.find(h), minlength=len(found.bits))
        fullest = int(held.argmax())
        deep, before = found.bits[fullest] == found.depth, len(found.pointers)
        found.split(fullest)
        assert len(found.pointers) == before * (2 if deep else 1) == 1 << found.depth
        sizes.append(len(found.pointers))
        owner = found.find(h)
        for b, (d, p) in enumerate(zip(found.bits, found.prefix)):
            assert (found.pointers == b).sum() == 1 << (found.depth - d)
            assert ((h.view(np.uint64) >> np.uint64(64 - d)) == p)[owner == b].all()
    assert len(set(sizes)) > 4 and len(found.bits) == 61


def test_directory_goes_deeper_than_one_histogram(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HISTOGRAM_BITS", 2)
    hashes = [i << 55 for i in range(40)] + [-(i << 50) - 1 for i in range(40)]
    entries = spark.createDataFrame([(h, 10) for h in hashes], "h long, n_bytes long")
    found = directory(entries, 50)
    assert sum(2.0 ** -d for d in found.bits) == 1 and len(found.pointers) == 1 << max(found.bits)
    owner = entries.select("h", bucket_of(found)("h").alias("b")).collect()
    for r in owner:
        assert (r.h % (1 << 64)) >> (64 - found.bits[r.b]) == found.prefix[r.b]
    assert max(sum(10 for r in owner if r.b == k) for k in range(len(found.bits))) <= 50
