"""Aligns the tokens of two tokenizers over the same bytes and scores the pairs that end together.

A text is encoded with a blank in front by a byte-level tokenizer (A) and by a piece model that adds this blank itself
(B).  Both begin a token at a blank after a visible character, so words are encoded apart and remembered.  The tokens
of all documents of a batch are then merged in lockstep: one state vector holds a place among the A tokens and one
among the B tokens for every stretch of words, each step compares the ends of all stretches at once, moves the place
that is behind (both where the ends agree, which is a link and a cut), and drops the stretches that are done.  Long
documents are several stretches, so that none holds its batch up.  Spark adds the links of each pair of ids up over
the corpus; blocks of documents hold their links as numbers of the block's own pairs and get the sums back by these.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.byte_pieces import byte_level_pieces, sentence_pieces, space_cuts
from groundwell.llm.common import slices
from groundwell.llm.packed import binary_array, gather, pack, unpack
from groundwell.session import settle

BLOCK_BYTES = 16 << 20  # texts whose pairs are numbered together
WORKING_SET = 2 << 20  # texts merged at once
STRETCH = 64  # words merged by one element of the state vector
REMEMBERED_BYTES = 24 << 20  # of words and their ids, in each of a worker's two memories
ENTRY_BYTES = 250  # what one remembered word costs besides

BLOCKS = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())),
    ("n_b", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())), ("groups", pa.list_(pa.string())),
    ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("pair_counts", pa.list_(pa.int64()))])
_BLOCKS_DDL = ("block long, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_links array<bigint>, "
               "groups array<string>, links binary, pairs array<bigint>, pair_counts array<bigint>")
ALIGNED = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups", pa.string())])


class WordPairs:
    """Both tokenizers over words, remembering the words of late."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.pieces_a, self.pieces_b = byte_level_pieces(self.a), sentence_pieces(self.b)
        self.sizes_a, self.sizes_b = (np.asarray(pc.binary_length(p)).astype(np.int64)
                                      for p in (self.pieces_a, self.pieces_b))
        self.memo: dict[bytes, tuple[bytes, bytes]] = {}
        self.older: dict[bytes, tuple[bytes, bytes]] = {}
        self.held = 0

    def known(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """The ids of each word, which begins with a blank, as little-endian bytes."""
        if self.held > REMEMBERED_BYTES:
            self.memo, self.older, self.held = {}, self.memo, 0
        memo, older, new = self.memo, self.older, []
        for w in words:
            if w not in memo:
                if w in older:
                    memo[w] = older[w]
                    self.held += ENTRY_BYTES
                else:
                    new.append(w)
        texts = [w.decode("utf-8", "replace") for w in new]
        found_a = self.a.encode_batch_fast(texts, add_special_tokens=False)
        found_b = self.b.encode([t[1:] for t in texts], num_threads=1) if texts else []
        for w, x, y in zip(new, found_a, found_b):
            memo[w] = np.array(x.ids, dtype="<u4").tobytes(), np.array(y, dtype="<u4").tobytes()
            self.held += ENTRY_BYTES + len(w) + sum(map(len, memo[w]))
        return [memo[w] for w in words]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray,
             stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of every pair that ends at the same byte, in order.

    Stretch k merges the A tokens from ``at_a[k]`` up to ``stop[k]`` with the B tokens from ``at_b[k]`` on; both
    end together.
    """
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    live = at_a < stop
    at_a, at_b, stop = at_a[live], at_b[live], stop[live]
    while len(at_a):
        x, y = end_a[at_a], end_b[at_b]
        linked = x == y
        found_a.append(at_a[linked])
        found_b.append(at_b[linked])
        at_a = at_a + (x <= y)
        at_b = at_b + (y <= x)
        live = at_a < stop
        if not live.all():
            at_a, at_b, stop = at_a[live], at_b[live], stop[live]
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


@lru_cache(maxsize=2)
def _written(size: int) -> tuple[np.ndarray, np.ndarray]:
    """(decimal digits of each id with ',', '|' or ';' after it, zero-padded; how long these are)."""
    digits = np.array([str(i).encode() for i in range(size)], dtype="S")
    width = digits.dtype.itemsize
    rows = np.zeros((3, size, width + 1), dtype=np.uint8)
    rows[:, :, :width] = digits.view(np.uint8).reshape(size, width)
    length = np.char.str_len(digits).astype(np.int64)
    for k, mark in enumerate(b",|;"):
        rows[k, np.arange(size), length] = mark
    return rows.reshape(3 * size, width + 1), length + 1


def write_groups(ids_a: np.ndarray, ids_b: np.ndarray, link_a: np.ndarray, link_b: np.ndarray,
                 doc_links: np.ndarray, vocabulary: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` for each document; ``doc_links`` says how many links each has."""
    rows, length = _written(vocabulary)
    until_a, until_b = link_a + 1, link_b + 1
    before_b = np.concatenate([[0], until_b[:-1]]) if len(until_b) else until_b
    group_a = np.repeat(np.arange(len(until_a)), np.diff(until_a, prepend=0))
    group_b = np.repeat(np.arange(len(until_b)), np.diff(until_b, prepend=0))
    place = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    mark = np.zeros(len(place), dtype=np.int64)
    at_a, at_b = np.arange(len(ids_a)) + before_b[group_a], np.arange(len(ids_b)) + until_a[group_b]
    place[at_a], place[at_b] = ids_a, ids_b
    mark[at_a[link_a]], mark[at_b[link_b]] = 1, 2
    flat = rows[place + mark * vocabulary].ravel()
    raw = flat[flat != 0].tobytes()
    ends = np.concatenate([[0], np.cumsum(length[place])])
    group_ends = np.concatenate([[0], ends[until_a + until_b]]) if len(until_a) else np.zeros(1, np.int64)
    cuts = group_ends[np.concatenate([[0], np.cumsum(doc_links)])].tolist()
    return [raw[x : max(x, y - 1)] for x, y in zip(cuts[:-1], cuts[1:])]  # without the last ';'


class Aligned:
    """What one batch of texts gives: per text the numbers of tokens and links, per link its pair of ids."""

    def __init__(self, n_a, n_b, n_links, ids_a, ids_b, link_a, link_b):
        self.n_a, self.n_b, self.n_links = n_a, n_b, n_links
        self.ids_a, self.ids_b, self.link_a, self.link_b = ids_a, ids_b, link_a, link_b

    def pairs(self) -> np.ndarray:
        return self.ids_a[self.link_a].astype(np.int64) << 32 | self.ids_b[self.link_b].astype(np.int64)


def align_texts(texts: pa.Array, encoder: WordPairs, stretch: int = STRETCH) -> Aligned:
    """Aligns a batch; a text that is null, empty or not given back by both tokenizers has no tokens."""
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    size = np.asarray(pc.binary_length(raw)).astype(np.int64)
    good = size > 0
    counts = np.zeros((3, len(raw)), dtype=np.int64)
    while True:
        chosen = np.flatnonzero(good)
        joined = pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), raw.take(pa.array(chosen)),
                                             pa.scalar(b"", pa.large_binary()))
        starts = np.concatenate([[0], np.cumsum(size[chosen] + 1)])
        if not len(chosen):
            none = np.zeros(0, np.int64)
            return Aligned(*counts, none, none, none, none)
        buffer = joined.buffers()[2].slice(0, int(starts[-1]))
        data = np.frombuffer(buffer, dtype=np.uint8)
        cut = space_cuts(data)
        cut[starts[1:] - 1] = False  # a last blank alone is no word for B
        cut[starts[:-1]] = True
        at = np.flatnonzero(cut)
        words = binary_array(np.diff(np.append(at, len(data))), buffer).dictionary_encode()
        found = encoder.known(words.dictionary.to_pylist())
        code = np.asarray(words.indices)
        doc_words = np.searchsorted(at, starts)
        ids, per_doc, first = [], [], []
        for side in (0, 1):
            table = np.frombuffer(b"".join([f[side] for f in found]), dtype="<u4")
            n = np.fromiter((len(f[side]) for f in found), np.int64, len(found)) // 4
            taken = n[code]
            ids.append(table[gather((np.cumsum(n) - n)[code], taken)])
            first.append(np.concatenate([[0], np.cumsum(taken)]))
            per_doc.append(np.diff(first[side][doc_words]))
        same = np.ones(len(chosen), dtype=bool)
        ends = []
        for side, (pieces, sizes) in enumerate(((encoder.pieces_a, encoder.sizes_a), (encoder.pieces_b, encoder.sizes_b))):
            end = np.cumsum(sizes[ids[side]])
            ends.append(end)
            doc_end = np.concatenate([[0], end])[first[side][doc_words]]
            if np.array_equal(doc_end, starts):
                back = np.frombuffer(pieces.take(pa.array(ids[side])).buffers()[2], dtype=np.uint8)[: len(data)]
                wrong = np.flatnonzero(back != data)
                same[np.searchsorted(starts, wrong, side="right") - 1] = False
            else:  # lengths differ somewhere: text by text
                back = pieces.take(pa.array(ids[side])).buffers()[2].to_pybytes()
                for k in range(len(chosen)):
                    same[k] &= back[doc_end[k] : doc_end[k + 1]] == data[starts[k] : starts[k + 1]].tobytes()
        if same.all():
            break
        good[chosen[~same]] = False
    heads = np.zeros(len(at), dtype=bool)  # words that begin a stretch
    ordinal = np.arange(len(at)) - np.repeat(doc_words[:-1], np.diff(doc_words))
    heads[ordinal % stretch == 0] = True
    head = np.flatnonzero(heads)
    at_a = first[0][head]
    link_a, link_b = lockstep(*ends, at_a, first[1][head], np.append(at_a[1:], len(ids[0])))
    link_cuts = np.searchsorted(link_a, first[0][doc_words])
    counts[0, chosen], counts[1, chosen], counts[2, chosen] = *per_doc, np.diff(link_cuts)
    return Aligned(*counts, *ids, link_a, link_b)


@lru_cache(maxsize=1)
def _encoder(byte_path: str, piece_path: str) -> WordPairs:
    return WordPairs(byte_path, piece_path)


def aligned_blocks(docs: DataFrame, byte_path: str, piece_path: str, written: bool,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``BLOCKS`` of all rows of ``docs`` (doc_id, text): groups as text, or the SHA-256 of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(byte_path, piece_path)
        vocabulary = max(len(encoder.pieces_a), len(encoder.pieces_b))
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            pairs, link, n = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True, return_counts=True)
            columns = {"block": block, "doc_ids": [d for h in held for d in h[0].to_pylist()],
                       "groups": [g for h in held for g in h[2]], "links": pack(link), "pairs": pairs,
                       "pair_counts": n}
            for k, name in enumerate(("n_a", "n_b", "n_links")):
                columns[name] = np.concatenate([h[1][k] for h in held])
            return pa.RecordBatch.from_pylist([columns], schema=BLOCKS)

        for whole in batches:
            for batch in slices(whole, WORKING_SET):
                got = align_texts(batch.column("text"), encoder)
                groups = write_groups(got.ids_a, got.ids_b, got.link_a, got.link_b, got.n_links, vocabulary)
                said = [g.decode() if written else hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                held.append((batch.column("doc_id"), (got.n_a, got.n_b, got.n_links), said, got.pairs()))
                size += batch.column("text").nbytes
                if size >= block_bytes:
                    yield flush()
                    block, held, size = block + 1, [], 0
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return settle(rows.mapInArrow(run, _BLOCKS_DDL), "aligned-blocks")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): links of each pair of ids over the corpus, and whether no other pair of its B id has more.

    There are no more rows than pairs of ids, and no B id has more rows than A has ids.
    """
    used = blocks.select(F.explode(F.arrays_zip("pairs", "pair_counts")).alias("p"))
    total = settle(used.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_counts").alias("n")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    most = total.groupBy(b).agg(F.max("n").alias("most"))
    return total.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_path: str, piece_path: str, written: bool = True,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every row of ``docs``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` with decimal ids, or its SHA-256 if not ``written``.  Tokens have at least
    one byte, so a group has exactly one link: its last tokens.  A text that is null or empty, or that either
    tokenizer does not give back byte by byte (one with U+2581, for one), has no tokens: zeros and ''.  Strings of
    special tokens are plain text.  ``n_best`` counts links of the most frequent pair of their B id, ties included;
    ``count_sum`` adds each link's count over the corpus.  Rows are kept one by one, whatever their doc_id; texts are
    read whole and other columns ignored.  An empty table gives no rows.
    """
    blocks = aligned_blocks(docs, byte_path, piece_path, written, block_bytes)
    asked = blocks.select("block", F.posexplode("pairs").alias("slot", "pair"))
    found = asked.join(pair_counts(blocks), "pair").groupBy("block").agg(
        F.collect_list(F.struct("slot", "n", "best")).alias("found"))  # as many as the block has pairs
    rows = blocks.select("block", "doc_ids", "n_a", "n_b", "n_links", "groups", "links").join(found, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                link = unpack(row["links"].as_py())
                n_links = np.asarray(row["n_links"].values)
                values = np.zeros((2, int(link.max()) + 1 if len(link) else 0), dtype=np.int64)
                if len(link):
                    fields = [np.asarray(row["found"].values.field(k)) for k in range(3)]
                    values[0, fields[0]], values[1, fields[0]] = fields[2], fields[1]
                cuts = np.concatenate([[0], np.cumsum(n_links)])
                sums = [np.diff(np.concatenate([[0], np.cumsum(v[link])])[cuts]) for v in values]
                yield pa.RecordBatch.from_arrays([
                    row["doc_ids"].values, row["n_a"].values, row["n_b"].values, row["n_links"].values,
                    row["n_links"].values, pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()),
                    row["groups"].values], schema=ALIGNED)

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                "count_sum long, groups string")
