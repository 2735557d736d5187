"""BPE encoding and decoding through a table of the distinct words of all texts.

A word is the white space before a run of visible characters and that run, cut also before a stop that follows a
letter; the tokenizer always begins a piece at such places, so words can be encoded apart.  Tasks cut their texts
into blocks; a block lists its distinct words and, for each place of each text, the number of its word there.  The
lists of all blocks are dealt out by a hash of the word, so that every word meets its copies in one bucket, where it
is encoded once.  Its ids go back to the blocks that asked, and each place takes the ids of its word.  Decoding joins
every id with its piece: a table of the vocabulary, which is the same size for any input, is looked up by id.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.byte_pieces import byte_level_pieces, word_cuts
from groundwell.llm.common import parts, slices
from groundwell.llm.packed import binary_array, gather, pack, pack_words, unpack, unpack_words
from groundwell.llm.tables import bucketed

BLOCK_BYTES = 16 << 20  # texts of a block; a longer text is a block of its own
SLICE_BYTES = 4 << 20  # texts split at once
BUCKET_WORDS = 500_000  # listed words that meet in one bucket, about
OUTPUT_BYTES = 2 << 20  # texts rebuilt at once

BLOCKS = pa.schema([
    ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_words", pa.list_(pa.int64())),
    ("codes", pa.binary()), ("lengths", pa.binary()), ("words", pa.binary()), ("n_listed", pa.int64())])
ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("slots", pa.binary()), ("lengths", pa.binary()),
                   ("words", pa.binary())])
ANSWERS = pa.schema([("block", pa.int64()), ("slots", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])
CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=1)
def _pieces(path: str) -> pa.Array:
    return byte_level_pieces(_tokenizer(path))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts one after the other, how many each text has); a null is an empty text."""
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return binary_array(np.zeros(0, np.int64), b""), np.zeros(len(raw), np.int64)
    data = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[first:last]
    cut = word_cuts(data)
    starts = offsets - first
    cut[starts[:-1][starts[:-1] < starts[1:]]] = True
    at = np.flatnonzero(cut)
    words = binary_array(np.diff(np.append(at, len(data))), raw.buffers()[2].slice(first, last - first))
    return words, np.diff(np.searchsorted(at, starts))


def _block(number: int, held: list[tuple[pa.Array, pa.Array, np.ndarray]]) -> pa.RecordBatch:
    coded = pa.chunked_array([w for _, w, _ in held]).unify_dictionaries()
    listed = coded.chunk(0).dictionary if coded.num_chunks else held[0][1].dictionary
    codes = np.concatenate([np.zeros(0, np.int32), *[np.asarray(c.indices) for c in coded.chunks]])
    # frequent words get small numbers, whose upper bytes are zero; words that are as frequent stand in alphabetical
    # order, in which they pack well
    order = pa.table({"seldom": -np.bincount(codes, minlength=len(listed)), "word": listed}).sort_by(
        [("seldom", "ascending"), ("word", "ascending")])["word"].combine_chunks() if len(listed) else listed
    place = np.asarray(pc.index_in(listed, order)).astype(np.uint32) if len(listed) else np.zeros(0, np.uint32)
    lengths, words = pack_words(order)
    return pa.RecordBatch.from_pylist([{
        "block": number, "doc_ids": [d for ids, _, _ in held for d in ids.to_pylist()],
        "doc_words": np.concatenate([n for _, _, n in held]), "codes": pack(place[codes]), "lengths": lengths,
        "words": words, "n_listed": len(listed)}], schema=BLOCKS)


def blocks_of(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``BLOCKS`` of all texts of ``docs`` (doc_id, text), written to the shared folder in buckets of ``block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for whole in batches:
            for batch in slices(whole, min(SLICE_BYTES, block_bytes)):
                words, counts = split_words(batch.column("text"))
                held.append((batch.column("doc_id"), words.dictionary_encode(), counts))
                size += batch.column("text").nbytes
                if size >= block_bytes:
                    yield _block(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield _block(number, held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return bucketed(rows.mapInArrow(
        run, "block long, doc_ids array<bigint>, doc_words array<bigint>, codes binary, lengths binary, words binary, "
             "n_listed long"), "block", "word-blocks")


def ask(blocks: DataFrame, buckets: int) -> DataFrame:
    """``ASKED``: the listed words of each block, dealt out by a hash of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, lengths, raw = (batch.column(k)[row].as_py() for k in ("block", "lengths", "words"))
                words = unpack_words(lengths, raw)
                bucket = np.fromiter((zlib.crc32(w) for w in words.to_pylist()), np.int64, len(words)) % buckets
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    slots = order[cuts[b] : cuts[b + 1]]
                    size, part = pack_words(words.take(pa.array(slots)))
                    yield pa.RecordBatch.from_pylist([{
                        "bucket": b, "block": block, "slots": pack(np.diff(slots, prepend=0)), "lengths": size,
                        "words": part}], schema=ASKED)

    return blocks.select("block", "lengths", "words").mapInArrow(
        run, "bucket int, block long, slots binary, lengths binary, words binary")


def answer(asked: DataFrame, tokenizer: str, buckets: int) -> DataFrame:
    """``ANSWERS``: each distinct word of a bucket is encoded once, for all blocks that list it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bucket, known = _tokenizer(tokenizer), None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    bucket, known = row["bucket"], {}
                words = unpack_words(row["lengths"], row["words"]).to_pylist()
                new = [w for w in words if w not in known]
                found = encoder.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)
                for w, f in zip(new, found):
                    known[w] = np.array(f.ids, dtype="<u4").tobytes()
                ids = [known[w] for w in words]
                counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                yield pa.RecordBatch.from_pylist([{
                    "block": row["block"], "slots": row["slots"], "counts": pack(counts),
                    "ids": pack(np.frombuffer(b"".join(ids), dtype="<u4"))}], schema=ANSWERS)

    dealt = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")
    return dealt.mapInArrow(run, "block long, slots binary, counts binary, ids binary")


def _rebuilt(row: dict, answers: list[dict], pieces: pa.Array) -> Iterator[pa.RecordBatch]:
    """The texts of one block from its places and the ids of its words."""
    slots = [np.cumsum(unpack(a["slots"]), dtype=np.int64) for a in answers]
    counts = [unpack(a["counts"]) for a in answers]
    table = np.concatenate([np.zeros(0, "<u4"), *[unpack(a["ids"]) for a in answers]])
    slot = np.concatenate([np.zeros(0, np.int64), *slots])
    n = np.concatenate([np.zeros(0, np.int64), *counts]).astype(np.int64)
    if len(slot) != row["n_listed"]:
        raise ValueError("a word of the block came back without its ids")
    size, start = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
    size[slot], start[slot] = n, np.cumsum(n) - n
    codes = unpack(row["codes"])
    doc_ids, doc_words = row["doc_ids"], np.array(row["doc_words"], dtype=np.int64)
    per_word = np.concatenate([[0], np.cumsum(size[codes])])
    word_ends = np.concatenate([[0], np.cumsum(doc_words)])
    id_ends = per_word[word_ends]
    a = 0
    while a < len(doc_ids):
        b = max(a + 1, int(np.searchsorted(id_ends, id_ends[a] + OUTPUT_BYTES // 4, side="right")) - 1)
        here = codes[word_ends[a] : word_ends[b]]
        ids = table[gather(start[here], size[here])]
        cuts = id_ends[a : b + 1] - id_ends[a]
        joined = pieces.take(pa.array(ids))  # the join of ids and pieces
        ends = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset : joined.offset + len(ids) + 1][cuts]
        raw = joined.buffers()[2].to_pybytes() if joined.buffers()[2] else b""
        texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
        flat = ids.astype("<u4").tobytes()
        yield pa.RecordBatch.from_arrays([
            pa.array(doc_ids[a:b], pa.int64()), pa.array(np.diff(cuts)),
            pa.array([flat[4 * x : 4 * y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary()),
            pa.array(texts, pa.string())], schema=CODED)
        a = b


def encode_and_decode(docs: DataFrame, tokenizer: str, block_bytes: int = BLOCK_BYTES,
                      bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded text of every row of ``docs``.

    Ids are those of the tokenizers library for the whole text without added special tokens; strings of special
    tokens in a text become their ids, as they do there.  A null text is empty; an empty text has no ids and decodes
    to an empty text.  Rows are kept one by one, so null or repeated doc_ids stay as they are.  Texts are read whole;
    other columns are ignored.  An empty table gives no rows.
    """
    blocks = blocks_of(docs, block_bytes)
    listed = blocks.agg(F.sum("n_listed")).first()[0] or 0
    buckets = parts(listed, bucket_words)
    answers = answer(ask(blocks, buckets), tokenizer, buckets).groupBy("block").agg(
        F.collect_list(F.struct("slots", "counts", "ids")).alias("answers"))  # of one block's own words
    # the blocks lie in buckets, so that only the answers are shuffled
    met = blocks.select("block", "doc_ids", "doc_words", "codes", "n_listed").join(
        answers.hint("merge"), "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(tokenizer)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                yield from _rebuilt(row, row["answers"] or [], pieces)

    return met.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
