"""Token ids in a compact binary table, coded with a static range asymmetric numeral system (rANS).

One table of frequencies is shared by all blocks.  A block holds whole documents, is coded by ``LANES`` interleaved
states and can be decoded alone; inside a block, checkpoints hold the states and the place in the word stream, so
that decoding may also begin there.  Every block carries a CRC-32 of its ids.

Layout of a folder: ``ids/`` has (id, freq), whose frequencies sum to ``1 << SCALE``; ``blocks/`` has one row per
block: shard, block, first_token (within the shard), n_tokens, doc_ids, doc_lens, crc, payload.  A payload is, all
little-endian: lanes u32, n_tokens u32, n_words u32, n_checkpoints u32; per checkpoint step u32 and word u32; per
checkpoint the states u64; then the words u32.  The first checkpoint is at step 0.  Spark's own committer writes
the files, so a lost executor leaves no half-written shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.llm.bpe_ids import WordMemo
from groundwell.llm.common import crc_of, lean, parts, slices, worker_cache
from groundwell.session import fresh_folder, scratch, settle

SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 2048
CHECKPOINT_STEPS = 128
BLOCK_TOKENS = 1 << 19
SHARD_TOKENS = 4_000_000
END_ID = 0
WORKING_SET = 1 << 22  # bytes of text taken up at once

STAGED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
BLOCKS = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("crc", pa.int64()),
    ("payload", pa.binary())])
READ = pa.schema([
    ("doc_id", pa.int64()), ("shard", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()),
    ("ids_crc32", pa.int64()), ("ids", pa.binary())])


class Table:
    """The shared frequencies as arrays that numpy can index by id and by slot."""

    def __init__(self, ids: list[int], freqs: list[int]):
        top = max(ids, default=0) + 1
        self.freq = np.zeros(top, dtype=np.uint64)
        self.freq[ids] = np.array(freqs, dtype=np.uint64)
        self.cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.slot = np.repeat(np.arange(top, dtype=np.uint32), self.freq.astype(np.int64))


def share_out(counts: dict[int, int]) -> tuple[list[int], list[int]]:
    """Frequencies summing to ``1 << SCALE``; every counted id gets at least 1, ties go to the smaller id."""
    if len(counts) > 1 << SCALE:
        raise ValueError("more ids than slots")
    ids = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[i] for i in ids.tolist()], dtype=np.float64)
    if not len(ids):
        return [], []
    spare = (1 << SCALE) - len(ids)
    exact = n / n.sum() * spare
    freq = np.floor(exact).astype(np.int64) + 1
    short = (1 << SCALE) - int(freq.sum())
    order = np.lexsort((ids, np.floor(exact) - exact))
    freq[order[:short]] += 1
    return ids.tolist(), freq.tolist()


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    n, steps = len(ids), -(-len(ids) // LANES)
    x = np.full(LANES, LOW, dtype=np.uint64)
    f_all, c_all = table.freq[ids], table.cum[ids]
    chunks: list[np.ndarray] = []
    marks: list[tuple[int, int, np.ndarray]] = []
    written = 0
    for t in range(steps - 1, -1, -1):
        f, c = f_all[t * LANES : (t + 1) * LANES], c_all[t * LANES : (t + 1) * LANES]
        xs = x[: len(f)]
        full = xs >= f << np.uint64(63 - SCALE)
        if full.any():
            out = xs[full]
            chunks.append(out.astype(np.uint32))  # the low half
            written += len(out)
            xs[full] = out >> np.uint64(32)
        q = xs // f
        xs[:] = (q << np.uint64(SCALE)) + (xs - q * f) + c
        if t % CHECKPOINT_STEPS == 0:
            marks.append((t, written, x.copy()))
    if not marks:
        marks.append((0, 0, x))
    marks.reverse()
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
    head = struct.pack("<4I", LANES, n, len(words), len(marks))
    places = np.array([(t, written - w) for t, w, _ in marks], dtype="<u4").tobytes()
    states = np.concatenate([s for _, _, s in marks]).astype("<u8").tobytes()
    return head + places + states + words.astype("<u4").tobytes()


def decode_block(payload: bytes, table: Table, checkpoint: int = 0) -> np.ndarray:
    """The ids of a block from a checkpoint on."""
    lanes, n, n_words, n_marks = struct.unpack_from("<4I", payload)
    places = np.frombuffer(payload, "<u4", 2 * n_marks, 16).reshape(-1, 2)
    states = np.frombuffer(payload, "<u8", lanes * n_marks, 16 + 8 * n_marks).reshape(-1, lanes)
    words = np.frombuffer(payload, "<u4", n_words, 16 + 8 * n_marks + 8 * lanes * n_marks).astype(np.uint64)
    x = states[checkpoint].astype(np.uint64)
    first, at = (int(v) for v in places[checkpoint])
    out = np.empty(max(0, n - first * lanes), dtype=np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    for a in range(0, len(out), lanes):
        xs = x[: min(lanes, len(out) - a)]
        slot = xs & mask
        ids = table.slot[slot]
        out[a : a + len(ids)] = ids
        xs[:] = table.freq[ids] * (xs >> np.uint64(SCALE)) + slot - table.cum[ids]
        low = xs < LOW
        k = int(np.count_nonzero(low))
        if k:
            xs[low] = (xs[low] << np.uint64(32)) | words[at : at + k]
            at += k
    return out


@worker_cache
@lru_cache(maxsize=1)
def _memo(path: str) -> WordMemo:
    return WordMemo(path)


def stage_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n, ids) of every whole text, the end id included; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(tokenizer)
        for whole in batches:
            for batch in slices(whole, WORKING_SET):
                ids, cuts = memo.encode(batch.column("text"), END_ID)
                held = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [
                    None, pa.py_buffer(cuts * memo.width.itemsize), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(cuts)), held.cast(pa.binary())], schema=STAGED)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return settle(rows.mapInArrow(lean(run, _memo), "doc_id long, n long, ids binary"), "token-ids")


def count_ids(staged: DataFrame, width: str) -> dict[int, int]:
    """How often each id occurs; the driver gets one row per id of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            column = batch.column("ids")
            if batch.num_rows:
                first, last = (np.frombuffer(column.buffers()[1], "<i4")[column.offset + k] for k in (0, batch.num_rows))
                found = np.bincount(np.frombuffer(column.buffers()[2][first:last], dtype=width))
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
                total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    counted = staged.select("ids").mapInArrow(lean(run), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r.id: r.n for r in counted.collect()}


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, shard_tokens: int = SHARD_TOKENS,
                 block_tokens: int = BLOCK_TOKENS) -> None:
    """Encodes every whole text, in ascending order of doc_id, into the folder.

    A null text is empty and yields the end id alone.  Null ids come first; rows that share an id are ordered by
    their ids' bytes, so reruns agree.  No rows give an empty folder of both tables.
    """
    spark = docs.sparkSession
    width = _memo(tokenizer).width.str
    staged = stage_ids(docs, tokenizer)
    counts = count_ids(staged, width)
    ids, freqs = share_out(counts)
    spark.createDataFrame(list(zip(ids, freqs)), "id int, freq int").coalesce(1).write.parquet(f"{folder}/ids")
    table = Table(ids, freqs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, block, first
            joined = np.concatenate([x for _, x in held])
            row = {"shard": shard, "block": block, "first_token": first, "n_tokens": size,
                   "doc_ids": [d for d, _ in held], "doc_lens": [len(x) for _, x in held], "crc": crc_of(joined),
                   "payload": encode_block(joined, table)}
            held, first, block, size = [], first + size, block + 1, 0
            return pa.RecordBatch.from_pylist([row], schema=BLOCKS)

        for batch in batches:
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                coded = np.frombuffer(value.as_py(), dtype=width)
                held.append((doc, coded))
                size += len(coded)
                if size >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    shards = parts(sum(counts.values()), shard_tokens)
    order = ["doc_id", F.xxhash64("ids"), "ids"]
    ranged = staged.select("doc_id", "ids").repartitionByRange(shards, *order[:2]).sortWithinPartitions(*order)
    ranged.mapInArrow(run, "shard int, block int, first_token long, n_tokens long, doc_ids array<bigint>, "
                           "doc_lens array<bigint>, crc long, payload binary").write.parquet(f"{folder}/blocks")


def read_table(spark: SparkSession, folder: str) -> Table:
    rows = spark.read.schema("id int, freq int").parquet(f"{folder}/ids").orderBy("id").collect()
    return Table([r.id for r in rows], [r.freq for r in rows])


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 and the ids (little-endian u32).

    A block whose ids do not match its checksum raises.
    """
    table = read_table(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = decode_block(row["payload"], table)
                if len(ids) != row["n_tokens"] or crc_of(ids) != row["crc"]:
                    raise ValueError(f"shard {row['shard']}, block {row['block']}: checksum")
                ends = np.cumsum(row["doc_lens"])
                starts = ends - row["doc_lens"]
                pieces = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(pieces)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * n, pa.int32()),
                    pa.array(starts + row["first_token"], pa.int64()), pa.array(row["doc_lens"], pa.int64()),
                    pa.array([zlib.crc32(p.data) for p in pieces], pa.int64()),
                    pa.array([p.tobytes() for p in pieces] if with_ids else [None] * n, pa.binary())], schema=READ)

    blocks = spark.read.schema(
        "shard int, block int, first_token long, n_tokens long, doc_ids array<bigint>, doc_lens array<bigint>, "
        "crc long, payload binary").parquet(f"{folder}/blocks")
    docs = blocks.mapInArrow(
        run, "doc_id long, shard int, start long, n_tokens long, ids_crc32 long, ids binary")
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("here"))  # one row per shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("base"))
    joined = docs.join(base, "shard").withColumn("start", F.col("start") + F.col("base"))
    return joined.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the files to the shared folder and returns what reading them back gives, without the ids."""
    folder = fresh_folder(docs.sparkSession, "tokens")
    with scratch(docs.sparkSession):
        write_tokens(docs, folder, tokenizer)
    return read_tokens(docs.sparkSession, folder, with_ids=False)
