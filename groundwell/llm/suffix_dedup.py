"""Repeated substrings: every byte covered by a string of ``WINDOW`` bytes that starts anywhere else goes.

The suffixes of all texts are put into buckets by a q-gram, and buckets are refined by the bytes at later and earlier
offsets; suffixes that are alone in their bucket drop out.  This begins as bucket-pointer refinement does, but buckets
are not sorted on the bucket numbers of other offsets: so that not every position has to travel, a bucket holds one
anchor for a range of positions, and is refined by the anchors' contexts:

1. For every window of ``WINDOW`` bytes, the anchor is its least q-gram by hash (the leftmost of equals).  Equal
   windows have their anchors at equal offsets, so windows can be equal only if their anchors share a bucket.
   Consecutive windows with one anchor make a range.  Buckets are keyed by the anchor's q-gram.
2. Within a bucket, anchors are sorted by the hash of all bytes that their range's windows cover.  Ranges with equal
   bytes are repeated as a whole.  Buckets of one anchor are gone.
3. Of what is left, each distinct context is fetched once from its text, and within the bucket the contexts are
   compared byte by byte to both sides of the anchor: a pair agrees on the windows that its common bytes hold.
   Buckets of many contexts are refined once more instead, by the hash at every offset; those of more than a task
   should hold are dealt out by that hash.
4. Ranges are joined back to the texts and cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.llm.common import slices
from groundwell.llm.wordhash import mix, powers
from groundwell.session import settle

WINDOW = 200
Q = 24
PAIRWISE = 16  # contexts of a bucket that are compared in pairs
HELD = 20_000  # contexts of a bucket that one task holds
WORKING_SET = 1 << 20
POSITION_BITS = 28
FILTER_BITS = 23

_VALUE = np.random.default_rng(10).integers(1, 1 << 63, 256, dtype=np.uint64)

ANCHORS = pa.schema([("bucket", pa.int64()), ("context", pa.int64()), ("key", pa.int64()), ("place", pa.int64()),
                     ("known", pa.int32())])
REFINED = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("key", pa.int64()), ("place", pa.int64())])
CONTEXTS = pa.schema([("bucket", pa.int64()), ("key", pa.int64()), ("place", pa.int64()), ("bytes", pa.binary())])
RANGES = pa.schema([("key", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
FRESH, TWICE, DONE = 0, 1, 2  # anchors: met once; one of several equal ones of a task; the others of them
WHOLE, LOOK, DEAL = 0, 1, 2  # kinds of refined rows: repeated as a whole; to be compared; to be dealt out


def _key() -> Column:
    """Stands for a row; rows that agree in doc_id and text are copies of each other and share all results."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _place(anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Anchor and its distances from the first and the last window of its range, in one number."""
    return anchor << 16 | (anchor - first) << 8 | (anchor - last)


def _unplace(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, largest and smallest distance of a window's start before it)."""
    return place >> 16, place >> 8 & 255, place & 255


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(data) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * up[: len(data)], dtype=np.uint64)]), down


def anchors(texts: list[bytes], window: int = WINDOW, q: int = Q) -> tuple[np.ndarray, ...]:
    """(text number, anchor, first window, last window, bucket, context hash); places are within the text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if len(data) < window:
        return none
    total, down = _prefix(data)
    n = len(data) - q + 1
    gram = mix((total[q:] - total[:n]) * down[:n])
    low = np.uint64((1 << POSITION_BITS) - 1)
    if n > int(low):
        raise ValueError("a text is larger than positions are numbered")
    ranked = (gram & ~low) | np.arange(n, dtype=np.uint64)
    w = window - q + 1  # q-grams of a window
    padded = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = ranked
    blocks = padded.reshape(-1, w)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    least = (np.minimum(backward[:m], forward[w - 1 : w - 1 + m]) & low).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    counts = np.maximum(sizes - window + 1, 0)  # windows within each text
    text = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    if not len(at):
        return none
    anchor = least[at]
    cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    first, last = at[cut], at[np.append(cut[1:], len(at)) - 1]
    anchor, text = anchor[cut], text[cut]
    span = mix((total[last + window] - total[first]) * down[first])
    context = mix(span + ((anchor - first) * 512 + (anchor - last)).astype(np.uint64))
    base = starts[text]
    return text, anchor - base, first - base, last - base, gram[anchor], context


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, WORKING_SET):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            text, anchor, first, last, bucket, context = anchors(texts)
            keys = batch.column("key").to_numpy(zero_copy_only=False)[text]
            place = _place(anchor, first, last)
            # of equal anchors one stands for all in their bucket; the others are known to be repeated and go anywhere
            order = np.lexsort((context, bucket))
            new = np.concatenate([[True], (context[order][1:] != context[order][:-1]) | (
                bucket[order][1:] != bucket[order][:-1])]) if len(order) else np.zeros(0, bool)
            _, size = _runs(np.cumsum(new)) if len(order) else (None, np.zeros(0, np.int64))
            known = np.where(new, np.where(np.repeat(size > 1, size), TWICE, FRESH), DONE)
            bucket, context, keys, place = bucket[order], context[order], keys[order], place[order]
            bucket = np.where(known == DONE, mix(keys.view(np.uint64) ^ place.view(np.uint64)), bucket)
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket.view(np.int64)), pa.array(context.view(np.int64)), pa.array(keys), pa.array(place),
                pa.array(known.astype(np.int32))], schema=ANCHORS)


def _grouped(batches: Iterator[pa.RecordBatch], column: str = "bucket") -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by the column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy(zero_copy_only=False)
        if held and values[0] == values[-1] == held[-1].column(column)[held[-1].num_rows - 1].as_py():
            held.append(batch)  # still the same group
            continue
        cut = int(np.searchsorted(values, values[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each run of equal values, its length)."""
    cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return cut, np.diff(np.append(cut, len(values)))


def _refine(batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Second step, over anchors sorted by bucket and context."""
    for table in _grouped(batches):
        done = np.flatnonzero(table["known"].to_numpy() == DONE)
        if len(done):
            bucket, key, place = (table[c].to_numpy()[done] for c in ("bucket", "key", "place"))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(done), WHOLE, np.int32)), *map(
                pa.array, (bucket, key, place))], schema=REFINED)
            table = table.filter(pa.array(np.logical_not(np.isin(np.arange(table.num_rows), done))))
            if not table.num_rows:
                continue
        bucket, context, key, place, known = (table[c].to_numpy() for c in ANCHORS.names)
        at, size = _runs(bucket)
        of = np.repeat(np.arange(len(at)), size)
        new = np.concatenate([[True], (context[1:] != context[:-1]) | (bucket[1:] != bucket[:-1])])
        kind_at = np.flatnonzero(new)
        rows_each = np.diff(np.append(kind_at, len(key)))
        copies = np.add.reduceat(1 + (known == TWICE), kind_at)
        repeated = np.repeat(copies > 1, rows_each)
        kinds = np.bincount(of[kind_at], minlength=len(at))
        single = np.bincount(of[kind_at], weights=copies == 1, minlength=len(at))
        look = kind_at[((kinds > 1) & (single > 0))[of[kind_at]]]  # one anchor for each context of such a bucket
        kind = np.where(kinds[of[look]] > held, DEAL, LOOK)
        rows = np.concatenate([np.flatnonzero(repeated), look])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([np.full(int(repeated.sum()), WHOLE), kind]).astype(np.int32)),
            pa.array(bucket[rows]), pa.array(key[rows]), pa.array(place[rows])], schema=REFINED)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Third step: the bytes around each anchor, or one row for each of its windows where those are dealt out."""
    for batch in batches:
        out: list[tuple] = []
        held = 0
        for text, key, looks in zip(batch.column("text").cast(pa.binary()), batch.column("key").to_pylist(),
                                    batch.column("looks")):
            data = text.as_py()
            looks = looks.values
            kinds, buckets, places = (looks.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for kind, bucket, place in zip(kinds.tolist(), buckets.tolist(), places.tolist()):
                a, far, near = place >> 16, place >> 8 & 255, place & 255
                if kind == LOOK:
                    out.append((bucket, key, place, data[max(0, a - WINDOW + Q) : a + WINDOW]))
                else:
                    part = np.frombuffer(data, np.uint8)[a - far : a - near + WINDOW]
                    total, down = _prefix(part)
                    n = far - near + 1
                    hashes = mix((total[WINDOW : WINDOW + n] - total[:n]) * down[:n] + np.uint64(bucket % (1 << 64)))
                    out += [(h, key, a << 16 | (far - k) << 8 | (far - k), None)
                            for k, h in enumerate(hashes.view(np.int64).tolist())]
                held += WINDOW
                if held > 1 << 22:
                    yield _context_batch(out)
                    out, held = [], 0
        yield _context_batch(out)


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CONTEXTS)], schema=CONTEXTS)


LEFT = WINDOW - Q  # bytes before an anchor that a window may hold


def _matrix(table: pa.Table, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts with the anchor at column LEFT, bytes known before it, bytes known from it on)."""
    column = table["bytes"].combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    sizes = np.diff(offsets)
    before = np.minimum(anchor, LEFT)
    out = np.zeros((len(column), LEFT + WINDOW), dtype=np.uint8)
    row = np.repeat(np.arange(len(column)), sizes)
    k = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, k + np.repeat(LEFT - before, sizes)] = data[offsets[0] : offsets[-1]]
    return out, before, sizes - before


def _agreement(x: np.ndarray, before: np.ndarray, after: np.ndarray, i: np.ndarray, j: np.ndarray):
    """(common bytes before the anchors, common bytes from them on) of pairs of contexts."""
    same = x[i] == x[j]
    left = np.where(same[:, :LEFT].all(axis=1), LEFT, (~same[:, LEFT - 1 :: -1] if LEFT else same).argmax(axis=1))
    right = np.where(same[:, LEFT:].all(axis=1), WINDOW, (~same[:, LEFT:]).argmax(axis=1))
    return np.minimum(left, np.minimum(before[i], before[j])), np.minimum(right, np.minimum(after[i], after[j]))


def _ranges(key: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (key, first, last)], schema=RANGES)


def _compare(batches: Iterator[pa.RecordBatch], pairwise: int = PAIRWISE) -> Iterator[pa.RecordBatch]:
    """Third step, over contexts sorted by bucket; windows that were dealt out are repeated if not alone."""
    for table in _grouped(batches):
        for part in _bounded(table):
            yield from _compare_groups(part, pairwise)


def _bounded(table: pa.Table) -> Iterator[pa.Table]:
    """Cuts a table of whole groups into tables of whole groups of bounded size."""
    at, size = _runs(table["bucket"].to_numpy())
    start = 0
    for a, n in zip(at.tolist(), size.tolist()):
        if a + n - start > HELD and a > start:
            yield table.slice(start, a - start)
            start = a
    yield table.slice(start)


def _compare_groups(table: pa.Table, pairwise: int) -> Iterator[pa.RecordBatch]:
    bucket, key, place = (table[c].to_numpy() for c in ("bucket", "key", "place"))
    anchor, far, near = _unplace(place)
    dealt = table["bytes"].is_null().to_numpy()
    at, size = _runs(bucket)
    sizes = np.repeat(size, size)
    if dealt.any():
        hit = dealt & (sizes > 1)
        yield _ranges(key[hit], (anchor - far)[hit], (anchor - far)[hit])
    small = ~dealt & (sizes > 1) & (sizes <= pairwise)
    if small.any():
        rows = np.flatnonzero(small)
        b, k, a, f, c = bucket[rows], key[rows], anchor[rows], far[rows], near[rows]
        x, before, after = _matrix(table.take(pa.array(rows)), a)
        i, step = np.arange(len(rows)), 1
        while len(i):
            i = i[i + step < len(rows)]
            i = i[b[i + step] == b[i]]
            j = i + step
            for s in range(0, len(i), 8192):
                p, r = i[s : s + 8192], j[s : s + 8192]
                left, right = _agreement(x, before, after, p, r)
                for one in (p, r):
                    low, high = np.maximum(WINDOW - right, c[one]), np.minimum(left, f[one])
                    ok = low <= high
                    yield _ranges(k[one][ok], (a[one] - high)[ok], (a[one] - low)[ok])
            step += 1
    for s, n in zip(at.tolist(), size.tolist()):
        if n > pairwise and not dealt[s]:
            yield from _by_offset(table.slice(s, n), key[s : s + n], anchor[s : s + n], far[s : s + n], near[s : s + n])


def _by_offset(table: pa.Table, key, anchor, far, near) -> Iterator[pa.RecordBatch]:
    """One large bucket, refined by the hash of the window at every offset."""
    x, _, _ = _matrix(table, anchor)
    up, down = powers(x.shape[1] + 1)
    total = np.zeros((len(x), x.shape[1] + 1), dtype=np.uint64)
    np.cumsum(_VALUE[x] * up[None, : x.shape[1]], axis=1, dtype=np.uint64, out=total[:, 1:])
    for offset in range(int(near.min()), int(far.max()) + 1):
        rows = np.flatnonzero((near <= offset) & (offset <= far))
        a = LEFT - offset
        h = mix((total[rows, a + WINDOW] - total[rows, a]) * down[a])
        order = np.argsort(h, kind="stable")
        _, size = _runs(h[order])
        hit = rows[order][np.repeat(size > 1, size)]
        if len(hit):
            yield _ranges(key[hit], anchor[hit] - offset, anchor[hit] - offset)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fourth step: texts without their repeated bytes."""
    for batch in batches:
        out = []
        for text, key, ranges in zip(batch.column("text").cast(pa.binary()), batch.column("key").to_pylist(),
                                     batch.column("ranges")):
            data = np.frombuffer(text.as_py(), np.uint8)
            mark = np.zeros(len(data) + 1, dtype=np.int64)
            first, last = (ranges.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            np.add.at(mark, first, 1)
            np.add.at(mark, last + WINDOW, -1)
            gone = np.cumsum(mark[:-1]) > 0
            kept = data[~gone].tobytes()
            spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
            out.append((key, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string(), pa.binary()])],
            ["key", "n_removed", "n_spans", "kept_sha256", "kept"])


def _maybe(keys: DataFrame):
    """A test that holds for all of the keys and few others, from a bit table of a fixed size."""
    bits = np.zeros(1 << FILTER_BITS >> 3, dtype=np.uint8)
    slots = keys.select(F.shiftrightunsigned("key", 64 - FILTER_BITS).alias("slot")).distinct()
    for batch in slots.toArrow().to_batches():  # 1 << FILTER_BITS rows at most
        slot = batch.column("slot").to_numpy(zero_copy_only=False)
        np.bitwise_or.at(bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))

    @F.arrow_udf("boolean")
    def known(key: pa.Array) -> pa.Array:
        slot = (key.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        return pa.array((bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool))

    return known


def repeated_ranges(keyed: DataFrame, held: int = HELD, pairwise: int = PAIRWISE) -> DataFrame:
    """(key, first, last): ranges of starts of repeated windows, of texts ``keyed`` (key, text)."""
    found = keyed.mapInArrow(_emit_anchors, "bucket long, context long, key long, place long, known int")
    sorted_ = found.repartition("bucket").sortWithinPartitions("bucket", "context", "known")
    refined = settle(sorted_.mapInArrow(partial(_refine, held=held), "kind int, bucket long, key long, place long"), "refined")
    looks = refined.where(F.col("kind") != WHOLE)
    known = _maybe(looks)
    by_text = looks.groupBy("key").agg(F.collect_list(F.struct("kind", "bucket", "place")).alias("looks"))
    unique = keyed.where(known("key")).dropDuplicates(["key"])
    fetched = unique.join(by_text, "key").select("key", "text", "looks").mapInArrow(
        _fetch, "bucket long, key long, place long, bytes binary")
    met = fetched.repartition("bucket").sortWithinPartitions("bucket")
    compared = met.mapInArrow(partial(_compare, pairwise=pairwise), "key long, first long, last long")
    anchor, far, near = (F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255),
                         F.col("place").bitwiseAND(255))
    whole = refined.where(F.col("kind") == WHOLE).select(
        "key", (anchor - far).alias("first"), (anchor - near).alias("last"))
    return whole.unionByName(compared)


def without_repeats(docs: DataFrame, with_text: bool = False, held: int = HELD,
                    pairwise: int = PAIRWISE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes that stay) for every row of ``docs``.

    A null text is empty; a text of under ``WINDOW`` bytes loses nothing.  Rows that agree in doc_id and text are
    copies like any others.  Other columns are not looked at.  No rows give no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), text.alias("text"))
    ranges = settle(repeated_ranges(keyed.select("key", "text"), held, pairwise), "ranges")
    known = _maybe(ranges)
    by_text = ranges.distinct().groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    cut = keyed.select("key", "text").where(known("key")).dropDuplicates(["key"]).join(by_text, "key").select(
        "key", "text", "ranges").mapInArrow(
        _cut, "key long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    light = keyed.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"),
                         F.sha2(F.col("text").cast("binary"), 256).alias("whole"),
                         *([F.col("text").cast("binary").alias("all")] if with_text else []))
    joined = light.join(cut if with_text else cut.drop("kept"), "key", "left")
    return joined.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
        *([F.coalesce("kept", "all").alias("kept")] if with_text else []))
