"""Compact binary columns: whole numbers by byte planes and raw bytes, both under zstd."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _expand(raw: bytes) -> bytes:
    size = int.from_bytes(raw[:8], "little")
    return pa.decompress(raw[8:], size, codec="zstd", asbytes=True) if size else b""


def pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0 to 2^32 - 1; their bytes are kept plane by plane, so that planes of zeros cost nothing."""
    return _squeeze(np.ascontiguousarray(numbers, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_expand(raw), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_words(words: pa.Array) -> tuple[bytes, bytes]:
    """(lengths, bytes) of an array of binary values without nulls."""
    lengths = np.diff(np.asarray(pa.array(_offsets(words))))
    first, last = _offsets(words)[[0, -1]]
    return pack(lengths), _squeeze(words.buffers()[2].slice(first, last - first).to_pybytes() if last > first else b"")


def _offsets(words: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(words.type) else np.int32
    return np.frombuffer(words.buffers()[1], dtype=kind)[words.offset : words.offset + len(words) + 1]


def unpack_words(lengths: bytes, raw: bytes) -> pa.Array:
    return binary_array(unpack(lengths), _expand(raw))


def binary_array(lengths: np.ndarray, raw) -> pa.Array:
    """An array of large binaries over ``raw``, whose parts have these lengths."""
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), raw if isinstance(raw, pa.Buffer) else pa.py_buffer(raw)])


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all elements of the runs that begin at ``starts``, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
