"""The bytes that the ids of a byte-level tokenizer stand for, and where its texts may be cut."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def byte_alphabet() -> dict[str, int]:
    """The visible character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_level_pieces(tokenizer) -> pa.Array:
    """id -> bytes for the whole vocabulary, added tokens included; an entry beyond the alphabet stands for itself."""
    alphabet = byte_alphabet()
    found = {}
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        known = [alphabet.get(c) for c in token]
        found[i] = token.encode() if None in known else bytes(known)
    return pa.array([found.get(i, b"") for i in range(max(found, default=-1) + 1)], pa.large_binary())


def sentence_pieces(processor) -> pa.Array:
    """id -> bytes of a piece model: U+2581 is a blank, <0xHH> a byte."""
    out = []
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace("▁", " ").encode())
    return pa.array(out, pa.large_binary())


_BLANK = np.isin(np.arange(256), [9, 10, 13, 32])
_SHOWN = (np.arange(256) > 32) & (np.arange(256) != 127)


def _visible_before(data: np.ndarray) -> np.ndarray:
    """For each byte: is the character that ends just before it visible under every reading of white space?

    Characters of two and three bytes from ranges that hold odd spaces or signs without width count as unsure.
    """
    n = len(data)
    sure = np.zeros(n, dtype=bool)
    sure[1:] = _SHOWN[data[:-1]]
    far = np.flatnonzero(sure & (np.concatenate([[0], data[:-1]]) >= 0x80))
    if len(far):
        two, three = data[np.maximum(far - 2, 0)], data[np.maximum(far - 3, 0)]
        odd = (two == 0xC2) | ((three == 0xE1) & ((two == 0x9A) | (two == 0xA0))) | (
            (three == 0xE2) & ((two == 0x80) | (two == 0x81) | (two == 0x96))) | (
            (three == 0xE3) & (two == 0x80)) | (three == 0xEF)
        sure[far[odd]] = False
    return sure


def blank_cuts(data: np.ndarray) -> np.ndarray:
    """True where a blank, tab or line end follows a visible character: byte-level rules always begin a piece there."""
    return _BLANK[data] & _visible_before(data)


_LETTER = np.isin(np.arange(256) | 32, np.arange(97, 123)) & (np.arange(256) < 128)
_STOP = np.isin(np.arange(256), np.frombuffer(b".,;:!?", dtype=np.uint8))


def word_cuts(data: np.ndarray) -> np.ndarray:
    """``blank_cuts``, and where a stop follows an ASCII letter; a piece always begins there as well."""
    cut = blank_cuts(data)
    cut[1:] |= _STOP[data[1:]] & _LETTER[data[:-1]]
    return cut


def space_cuts(data: np.ndarray) -> np.ndarray:
    """True at a space after a visible character: no byte-level piece and no piece with a leading blank spans it."""
    return (data == 32) & _visible_before(data)
