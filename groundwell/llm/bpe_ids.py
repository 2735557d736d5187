"""Texts to token ids with a public byte-level BPE tokenizer, remembering words already seen.

Byte-level BPE cuts a text before it merges, and a single space with visible characters on both sides always
begins a new piece.  So the stretches between such spaces can be encoded once each and looked up from then on.
A text that has a space beside other white space is handed to the tokenizer as a whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

REMEMBERED = 300_000  # stretches in each of a worker's two memories
JOINED = 1_000  # stretches that are encoded in one call
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")  # letters under every version of Unicode
ENDINGS = ".,"  # a stretch that ends in one of these after a letter is encoded without it


class WordMemo:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same merges for words of letters alone, which are one piece each: cut at the spaces and nowhere else
        self.letters = Tokenizer.from_file(path)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.tokenizer.get_vocab_size()
        self.width = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.memo: dict[str, bytes] = {}  # of late
        self.older: dict[str, bytes] = {}
        self.endings = self.whole(list(ENDINGS))
        self.remembered = remembered

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(f.ids, dtype=self.width).tobytes() for f in found]

    def _encode(self, words: list[str], tokenizer) -> None:
        for at in range(0, len(words), JOINED):
            group = words[at : at + JOINED]
            found = tokenizer.encode_batch_fast([" " + " ".join(group)], add_special_tokens=False)[0].ids
            ids = np.array(found, dtype=self.width)
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) != len(group):
                raise ValueError("the tokenizer does not begin a piece at each single space")
            raw, step = ids.tobytes(), self.width.itemsize
            ends = np.append(cuts[1:], len(ids)) * step
            for w, a, b in zip(group, (cuts * step).tolist(), ends.tolist()):
                self.memo[w] = raw[a:b]

    def _known(self, words: list[str]) -> list[bytes | None]:
        """The ids of distinct words; None for those that begin or end with white space and cannot stand alone.

        The memory is in two halves: when the newer is full it becomes the older, and what is still used moves back.
        """
        if len(self.memo) > self.remembered:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        found = list(map(memo.get, words))
        new = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            w = words[i]
            ids = older.get(w)
            if ids is not None:
                found[i] = memo[w] = ids
            elif w and not w[0].isspace() and not w[-1].isspace():
                new.append(i)
        of_letters = _LETTERS.fullmatch
        self._encode([words[i] for i in new if of_letters(words[i])], self.letters)
        self._encode([words[i] for i in new if not of_letters(words[i])], self.tokenizer)
        for i in new:
            found[i] = memo[words[i]]
        return found

    @staticmethod
    def _ended(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(words without a last full stop or comma after a letter, 0 for a stop, 1 for a comma, 2 for neither).

        After a letter, such a mark is a piece of its own.
        """
        core = pc.utf8_rtrim(words, characters=ENDINGS)
        one = pc.equal(pc.subtract(pc.binary_length(words), pc.binary_length(core)), 1)
        cut = pc.and_(one, pc.utf8_is_alpha(pc.utf8_slice_codeunits(core, -1, 1 << 30)))
        comma = pc.ends_with(words, ",").to_numpy(zero_copy_only=False)
        return pc.if_else(cut, core, words), np.where(cut.to_numpy(zero_copy_only=False), comma.astype(np.int32), 2)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts one after the other, where each text begins and the last ends).

        A null is an empty text; ``end`` is put after each text.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        lists = pc.split_pattern(texts, " ")
        offsets = np.asarray(lists.offsets)
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        n = len(texts)
        inner = np.ones(len(flat), dtype=bool)
        inner[offsets[:-1]] = False
        coded = flat.filter(pa.array(inner)).dictionary_encode()
        firsts = flat.take(pa.array(offsets[:-1])).to_pylist()
        core, ending = self._ended(coded.dictionary)
        core = core.dictionary_encode()
        known = self._known(core.dictionary.to_pylist())
        # runs of ids: cores, endings, openings of texts, the end
        runs = [k or b"" for k in known] + [*self.endings, b""] + self.whole(firsts)
        runs.append(b"" if end is None else np.array([end], dtype=self.width).tobytes())
        sizes = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs)) // self.width.itemsize
        ids, starts = np.frombuffer(b"".join(runs), dtype=self.width), np.cumsum(sizes) - sizes
        # each distinct word is its core and its ending
        core_of, two = np.asarray(core.indices), np.empty((len(coded.dictionary), 2), dtype=np.int64)
        two[:, 0], two[:, 1] = core_of, len(known) + ending
        table = ids[_places(starts[two.ravel()], sizes[two.ravel()])]
        word_sizes = sizes[two].sum(axis=1)
        sizes = np.concatenate([word_sizes, sizes[len(known) + 3 :]])
        ids, starts = np.concatenate([table, ids[starts[len(known) + 3] :]]), np.cumsum(sizes) - sizes
        # and each text is its opening, its words and the end
        order = np.empty(len(flat) + n, dtype=np.int64)
        last = offsets[1:] + np.arange(n)
        order[last] = len(word_sizes) + n
        body = np.ones(len(order), dtype=bool)
        body[last] = False
        order[body] = self._pieces(inner, np.asarray(coded.indices), len(word_sizes), n)
        lengths = sizes[order]
        out = ids[_places(starts[order], lengths)]
        ends = np.cumsum(lengths)[last]
        cuts = np.concatenate([[0], ends])
        slow = {t for t, first in enumerate(firsts) if not first or first[-1].isspace()}
        bad = np.fromiter((k is None for k in known), dtype=bool, count=len(known))
        if bad.any():
            at = np.flatnonzero(inner)[bad[core_of[np.asarray(coded.indices)]]]
            slow |= set((np.searchsorted(offsets, at, side="right") - 1).tolist())
        return self._whole_texts(texts, sorted(slow), out, cuts, end) if slow else (out, cuts)

    @staticmethod
    def _pieces(inner: np.ndarray, word: np.ndarray, words: int, n: int) -> np.ndarray:
        pieces = np.empty(len(inner), dtype=np.int64)
        pieces[inner] = word
        pieces[~inner] = words + np.arange(n)
        return pieces

    def _whole_texts(self, texts: pa.Array, slow: list[int], out: np.ndarray, cuts: np.ndarray,
                     end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Puts texts that were encoded as a whole in their places."""
        tail = np.array([] if end is None else [end], dtype=self.width)
        parts, at, sizes = [], 0, np.diff(cuts)
        for t, found in zip(slow, self.whole(texts.take(pa.array(slow)).to_pylist())):
            ids = np.concatenate([np.frombuffer(found, dtype=self.width), tail])
            parts += [out[cuts[at] : cuts[t]], ids]
            sizes[t], at = len(ids), t + 1
        return np.concatenate([*parts, out[cuts[at] :]]), np.concatenate([[0], np.cumsum(sizes)])


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all elements of the runs that begin at ``starts``, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(starts.max(initial=0)) + total) < 1 << 31 else np.int64
    return np.arange(total, dtype=kind) + np.repeat((starts - (ends - lengths)).astype(kind), lengths)
