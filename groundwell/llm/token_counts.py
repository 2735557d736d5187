"""Token counts under a unigram tokenizer, without making the tokens.

A text is cut before each blank, as the tokenizer's Metaspace rule does, and each distinct stretch of a task's texts
is counted once.  An Aho-Corasick automaton lists the pieces that end at each character; for each end, the best score
and the number of pieces of the best path are carried on.  Ties go as in the tokenizer: candidates come longest first
and only a higher score replaces one; a character that no single-character piece covers may stand as unknown, at the
lowest score of the vocabulary less 10, and counts as its UTF-8 bytes where all byte pieces exist, else as one with
its unknown neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.llm.common import slices

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 300_000
WORKING_SET = 8 << 20
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])


def unigram_vocabulary(model_file: str) -> list[tuple[str, float]]:
    """(piece, log probability) from the pieces of a public model, in its order; the first is the unknown piece.

    The model ranks its pieces, and a piece of rank r gets the Zipf probability in proportion to 1 / (r + 2); byte
    pieces get that of the last rank.  Control pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)]
    ranks = {i: r for r, i in enumerate(i for i in ids if not model.is_byte(i))}
    total = np.log(sum(1 / (r + 2) for r in range(len(ranks))))
    last = len(ranks) - 1
    return [("<unk>", 0.0), *((model.id_to_piece(i), float(-np.log(ranks.get(i, last) + 2) - total)) for i in ids)]


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int = 0):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (score, len(piece)))
        self.automaton.make_automaton()
        pieces = {p for p, _ in vocabulary}
        self.by_bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.memo: dict[str, tuple[int, int]] = {}
        self.older: dict[str, tuple[int, int]] = {}

    def _one(self, word: str) -> tuple[int, int]:
        """(tokens, unknown characters) of the best path through a stretch."""
        n = len(word)
        best, count, odd = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        was_unknown = [False] * (n + 1)
        at, top, single, back = 0, None, True, 0

        def close(end: int, top, single: bool, back: int) -> None:
            unknown = False
            if not single:
                score = best[end - 1] + self.unknown
                if top is None or score > top:
                    top, back, unknown = score, end - 1, True
            best[end], was_unknown[end] = top, unknown
            if not unknown:
                count[end], odd[end] = count[back] + 1, odd[back]
                return
            more = len(word[end - 1].encode("utf-8", "replace")) if self.by_bytes else int(not was_unknown[back])
            count[end], odd[end] = count[back] + more, odd[back] + 1

        for last, (score, length) in self.automaton.iter(word):
            end = last + 1
            if end != at:
                if at:
                    close(at, top, single, back)
                for gap in range(at + 1, end):
                    close(gap, None, False, 0)
                at, top, single, back = end, None, False, 0
            candidate = score + best[end - length]
            if top is None or candidate > top:
                top, back = candidate, end - length
            single = single or length == 1
        if at:
            close(at, top, single, back)
        for gap in range(at + 1, n + 1):
            close(gap, None, False, 0)
        return count[n], odd[n]

    def of_words(self, words: list[str]) -> list[tuple[int, int]]:
        """Counts of distinct stretches (without their leading blank)."""
        if len(self.memo) > REMEMBERED:
            self.memo, self.older = {}, self.memo
        found = list(map(self.memo.get, words))
        for i, known in enumerate(found):
            if known is None:
                w = words[i]
                known = self.older.get(w) or self._one(BLANK + w)
                self.memo[w] = found[i] = known
        return found

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, unknown characters) of each text; a null is an empty text, which has none."""
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), BLANK, " ")
        filled = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
        texts = pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)
        lists = pc.split_pattern(texts, " ")
        offsets = np.asarray(lists.offsets)
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        table = np.array(self.of_words(coded.dictionary.to_pylist()), dtype=np.int64).reshape(-1, 2)
        run = np.zeros((len(coded) + 1, 2), dtype=np.int64)
        np.cumsum(table[np.asarray(coded.indices)], axis=0, out=run[1:])
        cuts = offsets - offsets[0]
        total = (run[cuts[1:]] - run[cuts[:-1]]) * filled[:, None]
        return total[:, 0], total[:, 1]


@lru_cache(maxsize=1)
def _counter(model_file: str) -> UnigramCounter:
    return UnigramCounter(unigram_vocabulary(model_file))


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, n_unknown (characters that no piece covers) for every row of ``docs``.

    Null and empty texts have no tokens.  Rows are not merged, and other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_file)
        for whole in batches:
            for batch in slices(whole, WORKING_SET):
                tokens, unknown = counter.of_texts(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens), pa.array(unknown)],
                                                 schema=COUNTS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_unknown long")
