"""Token counts of a unigram tokenizer without its tokens.

The most likely segmentation is found by dynamic programming over the matches that an
Aho-Corasick automaton enumerates in one pass; only the best score and its number of
pieces are carried. Ties are broken as the tokenizer does: the matches of one end are met
in ascending start, and a later one must score strictly more. A character that no piece
covers costs the unknown score and counts as one piece for each of its bytes.

The tokenizer is the ``tokenizers`` library's unigram model with byte fallback over the
given pieces and scores, a mark put before the text and in place of every space. It adds
scores in double precision. Pieces that cross a mark are refused, so distinct runs of
marks with their word are counted once and a text is the sum of its runs; this is exact
for scores that are whole numbers, as those of the given file are, and sums below 2**53.

Defined results: a null or empty text has no tokens; a null ``doc_id`` stays null;
repeated rows give one result each; an empty table gives no rows; texts of any length count
whole; other columns of the input, whatever their names, stay outside.
"""

import functools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from caseloom.llm.chunk_table import MARK, ChunkCodec
from caseloom.llm.common import PieceTable, small_batches, texts

UNKNOWN_PENALTY = 10.0


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces with scores, by id."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]


class Counter:
    """Counts tokens with a vocabulary of (piece, score)."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if MARK in piece.lstrip(MARK):
                raise ValueError("a piece of this vocabulary crosses a whitespace marker")
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.table = PieceTable(lambda words: [self.count_word(MARK + w.replace(" ", MARK)).to_bytes(4, "little") for w in words])

    def count_word(self, word: str) -> int:
        """Pieces of the best segmentation of a marked word."""
        n = len(word)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        reached = [True] + [False] * n
        single = [False] * n
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (length, value) in self.automaton.iter(word):
            matches[end + 1 - length].append((end + 1, value))
            if length == 1:
                single[end] = True
        for start in range(n):
            base, pieces = score[start], count[start] + 1
            for end, value in matches[start]:
                if not reached[end] or base + value > score[end]:
                    score[end], count[end], reached[end] = base + value, pieces, True
            if not single[start]:
                end, value = start + 1, base + self.unknown
                if not reached[end] or value > score[end]:
                    score[end], count[end], reached[end] = value, count[start] + len(word[start].encode()), True
        return count[n]

    def count(self, batch: list[str]) -> list[int]:
        """Token counts of whole texts."""
        return [int(np.frombuffer(x, "<u4").sum()) for x in self.table.encoded(map(ChunkCodec.runs, batch))]


@functools.cache
def counter(model_file: str) -> Counter:
    return Counter(vocabulary(model_file))


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every document, with the pieces and scores of a model file as unigram vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in small_batches(whole, "text"):
                counts = counter(model_file).count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long")
