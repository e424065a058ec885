"""SentencePiece encoding and decoding through a table of distinct marked words.

The library marks every space with U+2581 and puts one mark before the text. In a model
where no piece holds a mark behind another character, no merge crosses from a word to
the next mark, so a text is the concatenation of runs "marks, then the characters up to
the next mark", and each distinct run needs to be segmented once. A Python worker keeps
the runs it has seen in a bounded table and joins ids back by position; texts are never
shuffled.

Defined results: a null text counts as empty and gives the begin and end id only; a null
``doc_id`` stays null; repeated rows give one result each; an empty table gives no rows; texts of any length count
whole; other columns of the input, whatever their names, stay outside.
"""

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from caseloom.llm.common import PieceTable, encode_joined, small_batches, texts

MARK = "▁"
RUN = re.compile(" +[^ ]*|[^ ]+")


class ChunkCodec:
    """Encodes and decodes whole texts with the ids of one model file."""

    def __init__(self, model_file: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any(MARK in piece.lstrip(MARK) for piece in pieces):
            raise ValueError("a piece of this model crosses a whitespace marker")
        if self.model.encode("a  b", out_type=str)[0][0] != MARK or self.model.decode(self.model.encode("a  b")) != "a  b":
            raise ValueError("this model drops white space or sets no mark before a text")
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.model.bos_id(), self.model.eos_id()))
        # A lone mark at the end of a text: given an empty string, the library would put no mark.
        self.lone = self.model.encode("a ")[len(self.model.encode("a")) :]
        self.lengths = np.array([1 if self.model.is_byte(i) else len(p.replace(MARK, " ").encode()) for i, p in enumerate(pieces)], np.int64)
        self.table = PieceTable(self._segment)

    def _segment(self, runs: list[str]) -> list[bytes]:
        """Ids of each run, without begin and end."""
        return encode_joined(runs, lambda found: self.model.encode(found, num_threads=1), self._each, self.lengths)

    def _each(self, runs: list[str]) -> list[bytes]:
        found = [ids if run else self.lone for run, ids in zip(runs, self.model.encode(runs, num_threads=1))]
        flat = np.fromiter((i for ids in found for i in ids), "<u4").tobytes()
        codes, at = [], 0
        for ids in found:
            codes.append(flat[at : at + 4 * len(ids)])
            at += 4 * len(ids)
        return codes

    @staticmethod
    def runs(text: str) -> list[str]:
        """The runs of a text, each without the mark that the library puts before it."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " not in text and text[-1] != " " and text[0] != " ":
            return text.split(" ")
        return [run[1:] for run in RUN.findall(" " + text)]

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit integers."""
        return [self.begin + ids + self.end for ids in self.table.encoded(map(self.runs, batch))]

    def decode(self, batch: list[bytes]) -> list[str]:
        return self.model.decode([np.frombuffer(ids, "<u4").tolist() for ids in batch], num_threads=1)


@functools.cache
def codec(model_file: str) -> ChunkCodec:
    return ChunkCodec(model_file)


def encode_texts(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id``, ``ids`` (array of int, with begin and end) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in small_batches(whole, "text", 1_000_000):
                ids = [np.frombuffer(x, "<u4").astype("i4") for x in codec(model_file).encode(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model_file: str) -> DataFrame:
    """``doc_id`` and the decoded ``text`` of each array of ids (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in small_batches(whole, "ids"):
                ids = [x or [] for x in part.column("ids").to_pylist()]
                decoded = codec(model_file).model.decode(ids, num_threads=1) if ids else []
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(decoded, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """Encode and decode every text; return the number of ids and digests of ids and decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(model_file)
        for whole in batches:
            for part in small_batches(whole, "text"):
                ids = work.encode(part.column("text").to_pylist())
                decoded = work.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
