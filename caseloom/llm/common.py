"""What the operators of this folder share: reading tables, clean inputs, word-wise encoding tables."""

from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that Spark alone needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Ask Spark for Arrow batches of at most ``rows`` rows from here on: whole texts can be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the whole ``text`` (null: empty); any other column of the input stays outside."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def id_crc_mod(column: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``: the fold a row belongs to."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(parts))


class PieceTable:
    """Distinct strings and what they encode to, for the life of a Python worker.

    ``encode`` turns a list of distinct strings into as many byte strings. Strings live in
    two generations of about ``limit`` / 2 each: when the newer one is full it becomes the older
    one, and what is met again moves back, so frequent strings stay. Strings over ``longest``
    characters are encoded where they occur but not kept, so memory is bounded whatever the
    corpus; workers are used again by later stages, which find it taken.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 100_000, longest: int = 64):
        self.encode, self.limit, self.longest = encode, limit, longest
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encoded(self, split: Iterable[list[str]]) -> list[bytes]:
        """For each list of strings, their encodings joined in order."""
        split = list(split)
        if len(self.known) > self.limit // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new, extra = [], {}
        for word in set().union(*(set(words).difference(known) for words in split)):
            if word in older:
                known[word] = older[word]
            else:
                new.append(word)
        if new:
            for word, code in zip(new, self.encode(new)):
                (known if len(word) <= self.longest else extra)[word] = code
        found = known.__getitem__
        if extra:
            found = lambda word: extra[word] if word in extra else known[word]
        return [b"".join(map(found, words)) for words in split]


def encode_joined(runs: list[str], encode: Callable[[list[str]], list[list[int]]], each: Callable[[list[str]], list[bytes]], lengths: np.ndarray, at_once: int = 250) -> list[bytes]:
    """Ids of each run, as little-endian unsigned 32-bit integers, under a tokenizer that joins no characters across a space
    behind a character other than white space.

    ``encode`` takes texts of up to ``at_once`` runs with a space between them, whose ids are cut where the runs end: ``lengths``
    holds the bytes that each id stands for, a run's with the space before it. Runs that are empty or end in white space, and those
    of a text whose ids do not end where its runs do, go to ``each`` by themselves.
    """
    plain = [run for run in runs if run and not run[-1].isspace()]
    chunks = [plain[i : i + at_once] for i in range(0, len(plain), at_once)]
    found = encode(list(map(" ".join, chunks))) if chunks else []
    ids = np.fromiter(chain.from_iterable(found), "<u4")
    # Bytes that end with each id, and those that end with each run.
    ends = np.cumsum(lengths[ids])
    own = np.cumsum(np.fromiter(map(len, map(str.encode, plain)), np.int64, len(plain)) + 1)
    cuts = np.searchsorted(ends, own) + 1
    if len(plain) and (cuts[-1] != len(ids) or (ends[cuts - 1] != own).any()):
        if len(chunks) > 1:
            return [code for i in range(0, len(runs), at_once) for code in encode_joined(runs[i : i + at_once], encode, each, lengths, at_once)]
        return each(runs)
    code, cuts = ids.tobytes(), (4 * cuts).tolist()
    known = dict(zip(plain, [code[i:j] for i, j in zip([0, *cuts], cuts)]))
    alone = [run for run in runs if run not in known] if len(plain) < len(runs) else []
    if alone:
        known.update(zip(alone, each(alone)))
    return list(map(known.__getitem__, runs))


def small_batches(batch: pa.RecordBatch, column: str, characters: int = 8_000_000) -> Iterable[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``characters`` bytes, so that one batch of very long texts stays small."""
    step = max(1, min(batch.num_rows, characters * batch.num_rows // max(1, batch.column(column).nbytes)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)
