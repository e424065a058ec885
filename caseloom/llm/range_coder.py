"""Token ids in binary files, compressed by an adaptive range coder.

Format of a block: 4 bytes number of ids, 4 bytes crc32 of the ids as little-endian
unsigned 32-bit integers, then the coder's 16-bit words (little-endian). Every block
starts from the same state, so blocks are read alone and a damaged one is noticed.

Model: order 2 and order 1 each predict the id that last followed the two ids, or the
one id, before; order 0 is the adaptive distribution of the ids' bit lengths. One symbol
says which prediction holds, or else the id's bit length, whose remaining bits follow.
The symbol's distribution mixes an adaptive one of order 0 with one for the confidence
that the two predictions have earned. Blocks are coded side by side, one numpy lane
each, so a step codes one id of every block.

A file is a Parquet table of segments: consecutive documents (ids and counts) with their
blocks. Documents are dealt into ranges of ``doc_id``, sorted and written in that order,
so ``bucket`` and ``segment`` order the files' rows by ascending ``doc_id``.

Defined results: a null or empty text holds the end id alone; null ids come before all
others; rows of one id are ordered by text and each has its own place; an empty table gives no rows; texts of any length count
whole; other columns of the input, whatever their names, stay outside.
"""

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from caseloom.llm.common import PieceTable, texts
from caseloom.sources.tables import stage

BLOCK = 8192  # Ids of a block.
SEGMENT = 8_000_000  # Ids of a segment, about.
BITS = 21  # Ids are below 2 ** BITS.
SYMBOLS = BITS + 3
SCALE = 12
SLOTS = 2048  # Contexts kept for each order and lane.
_TARGETS = np.where(np.arange(SYMBOLS - 1)[None, :] >= np.arange(SYMBOLS)[:, None], 1 << SCALE, 0).astype(np.int16)
_STEPS = (2 * np.arange(1, SYMBOLS)).astype(np.int16)


class _Model:
    """The adaptive state of all lanes."""

    def __init__(self, lanes: int):
        start = (np.arange(1, SYMBOLS) * ((1 << SCALE) // SYMBOLS)).astype(np.int16)
        self.base = np.tile(start, (lanes, 1))
        self.trust = np.tile(start, (16 * lanes, 1))
        self.two, self.one = np.zeros(SLOTS * lanes, np.int32), np.zeros(SLOTS * lanes, np.int32)
        self.before, self.last = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.bounds = np.zeros((lanes, SYMBOLS + 1), np.int16)
        self.bounds[:, -1] = 1 << SCALE
        self.at = np.arange(lanes, dtype=np.int32)

    def predict(self, n: int) -> None:
        """Predicted ids, their confidence and the symbols' bounds for the first ``n`` lanes."""
        lane = self.at[:n]
        self.i2 = lane * SLOTS + ((self.before[:n] * 40503 ^ self.last[:n]) & (SLOTS - 1))
        self.i1 = lane * SLOTS + (self.last[:n] & (SLOTS - 1))
        self.e2, self.e1 = self.two[self.i2], self.one[self.i1]
        self.row = lane * 16 + ((self.e2 & 3) << 2) + (self.e1 & 3)
        self.own = self.trust[self.row]
        mixed = (self.base[:n] + self.own) >> 1
        self.bounds[:n, 1:-1] = mixed - (mixed >> 6) + _STEPS

    def update(self, n: int, ids: np.ndarray, symbol: np.ndarray) -> None:
        target = _TARGETS[symbol]
        base = self.base[:n]
        base += (target - base) >> 5
        self.trust[self.row] = self.own + ((target - self.own) >> 4)
        for table, i, e in ((self.two, self.i2, self.e2), (self.one, self.i1, self.e1)):
            table[i] = np.where(e >> 2 == ids, e + ((e & 3) < 3), 1) & 3 | ids << 2
        self.before[:n], self.last[:n] = self.last[:n], ids


def _lengths(n: int, total: int) -> np.ndarray:
    """How many lanes have an id at each step; every lane but the last is full."""
    steps = np.full(min(BLOCK, total), n)
    if total > BLOCK:
        steps[total - (n - 1) * BLOCK :] = n - 1
    return steps


def encode(ids: np.ndarray) -> list[bytes]:
    """Blocks of a sequence of ids below 2 ** BITS."""
    if not len(ids):
        return []
    if ids.max() >> BITS:
        raise ValueError("an id is out of the format's range")
    n = -(-len(ids) // BLOCK)
    columns = np.zeros((n, BLOCK), np.int32)
    columns.ravel()[: len(ids)] = ids
    columns = np.ascontiguousarray(columns.T)
    model, lane = _Model(n), np.arange(n)
    low, span = np.zeros(n, np.uint64), np.full(n, 1 << 48, np.uint64)
    words, used = np.zeros((n, 2 * BLOCK + 8), np.uint16), np.zeros(n, np.int64)

    def put(rows: np.ndarray) -> None:
        """Move the top 16 bits of the lanes' ``low`` out, carrying into the words before."""
        top = low[rows] >> np.uint64(32)
        back, at = rows[top > 0xFFFF], used[rows[top > 0xFFFF]] - 1
        while len(back):
            words[back, at] += np.uint16(1)
            over = words[back, at] == 0
            back, at = back[over], at[over] - 1
        words[rows, used[rows]] = top.astype(np.uint16)
        used[rows] += 1
        low[rows] = (low[rows] & np.uint64(0xFFFFFFFF)) << np.uint64(16)

    def narrow(m: int, start: np.ndarray, size: np.ndarray, unit: np.ndarray) -> None:
        low[:m] += start.astype(np.uint64) * unit
        span[:m] = size.astype(np.uint64) * unit
        while len(rows := np.flatnonzero(span[:m] < 1 << 32)):
            put(rows)
            span[rows] <<= np.uint64(16)

    for step, m in enumerate(_lengths(n, len(ids)).tolist()):
        now = columns[step, :m]
        bits = np.frexp(now.astype(np.float64))[1].astype(np.int64)
        model.predict(m)
        hit2, hit1 = (model.e2 & 3 > 0) & (model.e2 >> 2 == now), (model.e1 & 3 > 0) & (model.e1 >> 2 == now)
        symbol = np.where(hit2, 0, np.where(hit1, 1, bits + 2))
        start = model.bounds[lane[:m], symbol]
        narrow(m, start, model.bounds[lane[:m], symbol + 1] - start, span[:m] >> np.uint64(SCALE))
        rest = np.maximum(np.where(symbol < 2, 0, bits - 1), 0)
        narrow(m, now & (1 << rest) - 1, np.ones(m), span[:m] >> rest.astype(np.uint64))
        model.update(m, now, symbol)
    for _ in range(3):
        put(lane)
    out = []
    for i in range(n):
        block = ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4")
        head = np.array([len(block), zlib.crc32(block.tobytes())], "<u4").tobytes()
        out.append(head + words[i, : used[i]].astype("<u2").tobytes())
    return out


def decode(blocks: list[bytes]) -> np.ndarray:
    """The ids of the blocks of one sequence, in order; raises ValueError where a checksum does not fit."""
    if not blocks:
        return np.empty(0, np.uint32)
    heads = np.array([np.frombuffer(b[:8], "<u4") for b in blocks], np.int64)
    n, total = len(blocks), int(heads[:, 0].sum())
    if (heads[:-1, 0] != BLOCK).any() or not 0 < heads[-1, 0] <= BLOCK:
        raise ValueError("blocks are missing or damaged")
    words = np.zeros((n, max(len(b) for b in blocks) // 2 + 8), np.uint64)
    for i, b in enumerate(blocks):
        words[i, : len(b) // 2 - 4] = np.frombuffer(b, "<u2", offset=8)
    model, lane = _Model(n), np.arange(n)
    code = (words[:, 0] << np.uint64(32)) | (words[:, 1] << np.uint64(16)) | words[:, 2]
    span, used = np.full(n, 1 << 48, np.uint64), np.full(n, 3)
    columns = np.zeros((min(BLOCK, total), n), np.int32)

    def narrow(m: int, start: np.ndarray, size: np.ndarray, unit: np.ndarray) -> None:
        code[:m] -= start.astype(np.uint64) * unit
        span[:m] = size.astype(np.uint64) * unit
        while len(rows := np.flatnonzero(span[:m] < 1 << 32)):
            code[rows] = code[rows] << np.uint64(16) | words[rows, np.minimum(used[rows], words.shape[1] - 1)]
            used[rows] += 1
            span[rows] <<= np.uint64(16)

    for step, m in enumerate(_lengths(n, total).tolist()):
        model.predict(m)
        unit = span[:m] >> np.uint64(SCALE)
        slot = np.minimum(code[:m] // unit, (1 << SCALE) - 1).astype(np.int16)
        symbol = (model.bounds[:m, 1:-1] <= slot[:, None]).sum(axis=1)
        start = model.bounds[lane[:m], symbol]
        narrow(m, start, model.bounds[lane[:m], symbol + 1] - start, unit)
        rest = np.maximum(symbol - 3, 0)
        unit = span[:m] >> rest.astype(np.uint64)
        value = np.minimum(code[:m] // unit, (1 << rest) - 1).astype(np.int32)
        narrow(m, value, np.ones(m), unit)
        value += np.where(symbol > 2, 1 << rest, 0).astype(np.int32)
        now = np.where(symbol == 0, model.e2 >> 2, np.where(symbol == 1, model.e1 >> 2, value))
        columns[step, :m] = now
        model.update(m, now, symbol)
    ids = np.ascontiguousarray(columns.T).ravel()[:total] if n == 1 else columns.T.reshape(-1)[:total]
    ids = ids.astype(np.uint32)
    for i, (_, crc) in enumerate(heads):
        if zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i} does not match its checksum")
    return ids


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space, so that no token spans two words."""

    SPACE = re.compile("[ \n]")

    def __init__(self, tokenizer_file: str):
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        if any(len(self.tokenizer.encode(t, add_special_tokens=False).ids) for t in (" ", "\n")):
            raise ValueError("this tokenizer keeps white space")
        self.table = PieceTable(self._words)

    def _words(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def encode(self, batch: list[str]) -> list[bytes]:
        return self.table.encoded(self.SPACE.split(t) for t in batch)


@functools.cache
def encoder(tokenizer_file: str) -> WordEncoder:
    return WordEncoder(tokenizer_file)


def _buckets(rows: DataFrame) -> DataFrame:
    """``bucket``: a range of ``ord``, by quantiles; bounds are as many as there are buckets."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("ord", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids), dtype="int32")

    return rows.withColumn("bucket", bucket_of("ord"))


SEGMENTS = "bucket int, segment int, doc_ids array<long>, counts array<int>, n_ids long, blocks array<binary>"


def write_ids(docs: DataFrame, tokenizer_file: str, end_id: int, name: str = "token-ids") -> DataFrame:
    """Encode every whole text, put ``end_id`` behind it, write the ids in ascending ``doc_id`` order; the written table."""
    rows = _buckets(texts(docs).withColumn("ord", F.coalesce("doc_id", F.lit(-(2**63)))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "ord", "text").select("bucket", "doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, segment, held, size = None, 0, [], 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            counts = [len(x) // 4 for _, x in held]
            columns = [[bucket], [segment], [[i for i, _ in held]], [counts], [len(ids)], [encode(ids)]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "segment", "doc_ids", "counts", "n_ids", "blocks"])

        work = encoder(tokenizer_file)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = work.encode(part.column("text").to_pylist())
                for b, doc_id, ids in zip(part.column("bucket").to_pylist(), part.column("doc_id").to_pylist(), found):
                    if held and (b != bucket or size > SEGMENT):
                        yield flush()
                        segment, held, size = segment + 1 if b == bucket else 0, [], 0
                    bucket = b
                    held.append((doc_id, ids + end))
                    size += len(ids) // 4 + 1
        if held:
            yield flush()

    return stage(rows.mapInArrow(run, SEGMENTS), name)


def read_ids(written: DataFrame) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids_crc32`` of every document, from the files."""
    totals = {r.bucket: r.n for r in written.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect()}  # One row for each bucket.
    before, at = {}, 0
    for bucket in sorted(totals):
        before[bucket], at = at, at + totals[bucket]
    inside = Window.partitionBy("bucket").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = written.select("bucket", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("ahead"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = decode(row["blocks"]).astype("<u4")
                counts = np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                start = before[row["bucket"]] + row["ahead"] + ends - counts
                crcs = [zlib.crc32(ids[e - c : e].tobytes()) for e, c in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(counts), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # One row for each segment, of millions of ids: broadcast, so that no block is shuffled or sorted.
    return written.join(F.broadcast(starts), ["bucket", "segment"]).select("bucket", "ahead", "doc_ids", "counts", "blocks").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
