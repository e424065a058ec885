"""Alignment of two tokenizers' tokens over a corpus, counted through a minimal perfect hash.

Tokens of A (byte-level BPE over a space and the text) and of B (SentencePiece over the text)
cover the same bytes. Offsets at which tokens of both end cut them into groups; all A-B
occurrence pairs of a group are linked.

1. A scan encodes whole texts, writes both lists of ids and, per task, its distinct id pairs.
   Neither tokenizer joins characters across a space that follows a character other than
   white space, so distinct runs between such places are encoded once a worker.
2. Pair sets are united bucket by bucket in steps of ``FAN_IN``. Every pair of one A id is
   in one bucket. A bucket's keys get a minimal perfect hash: levels of bit arrays, in which
   a key owns the bit that no other key of its level hits; its number is the rank of the bit.
3. A second scan re-aligns the ids and counts, for each pair, the documents that hold it, in
   a dense vector indexed by the hash. Vectors are summed slice by slice in a tree.
4. A third scan re-aligns and looks counts up. The keys lie in hash order beside the counts, and
   each look-up compares its key; a key that is not the pair's raises.

Hash, keys and counts of at most ``SHARD`` pairs are broadcast at a time, by ranges of buckets; one
A id has no more pairs than B has ids. Sums of a document add up over the ranges.

Defined results: a null or empty text, or one whose tokens do not give back its bytes (as any
text with U+2581), has no tokens, zeros and an empty digest; strings of special tokens are plain
text; repeated rows, and rows with equal or null ``doc_id``, are documents of their own; texts of any length
are aligned in full, in slices of links; ties for an A id's highest count all count; other
columns of the input, whatever their names, stay outside; an empty table gives no rows.
"""

import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseloom.llm.chunk_table import MARK, codec
from caseloom.llm.common import encode_joined, small_batches, texts
from caseloom.llm.shingles import mix
from caseloom.sources.tables import stage

BUCKETS, FAN_IN, CELLS = 256, 64, 1 << 16
SHARD = 8_000_000  # Pairs whose hash, keys and counts are broadcast together: 17 bytes each.
HELD = 2_000_000  # Distinct pairs that a task holds before it passes them on.
LINKS = 2_000_000  # Links expanded at a time.
SPACING = 1.5  # Bits of a level for each of its keys.


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Ids of whole texts under both tokenizers, from a bounded table of runs."""

    #: White space before a space, or a space in front: there a run goes on.
    JOINED = re.compile(r" (?:(?<=\s )|(?<=^ ))")
    AT_ONCE = 4_000  # New runs that the libraries are given at a time.

    def __init__(self, a_file: str, b_file: str, limit: int = 220_000, longest: int = 64):
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.codec, self.limit, self.longest = codec(b_file), limit, longest
        alphabet, b = byte_alphabet(), self.codec.model
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(map(alphabet.__getitem__, e)) if all(c in alphabet for c in e) else e.encode() for e in entries]
        pieces = [(i, b.id_to_piece(i)) for i in range(b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in pieces]
        self.a_length, self.b_length = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), len(self.b_bytes))
        if most > 1 << 31:
            raise ValueError("ids of these vocabularies do not fit")
        self.kind = "<u2" if most <= 1 << 16 else "<u4"
        # An id's decimal digits with what follows: another id of its side, or what closes its side.
        self.a_text, self.b_text = (
            (np.array([f"{i},".encode() for i in range(n)], object), np.array([f"{i}{close}".encode() for i in range(n)], object))
            for n, close in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";"))
        )
        # Two generations: what is met again while the older one is kept moves on to the younger.
        self.known: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    @classmethod
    def runs(cls, text: str) -> list[str]:
        """The runs of a space and the text, each without its first space; after white space none begins."""
        words = text.split(" ")
        if not cls.JOINED.search(text):
            return words
        out = []
        for word in words:
            if out and (not out[-1] or out[-1][-1].isspace()):
                out[-1] += " " + word
            else:
                out.append(word)
        return out

    def _a_ids(self, runs: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast([" " + run for run in runs], add_special_tokens=False)]

    def _a_each(self, runs: list[str]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self._a_ids(runs)]

    def _new(self, words: list[str]) -> list[bytes | None]:
        """A's ids, then B's with the top bit set; None where they do not give back the run."""
        a, b = encode_joined(words, self._a_ids, self._a_each, self.a_length), self.codec._segment(words)
        flat_a, flat_b = (np.frombuffer(b"".join(side), "<u4") for side in (a, b))
        marked, out, at = (flat_b | np.uint32(1 << 31)).tobytes(), [], 0
        for one, two in zip(a, b):
            out.append(one + marked[at : at + len(two)])
            at += len(two)
        spelt = lambda table, ids: b"".join([table[i] for i in ids.tolist()])
        whole = b"".join([b" " + w.encode() for w in words])
        if spelt(self.a_bytes, flat_a) != whole or spelt(self.b_bytes, flat_b) != whole:
            for at, (one, two, word) in enumerate(zip(a, b, words)):
                if any(spelt(table, np.frombuffer(code, "<u4")) != b" " + word.encode() for table, code in ((self.a_bytes, one), (self.b_bytes, two))):
                    out[at] = None
        return out

    def encode(self, batch: list[str]) -> "Groups":
        """The groups of whole texts."""
        split = [self.runs(t) if t and MARK not in t else [] for t in batch]
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        known, older, extra = self.known, self.older, {}
        missing = set().union(*split).difference(known)
        known.update((word, older[word]) for word in missing.intersection(older))
        new = list(missing.difference(older))
        for i in range(0, len(new), self.AT_ONCE):
            part = new[i : i + self.AT_ONCE]
            for word, code in zip(part, self._new(part)):
                (known if len(word) <= self.longest else extra)[word] = code
        look = (lambda w: extra[w] if w in extra else known[w]) if extra else known.__getitem__
        codes = []
        for words in split:
            try:
                codes.append(b"".join(map(look, words)))
            except TypeError:  # A run without tokens.
                codes.append(b"")
        flat = np.frombuffer(b"".join(codes), "<u4")
        second = flat >> np.uint32(31) == 1
        ends = np.cumsum([len(c) // 4 for c in codes], dtype=np.int64)
        n_b = np.diff(np.append(0, np.cumsum(second))[ends], prepend=0)
        n_a = np.diff(ends, prepend=0) - n_b
        return Groups(flat[~second].astype(np.int64), (flat[second] & np.uint32((1 << 31) - 1)).astype(np.int64), n_a, n_b, self.a_length, self.b_length)

    def digests(self, groups: "Groups") -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each document; empty without tokens."""
        texts_ = np.empty(len(groups.a) + len(groups.b), object)
        for ids, starts, table, side in ((groups.a, groups.a_start, self.a_text, 0), (groups.b, groups.b_start, self.b_text, 1)):
            last = np.zeros(len(ids), bool)
            last[starts[1:] - 1] = True
            # A group's ids of A stand before its ids of B.
            size = np.diff(starts)
            other = groups.b_start[:-1] if side == 0 else groups.a_start[1:]
            place = np.arange(len(ids)) + np.repeat(other, size)
            texts_[place] = np.where(last, table[1][ids], table[0][ids])
        ends = np.cumsum(groups.docs_a + groups.docs_b)
        found, start = texts_.tolist(), 0
        out = []
        for end in ends.tolist():
            out.append(hashlib.sha256(b"".join(found[start:end])[:-1]).hexdigest() if end > start else "")
            start = end
        return out


@functools.cache
def aligner(a_file: str, b_file: str) -> Aligner:
    return Aligner(a_file, b_file)


class Groups:
    """The groups of several documents' ids ``a`` and ``b``, laid end to end; ``docs_a`` and ``docs_b`` are the documents' shares."""

    def __init__(self, a: np.ndarray, b: np.ndarray, docs_a: np.ndarray, docs_b: np.ndarray, a_length: np.ndarray, b_length: np.ndarray):
        self.a, self.b, self.docs_a, self.docs_b = a, b, docs_a, docs_b
        a_end, b_end = np.cumsum(a_length[a]), np.cumsum(b_length[b])
        ends = np.zeros((a_end[-1] if len(a_end) else 0) + 1, bool)
        ends[a_end] = True
        last = np.flatnonzero(ends[b_end])
        self.b_start = np.append(0, last + 1)
        self.a_start = np.append(0, np.searchsorted(a_end, b_end[last]) + 1)
        self.n_a, self.n_b = np.diff(self.a_start), np.diff(self.b_start)
        # The document of each group, by where the documents' own ids end.
        closing = np.searchsorted(self.a_start, np.cumsum(docs_a))
        self.per_doc = np.diff(closing, prepend=0)
        self.doc = np.repeat(np.arange(len(docs_a)), self.per_doc)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over each document's groups."""
        total = np.append(0, np.cumsum(values))
        ends = np.cumsum(self.per_doc)
        return total[ends] - total[ends - self.per_doc]

    def links(self, pairs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ``document * pairs + a * width + b`` of all links, ascending, and how often each occurs."""
        size = self.n_a * self.n_b
        # Groups of many links are told by their distinct ids; the others are listed, some at a time.
        wide = np.flatnonzero(size > CELLS)
        found = [part for g in wide for part in self._wide(g, pairs, width)]
        rest = np.flatnonzero(size <= CELLS)
        total = np.cumsum(size[rest])
        for part in np.split(rest, np.searchsorted(total, np.arange(LINKS, total[-1] if len(total) else 0, LINKS))):
            n_a, n_b = self.n_a[part], self.n_b[part]
            a_at = np.repeat(self.a_start[part] - np.append(0, np.cumsum(n_a)[:-1]), n_a) + np.arange(n_a.sum())
            wide_b = np.repeat(n_b, n_a)
            first = np.repeat(np.repeat(self.b_start[part], n_a) - np.append(0, np.cumsum(wide_b)[:-1]), wide_b)
            a = np.repeat(self.a[a_at] * width + np.repeat(self.doc[part], n_a) * pairs, wide_b)
            found.append(np.unique(a + self.b[first + np.arange(len(first))], return_counts=True))
        return _merged(found)

    def _wide(self, g: int, pairs: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a, times_a = np.unique(self.a[self.a_start[g] : self.a_start[g + 1]], return_counts=True)
        b, times_b = np.unique(self.b[self.b_start[g] : self.b_start[g + 1]], return_counts=True)
        step = max(1, LINKS // len(b))
        for i in range(0, len(a), step):
            keys = self.doc[g] * pairs + a[i : i + step, None] * width + b
            yield keys.ravel(), (times_a[i : i + step, None] * times_b).ravel()


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(found) < 2:
        return found[0] if found else (np.empty(0, np.int64), np.empty(0, np.int64))
    keys, times = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    start = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[start], np.add.reduceat(times, start) if len(start) else times


def bucket_of(a: np.ndarray) -> np.ndarray:
    return (mix(a.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) % BUCKETS


def _packed(keys: np.ndarray) -> bytes:
    """Ascending keys."""
    return zlib.compress(np.diff(keys, prepend=0).astype("<u8").tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), "<u8").astype(np.int64))


def _hit(keys: np.ndarray, level: int, bits) -> np.ndarray:
    """The bit of each key within an array of ``bits`` bits at this level."""
    return (mix(keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.asarray(bits, np.uint64)).astype(np.int64)


def hash_levels(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays (64-bit words) of a minimal perfect hash of distinct keys, level by level."""
    levels = []
    while len(keys):
        words = max(1, -(-int(SPACING * len(keys)) // 64))
        bit = _hit(keys, len(levels), 64 * words)
        alone = np.bincount(bit, minlength=64 * words) == 1
        levels.append(np.packbits(alone, bitorder="little").view("<u8"))
        keys = keys[~alone[bit]]
    return levels


class PairHash:
    """A minimal perfect hash over the keys of several buckets: 0 to n - 1, by level, bucket and bit."""

    def __init__(self, width: int, buckets: dict[int, list[np.ndarray]]):
        self.width, self.n, self.levels = width, 0, []
        self.mine = np.isin(np.arange(BUCKETS), list(buckets))
        for level in range(max(map(len, buckets.values()), default=0)):
            words = [buckets[b][level] if b in buckets and level < len(buckets[b]) else np.empty(0, "<u8") for b in range(BUCKETS)]
            sizes = np.array([len(w) for w in words])
            flat = np.concatenate(words)
            ranks = self.n + np.append(0, np.cumsum(np.bitwise_count(flat), dtype=np.int64))
            self.levels.append((sizes, np.cumsum(sizes) - sizes, flat, ranks[:-1]))
            self.n = int(ranks[-1])

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of keys of these buckets; a key that was not hashed gets any number, or -1."""
        out, left, bucket = np.full(len(keys), -1), np.arange(len(keys)), bucket_of(keys // self.width)
        for level, (sizes, starts, words, ranks) in enumerate(self.levels):
            size = sizes[bucket]
            if not size.all():
                left, bucket, size = left[size > 0], bucket[size > 0], size[size > 0]
            bit = _hit(keys[left], level, 64 * size)
            at, shift = starts[bucket] + (bit >> 6), (bit & 63).astype(np.uint64)
            word = words[at]
            hit = (word >> shift) & np.uint64(1) == 1
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << shift[hit]) - np.uint64(1)))
            out[left[hit]] = ranks[at[hit]] + below
            left, bucket = left[~hit], bucket[~hit]
            if not len(left):
                break
        return out

    def verified(self, keys: np.ndarray, stored: np.ndarray) -> np.ndarray:
        """The numbers of the keys, each of which must be the one stored at its number."""
        at = self.of(keys)
        if (at < 0).any() or (stored[at] != keys).any():
            raise ValueError("a pair is not among the hashed ones")
        return at


def _bytes_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return batch.column(name).to_pylist()


def _cut(ids: np.ndarray, sizes: np.ndarray, kind: str) -> list[bytes]:
    """Each document's ids as bytes."""
    raw, width = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
    ends = (np.cumsum(sizes) * width).tolist()
    return [raw[e - n * width : e] for e, n in zip(ends, sizes.tolist())]


def _joined(batch: pa.RecordBatch, name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all documents, and how many each has."""
    found = _bytes_column(batch, name)
    width = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(found), kind).astype(np.int64), np.array([len(x) // width for x in found], np.int64)


def encode(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Rows of documents (``row``, digest columns, ids ``a`` and ``b``), and of pairs (``bucket``, ``keys``), written."""
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "bucket", "keys"]
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    rows = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(a_file, b_file)
        width, pairs = len(work.b_bytes), len(work.a_bytes) * len(work.b_bytes)
        row, held, size = TaskContext.get().partitionId() << 33, [], 0

        def passed_on() -> pa.RecordBatch:
            keys = np.unique(np.concatenate(held))
            bucket = bucket_of(keys // width)
            keys = keys[np.argsort(bucket, kind="stable")]
            parts = np.split(keys, np.cumsum(np.bincount(bucket, minlength=BUCKETS))[:-1])
            used = [b for b in range(BUCKETS) if len(parts[b])]
            columns = {"bucket": used, "keys": [_packed(parts[b]) for b in used]}
            return pa.RecordBatch.from_arrays([pa.array(columns.get(n, [None] * len(used)), k) for n, k in zip(names, kinds)], names)

        for whole in batches:
            for part in small_batches(whole, "text", 500_000):
                groups = work.encode(part.column("text").to_pylist())
                keys, _ = groups.links(pairs, width)
                held.append(np.unique(keys % pairs))
                size += len(held[-1])
                columns = [
                    range(row, row + part.num_rows), part.column("doc_id"), groups.docs_a, groups.docs_b,
                    groups.per_doc, groups.sums(groups.n_a * groups.n_b), work.digests(groups),
                    _cut(groups.a, groups.docs_a, work.kind), _cut(groups.b, groups.docs_b, work.kind), [None] * part.num_rows, [None] * part.num_rows,
                ]
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names)
                if size > HELD:
                    held = [np.unique(np.concatenate(held))]
                    size = len(held[0])
                    if size > HELD // 2:
                        yield passed_on()
                        held, size = [], 0
        if size:
            yield passed_on()

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary, bucket int, keys binary"
    return stage(rows.mapInArrow(run, schema), "token-ids")


def distinct_pairs(encoded: DataFrame) -> DataFrame:
    """``bucket``, ``n`` and ``keys`` (ascending) of all linked pairs, written; sets are united in steps of ``FAN_IN``."""

    def unite(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(np.concatenate([_unpacked(k) for k in group["keys"]]))
        return pd.DataFrame({"bucket": group["bucket"].iloc[:1], "part": group["part"].iloc[:1] // FAN_IN, "n": [len(keys)], "keys": [_packed(keys)]})

    sets = encoded.where("bucket is not null").select("bucket", F.spark_partition_id().cast("long").alias("part"), F.lit(0).cast("long").alias("n"), "keys")
    left = sets.rdd.getNumPartitions()
    while True:
        sets = sets.groupBy("bucket", F.floor(F.col("part") / FAN_IN).alias("step")).applyInPandas(unite, "bucket int, part long, n long, keys binary")
        left = -(-left // FAN_IN)
        if left <= 1:
            return stage(sets, "token-pairs")


def pair_hash(sets: DataFrame, width: int) -> tuple[PairHash, np.ndarray]:
    """The hash of all keys of ``sets``, and the keys in its order; both bounded by ``SHARD``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = [[w.tobytes() for w in hash_levels(_unpacked(k))] for k in _bytes_column(batch, "keys")]
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(levels, pa.list_(pa.binary()))], ["bucket", "levels"])

    found = sets.select("bucket", "keys").mapInArrow(build, "bucket int, levels array<binary>").collect()  # Some bits for each key.
    table = PairHash(width, {r.bucket: [np.frombuffer(w, "<u8") for w in r.levels] for r in found})
    shared = sets.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_unpacked(k) for k in _bytes_column(batch, "keys")]
            at = [shared.value.of(k).tobytes() for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary())], ["at", "keys"])

    stored, met = np.zeros(table.n, np.int64), 0
    for r in sets.select("keys").mapInArrow(place, "at binary, keys binary").toLocalIterator():
        at, keys = np.frombuffer(r["at"], np.int64), np.frombuffer(r["keys"], np.int64)
        stored[at] = keys
        met += len(keys)
    shared.destroy()
    if met != table.n:
        raise ValueError("the hash does not cover its keys")
    return table, stored


def _realigned(batch: pa.RecordBatch, work: Aligner, table: PairHash) -> tuple[Groups, np.ndarray, np.ndarray, np.ndarray]:
    """Documents, pairs and times of the links of a batch whose pairs are in the table's buckets."""
    width, pairs = len(work.b_bytes), len(work.a_bytes) * len(work.b_bytes)
    (a, docs_a), (b, docs_b) = (_joined(batch, name, work.kind) for name in ("a", "b"))
    groups = Groups(a, b, docs_a, docs_b, work.a_length, work.b_length)
    keys, times = groups.links(pairs, width)
    doc, keys = np.divmod(keys, pairs)
    if not table.mine.all():
        own = table.mine[bucket_of(keys // width)]
        doc, keys, times = doc[own], keys[own], times[own]
    return groups, doc, keys, times


def document_counts(encoded: DataFrame, shared, a_file: str, b_file: str) -> np.ndarray:
    """For each number of the hash how many documents hold its pair linked."""
    documents = encoded.where("bucket is null").select("a", "b")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, (table, stored) = aligner(a_file, b_file), shared.value
        work.known, work.older = {}, {}  # Nothing is encoded any more.
        total = np.zeros(table.n, np.uint32)
        for whole in batches:
            for part in small_batches(whole, "a", 1_000_000):
                keys, times = np.unique(_realigned(part, work, table)[2], return_counts=True)
                total[table.verified(keys, stored)] += times.astype(np.uint32)
        parts = [total[i : i + CELLS] for i in range(0, table.n, CELLS)]
        used = [i for i, p in enumerate(parts) if p.any()]
        sums = pa.array([zlib.compress(parts[i].astype("<u8").tobytes(), 1) for i in used], pa.binary())
        task = pa.array([TaskContext.get().partitionId()] * len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), task, sums], ["slice", "part", "sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(s), "<u8") for s in group["sums"])
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "part": group["part"].iloc[:1] // FAN_IN, "sums": [zlib.compress(total.tobytes(), 1)]})

    schema = "slice long, part long, sums binary"
    sums, left = documents.mapInArrow(count, schema), documents.rdd.getNumPartitions()
    while True:
        sums = sums.groupBy("slice", F.floor(F.col("part") / FAN_IN).alias("step")).applyInPandas(add, schema)
        left = -(-left // FAN_IN)
        if left <= 1:
            break
    counts = np.zeros(shared.value[0].n, np.int64)
    for r in sums.select("slice", "sums").toLocalIterator():
        counts[r["slice"] * CELLS : (r["slice"] + 1) * CELLS] = np.frombuffer(zlib.decompress(r["sums"]), "<u8")
    return counts


def looked_up(encoded: DataFrame, shared, a_file: str, b_file: str) -> DataFrame:
    """``row``, ``n_best`` and ``count_sum`` over the links of the hash's buckets, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, (table, stored, counts, best) = aligner(a_file, b_file), shared.value
        for whole in batches:
            for part in small_batches(whole, "a", 1_000_000):
                _, doc, keys, times = _realigned(part, work, table)
                at = table.verified(keys, stored)
                sums = np.zeros((2, part.num_rows), np.int64)
                np.add.at(sums[0], doc, times * best[at])
                np.add.at(sums[1], doc, times * counts[at])
                yield pa.RecordBatch.from_arrays([part.column("row"), *map(pa.array, sums)], ["row", "n_best", "count_sum"])

    found = encoded.where("bucket is null").select("row", "a", "b").mapInArrow(run, "row long, n_best long, count_sum long")
    return stage(found, "token-counts")


def align(docs: DataFrame, a_file: str, b_file: str, shard: int = SHARD) -> DataFrame:
    """For each document its tokens, groups and links under both tokenizers, how many links are their A id's most
    frequent in the corpus, and the sum of the links' document counts."""
    work, context = aligner(a_file, b_file), docs.sparkSession.sparkContext
    width = len(work.b_bytes)
    encoded = encode(docs, a_file, b_file)
    sets = distinct_pairs(encoded)
    ranges: list[list[int]] = [[]]
    room = shard
    for bucket, n in sets.select("bucket", "n").orderBy("bucket").collect():  # At most BUCKETS rows.
        if ranges[-1] and n > room:
            ranges.append([])
            room = shard
        ranges[-1].append(bucket)
        room -= n
    sums = None
    for buckets in ranges:
        table, stored = pair_hash(sets.where(F.col("bucket").isin(buckets)), width)
        shared = context.broadcast((table, stored))
        counts = document_counts(encoded, shared, a_file, b_file)
        shared.destroy()
        highest = np.zeros(len(work.a_bytes), np.int64)
        np.maximum.at(highest, stored // width, counts)
        shared = context.broadcast((table, stored, counts, counts == highest[stored // width]))
        found = looked_up(encoded, shared, a_file, b_file)
        shared.destroy()
        sums = found if sums is None else sums.unionByName(found)
    totals = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    kept = encoded.where("bucket is null").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return kept.join(totals, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
