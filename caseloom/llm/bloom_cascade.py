"""URL rules judged by a Bloom filter cascade.

A rule is a host and a path prefix with an action. A URL's keys are its host's suffixes
joined with its path's prefixes; a rule fits when it is one of them. The cascade answers
"is this key listed" exactly and without a join: level 1 is a Bloom filter of the listed
keys, level 2 one of those other keys of the corpus that level 1 lets through, level 3
one of the listed keys that level 2 lets through, and so on until nothing gets through
wrongly. It is exact for every key in the complete key universe it was built over.

Filters are built by Spark (bits are combined by word) and reach the tasks as broadcast
data only up to ``MOST_BYTES``. A longer list is dealt into parts by key hash; each part
has a cascade within that bound, and the URLs pass by the parts one after the other.

Defined results: a null URL or one without ``://`` has empty host and path and no rule;
a null ``page_id`` stays null; repeated rows give one result each; no rules, or an empty
table, give no rule and the verdict "allow". A rule listed as both "block" and "allow"
blocks. Of two fitting rules of equal length the one with the longer host wins.
"""

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.sources.tables import stage

BITS_PER_KEY, HASHES = 8, 5
MOST_BYTES = 64 << 20
KEYS_PER_WORD, MOST_WORDS = 4, 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def with_keys(pages: DataFrame, prefix_lengths: list[int]) -> DataFrame:
    """``page_id``, ``host``, ``path`` and the keys a rule could have; no keys without a host."""
    host, path = host_and_path(F.col("url"))
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in prefix_lengths]).cast("array<int>"), lambda n: F.length("path") >= n)
    prefixes = F.transform(fitting, lambda n: F.substring("path", F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn(
        "keys", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(keys)
    )


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), key).alias("g1"), F.xxhash64(F.lit(2), key).alias("g2")]  # The seed comes first, or both would hang on one hash.


def positions(g1: np.ndarray, g2: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bit positions of keys in a level, one row per key; every level hashes anew."""
    x = g1.view(np.uint64)[:, None] + g2.view(np.uint64)[:, None] * np.arange(level * HASHES + 1, (level + 1) * HASHES + 1, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) % np.uint64(bits)


def passes(words: np.ndarray, g1: np.ndarray, g2: np.ndarray, level: int) -> np.ndarray:
    at = positions(g1, g2, level, 64 * len(words))
    return ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def member(levels: list[np.ndarray], g1: np.ndarray, g2: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the parity of the first level that stops it."""
    found = np.zeros(len(g1), bool)
    alive = np.arange(len(g1))
    for level, words in enumerate(levels):
        alive = alive[passes(words, g1[alive], g2[alive], level)]
        found[alive] = level % 2 == 0
    return found


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("g1").to_numpy(), batch.column("g2").to_numpy()


def filter_words(keys: DataFrame, n: int, level: int = 0, most_bytes: int = MOST_BYTES) -> np.ndarray:
    """The words of a Bloom filter over ``n`` keys (``g1``, ``g2``), never more than ``most_bytes``."""
    size = max(1, min(-(-n * BITS_PER_KEY // 64), most_bytes // 8))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(positions(*_columns(batch), level, 64 * size))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.view("i8")), pa.array(bits.view("i8"))], ["word", "bits"])

    rows = keys.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return words


def likely_among(keys: DataFrame, most_bytes: int = 16 << 20) -> Callable[..., Column]:
    """A function of two columns that is true for all of ``keys`` (``g1``, ``g2``; written) and for few others, by a filter of at most ``most_bytes``."""
    words = keys.sparkSession.sparkContext.broadcast(filter_words(keys, keys.count(), most_bytes=most_bytes))

    @F.pandas_udf("boolean")
    def likely(g1: pd.Series, g2: pd.Series) -> pd.Series:
        return pd.Series(passes(words.value, g1.to_numpy(), g2.to_numpy(), 0))

    return likely


def mark_likely(rows: DataFrame, keys: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """``rows`` (with ``g1``, ``g2``) and the flag ``likely``, true for all ``keys`` (written) and for few others.

    DataFrame functions alone: ``g1`` names a key's 64-bit word of the filter, ``g2`` its bits there. At most
    ``most_words`` words are broadcast; beyond, more rows are taken for likely.
    """
    n = max(1, min(most_words, -(-keys.count() // KEYS_PER_WORD)))
    word = F.pmod("g1", F.lit(n)).alias("word")
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("g2", 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    mask = functools.reduce(Column.bitwiseOR, bit)
    words = stage(keys.groupBy(word).agg(F.bit_or(mask).alias("bits")), "likely-words")
    marked = rows.withColumn("word", word).join(F.broadcast(words), "word", "left")
    return marked.select(*rows.columns, F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False)).alias("likely"))


def _let_through(keys: DataFrame, words: np.ndarray, level: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(words)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(shared.value, *_columns(batch), level)))

    return keys.mapInArrow(keep, "g1 long, g2 long")


def build(universe: DataFrame) -> list[np.ndarray]:
    """Levels of the cascade over ``universe``: distinct ``g1``, ``g2`` with the flag ``listed``."""
    inside = universe.where("listed").select("g1", "g2")
    outside = universe.where("not listed").select("g1", "g2")
    levels, n = [], inside.count()
    while n:
        if len(levels) == 64 or 8 * sum(map(len, levels)) + n * BITS_PER_KEY // 8 > MOST_BYTES:
            raise ValueError("a part of the list outgrew the bound of a cascade")
        words = filter_words(inside, n, len(levels))
        wrong = stage(_let_through(outside, words, len(levels)), "cascade-level")
        levels.append(words)
        inside, outside, n = wrong, inside, wrong.count()
    return levels


def cascades(keys: DataFrame, listed: DataFrame) -> list[list[np.ndarray]]:
    """One cascade for each part of the ``listed`` keys, exact over those and the corpus's ``keys`` (columns ``key``)."""
    corpus = keys.select(*_hashes(F.col("key"))).distinct().withColumn("listed", F.lit(False))
    marked = listed.select(*_hashes(F.col("key"))).distinct().withColumn("listed", F.lit(True))
    universe = stage(corpus.unionByName(marked).groupBy("g1", "g2").agg(F.max("listed").alias("listed")), "cascade-keys")
    parts = max(1, -(-universe.where("listed").count() * BITS_PER_KEY // (2 * MOST_BYTES)))
    return [build(universe.where(F.pmod("g1", F.lit(parts)) == part)) for part in range(parts)]


def mark_listed(df: DataFrame, column: str, into: str, parts: list[list[np.ndarray]]) -> DataFrame:
    """Add ``into``: for each key of the array ``column`` whether it is listed."""
    spark = df.sparkSession
    result = df.withColumn(into, F.transform(column, lambda k: F.lit(False)))
    n_parts = len(parts)
    for part, levels in enumerate(parts):
        if not levels:
            continue
        shared = spark.sparkContext.broadcast(levels)

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                g1, g2, before = (batch.column(c) for c in ("_g1", "_g2", into))
                a, b = g1.flatten().to_numpy(), g2.flatten().to_numpy()
                found = before.flatten().to_numpy(zero_copy_only=False).astype(bool)
                own = np.flatnonzero(a % n_parts == part)
                found[own] = member(shared.value, a[own], b[own])
                sizes = np.asarray(before.value_lengths().to_numpy(zero_copy_only=False), np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                marks = pa.ListArray.from_arrays(offsets, pa.array(found))
                kept = [marks if n == into else batch.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(kept, names)

        names, schema = result.columns, result.schema
        first, second = (F.transform(column, lambda k: _hashes(k)[i]) for i in (0, 1))
        result = result.withColumns({"_g1": first, "_g2": second}).mapInArrow(judged, schema)
        if n_parts > 1:  # Not two parts' filters in one task.
            result = stage(result, "cascade-pass")
    return result


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id``, ``host``, ``path``, the longest fitting ``rule`` and the ``verdict`` of every page.

    ``rules`` has ``action`` ("allow" or "block"), ``host`` and ``path``. A page without a
    fitting rule has a null rule and, as none of its keys is listed, the verdict "allow".
    """
    rules = rules.select("action", F.concat("host", "path").alias("key"), F.length("path").alias("n")).where("key is not null")
    lengths = sorted(r[0] for r in rules.select("n").distinct().collect())  # Bounded by the longest path of a rule.
    keyed = with_keys(pages, lengths)
    keys = keyed.select(F.explode("keys").alias("key"))
    listed = cascades(keys, rules)
    blocked = cascades(keys, rules.where("action = 'block'"))
    marked = mark_listed(mark_listed(keyed, "keys", "_listed", listed), "keys", "_blocked", blocked)
    fitting = F.filter(F.arrays_zip(F.col("keys"), F.col("_listed"), F.col("_blocked")), lambda k: k["_listed"])
    ranked = F.transform(fitting, lambda k: F.struct(F.length(k["keys"]).alias("n"), F.locate("/", k["keys"]).alias("h"), k["keys"].alias("key"), k["_blocked"].alias("blocked")))
    return marked.withColumn("_best", F.array_max(ranked)).select(
        "page_id", "host", "path", F.col("_best.key").alias("rule"), F.when(F.col("_best.blocked"), "block").otherwise("allow").alias("verdict")
    )
