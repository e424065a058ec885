"""Exact Jaccard join on word n-grams by a blocked product of document and n-gram incidence.

1. A scan turns each text into its distinct n-grams. Equal sets are one matrix row.
2. Linked sets of sizes n and m differ in at most d = (n + m) * (1 - t) / (1 + t) n-grams.
   N-grams are dealt by hash to more than d buckets, as many for all sets of a size class;
   an n-gram in which two sets differ changes one bucket. So in any order of buckets by what
   they hold, the first d + 1 of the one set and the first d + 1 of the other have a bucket in
   common, with the same n-grams. Those with many n-grams that few documents hold come first (by a
   sketch of bounded size; any order gives the same links, a good one fewer candidates): that
   several n-grams agree is rare between other sets, whatever the number of documents and
   however full the sketch. Sets of sizes that can link and with such a bucket in common are
   chained to the first of them: no pairs are listed, and a bucket that a third of all rows
   hold is cut up by range. Sizes fall into classes; links are within a class or between neighbours.
   For t under ``BUCKETS_FROM`` percent, buckets would hold one n-gram: there single n-grams are taken,
   rare ones first. Linked sets share t * n and t * m, so one among the first n - ceil(t * n) + 1.
3. Groups of chained sets are thinned by parity bitmaps: each n-gram flips a bit, so two
   bitmaps differ in at most as many bits as the sets in n-grams. Pairs whose bitmaps
   differ too much cannot link; what is left falls into smaller groups.
4. Only sets of these groups are multiplied, in tiles of at most ``TILE`` rows, by size
   class, as far as sizes can link. A tile's product accumulates overlap
   counts over column strips and discards pairs that their sizes, or what is left of
   their n-grams, rule out. A tile returns a spanning forest of its links.

A document's component is the smallest id reachable by links. Only ids, sizes, hashes
and the sets of chained documents are shuffled. N-grams are compared by 64-bit hash.

Defined results: null or wordless texts have an empty set, link with nothing and are
their own component; a null ``doc_id`` is never a component id: such a row has its set's
component where a row with an id has the same set, else null; repeated rows give one
result each; an empty table gives no rows; texts of any length count
whole; other columns of the input, whatever their names, stay outside.
"""

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.bloom_cascade import filter_words, passes
from caseloom.llm.common import small_batches, texts
from caseloom.llm.components import connected_components
from caseloom.llm.shingles import mix, shingle_hashes
from caseloom.llm.sketch import cell_of, document_frequencies
from caseloom.sources.tables import stage

TILE, STRIP = 256, 4096
WIDE, VOLUME = 2048, 8_000_000  # Rows of a tile of bitmaps, and n-grams of half of one.
FILTER_BYTES = 16 << 20
BUCKETS_FROM, ROOM = 75, 1.4  # Least percent for which n-grams are dealt to buckets, and buckets for each that is taken.


class Classes:
    """Size classes: sets of linked documents are of one class or of two next to each other. N-grams
    are ``common`` from that count of the sketch on."""

    def __init__(self, percent: int, common: int = 1 << 16):
        if not 50 <= percent < 100:
            raise ValueError("percent must be from 50 to 99")
        self.least = [1]  # The smallest size of each class; a class spans two steps of 1 / t.
        while self.least[-1] < 1 << 40:
            self.least.append(self.least[-1] * 10_000 // percent**2 + 1)
        self.percent, self.common = percent, common

    def of(self, size: int) -> list[int]:
        """The class of a size, and the one below where a linked set could be in it."""
        own = bisect_right(self.least, size) - 1
        return [own, own - 1] if own and size * self.percent <= 100 * (self.least[own] - 1) else [own]


def least_common(frequencies: np.ndarray) -> int:
    """The sketch's count from which an n-gram is told from those that share its cell by chance."""
    usual = float(np.median(frequencies))
    return int(usual + 4 * usual**0.5) + 2


def rare_first(grams: np.ndarray, frequencies: np.ndarray, classes: Classes) -> np.ndarray:
    """Hashes of a set's first buckets (or columns), of which it shares one with every set it links to, with each
    size class it takes part in. A set that links with equal ones only has none."""
    n, percent = len(grams), classes.percent
    counts = frequencies[cell_of(grams)]
    if percent < BUCKETS_FROM:
        order = (np.minimum(counts, 0xFFFF).astype(np.uint64) << np.uint64(48)) | (mix(grams) >> np.uint64(16))
        size = n - -(-n * percent // 100) + 1
        first = grams[np.argpartition(order, size - 1)[:size]] if size < n else grams
        return np.concatenate([mix(first ^ np.uint64(cls + 1)) for cls in classes.of(n)])
    # N-grams are hashes in ascending order, so a bucket is a stretch of them.
    place = grams >> np.uint64(32)
    sums, rare = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.int64)
    np.cumsum(grams, out=sums[1:])
    np.cumsum(counts < classes.common, out=rare[1:])
    found = [np.empty(0, np.uint64)]
    for cls in classes.of(n):
        # Sets of the class below are met in its own blocks, and have at most its sizes.
        top = classes.least[cls + 1] - 1
        most = n * 100 // percent if n <= top else top
        differ = (n + most) * (100 - percent) // (100 + percent)
        if not differ:
            continue
        buckets = int(ROOM * (top * (100 - percent) // percent + 1)) + 2
        sizes = np.bincount((place * np.uint64(buckets) >> np.uint64(32)).view(np.int64), minlength=buckets)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        held = mix((sums[ends] - sums[starts]) ^ (np.arange(cls + 1 << 40, (cls + 1 << 40) + buckets, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        score = np.minimum(rare[ends] - rare[starts], 15) << 4 | np.minimum(sizes, 15)
        order = ((255 - score).view(np.uint64) << np.uint64(56)) | (held >> np.uint64(8))
        found.append(held[np.argpartition(order, differ)[: differ + 1]])
    return np.concatenate(found)


def parity_bits(grams: np.ndarray) -> bytes:
    """A bitmap of about one bit for each n-gram, in which each n-gram flips one."""
    size = 1 << max(6, int(len(grams) - 1).bit_length())
    odd = np.bincount((mix(grams ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(size - 1)).astype(np.intp), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def set_hashes(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes that stand for the set."""
    with np.errstate(over="ignore"):
        return int(mix(grams + np.uint64(1)).sum().astype(np.int64)), int(mix(grams ^ np.uint64(0xA0761D6478BD642F)).sum().astype(np.int64))


def incidence(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id``, set hashes ``s1`` and ``s2``, set size ``n`` and ``first``: the set's first blocks, and
    its parity ``bits``, given once for each set and batch so that exact copies are thinned out before the shuffle."""
    counts = document_frequencies(texts(docs), lambda text: shingle_hashes(text.encode(), words))
    classes = Classes(percent, least_common(counts))
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 0xFFFF).astype(np.uint16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            seen = set()
            for part in small_batches(whole, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    grams = shingle_hashes(text.encode(), words)
                    key = set_hashes(grams)
                    fresh = len(grams) and key not in seen
                    rows.append((*key, len(grams), rare_first(grams, shared.value, classes).view(np.int64) if fresh else np.empty(0, np.int64), parity_bits(grams) if fresh else None))
                    seen.add(key)
                s1, s2, n, first, bits = zip(*rows)
                arrays = [part.column("doc_id"), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "s1", "s2", "n", "first", "bits"])

    return texts(docs).mapInArrow(run, "doc_id long, s1 long, s2 long, n long, first array<long>, bits binary")


def chains(rows: DataFrame) -> DataFrame:
    """``a``, ``b``: each entry ``s1`` chained to the first one with the same ``block`` (a column, or a hash).

    Rows are sorted by block and set over range partitions, so one block may span several
    tasks; a task holds one batch. Where a block meets a partition's edge, the chains of
    both sides are joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "a", "b", "edge"]
        last = None
        for batch in batches:
            block, s1 = batch.column("block").to_numpy(), batch.column("s1").to_numpy()
            if not len(block):
                continue
            fresh = np.concatenate([[last is None or last[0] != block[0]], block[1:] != block[:-1]])
            run_of = np.cumsum(fresh) - 1
            hubs = s1[fresh]
            if not fresh[0]:
                run_of, hubs = run_of + 1, np.concatenate([[last[1]], hubs])
            hub = hubs[run_of]
            if last is None:
                yield pa.RecordBatch.from_arrays([pa.array(block[:1]), pa.array(hub[:1]), pa.array(hub[:1]), pa.array([False])], names)
            last = block[-1], hub[-1]
            kept = np.flatnonzero(hub != s1)
            if len(kept):
                yield pa.RecordBatch.from_arrays([pa.array(block[kept]), pa.array(hub[kept]), pa.array(s1[kept]), pa.array(np.ones(len(kept), bool))], names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([*(pa.array(np.array([x])) for x in (*last, last[1])), pa.array([False])], names)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stage(
        rows.repartitionByRange(parts, "block", "s1").sortWithinPartitions("block", "s1").mapInArrow(run, "block long, a long, b long, edge boolean").distinct(),
        "chains",
    )
    ends = found.where("not edge")
    joined = ends.join(ends.groupBy("block").agg(F.min("a").alias("hub")), "block").select("a", F.col("hub").alias("b"))
    return found.where("edge").select("a", "b").unionByName(joined).where("a <> b")


def tile_links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links among the rows of a tile, as a spanning forest, by a product of incidence strips."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    rank = np.cumsum(count > 1) - 1
    row, column = row[shared], rank[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = sizes[:, None] + sizes[None, :]
    needed = -(-total * percent // (100 + percent))  # The least overlap of a link.
    viable = np.triu(np.minimum(sizes[:, None], sizes[None, :]) >= needed, 1)
    overlap = np.zeros(total.shape, np.float32)
    left = np.bincount(row, minlength=len(sets))
    n_columns = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, n_columns, STRIP):
        lo, hi = np.searchsorted(column, [start, start + STRIP])
        viable &= overlap + np.minimum(left[:, None], left[None, :]) >= needed
        alive = np.flatnonzero(viable.any(axis=0) | viable.any(axis=1))
        if not len(alive):
            return []
        place = np.full(len(sets), -1)
        place[alive] = np.arange(len(alive))
        r, c = place[row[lo:hi]], column[lo:hi] - start
        strip = np.zeros((len(alive), min(STRIP, n_columns - start)), np.float32)
        strip[r[r >= 0], c[r >= 0]] = 1
        overlap[np.ix_(alive, alive)] += strip @ strip.T
        left -= np.bincount(row[lo:hi], minlength=len(sets))
    return _forest(ids, np.argwhere(viable & (overlap >= needed)))


def _forest(ids: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of positions that a spanning forest keeps, as ids."""
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    kept = []
    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((int(ids[a]), int(ids[b])))
    return kept


def tile_survivors(ids: np.ndarray, sizes: np.ndarray, bits: list[bytes], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that sizes and parity bitmaps do not rule out."""
    maps = [np.frombuffer(b, np.uint64) for b in bits]
    width = np.array([len(m) for m in maps])
    near = np.zeros((len(ids), len(ids)), bool)
    for w in np.unique(width):
        # Bitmaps of this width, and wider ones folded to it.
        own = np.flatnonzero(width == w)
        rest = np.flatnonzero((width >= w) & (sizes * percent <= 100 * sizes[own].max()))
        left = np.stack([maps[i] for i in own])
        right = np.stack([np.bitwise_xor.reduce(maps[i].reshape(-1, w), axis=0) for i in rest])
        step = max(1, 1_000_000 // (len(rest) * int(w)))
        for start in range(0, len(own), step):
            a = own[start : start + step]
            differ = np.bitwise_count(left[start : start + step, None] ^ right[None]).sum(axis=2, dtype=np.int64)
            small, large = np.minimum(sizes[a][:, None], sizes[rest]), np.maximum(sizes[a][:, None], sizes[rest])
            near[np.ix_(a, rest)] = (differ * (100 + percent) <= (small + large) * (100 - percent)) & (small * 100 >= large * percent)
    near |= near.T
    return _spanning(ids, near)


def _spanning(ids: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """The pairs, as ids, of a spanning forest of a symmetric matrix of pairs."""
    left, kept = np.ones(len(ids), bool), []
    for start in range(len(ids)):
        todo = [start] if left[start] else []
        left[start] = False
        while todo:
            x = todo.pop()
            new = np.flatnonzero(near[x] & left)
            left[new] = False
            kept += [(int(ids[x]), int(y)) for y in ids[new]]
            todo += new.tolist()
    return kept


def _in_tiles(nodes: DataFrame, percent: int, wide: int = TILE, volume: int | None = VOLUME) -> DataFrame:
    """``nodes`` (``id``, ``n``, ``root`` and others) with the ``tiles`` in which each meets the rest of its group.

    Groups within a tile's bound share tiles; larger ones are cut by size class and slice. Tiles of
    larger groups have up to ``wide`` rows where these are small (``n`` in all up to ``volume`` for half of one), as each row is in the fewer of them.
    """
    sizes = nodes.groupBy("root").count()
    packs = max(1, -(-nodes.count() // TILE))
    classes = Classes(percent)

    @F.pandas_udf("int")
    def size_class(n: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(classes.least, n, side="right") - 1, dtype="int32")

    pack = F.concat_ws(":", F.lit("p"), F.pmod(F.xxhash64("root"), F.lit(packs)))
    small = nodes.join(sizes.where(f"count <= {TILE}"), "root").select(*nodes.columns, F.array(pack).alias("tiles"))
    large = nodes.join(sizes.where(f"count > {TILE}"), "root").withColumn("cls", size_class("n"))
    slices = F.expr(f"least(ceil(count(*) / ({TILE} / 2)), greatest(ceil(count(*) / ({max(wide, TILE)} / 2)), ceil(sum(n) / {volume or 1 << 62})))").cast("int").alias("slices")
    slices = large.groupBy("root", "cls").agg(slices)
    above = slices.select("root", (F.col("cls") - 1).alias("cls"), F.col("slices").alias("over"))
    below = slices.select("root", (F.col("cls") + 1).alias("cls"), F.col("slices").alias("under"))
    cut = large.join(slices, ["root", "cls"]).join(above, ["root", "cls"], "left").join(below, ["root", "cls"], "left")
    # Only rows that can link with the nearest size of the class above or below are in tiles with it.
    bounds = F.array(*map(F.lit, classes.least))
    meets_above = F.col("n") * 100 >= percent * F.element_at(bounds, F.col("cls") + 2)
    meets_below = F.col("n") * percent <= 100 * (F.element_at(bounds, F.col("cls") + 1) - 1)
    cut = cut.withColumn("over", F.when(meets_above, F.col("over"))).withColumn("under", F.when(meets_below, F.col("under")))
    own = "cast(pmod(xxhash64(id), slices) as int)"
    tiles = f"""concat(
        transform(sequence(0, slices - 1), j -> concat_ws(':', root, cls, cls, least(j, {own}), greatest(j, {own}))),
        if(over is null, array(), transform(sequence(0, over - 1), j -> concat_ws(':', root, cls, cls + 1, {own}, j))),
        if(under is null, array(), transform(sequence(0, under - 1), j -> concat_ws(':', root, cls - 1, cls, j, {own}))))"""
    return small.unionByName(cut.select(*nodes.columns, F.expr(tiles).alias("tiles")))


def links(docs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between set representatives (``a``, ``b``: ids), a spanning forest of each tile.

    ``rows`` is the result of ``incidence``, written.
    """
    edges = chains(rows.select(F.explode("first").alias("block"), "s1"))
    grouped = connected_components(edges)
    nodes = rows.where("n > 0").join(grouped.select(F.col("node").alias("s1"), "root"), "s1")
    # The row that carries a set's bits may be one without an id.
    nodes = nodes.groupBy("s1", "s2", "n", "root").agg(F.min("doc_id").alias("id"), F.max("bits").alias("bits"))
    nodes = stage(nodes.where("id is not null"), "chained-sets")

    def thin(group: pd.DataFrame) -> pd.DataFrame:
        forest = []
        for _, one in group.groupby("root"):
            if len(one) > 1:
                forest += tile_survivors(one["id"].to_numpy(), one["n"].to_numpy(), one["bits"].tolist(), percent)
        return pd.DataFrame(forest, columns=["a", "b"], dtype="int64")

    tiled = _in_tiles(nodes, percent, WIDE).select(F.explode("tiles").alias("tile"), "id", "n", "root", "bits")
    left = connected_components(tiled.groupBy("tile").applyInPandas(thin, "a long, b long"))
    nodes = stage(nodes.drop("root", "bits").join(left.select(F.col("node").alias("id"), "root"), "id"), "thinned-sets")
    placed = stage(_in_tiles(nodes, percent), "tiles")

    # The sets of representatives are read off the texts once more; a bounded filter leaves out nearly all other texts.
    keyed = placed.select(F.xxhash64("id").bitwiseXOR(F.col("s1")).alias("g1"), F.col("s2").alias("g2"))
    words_of = rows.sparkSession.sparkContext.broadcast(filter_words(keyed, placed.count(), most_bytes=FILTER_BYTES))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in small_batches(whole, "text"):
                found = [shingle_hashes(t.encode(), words) for t in part.column("text").to_pylist()]
                s1, s2 = (np.array(x, np.int64) for x in zip(*map(set_hashes, found)))
                kept = np.flatnonzero(passes(words_of.value, part.column("h").to_numpy() ^ s1, s2, 0))
                if len(kept):
                    arrays = [part.column("doc_id").take(pa.array(kept)), pa.array(s1[kept]), pa.array(s2[kept]), pa.array([found[i].tobytes() for i in kept], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, ["id", "s1", "s2", "grams"])

    read = texts(docs).where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    sets = read.mapInArrow(wanted, "id long, s1 long, s2 long, grams binary")
    tiled = placed.join(sets, ["id", "s1", "s2"]).select(F.explode("tiles").alias("tile"), "id", "s1", "s2", "root", "grams")

    def multiply(group: pd.DataFrame) -> pd.DataFrame:
        forest = []
        for _, one in group.drop_duplicates(["s1", "s2"]).groupby("root"):
            if len(one) > 1:
                forest += tile_links(one["id"].to_numpy(), [np.frombuffer(g, np.uint64) for g in one["grams"]], percent)
        return pd.DataFrame(forest, columns=["a", "b"], dtype="int64")

    return tiled.groupBy("tile").applyInPandas(multiply, "a long, b long")


def jaccard_components(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document: links need
    100 * intersection >= ``percent`` * union of the distinct ``words``-grams."""
    rows = stage(incidence(docs, words, percent), "incidence")
    linked = connected_components(links(docs, rows, words, percent)).select(F.col("node").alias("id"), "root")
    nodes = rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("id"))
    placed = nodes.join(linked, "id", "left").select("s1", "s2", "n", F.coalesce("root", "id").alias("component_id"))
    full = rows.where("n > 0").drop("first", "bits").join(placed, ["s1", "s2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
