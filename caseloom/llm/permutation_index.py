"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Shards of at most ``SHARD``
distinct vectors hold one inverted file for each pivot: which vectors have it among their
``DEPTH`` nearest, and where. A query walks the files of its own nearest pivots and adds
up how far the positions agree; that sum falls as Spearman's footrule distance of the
cut-off permutations grows. Of each shard the ``share`` of vectors at the least footrule
distance, with all that tie with the last of them, is reranked by cosine in double precision.

Every vector is indexed. Pivots are a bounded sample: ``PIVOTS`` distinct vectors of
least hash. Equal vectors are one entry with its smallest ids, so a vector that a third
of all rows share is stored and ranked once. Queries meet shards in blocks; a task holds
one shard and one block of queries.

Defined results: a vector that is null, empty or zero, holds null or non-finite
components, or has another dimension than most vectors takes no part, nor does a null
``vec_id``; ties go to the smaller id, however many vectors tie (cosines that
agree in 12 decimal digits count as tied, so multiples of one vector do); other columns of the
input, whatever their names, stay outside; vectors of any dimension are compared whole; repeated rows count once; an id is never its own
neighbour, even if it has several vectors; an empty table gives no rows.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.sources.tables import stage

PIVOTS, DEPTH = 256, 64
SHARD, BLOCK = 4096, 1024
DIGITS = 12  # Decimal digits by which cosines are told apart while searching.


def _usable(vector: Column) -> Column:
    """No null or non-finite component, and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def entries(vectors: DataFrame, most_ids: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (``e1``, ``e2``, ``v``, ``ids``: the ``most_ids`` smallest) and all members (``e1``, ``e2``, ``vec_id``)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(_usable(F.col("v")) & F.col("vec_id").isNotNull())
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (common.n if common else 0))
    rows = stage(rows.select(F.xxhash64("v").alias("e1"), F.xxhash64(F.lit(3), "v").alias("e2"), "vec_id", "v"), "vectors")
    members = rows.select("e1", "e2", "vec_id").distinct()
    order = F.row_number().over(Window.partitionBy("e1", "e2").orderBy("vec_id"))
    least = members.withColumn("_n", order).where(F.col("_n") <= most_ids).groupBy("e1", "e2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    first = rows.join(least.select("e1", "e2", "ids", F.col("ids")[0].alias("vec_id")), ["e1", "e2", "vec_id"])
    return stage(first.groupBy("e1", "e2").agg(F.min("v").alias("v"), F.min("ids").alias("ids")), "entries"), members


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each vector the rank (from 0) of each pivot, ``DEPTH`` from there on."""
    order = np.argsort(-(unit @ pivots.T), axis=1, kind="stable")
    ranks = np.empty(order.shape, np.int64)
    np.put_along_axis(ranks, order, np.arange(order.shape[1])[None, :], 1)
    return np.minimum(ranks, DEPTH)


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class Shard:
    """The inverted files of one shard."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, pivots: np.ndarray):
        self.unit, self.ids = _unit(vectors), ids
        ranks = nearest_pivots(self.unit, pivots)
        pivot, self.row = np.nonzero(ranks.T < DEPTH)
        self.at = ranks[self.row, pivot]
        self.start = np.searchsorted(pivot, np.arange(len(pivots) + 1))

    def search(self, query: np.ndarray, ranks: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the ``k`` best of the reranked vectors, ties to the smaller id."""
        own = np.flatnonzero(ranks < DEPTH)
        parts = [slice(self.start[p], self.start[p + 1]) for p in own]
        row = np.concatenate([self.row[s] for s in parts])
        gain = np.concatenate([DEPTH - np.maximum(self.at[s], ranks[p]) for s, p in zip(parts, own)])
        agreed = np.bincount(row, gain, len(self.unit))
        keep = min(len(agreed), max(k, int(np.ceil(share * len(agreed)))))
        found = np.flatnonzero(agreed >= np.partition(agreed, len(agreed) - keep)[len(agreed) - keep])
        cosine = np.round(self.unit[found] @ query, DIGITS)
        best = np.lexsort((self.ids[found], -cosine))[:k]
        return found[best], cosine[best]


def search(vectors: DataFrame, queries: Column, k: int = 5, share: float = 0.35) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` (cosine) of the ``k`` nearest found for each row that ``queries`` holds for."""
    kept, members = entries(vectors, k + 1)
    pivots = np.array([r.v for r in kept.orderBy(F.xxhash64("e1", F.lit(9)), "e2").limit(PIVOTS).select("v").collect()])
    asked = members.where(queries)
    wanted = asked.select("e1", "e2").distinct().join(kept.select("e1", "e2", "v"), ["e1", "e2"])
    wanted = stage(wanted, "queries")
    n_shards, n_blocks = max(1, -(-kept.count() // SHARD)), max(1, -(-wanted.count() // BLOCK))
    place = F.xxhash64("e1", "e2", F.lit(21))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shards = kept.select("e1", "e2", "v", F.col("ids")[0].alias("first"), F.pmod(place, F.lit(n_shards)).cast("int").alias("shard"), numbers(n_blocks).alias("block"))
    blocks = wanted.select("e1", "e2", "v", F.pmod(place, F.lit(n_blocks)).cast("int").alias("block"), numbers(n_shards).alias("shard"))
    unit_pivots = _unit(pivots) if len(pivots) else pivots

    def run(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shard) and len(block):
            files = Shard(np.stack(shard["v"].to_numpy()), shard["first"].to_numpy(), unit_pivots)
            asked_for = _unit(np.stack(block["v"].to_numpy()))
            one, two = shard["e1"].to_numpy(), shard["e2"].to_numpy()
            for q1, q2, query, ranks in zip(block["e1"], block["e2"], asked_for, nearest_pivots(asked_for, unit_pivots)):
                # One more than asked for: the query's own vector may be among them.
                rows, scores = files.search(query, ranks, k + 1, share)
                out += [(q1, q2, one[r], two[r], files.ids[r], s) for r, s in zip(rows.tolist(), scores.tolist())]
        whole = {c: "int64" for c in ("q1", "q2", "e1", "e2", "first")}
        return pd.DataFrame(out, columns=[*whole, "near"]).astype(whole | {"near": "float64"})

    found = shards.groupBy("shard", "block").cogroup(blocks.groupBy("shard", "block")).applyInPandas(run, "q1 long, q2 long, e1 long, e2 long, first long, near double")
    best = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("near"), "first"))
    best = found.withColumn("_n", best).where(F.col("_n") <= k + 1).join(kept.select("e1", "e2", F.col("v").alias("b"), "ids"), ["e1", "e2"])
    best = best.join(kept.select(F.col("e1").alias("q1"), F.col("e2").alias("q2"), F.col("v").alias("a")), ["q1", "q2"])
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    score = dot(F.col("a"), F.col("b")) / (F.sqrt(dot(F.col("a"), F.col("a"))) * F.sqrt(dot(F.col("b"), F.col("b"))))
    lists = stage(best.select("q1", "q2", score.alias("score"), "ids"), "neighbours")
    each = asked.select(F.col("e1").alias("q1"), F.col("e2").alias("q2"), F.col("vec_id").alias("query_id")).join(lists, ["q1", "q2"])
    each = each.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), "vec_id"))
    return each.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
