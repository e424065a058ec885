"""Prefix trie of rebuilt conversations, rolled up by a centroid decomposition of its parent edges.

1. Turns are ordered over range partitions and rebuilt: a conversation starts with turns of
   its family's first conversation and goes on with its own.
2. A prefix is known by the exclusive-or of two 64-bit hashes of (depth, turn) over its
   turns, so a prefix's parent needs no look-up. Long conversations are hashed in slices.
3. A node's members are counted by its prefix. So is its weight, the (conversation, depth)
   pairs below it: that is the subtree sum of members, known before any walk on the tree.
4. Totals over subtrees come from a centroid decomposition. A component's nodes of more than
   half its weight are a path that starts at its top; the last is the centroid. The sum of
   all below the centroid is added to that path. The centroid is cut out: the components are
   then its children's subtrees and what lies above. A weight only changes on the path, so
   every round is a few joins. Weight halves, so rounds grow with its logarithm,
   however deep the trie. Components of at most ``LIMIT`` nodes finish inside a task.

A turn stands for its role and text by MD5, and turns of one conversation and ``turn`` are in
the order of that digest. Defined results: a null ``turn`` comes first; null role or text is
empty; rows without a ``conv_id`` belong to no conversation and are left out; repeated rows
are turns of their own; texts of any length count in full and are never shuffled; other
columns of the input, whatever their names, stay outside; an empty table has no node.
"""

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.operators.keyed import number_in_order
from caseloom.sources.tables import stage

FAMILY, SHARED = 100, 6
SLICE = 1024  # Turns of a conversation that one window hashes.
LIMIT = 16_384  # Nodes of a component that is finished inside a task.
CHUNK = 1 << 16  # Characters of joined ids passed on at a time.


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (``conv``), and their rebuilt turns: ``conv``, ``at`` (from 1), ``digest`` and ``chars``."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED
    family = F.col("conv") - F.col("conv") % FAMILY
    convs = turns.select("conv").distinct()
    placed = number_in_order(turns, "conv", "turn", ["digest"], "pos")
    heads = placed.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < SHARED)).select(F.col("conv").alias("family"), "pos", "digest", "chars")
    lead = convs.select("conv", family.alias("family"), taken.alias("taken")).join(heads, "family").where("pos <= taken")
    lent = heads.groupBy("family").agg(F.count(F.lit(1)).alias("lent"))
    own = placed.where(F.col("pos") > taken).select("*", family.alias("family"), taken.alias("taken")).join(lent, "family", "left")
    rows = lead.select("conv", F.col("pos").alias("at"), "digest", "chars").unionByName(
        own.select("conv", F.expr("pos - taken + least(taken, coalesce(lent, 0))").alias("at"), "digest", "chars")
    )
    return convs, rows


def prefixes(convs: DataFrame, rows: DataFrame, slice_size: int = SLICE) -> DataFrame:
    """A row for each conversation and depth: node ``p1``, ``p2``, parent ``q1``, ``q2``, ``chars`` of the last turn,
    ``length`` of the conversation. The root is (0, 0)."""
    own = [F.xxhash64(F.lit(seed), "at", "digest") for seed in (0x5EED, 0xF00D)]
    cut = rows.select("conv", "at", "chars", F.floor(F.col("at") / slice_size).alias("slice"), own[0].alias("g1"), own[1].alias("g2"))
    within = Window.partitionBy("conv", "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    run = cut.select("*", F.bit_xor("g1").over(within).alias("x1"), F.bit_xor("g2").over(within).alias("x2"))
    before = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = run.groupBy("conv", "slice").agg(F.max_by("x1", "at").alias("x1"), F.max_by("x2", "at").alias("x2"), F.max("at").alias("last"))
    shift = totals.select(
        "conv",
        "slice",
        F.coalesce(F.bit_xor("x1").over(before), F.lit(0)).alias("b1"),
        F.coalesce(F.bit_xor("x2").over(before), F.lit(0)).alias("b2"),
        F.max("last").over(Window.partitionBy("conv")).alias("length"),
    )
    steps = run.join(shift, ["conv", "slice"]).select(
        "conv",
        F.col("at").cast("long").alias("depth"),
        F.col("x1").bitwiseXOR(F.col("b1")).alias("p1"),
        F.col("x2").bitwiseXOR(F.col("b2")).alias("p2"),
        F.col("x1").bitwiseXOR(F.col("b1")).bitwiseXOR(F.col("g1")).alias("q1"),
        F.col("x2").bitwiseXOR(F.col("b2")).bitwiseXOR(F.col("g2")).alias("q2"),
        "chars",
        F.col("length").cast("long").alias("length"),
    )
    lengths = steps.groupBy("conv").agg(F.max("length").alias("length"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "p1", "p2", "q1", "q2", "chars")]
    roots = convs.join(lengths, "conv", "left").select("conv", *zero, F.coalesce("length", F.lit(0).cast("long")).alias("length"))
    return steps.unionByName(roots)


def trie_nodes(steps: DataFrame) -> DataFrame:
    """The distinct prefixes with members, children and ``weight``, the members summed over the subtree."""
    nodes = steps.groupBy("p1", "p2").agg(
        F.min("depth").alias("depth"),
        F.min("conv").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.expr("length - depth + 1")).alias("weight"),
        F.max("chars").alias("chars"),
        F.min("q1").alias("q1"),
        F.min("q2").alias("q2"),
    )
    below = nodes.where("depth > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    return nodes.join(below, ["p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


def centroid_sums(parent: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of ``values`` (rows by node) in a forest, by centroid decomposition.

    ``parent`` is -1 at a top; ``weight`` is any positive weight summed over the subtree.
    """
    n = len(parent)
    children: list[list[int]] = [[] for _ in range(n)]
    tops = []
    for node, above in enumerate(parent.tolist()):
        (children[above] if above >= 0 else tops).append(node)
    # Places of a walk in preorder tell what lies below a centroid.
    first, last, part = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = 0
    for top in tops:
        todo = [top]
        while todo:
            node = todo.pop()
            if node < 0:
                last[~node] = at
                continue
            first[node], part[node] = at, top
            at += 1
            todo.append(~node)
            todo += children[node]
    weight, sums = weight.copy(), np.zeros_like(values)
    left = np.arange(n)
    while len(left):
        mine = part[left]
        total = np.zeros(n, weight.dtype)
        np.maximum.at(total, mine, weight[left])
        path = left[2 * weight[left] > total[mine]]
        order = np.lexsort((weight[path], part[path]))
        ranked = path[order]
        centre_of = np.full(n, -1)
        starts = np.flatnonzero(np.diff(part[ranked], prepend=-1))
        centre_of[part[ranked[starts]]] = ranked[starts]
        centre = centre_of[mine]
        inside = (first[left] >= first[centre]) & (first[left] < last[centre])
        below = np.zeros_like(values)
        np.add.at(below, mine[inside], values[left[inside]])
        sums[path] += below[part[path]]
        weight[path] -= weight[centre_of[part[path]]]
        # A centroid's children become tops; whoever lies below them goes along.
        tops_now = left[parent[left] == centre]
        key = part[tops_now] * n + first[tops_now]
        tops_now, key = tops_now[np.argsort(key)], np.sort(key)
        moved = left[inside & (left != centre)]
        part[moved] = tops_now[np.searchsorted(key, part[moved] * n + first[moved], side="right") - 1]
        left = left[left != centre]
    return sums


def _finish(group: pd.DataFrame) -> pd.DataFrame:
    """Subtree sums of whole components."""
    keys = np.stack([group["p1"], group["p2"]], axis=1).astype(np.int64)
    above = np.stack([group["q1"], group["q2"]], axis=1).astype(np.int64)
    _, index = np.unique(np.concatenate([keys, above]), axis=0, return_inverse=True)
    index = index.ravel()
    place = np.full(len(index), -1)
    place[index[: len(keys)]] = np.arange(len(keys))
    parent = place[index[len(keys) :]]
    own = group[["k1", "k2"]].to_numpy()
    # An edge to another component was cut; the root, whose parent key is its own, has none.
    cut = (parent < 0) | (own[parent] != own).any(axis=1) | (parent == np.arange(len(keys)))
    sums = centroid_sums(np.where(cut, -1, parent), group["w"].to_numpy(), group[["leaf", "saved"]].to_numpy(np.int64))
    return pd.DataFrame({"p1": group["p1"], "p2": group["p2"], "n_leaves": sums[:, 0], "saved_tokens": sums[:, 1]})


SUMS = "p1 long, p2 long, n_leaves long, saved_tokens long"


def rollup(nodes: DataFrame, steps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``n_leaves`` and ``saved_tokens`` of every node's subtree; both arguments are written tables.

    Components of more than ``limit`` nodes are halved by weight in rounds over all of them.
    """
    live = nodes.select(
        "p1", "p2", "q1", "q2", "conv_id", "depth",
        F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"),
        F.col("weight").alias("w"),
        (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    state = live.columns
    small, added = [], []
    while True:
        sizes = stage(live.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("nodes"), F.max("w").alias("total")), "trie-components")
        large = sizes.where(F.col("nodes") > limit).select("k1", "k2", "total")
        if large.isEmpty():
            small.append(live)
            break
        small.append(live.join(large.select("k1", "k2"), ["k1", "k2"], "left_anti"))
        whole = live.join(large, ["k1", "k2"])
        path = F.col("2w") > F.col("total")
        centre = F.min_by(F.struct("p1", "p2", "depth", "w"), "w").alias("c")
        centres = stage(whole.withColumn("2w", 2 * F.col("w")).where(path).groupBy("k1", "k2", "total").agg(centre), "trie-centroids")
        # The conversations that go on below a centroid, and its child on their way.
        through = centres.select("k1", "k2", "c.p1", "c.p2", F.col("c.depth").alias("cut"))
        through = through.withColumnsRenamed({"p1": "q1", "p2": "q2"})
        ways = steps.where("depth > 0").select("q1", "q2", F.col("conv").alias("conv_id"), F.col("p1").alias("t1"), F.col("p2").alias("t2"))
        ways = ways.join(through, ["q1", "q2"]).select("k1", "k2", "conv_id", "t1", "t2", "cut")
        met = live.join(centres, ["k1", "k2"]).join(ways, ["k1", "k2", "conv_id"], "left")
        under = F.col("depth") > F.col("cut")
        is_centre = (F.col("p1") == F.col("c.p1")) & (F.col("p2") == F.col("c.p2"))
        met = met.select(
            *state,
            (2 * F.col("w") > F.col("total")).alias("path"),
            is_centre.alias("centre"),
            (is_centre | F.coalesce(under, F.lit(False))).alias("inside"),
            F.when(under, F.col("t1")).otherwise(F.col("k1")).alias("n1"),
            F.when(under, F.col("t2")).otherwise(F.col("k2")).alias("n2"),
            F.col("c.w").alias("cut_w"),
        )
        met = stage(met, "trie-round")
        totals = met.where("inside").groupBy("k1", "k2").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
        added.append(met.where("path").select("p1", "p2", "k1", "k2").join(totals, ["k1", "k2"]).drop("k1", "k2"))
        live = met.where("not centre").select(
            *[c for c in state if c not in ("k1", "k2", "w")],
            F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.expr("if(path, w - cut_w, w)").alias("w"),
        )
    rest = reduce(DataFrame.unionByName, small)
    packs = max(1, -(-nodes.count() // limit))
    local = rest.groupBy(F.pmod(F.xxhash64("k1", "k2"), F.lit(packs))).applyInPandas(_finish, SUMS)
    sums = reduce(DataFrame.unionByName, added, local)
    return sums.groupBy("p1", "p2").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def end_digests(steps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``ends_sha256`` of each node at which conversations end: their ids in ascending order, joined by commas.

    Range partitions, which may cut through a node, join ids to chunks; a digest then reads
    one row a chunk. SHA-256 itself cannot be split, so a node's chunks meet in one task, one at a time.
    """
    ends = steps.where("depth = length").select("p1", "p2", "conv")

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size = None, [], 0

        def row() -> pa.RecordBatch:
            arrays = [*(pa.array([x], pa.int64()) for x in (*node, ids[0])), pa.array([",".join(map(str, ids))])]
            return pa.RecordBatch.from_arrays(arrays, ["p1", "p2", "start", "ids"])

        for batch in batches:
            done = []
            for p1, p2, conv in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "conv"))):
                if ids and (node != (p1, p2) or size >= chunk):
                    done.append(row())
                    ids, size = [], 0
                node = p1, p2
                ids.append(conv)
                size += 21
            yield from done
        if ids:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def rows(found: list) -> pa.RecordBatch:
            p1, p2, hexes = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(p1, pa.int64()), pa.array(p2, pa.int64()), pa.array(hexes, pa.string())], ["p1", "p2", "ends_sha256"])

        for batch in batches:
            found = []
            for p1, p2, ids in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "ids"))):
                if node == (p1, p2):
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    found.append((*node, state.hexdigest()))
                node, state = (p1, p2), hashlib.sha256(ids.encode())
            yield rows(found)
        if node is not None:
            yield rows([(*node, state.hexdigest())])

    parts = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["p1", "p2", "conv"]
    joined = ends.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(join_ids, "p1 long, p2 long, start long, ids string")
    return joined.repartition(parts, "p1", "p2").sortWithinPartitions("p1", "p2", "start").mapInArrow(digest, "p1 long, p2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, limit: int = LIMIT, slice_size: int = SLICE) -> DataFrame:
    """Every node: smallest member ``conv_id``, ``depth``, ``parent_conv_id``, members, children, and the leaves and
    saved code points of its subtree, with the digest of the conversations that end there."""
    convs, rows = rebuilt_turns(conversations)
    steps = stage(prefixes(convs, rows, slice_size), "trie-steps")
    nodes = stage(trie_nodes(steps), "trie-nodes")
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    none: Column = F.lit(hashlib.sha256().hexdigest())
    up = nodes.where("depth > 0").select("p1", "p2", "q1", "q2").join(parents, ["q1", "q2"]).drop("q1", "q2")
    return (
        nodes.join(rollup(nodes, steps, limit), ["p1", "p2"])
        .join(end_digests(steps), ["p1", "p2"], "left")
        .join(up, ["p1", "p2"], "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
    )
