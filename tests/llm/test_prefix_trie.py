"""The prefix trie against a dictionary of prefixes, its SQL, and the rollup against plain subtree sums."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from caseloom.llm import prefix_trie
from caseloom.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, digest string, p1 string, pos long, conv string"
SF = "/root/testdata/sf0.001"


def brute(rows):
    """All nodes, from a dictionary of whole prefixes."""
    told = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            told[conv].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [t[2] for t in sorted(v, key=lambda t: t[:2])] for c, v in told.items()}
    rebuilt = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        rebuilt[conv] = own.get(conv - int(np.fmod(conv, 100)), [])[:h] + turns[h:]
    members, kids, leaves, saved = defaultdict(list), defaultdict(set), defaultdict(int), defaultdict(int)
    for conv, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    for key in members:
        if key:
            kids[key[:-1]].add(key)
    for key, convs in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += key not in kids
            saved[key[:d]] += (len(convs) - 1) * (len(key[-1][1]) if key else 0)
    out = []
    for key, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(key))
        above = min(members[key[:-1]]) if key else None
        out.append((min(convs), len(key), above, len(convs), len(kids.get(key, ())), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=260):
    """Nulls, ties, repeated rows, negative ids, turnless conversations, one long and hot conversation, a very long text."""
    rng = random.Random(seed)
    ids = [0, 1, 2, 5, 7, 100, 101, 199, 200, 250, 251, -3, -100, -150, None]
    rows = [(rng.choice(ids) if rng.random() < 0.7 else 1, rng.choice([None, 0, 1, 2, 3, 3]), rng.choice([None, "u", "a", ""]), rng.choice([None, "", "x", "é😀"])) for _ in range(n)]
    rows += [(1000 + i, t, "u", "hi" * (t + 1)) for i in range(40) for t in range(7)]
    return rows + rows[:3] + [(300, 1, "u", "long " * 50_000)]


@pytest.mark.parametrize("limit, slice_size", [(prefix_trie.LIMIT, prefix_trie.SLICE), (12, 4)])
def test_nodes(spark, limit, slice_size):
    rows = made(limit)
    df = spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], SCHEMA)
    got = prefix_trie.prefix_trie(df, limit, slice_size)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_chunks_of_ids(spark):
    """A node's digest does not depend on how its ids are cut."""
    steps = spark.createDataFrame([(i, 1, 5, 6, 1) for i in range(-9, 300)] + [(900, 1, 7, 7, 2)], "conv long, depth long, p1 long, p2 long, length long")
    want = hashlib.sha256(",".join(map(str, range(-9, 300))).encode()).hexdigest()
    assert [tuple(r) for r in prefix_trie.end_digests(steps, chunk=100).collect()] == [(5, 6, want)]


def test_empty(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "x", "", "", 1, "")], SCHEMA)).count() == 0


def test_query_and_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    got = QUERIES["op11_prefix_trie"](spark, SF)
    want = con.sql(ORACLES["op11_prefix_trie"])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.select(", ".join(got.columns)).fetchall(), key=str)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "comb", "forest"])
def test_centroid_sums(shape):
    rng, n = np.random.default_rng(4), 700
    if shape == "chain":
        parent = np.arange(-1, n - 1)
    elif shape == "star":
        parent = np.where(np.arange(n) == 0, -1, 0)
    elif shape == "comb":
        parent = np.array([-1] + [i - 1 if i % 2 else max(i - 2, 0) for i in range(1, n)])
    else:
        parent = np.array([-1] + [int(rng.integers(0, i)) for i in range(1, n)])
        if shape == "forest":
            parent[rng.integers(0, n, 30)] = -1
    mass, values = rng.integers(1, 50, n), rng.integers(0, 2**50, (n, 2))
    weight, want = mass.copy(), values.copy()
    for node in range(n - 1, 0, -1):
        if parent[node] >= 0:
            weight[parent[node]] += weight[node]
            want[parent[node]] += want[node]
    assert (prefix_trie.centroid_sums(parent, weight, values) == want).all()
