"""Keyed operators against brute force, with one key holding most rows."""

import random

from pyspark.sql import functions as F

from caseloom.operators import keyed as K
from caseloom.sources.tables import stage
from tests.helpers import at, dicts


def _skewed(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}", at(rng.randrange(1400)), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, ts timestamp_ntz, id int").repartition(7)


def test_newest_per_group(spark):
    rows, df = _skewed(spark)
    expected = set()
    for g in {r[0] for r in rows}:
        ranked = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1].timestamp(), r[2]))
        expected |= {(g, r[2], p) for p, r in enumerate(ranked[:50], 1)}
    got = K.newest_per_group(df, "g", "ts", ["id"], 50, "p").select("g", "id", "p").collect()
    assert {tuple(r) for r in got} == expected


def test_newest_per_group_limits_before_the_shuffle(spark):
    _, df = _skewed(spark)
    plan = K.newest_per_group(df, "g", "ts", ["id"], 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4


def test_number_in_order(spark):
    rows, df = _skewed(spark)
    rows += [("hot", None, -1), ("k1", None, -2)]
    df = df.unionByName(spark.createDataFrame(rows[-2:], df.schema))
    start = {"hot": 99990, "k1": 5}
    offsets = spark.createDataFrame(list(start.items()), "g string, start bigint")
    expected = set()
    for g in {r[0] for r in rows}:
        ranked = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or at(0), r[2]))
        expected |= {(r[2], start.get(g, 0) + p) for p, r in enumerate(ranked, 1)}
    got = K.number_in_order(df, "g", "ts", ["id"], "n", offsets)
    assert {(r["id"], r["n"]) for r in got.collect()} == expected


def test_numbers_of_a_burst(spark, monkeypatch):
    """All rows of the hot group arrive at one moment; many tasks share them."""
    written = []
    monkeypatch.setattr(K, "stage", lambda *args: written.append(stage(*args)) or written[-1])
    # Rows this few would be merged into one partition.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [("hot", at(5), i) for i in range(4000)] + [("cold", at(i), i) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, id int").repartition(5)
    got = K.number_in_order(df, "g", "ts", ["id"], "n")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["g"], r["id"], r["n"]) for r in got.collect()} == {(g, i, i + 1) for g, _, i in rows}
    tasks = [r["count"] for r in written[0].filter("g = 'hot'").groupBy(F.shiftright("_at", 33)).count().collect()]
    assert len(tasks) >= 4 and max(tasks) < 2000


def test_keep_last(spark):
    rows, df = _skewed(spark)
    expected = {g: max((r[1], r[2]) for r in rows if r[0] == g) for g in {r[0] for r in rows}}
    got = {r["g"]: (r["ts"], r["id"]) for r in K.keep_last(df, ["g"], ["ts", "id"]).collect()}
    assert got == expected


def test_upsert(spark):
    target = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")], "k string, v int, w string")
    changes = spark.createDataFrame(
        [("b", 9, "q", 1), ("b", 10, "r", 2), ("d", 4, "n", 1)], "k string, v int, w string, o int"
    )
    got = K.upsert(target, changes, "k", ["o"], keep=["w"])
    assert dicts(got, "k") == [
        {"k": "a", "v": 1, "w": "x"}, {"k": "b", "v": 10, "w": "y"}, {"k": "c", "v": 3, "w": "z"},
        {"k": "d", "v": 4, "w": "n"},
    ]
    # A kept NULL survives a match; it is not taken for "no match".
    blank = target.withColumn("w", F.lit(None).cast("string"))
    assert [r["w"] for r in dicts(K.upsert(blank, changes, "k", ["o"], keep=["w"]), "k")] == [None, None, None, "n"]


def test_newest_asks_for_at_least_one(spark):
    _, df = _skewed(spark)
    assert K.newest(df, 0, "ts", ["id"]).count() == 1
