"""Word matching against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.functions.text import tokens
from caseloom.operators import case_index as I
from caseloom.operators import match as M
from caseloom.sources.tables import conform
from tests.helpers import at, dicts

WORDS = [f"word{i}" for i in range(30)] + ["the"]


def _texts(rng, n):
    return [" ".join(["the", *rng.choices(WORDS, k=rng.randrange(1, 12))]) for _ in range(n)]


@pytest.fixture
def sides(spark):
    rng = random.Random(5)
    scopes = ["hot"] * 8 + ["a", "b"]
    targets = [(i, rng.choice(scopes), t) for i, t in enumerate(_texts(rng, 120))] + [(999, "a", "zz"), (998, "none", "the")]
    targets += [(500 + i, "hot", "the") for i in range(9)] + [(600 + i, "hot", "the word1") for i in range(9)]
    pool = [(f"k{i:03}", rng.choice(scopes), at(rng.randrange(40)), t) for i, t in enumerate(_texts(rng, 90))]
    best = {}
    for tid, scope, text in targets:
        mine = sorted((c for c in pool if c[1] == scope), key=lambda c: (-c[2].timestamp(), c[0]))
        scored = [(len(set(text.split()) & set(c[3].split())), place, c[0]) for place, c in enumerate(mine)]
        ranked = sorted((s for s in scored if s[0]), key=lambda s: (-s[0], s[1]))
        best[tid] = [(k, s) for s, _, k in ranked]
    tdf = spark.createDataFrame(targets, "target_id int, scope string, text string")
    cdf = spark.createDataFrame(pool, "key string, scope string, ts timestamp_ntz, text string")
    return (
        tdf.select("target_id", "scope", tokens(F.col("text")).alias("words")),
        M.candidate_pool(cdf, "scope", "key", "ts", tokens(F.col("text"))),
        best,
    )


@pytest.mark.parametrize("walk", [M.FIRST_WALK, 60, 1])
@pytest.mark.parametrize("k", [1, 3, 250])
def test_overlap(sides, walk, k):
    """Every target gets its list, in one walk or many."""
    targets, pool, best = sides
    got = {}
    for r in dicts(M.best_by_bounds(targets, M.pool_postings(pool), k, walk), "target_id", "position"):
        got.setdefault(r["target_id"], []).append((r["key"], r["score"]))
    assert got == {tid: ranked[:k] for tid, ranked in best.items() if ranked}


def test_no_pairs_are_shuffled(spark, sides):
    """What is shuffled for the counts are words of both sides and results: no row for each target and candidate in common."""
    targets, pool, _ = sides
    plan = M.token_overlap(targets, pool, 1)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "HashAggregate" not in plan


def test_repeated_and_null_keys(spark):
    """Repeated rows count as often as they are there, a null key or target is one like any other."""
    targets = spark.createDataFrame([(1, "s", ["a", "b"]), (1, "s", ["a"]), (None, "s", ["b"]), (2, None, ["a"]), (3, "s", None)], "target_id int, scope string, words array<string>")
    pool = spark.createDataFrame(
        [("x", "s", 5, ["a"]), ("x", "s", 5, ["a", "b"]), (None, "s", 5, ["a", "b", None]), ("y", "s", 6, ["b"]), ("z", None, 9, ["a"])],
        "key string, scope string, recency bigint, words array<string>",
    )
    want = [(1, 1, "x", 5), (1, 2, None, 3), (1, 3, "y", 1), (None, 1, "y", 1), (None, 2, None, 1), (None, 3, "x", 1)]
    for found in (M.token_overlap(targets, pool, 3), M.best_by_bounds(targets, M.pool_postings(pool), 3, 1)):
        assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(want, key=str)


def test_index_counts_in_tasks(spark, sides):
    """From stored postings of two versions: only the valid one counts, and no hits are shuffled."""
    targets, pool, best = sides
    postings = M.pool_postings(pool).withColumn("version", F.lit(1).cast("bigint"))
    stale = postings.withColumn("version", F.lit(0).cast("bigint")).withColumn("recency", F.col("recency") + 1)
    stored = stale.unionByName(postings).withColumn("bucket", I._bucket())
    found = I.similar_by_index(targets, stored, pool.selectExpr("key", "1L as version"), 3)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in dicts(found, "target_id", "position"):
        got.setdefault(r["target_id"], []).append((r["case_number"], r["score"]))
    assert got == {tid: ranked[:3] for tid, ranked in best.items() if ranked}


def test_changes_are_computed_once(spark, sides):
    """Postings and live versions of a change come from written cases, not each from the changes' whole plan."""
    _, pool, _ = sides
    cases = pool.selectExpr("scope", "key as case_number", "timestamp_micros(recency) as updated_at", "array_join(words, ' ') as search_text", "key < 'k050' as learning_eligible")
    live = cases.selectExpr("case_number as key", "0L as version")
    touched = [cases.filter("case_number >= 'k040'")]
    postings, after = I.change_index(live, cases.repartition(2, "scope"), touched, 1)
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()
    assert {r.key for r in postings.collect()} == {f"k{i:03}" for i in range(40, 50)}
    assert {(r.key, r.version) for r in after.collect()} == {(f"k{i:03}", int(i >= 40)) for i in range(50)}


def _request(spark, rows):
    schema = schemas.T.StructType([schemas.T.StructField("id", schemas.I), *schemas.REQUESTS.fields])
    form = [None] * 9
    full = [(i, cat, tuple([None, problem, *form[2:]]), chat, None, None) for i, cat, problem, chat in rows]
    return spark.createDataFrame(full, schema)


def test_recommend_and_render(spark):
    catalog = spark.createDataFrame(
        [("belt", "u1", "acme fan belt", True, at(1), "", [("Size", "2"), ("Make", "A")]),
         ("belt", "u2", "fan belt", True, at(2), "B-2", []),
         ("belt", "u3", "fan belt engine", False, at(3), "", []),
         ("chain", "u4", "fan belt engine", True, at(3), "", [])],
        "app_category_slug string, product_url string, searchable_text string, is_active boolean, "
        "last_synced_at timestamp_ntz, sku string, specs array<struct<key: string, value: string>>",
    )
    catalog = conform(catalog.withColumn("product_name", F.upper("product_url")), schemas.PRODUCTS, schemas.PRODUCT_DEFAULTS)
    requests = _request(spark, [
        (1, "Belt", "Fan BELT, noisy", [("from Acme", ["engine"], None)]), (2, "belt ", "fan", None), (3, "", "fan", None),
        (4, "gearbox", "fan", None),
    ])
    best = M.recommend_products(requests, catalog, "id")
    assert [(r["id"], r["position"], r["product_url"], r["score"]) for r in dicts(best, "id", "position")] == [
        (1, 1, "u1", 3), (1, 2, "u2", 2), (2, 1, "u2", 2), (2, 2, "u1", 2),
    ]
    blocks = {r["id"]: r["block"].split("\n") for r in dicts(M.render_products(best, "id", requests), "id")}
    assert blocks[1][2:] == [
        "1. U1 | SKU: N/A | Brand: N/A | Price: N/A | Availability: unknown | URL: u1 | Specs: Size: 2; Make: A",
        "2. U2 | SKU: B-2 | Brand: N/A | Price: N/A | Availability: unknown | URL: u2",
    ]
    assert blocks[3] == blocks[4] == [M.NO_PRODUCTS]


def test_similar_cases_only_learn_from_eligible(spark):
    cases = spark.createDataFrame(
        [("all", "c1", at(1), "belt slips", True), ("all", "c2", at(2), "belt slips badly", False),
         ("all", "c3", at(3), "belt", True)],
        "scope string, case_number string, updated_at timestamp_ntz, search_text string, learning_eligible boolean",
    )
    targets = M.request_words(_request(spark, [(7, "x", "The belt slips!", None)]), "id", F.lit("all"))
    got = [(r["case_number"], r["score"]) for r in dicts(M.similar_cases(targets, cases), "position")]
    assert got == [("c1", 2), ("c3", 1)]
