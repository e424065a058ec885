"""Operators over the whole corpus, against brute force."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import bloom_cascade, components, edit_embedding, ngram_join, permutation_index, shingles, sketch, temperature_mixing
from caseloom.sources.tables import collected
from tests.llm.cases import awkward_docs, empty_docs, near_copies, rows_of


def _vectors(spark, rows):
    rows = [(*r, None)[:3] for r in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(permutation_index, "SHARD", 200)
    monkeypatch.setattr(permutation_index, "BLOCK", 7)
    rng = np.random.default_rng(2)
    points = rng.normal(size=(900, 16)).astype("f4")
    points[300:] = points[rng.integers(0, 300, 600)] + rng.normal(size=(600, 16)).astype("f4") * 0.3
    points[700:850] = points[5]  # A vector that many rows share.
    rows = [(i, v.tolist(), "x") for i, v in enumerate(points)]
    odd = [(2000, None, ""), (2050, [0.0] * 16, ""), (2100, [float("nan")] * 16, ""), (2150, [None] * 16, ""), (2200, [1.0] * 3, ""), (None, [1.0] * 16, ""), (2250, [], "")]
    found = defaultdict(list)
    for r in permutation_index.search(_vectors(spark, rows + odd + rows[:3]), F.col("vec_id") % 50 == 0).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    unit = points.astype("f8") / np.linalg.norm(points.astype("f8"), axis=1, keepdims=True)
    assert set(found) == set(range(0, 900, 50))
    hits = 0
    for q, got in found.items():
        got.sort()
        cosine = unit @ unit[q]
        cosine[q] = -9
        assert [g[0] for g in got] == [1, 2, 3, 4, 5] and all(abs(cosine[v] - s) < 1e-9 for _, v, s in got)
        hits += sum(s >= np.sort(cosine)[-5] - 1e-9 for _, _, s in got)
    assert hits >= 0.9 * 5 * len(found)
    assert [v for _, v, _ in found[700]] == [5, 701, 702, 703, 704]
    assert permutation_index.search(_vectors(spark, odd), F.lit(True)).count() == 0
    few = _vectors(spark, [(0, [1.0, 0.0], ""), (1, [1.0, 1.0], "")])
    assert [(r.query_id, r.vec_id) for r in permutation_index.search(few, F.col("vec_id") == 0).collect()] == [(0, 1)]


def _pages(spark, urls):
    return spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, keys int")


@pytest.mark.parametrize("most_bytes", [bloom_cascade.MOST_BYTES, 400])
def test_cascade_is_exact(spark, monkeypatch, most_bytes):
    """Every listed key and no other, in one part or several."""
    monkeypatch.setattr(bloom_cascade, "MOST_BYTES", most_bytes)
    rng = random.Random(3)
    hosts = [f"h{i}.example.{rng.choice(['com', 'net'])}" for i in range(800)]
    listed = [h for h in hosts if rng.random() < 0.3]
    rules = spark.createDataFrame([("block", h, "/") for h in listed], "action string, host string, path string")
    judged = bloom_cascade.judge(_pages(spark, [f"https://{h}/x" for h in hosts]), rules)
    assert {r.host for r in judged.where("verdict = 'block'").collect()} == set(listed)
    assert {r.host for r in judged.where("rule is not null").collect()} == set(listed)


def test_rules(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "a.b", ""), ("block", "twice", "/"), ("allow", "twice", "/")]
    urls = {
        "http://X.Example.NET/en/1?q": ("example.net/en/", "allow"), "http://example.net/de": ("net/", "block"), "http://net?x=/": (None, "allow"),
        "http://c.a.b": ("a.b", "block"), "http://ca.b/": (None, "allow"), "no scheme/net/": (None, "allow"), "ftp://twice/": ("twice/", "block"), "://": (None, "allow"),
    }
    frame = spark.createDataFrame(rules, "action string, host string, path string")
    judged = bloom_cascade.judge(_pages(spark, [*urls, None, *urls]), frame).collect()
    assert len(judged) == 2 * len(urls) + 1
    for r in judged:
        url = [*urls, None, *urls][r.page_id]
        assert (r.rule, r.verdict) == urls.get(url, (None, "allow")), url
    assert [(r.host, r.path) for r in judged if r.page_id == 0] == [("x.example.net", "/en/1")]
    assert bloom_cascade.judge(_pages(spark, ["http://net/"]), frame.limit(0)).first().verdict == "allow"
    assert bloom_cascade.judge(_pages(spark, []), frame).count() == 0


def _sets(texts, words):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    import re

    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        out.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def _classes(texts, words, percent):
    sets, root = _sets(texts, words), list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return {(i, len(sets[i]), root[i]) for i in range(len(texts))}


@pytest.mark.parametrize("tile", [256, 8])
@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard_components(spark, monkeypatch, tile, words, percent):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "STRIP", 16)
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r) for r in ngram_join.jaccard_components(docs, words, percent).collect()}
    assert got == _classes(texts, words, percent)


def test_jaccard_awkward(spark):
    got = rows_of(ngram_join.jaccard_components(awkward_docs(spark)))
    assert len(got) == 15 and (None, 3, None) in got and (None, 0, None) in got
    assert [r for r in got if r[0] == 5].count((5, 1, 5)) == 3 and (0, 0, 0) in got and (3, 0, 3) in got
    assert ngram_join.jaccard_components(empty_docs(spark)).count() == 0


def test_jaccard_set_first_met_without_an_id(spark):
    base = [f"w{i}" for i in range(60)]
    text, near = " ".join(base), " ".join([*base[:-1], "other"])
    rows = [(None, text), (7, text), (3, near), (None, near + " x"), (9, "quite another text of six words")]
    got = rows_of(ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)))
    assert got == [(None, 58, 3), (None, 59, None), (3, 58, 3), (7, 58, 3), (9, 4, 9)]


def test_rows_of_large_groups_are_in_few_tiles(spark):
    """Bitmaps are compared in wide tiles: a row is copied the less often; every pair still meets."""
    nodes = spark.range(4000).selectExpr("id", "300L as n", "7L as root")
    placed = [set(r.tiles) for r in ngram_join._in_tiles(nodes, 80, ngram_join.WIDE).select("tiles").collect()]
    assert len(placed) == 4000 and max(map(len, placed)) <= 5
    assert all(placed[i] & placed[j] for i in range(0, 4000, 97) for j in range(0, 4000, 89))
    long = nodes.withColumn("n", F.lit(ngram_join.VOLUME // 100))  # Long sets: as narrow as before.
    assert min(len(r.tiles) for r in ngram_join._in_tiles(long, 80, ngram_join.WIDE).select("tiles").collect()) > 20


@pytest.mark.parametrize("percent", [50, 74, 75, 80, 90, 99])
def test_linked_sets_share_a_first_block(percent):
    rng = np.random.default_rng(percent)
    flat, classes = np.full(sketch.CELLS, 9, np.uint16), ngram_join.Classes(percent, 12)
    flat[rng.integers(0, sketch.CELLS, sketch.CELLS // 4)] = 12
    linked = 0
    for n in [*range(1, 40), *rng.integers(40, 2000, 60).tolist()]:
        base = rng.integers(0, 2**64, 4 * n + 9, dtype=np.uint64)
        own = np.sort(base[:n])
        most = 100 * n // percent
        for size, kept in ((most, n), (n, -(-2 * n * percent // (100 + percent))), (-(-n * percent // 100), -(-n * percent // 100)), ((n + most) // 2, -(-(n + (n + most) // 2) * percent // (100 + percent)))):
            other = np.sort(np.concatenate([base[n - kept : n], base[n : n + size - kept]]))
            if 100 * kept >= percent * (n + size - kept) and kept < max(n, size):
                linked += 1
                assert np.intersect1d(*(ngram_join.rare_first(x, flat, classes) for x in (own, other))).size, (n, size, kept)
    assert linked > 50


def test_few_sets_are_chained_when_the_sketch_is_full():
    """The sketch tells nothing once all cells are full: sets that share single n-grams with many others are still not chained."""
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**64, 40_000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, 200)) for _ in range(2000)]  # Each n-gram is in ten of them.
    flat = np.full(sketch.CELLS, 500, np.uint16)
    for percent, most in ((80, 200), (90, 10)):
        blocks, counts = np.unique(np.concatenate([ngram_join.rare_first(s, flat, ngram_join.Classes(percent)) for s in sets]), return_counts=True)
        assert (counts - 1).sum() <= most


def test_survivors_of_bitmaps_hold_all_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**62, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 400 - k], rng.integers(0, 2**62, k).astype(np.uint64)])) for k in [0, 5, 10, 20, 150, 390] * 3]
    bits, sizes = [ngram_join.parity_bits(s) for s in sets], np.array([len(s) for s in sets])
    forest = ngram_join.tile_survivors(np.arange(len(sets)) + 100, sizes, bits, 80)
    reached = {100}
    for _ in sets:
        reached |= {y for pair in forest for y in pair if reached & set(pair)}
    assert {100 + i for i in range(len(sets)) if i % 6 < 4} <= reached and len(forest) < len(sets)


def test_sketch_counts_every_row(spark):
    texts = near_copies()
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(70)
    counts = sketch.document_frequencies(docs, lambda t: shingles.shingle_hashes(t.encode(), 2))
    assert counts.sum() == sum(len(s) for s in _sets(texts, 2))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (300, 200), (200, 300), (250, 300)]
    frame = spark.createDataFrame(edges, "a long, b long")
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {200: 200, 250: 200, 300: 200}
    assert {r.node: r.root for r in components.connected_components(frame).collect()} == want
    assert components.connected_components(frame.limit(0)).count() == 0


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(temperature_mixing, "BLOCK", 10)
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 40), "hot" if i % 3 == 0 else None if i % 7 == 0 else f"s{i % 5}") for i in range(400)] + [(900, "", "s1"), (901, None, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("pass", F.lit("x"))
    size = {i: len((t or "").split()) for i, t, _ in rows}
    tokens = defaultdict(int)
    for i, _, s in rows:
        tokens[s] += size[i]
    placed = temperature_mixing.mixture(docs, repetition_limit=1.5).collect()
    mixed, seen = defaultdict(int), defaultdict(list)
    for r in placed:
        mixed[r.source] += r.n_tokens
        seen[r.source, r["pass"]].append(r.doc_id)
    assert all(len(ids) == len(set(ids)) for ids in seen.values())
    assert {i for (_, p), ids in seen.items() if p == 0 for i in ids} == {i for i, _, _ in rows}
    high = max(tokens.values())
    exponent = 1 - math.log(1.5) / math.log(high / min(tokens.values()))
    for s, t in tokens.items():
        quota = high * (t / high) ** exponent
        assert quota - 2 <= mixed[s] <= quota + 41
    drawn = temperature_mixing.mixture(docs, target_entropy=1.2, budget=3000.0).groupBy("source").agg(F.sum("n_tokens")).collect()
    share = np.array([r[1] for r in drawn if r[1]]) / sum(r[1] for r in drawn)
    assert abs(-(share * np.log(share)).sum() - 1.2) < 0.08
    copies = temperature_mixing.realise(docs, repetition_limit=1.5)
    assert copies.columns == docs.columns and copies.count() == len(placed)
    assert temperature_mixing.realise(awkward_docs(spark)).count() == 15 and temperature_mixing.mixture(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("budget", [None, 40, 95, 300])
def test_realised_rows_are_the_mixture(spark, monkeypatch, budget):
    """Blocks taken whole and blocks that a quota cuts; equal rows, rows without words; texts are not staged."""
    monkeypatch.setattr(temperature_mixing, "BLOCK", 3)
    rows = [(i, "a b " * (i % 4), "s" if i % 5 else None) for i in range(40)] + [(1, "a b ", "s")] * 7 + [(2, "a b a b ", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = temperature_mixing.mixture(docs, repetition_limit=3.0 if budget is None else None, budget=budget)
    with collected() as made:
        got = temperature_mixing.realise(docs, repetition_limit=3.0 if budget is None else None, budget=budget)
    assert rows_of(got, "doc_id", "source") == rows_of(want, "doc_id", "source")
    assert made and not any({"r", "text"} & set(spark.read.parquet(path).columns) for path in made)


def test_fingerprints(spark):
    docs = awkward_docs(spark)
    rows = sorted(docs.collect(), key=lambda r: (-(r.doc_id if r.doc_id is not None else -9), r.text or ""))
    want = []
    for r, after in zip(rows, rows[1:] + rows[:1]):
        a, b = r.text or "", after.text or ""
        edited = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        f, g, h = edit_embedding.fingerprints([a, edited, b])
        want.append((r.doc_id, len(a), hashlib.sha256(edited.encode()).hexdigest(), str(f), str(g), f.likeness(g), f.likeness(h)))
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert rows_of(edit_embedding.with_edited(docs)) == sorted(want, key=key)
    assert edit_embedding.with_edited(empty_docs(spark)).count() == 0
    assert edit_embedding.with_edited(docs.where("doc_id = 4")).first().near_next == 1.0


def test_likeness_falls_with_edits():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    means = []
    for rate in (0, 0.002, 0.02, 0.3):
        edited = ["".join(c if rng.random() >= rate else rng.choice(["", "x", c + "y"]) for c in text) for _ in range(8)]
        own, *others = edit_embedding.fingerprints([text, *edited])
        means.append(np.mean([own.likeness(o) for o in others]))
    assert means[0] == 1.0 and means[0] > means[1] > means[2] > means[3] and means[1] > 0.7 and means[3] < 0.5
    assert edit_embedding.Print.parse(str(own)).likeness(own) == 1.0


def test_near_copies(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(12):
        base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(2500))
        texts += [base, base[:2400] + "changed tail", base, base[:2000] + "Q" + base[2001:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in edit_embedding.near_copies(docs).collect()}
    assert len(got) == 48 and sum(got[i] == i - i % 4 for i in got) >= 46 and all(c % 4 == 0 or got[i] == i for i, c in got.items())


def test_classes_of_near_copies_are_in_the_rows(spark):
    """Also those of short texts, and of copies that are no neighbours."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    bases = [word(28) for _ in range(10)] + [word(1500) for _ in range(10)]
    rows = [(i, b) for i, b in enumerate(bases)] + [(100 + i, b[:-1] + "Z") for i, b in enumerate(bases)] + [(200, ""), (201, None), (None, bases[0])]
    rows += [(5, bases[15]), (50, "an id used twice"), (50, bases[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = edit_embedding.with_classes(docs).collect()
    assert len(got) == len(rows) and [r.class_id for r in got if r.doc_id is None] == [None]
    assert sum(r.class_id == r.doc_id - 100 for r in got if r.doc_id is not None and 100 <= r.doc_id < 200 and r.doc_id != 115) >= 17
    assert {r.class_id for r in got if r.doc_id in (200, 201)} == {200}
    assert sorted(r.class_id for r in got if r.doc_id == 50) == [3, 50] and sorted(r.class_id for r in got if r.doc_id == 5) == [5, 5]
    assert edit_embedding.with_classes(empty_docs(spark)).count() == edit_embedding.near_copies(empty_docs(spark)).count() == 0


def test_pairs_alike_are_those_of_the_likeness():
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(600))
    texts = ["", "a", "ab"] + [base[: rng.randint(1, 600)] for _ in range(20)] + ["".join(c if rng.random() > 0.02 else "x" for c in base) for _ in range(20)]
    prints = edit_embedding.fingerprints(texts)
    want = {frozenset((i, j)) for i in range(len(texts)) for j in range(i) if prints[i].likeness(prints[j]) >= 0.8}
    assert {frozenset(p) for p in edit_embedding.alike(prints, 0.8).tolist()} == want
    assert all(10 * min(prints[i].ticks, prints[j].ticks) >= 6 * max(prints[i].ticks, prints[j].ticks) for i, j in map(tuple, want))


def test_rows_are_in_tiles_of_a_class_only_where_sizes_can_link(spark):
    sizes = [int(50 * 1.012**i) for i in range(600)]
    nodes = spark.createDataFrame([(i, n, 1) for i, n in enumerate(sizes)], "id long, n long, root long")
    placed = {r.id: set(r.tiles) for r in ngram_join._in_tiles(nodes, 60, 400).collect()}
    assert all(placed[i] & placed[j] for i, n in enumerate(sizes) for j in range(i) if 10 * sizes[j] >= 6 * n)
    # A class spans two steps of 1 / t: no row can link with the class above and the one below.
    assert len(placed) == 600 and max(len({c for t in tiles for c in t.split(":")[1:3]}) for tiles in placed.values()) == 2


def test_sketches_rule_out_no_pair_that_is_alike():
    rng = np.random.default_rng(4)
    texts = ["", "a", "b", "ab", "the same " * 7, "the same " * 8]
    for size in (3, 30, 400, 2000):
        for _ in range(12):
            text = "".join(rng.choice(list("abcdefgh rst"), int(size * rng.uniform(0.5, 1.5)) + 1))
            cut = int(rng.integers(len(text)))
            texts += [text, text[:cut] + "zz" + text[cut + int(rng.integers(9)) :], text[: int(len(text) * rng.uniform(0.7, 1)) + 1]]
    prints = edit_embedding.fingerprints(texts)
    assert [str(edit_embedding.Print.unpack(p.ticks, p.packed())) for p in prints] == list(map(str, prints))

    def groups(pairs):
        root = list(range(len(texts)))
        for a, b in pairs:
            root = [root[a] if r == root[b] else r for r in root]
        return root

    for least in (0.6, 0.8, 0.95):
        pairs = edit_embedding.alike(prints, least).tolist()
        left = groups(edit_embedding.thinned(np.array([p.ticks for p in prints]), edit_embedding.sketches(prints), least))
        assert len(pairs) > 20 and all(left[a] == left[b] for a, b in pairs)
        assert least < 0.8 or len(set(left)) > len(texts) // 4  # Other texts are told apart by a few words for each, so fingerprints are not copied to tiles.
        found, want = (groups(x) for x in (edit_embedding.alike_forest(prints, least), pairs))
        assert len({*zip(found, want)}) == len(set(found)) == len(set(want))


def test_mixing_targets_out_of_reach(spark):
    """An error instead of a plan; a narrow but reachable pair of targets is met."""
    sources = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, tokens long")
    solve = temperature_mixing.solve_exponent
    for targets in ({"target_entropy": 0.05, "repetition_limit": 1.5}, {"target_entropy": -1.0}, {"repetition_limit": 0.5}):
        with pytest.raises(ValueError):
            solve(sources, **targets)
    exponent = solve(sources, target_entropy=0.33, repetition_limit=2.0)
    power = [(t / 1110) ** exponent for t in (1000, 100, 10)]
    weights = [p / sum(power) for p in power]
    repeats = [w / t for w, t in zip(weights, (1000, 100, 10))]
    assert -sum(w * math.log(w) for w in weights) <= 0.33 + 1e-6 and max(repeats) / min(repeats) <= 2 + 1e-6


def test_ties_go_to_the_smaller_id(spark):
    """Many multiples of one vector tie; copies of a third of all rows and a group above the share are searched."""
    rng = np.random.default_rng(12)
    line = [(i, ((1 + i % 37) * np.array([1.0, 2.0, 3.0, 0.5])).tolist()) for i in range(0, 400, 2)]
    rest = [(1001 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))]
    got = permutation_index.search(_vectors(spark, line + rest), F.col("vec_id") % 50 == 0).where("query_id < 400").collect()
    for r in got:
        first = [i for i, _ in line if i != r.query_id][:5]
        assert r.vec_id == first[r["rank"] - 1] or abs(r.score - 1) > 1e-12


def test_recall_where_near_copies_exceed_the_share(spark, monkeypatch):
    """Half of the rows are near copies of one vector; few of a shard's vectors are reranked."""
    monkeypatch.setattr(permutation_index, "SHARD", 1500)
    rng = np.random.default_rng(13)
    centre = rng.normal(size=24)
    rows = np.concatenate([centre + 0.05 * rng.normal(size=(1500, 24)), rng.normal(size=(40, 24)).repeat(40, 0)[:1500] + 0.4 * rng.normal(size=(1500, 24))])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    got = permutation_index.search(_vectors(spark, [(i, v.tolist()) for i, v in enumerate(rows)]), F.col("vec_id") % 50 == 0).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, 3000, 50):
        near = unit @ unit[q]
        near[q] = -2
        hit += len(set(np.argsort(-near)[:5].tolist()) & found[q])
    assert hit / 300 >= 0.9
