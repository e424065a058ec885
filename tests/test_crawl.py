"""The crawl frontier and the sync against the rule written as a loop."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.functions.text import slug
from caseloom.operators import catalog as C
from caseloom.operators import crawl
from caseloom.plans.catalog_sync import catalog_sync, run_catalog_sync
from caseloom.sources.dimensions import catalog_sources, category_hints
from caseloom.sources.tables import conform, new_path, read_snapshot
from tests.helpers import dicts

LINKS = "source_label string, page_no int, link_pos int, product_url string, has_next boolean"
NOW = "2024-06-01 00:00:00"


def walk(pages, max_pages):
    """``pages``: {page_no: (urls, has_next)}; the kept pages with their new URLs."""
    seen, kept, page = set(), [], 1
    while page in pages and not (max_pages and page > max_pages):
        urls, has_next = pages[page]
        new = [u for u in dict.fromkeys(urls) if u not in seen]
        seen |= set(new)
        kept.append((page, len(new)))
        if not urls or not new or not has_next:
            break
        page += 1
    return kept, seen


def _rows(sources):
    rows = []
    for label, pages in sources.items():
        for page, (urls, has_next) in pages.items():
            rows += [(label, page, i, u, has_next) for i, u in enumerate(urls)] or [(label, page, None, None, has_next)]
    return rows


CASES = {
    "plain": {1: (["a", "b"], True), 2: (["b", "c"], True), 3: (["d"], False), 4: (["e"], True)},
    "empty first": {1: ([], True), 2: (["a"], True)},
    "repeats only": {1: (["a"], True), 2: (["a"], True), 3: (["b"], True)},
    "gap": {1: (["a"], True), 3: (["b"], True)},
    "starts late": {2: (["a"], True), 3: (["b"], True)},
    "single": {1: (["a", "a"], False)},
}


@pytest.mark.parametrize("max_pages", [0, 1, 2])
def test_frontier(spark, max_pages):
    rng = random.Random(3)
    sources = dict(CASES)
    for i in range(40):
        sources[f"r{i}"] = {
            p: ([f"u{rng.randrange(12)}" for _ in range(rng.randrange(5))], rng.random() < 0.8)
            for p in range(1, 9) if rng.random() < 0.93
        }
    links = spark.createDataFrame(_rows(sources), LINKS)
    kept, seen = set(), set()
    for label, pages in sources.items():
        k, s = walk(pages, max_pages)
        kept |= {(label, *x) for x in k}
        seen |= {(label, u) for u in s}
    assert {tuple(r) for r in crawl.crawl_frontier(links, max_pages).collect()} == kept
    got = crawl.seen_links(links, max_pages).select("source_label", "product_url").collect()
    assert {tuple(r) for r in got} == seen


BASE, PREFIX = "https://shop.example.com", "/my/shop"


def _page(name, sku="", extra=""):
    return f"<h1>{name}</h1><b>SKU</b> <i>{sku}</i>{extra}"


@pytest.fixture
def shop(spark):
    rows = [
        ("Belt", "category", "V-Belts", "v-belts.html"),
        ("Chain", "search", "Chains", "chain"),
        ("Belt", "search", "Fan Belt", "fan belt"),
        ("Empty", "search", "Nothing", "nothing"),
        ("Gearbox", "search", "Gears", "gear"),
    ]
    sources = catalog_sources(spark, BASE + PREFIX, rows)

    def url(n):
        return f"{BASE}{PREFIX}/{n}.html"

    def listing(names, more=""):
        return "".join(f'<a class="product-item-link" href="{PREFIX}/{n}.html?x">n</a>' for n in names) + more

    listings = [
        ("V-Belts", 1, listing(["b1", "b2", "untitled", "b1"], "<p>Page 2</p>")),
        ("V-Belts", 2, listing(["b3", "alias", "motor"], "<p>Page 3</p>")),
        ("Chains", 1, listing(["c1", "b1", "lost"])),
        ("Fan Belt", 1, listing(["b2"], "Page Next")),
        ("Fan Belt", 2, listing(["b2"], "Page Next")),
        ("Nothing", 1, "<p>Page 2</p>"),
        ("Gears", 1, listing(["c1"])),
    ]
    pages = [
        (url("b1"), _page("Acme belt chain", "B-1")), (url("b2"), _page("Acme fan belt", "B-2")),
        (url("untitled"), "<p>belt</p>"), (url("b3"), _page("Big BELT")),
        # Another address of b3; the later link wins.
        (url("alias"), _page("Big belt again", "B-9", f'<link rel="canonical" href="{url("b3")}">')),
        (url("motor"), _page("Electric motor")), (url("c1"), _page("Roller chain")),
    ]
    old = [
        ("belt", url("b1"), True), ("belt", url("gone"), True), ("belt", url("off"), False),
        ("chain", url("b3"), True), ("empty", url("e1"), True), ("other", url("o1"), True),
    ]
    catalog = spark.createDataFrame(old, "app_category_slug string, product_url string, is_active boolean")
    catalog = conform(catalog, schemas.PRODUCTS, schemas.PRODUCT_DEFAULTS)
    listing_pages = spark.createDataFrame(listings, "source_label string, page_no int, html string")
    links = crawl.listing_links(listing_pages, BASE, PREFIX)
    pages = spark.createDataFrame(pages, schemas.PAGES)
    return catalog, sources, links, pages, category_hints(spark), url


def test_catalog_sync(spark, shop):
    catalog, sources, links, pages, hints, url = shop
    result = catalog_sync(catalog, sources, links, pages, hints, BASE, PREFIX, NOW)
    rows = {r["product_url"]: r for r in dicts(result.catalog, "product_url")}
    state = {u.rsplit("/", 1)[1]: (r["app_category_slug"], r["source_label"], r["is_active"]) for u, r in rows.items()}
    assert state == {
        "b1.html": ("chain", "Chains", True),  # in two categories: the later source wins
        "b2.html": ("belt", "Fan Belt", True),
        "b3.html": ("belt", "V-Belts", True),
        "c1.html": ("chain", "Chains", True),  # refused by the gearbox hints, kept from chains
        "gone.html": ("belt", None, False),
        "off.html": ("belt", None, False),
        "e1.html": ("empty", None, False),  # synced category with nothing seen
        "o1.html": ("other", None, True),  # not synced
    }
    assert rows[url("b3")]["product_name"] == "Big belt again"
    assert rows[url("b3")]["sku"] == "B-9"
    stamped = {u for u, r in rows.items() if str(r["last_synced_at"]) == NOW}
    assert stamped == set(rows) - {url("o1")}
    counts = {r["source_label"]: (r["products_seen"], r["products_upserted"]) for r in dicts(result.summary, "source_pos")}
    assert counts == {"V-Belts": (6, 3), "Chains": (3, 2), "Fan Belt": (1, 1), "Nothing": (0, 0), "Gears": (1, 0)}
    assert dicts(C.sync_totals(result.summary), "total_products_seen") == [
        {"total_products_seen": 11, "total_products_upserted": 6}
    ]


def test_sync_equals_upsert_then_reconcile(spark, shop):
    """The plan's single pass gives what the separate operators give."""
    catalog, sources, links, pages, hints, _ = shop
    result = catalog_sync(catalog, sources, links, pages, hints, BASE, PREFIX, NOW, staged=True)
    after = C.upsert_products(catalog, result.products, ["source_pos"])
    seen = result.products.select("app_category_slug", "product_url").distinct()
    after = C.deactivate_missing(after, seen, sources, NOW)
    assert dicts(result.catalog, "product_url") == dicts(after, "product_url")


def test_sync_of_chosen_categories(spark, shop):
    catalog, sources, links, pages, hints, url = shop
    result = catalog_sync(catalog, sources, links, pages, hints, BASE, PREFIX, NOW, categories=["Chain"], max_pages=1)
    active = {r["product_url"] for r in dicts(result.catalog.filter("is_active"), "product_url")}
    # b3 was a chain product the crawl did not show; belts are left alone.
    assert active == {url("b1"), url("c1"), url("gone"), url("e1"), url("o1")}


def test_sync_run_is_written(spark, shop):
    catalog, sources, links, pages, hints, _ = shop
    result = catalog_sync(catalog, sources, links, pages, hints, BASE, PREFIX, NOW, staged=True)
    root, runs_root = new_path(spark, "catalog"), new_path(spark, "runs")
    runs = spark.createDataFrame([], schemas.SYNC_RUNS)
    run_catalog_sync(result, root, 1, runs, runs_root, "run_1", "2024-05-31 23:00:00", NOW)
    assert dicts(read_snapshot(spark, root, schemas.PRODUCTS), "product_url") == dicts(result.catalog, "product_url")
    saved = read_snapshot(spark, runs_root, schemas.SYNC_RUNS)
    report = dicts(C.sync_report(saved, "nightly"), "run_id")[0]["report"].split("\n")
    assert report[2:7] == [
        "Trigger: nightly", "Started: 2024-05-31T23:00:00.000Z", "Finished: 2024-06-01T00:00:00.000Z",
        "Total products seen: 11", "Total products upserted: 6",
    ]
    assert report[9:] == [
        "- Belt: seen 6, upserted 3", "- Chain: seen 3, upserted 2", "- Belt: seen 1, upserted 1",
        "- Empty: seen 0, upserted 0", "- Gearbox: seen 1, upserted 0",
    ]


def test_deactivate_missing(spark):
    rows = [("a", "u1", True), ("a", "u2", False), ("a", "u3", True), ("b", "u4", True), ("c", "u5", True)]
    catalog = conform(
        spark.createDataFrame(rows, "app_category_slug string, product_url string, is_active boolean"), schemas.PRODUCTS
    )
    seen = spark.createDataFrame([("a", "u1"), ("b", "u3")], "app_category_slug string, product_url string")
    synced = spark.createDataFrame([("a",), ("b",), ("b",)], "app_category_slug string")
    after = {r["product_url"]: (r["is_active"], r["last_synced_at"] is not None)
             for r in dicts(C.deactivate_missing(catalog, seen, synced, NOW), "product_url")}
    assert after == {
        "u1": (True, False), "u2": (False, True), "u3": (False, True), "u4": (False, True), "u5": (True, False),
    }
    assert {r["product_url"] for r in dicts(C.missing_products(catalog, seen, synced), "product_url")} == {"u2", "u3", "u4"}


def test_default_dimensions(spark):
    sources = catalog_sources(spark, BASE)
    assert sources.count() == 12
    assert sources.filter("source_type = 'search' and url is null and query is not null").count() == 7
    hinted = {r["app_category_slug"] for r in category_hints(spark).collect()}
    assert hinted == {r[0] for r in sources.select(slug(F.col("app_category"))).distinct().collect()}
    plan = sources._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan


def test_hints_are_phrases_of_the_own_category(spark):
    """Ten thousand phrases keep the same rows as one contains per phrase, and one pattern a category."""
    rng = random.Random(8)
    hints = {"belt": [f"w{i:04} x" for i in range(10_000)], "chain": ["roller", "a.c"]}
    rows = [(f"u{i}", rng.choice(["belt", "chain", "other", None]), f"W{rng.randrange(20_000):04} {rng.choice('xy')} {rng.choice(['Roller', 'abc', 'a.c'])}") for i in range(300)]
    products = conform(spark.createDataFrame(rows, "product_url string, app_category_slug string, product_name string"), schemas.PRODUCTS)
    kept = C.filter_by_hints(products, category_hints(spark, hints))
    want = {u for u, c, t in rows if c not in hints or any(h in t.lower() for h in hints[c])}
    assert {r["product_url"] for r in kept.collect()} == want
    assert C.filter_by_hints(products, category_hints(spark, {})).count() == len(rows)
