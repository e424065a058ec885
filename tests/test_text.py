"""Column transforms against hand-made edge rows."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.functions import pages as P
from caseloom.functions import records as R
from caseloom.functions import text as X
from caseloom.functions import urls as U
from tests.helpers import values

BASE, PREFIX = "https://shop.example.com", "/my/shop"


def test_slug(spark):
    given = [None, "", "  ", "--", "Electric Motor", "A & B", "für", " _x_ ", " Belt"]
    assert values(spark, X.slug, given) == [
        "other", "other", "other", "other", "electric_motor", "a_b", "f_r", "x", "belt",
    ]


def test_decode_is_ordered(spark):
    assert values(spark, X.decode_entities, ["&amp;lt;", "&quot;a&#39;", None]) == ["<", "\"a'", ""]


def test_strip_html_decodes_after_collapsing(spark):
    given = ["a&nbsp;&nbsp;b", "<b>x</b>y", "open <p", " <i>  </i>z\t\n", None]
    assert values(spark, X.strip_html, given) == ["a  b", "x y", "open <p", "z", ""]


def test_clean_texts(spark):
    assert values(spark, lambda c: X.clean_text(c, 5), ["\t a  b  c d", None, "\U0001F600" * 7]) == [
        "a b c", "", "\U0001F600" * 2,
    ]
    assert values(spark, lambda c: X.clean_large_text(c, 6), ["﻿ a\r\n b  c ", "\r\n"]) == ["a\n b  ", ""]
    assert values(spark, X.clean_path, ["\\\\a\\b//c/", "/ x /", None]) == ["a/b/c", "x", ""]


def test_tokens(spark):
    found = values(spark, X.tokens, ["The the V-belt 12 123 für übung", "", None])
    assert [sorted(t) for t in found] == [["123", "belt", "bung", "the"], [], []]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("/my/shop/a.html", f"{BASE}/my/shop/a.html"),
        ("my/shop/a.html", f"{BASE}/my/shop/a.html"),
        ("//Other.example.com:443/my/shop/a.html", "https://other.example.com/my/shop/a.html"),
        ("HTTP://user:pw@Host.example.com:80/my/shop/A.HTML?x#y", "http://host.example.com/my/shop/A.HTML"),
        ("http://host.example.com:8080/my/shop/a.html///", "http://host.example.com:8080/my/shop/a.html"),
        ("https://h.example.com/MY/Shop/a.html", "https://h.example.com/MY/Shop/a.html"),
        ("/my/shop/deep/a.html", ""),
        ("/my/shop/catalog/product/view/id/12/s/name/", f"{BASE}/my/shop/catalog/product/view/id/12/s/name"),
        ("/my/shop/catalog/product/view/id/12", f"{BASE}/my/shop/catalog/product/view/id/12"),
        ("/my/shop/catalog/product/view/id/x", ""),
        ("mailto:a@b.html", ""),
        ("?p=2", ""),
        ("#top", ""),
        (" \t/my/shop/a.html \n", f"{BASE}/my/shop/a.html"),
        ("", ""),
        (None, ""),
    ],
)
def test_product_url(spark, raw, expected):
    assert values(spark, lambda c: U.normalise_product_url(c, BASE, PREFIX), [raw]) == [expected]


def test_url_encoders(spark):
    assert values(spark, U.url_component, ["\"fan belt\"", "a!'()*~b&c"]) == ["%22fan%20belt%22", "a!'()*~b%26c"]
    root = BASE + PREFIX
    search = values(
        spark, lambda c: U.listing_url(F.lit("search"), F.lit(None).cast("string"), c, F.lit(2), root), ["\"fan belt\""]
    )
    assert search == [f"{root}/catalogsearch/result/?q=%22fan+belt%22&product_list_limit=72&p=2"]
    plain = values(spark, lambda c: U.listing_url(F.lit("category"), c, F.lit(""), F.lit(1), root), [f"{root}/b.html"])
    assert plain == [f"{root}/b.html?product_list_limit=72"]


def test_links_prefer_product_anchors(spark):
    marked = (
        '<a href="/my/shop/x.html">x</a><A title="t" class="p product-item-link q" HREF="/my/shop/y.html?a">y</A>'
        '<a class="product-item-link" href="/my/shop/y.html">y</a><a class="product-item-linked" href="/my/shop/z.html">'
    )
    no_valid = '<a class="product-item-link" href="/blog">b</a><a href="/my/shop/x.html">x</a>'
    got = values(spark, lambda c: P.product_links(c, BASE, PREFIX), [marked, no_valid, "", None])
    assert got == [[f"{BASE}/my/shop/y.html"], [f"{BASE}/my/shop/x.html"], [], []]


def test_next_page(spark):
    given = ["<b>Page</b>&nbsp;3", "Page 31", "page  3x", "Page 3é", "Page 3.", "nothing", "PAGE NEXT", "Page 03"]
    assert values(spark, lambda c: P.has_next_page(c, F.lit(2)), given) == [
        True, False, False, True, True, False, True, False,
    ]


def test_fields(spark):
    html = (
        '<meta name="description" content=" Belt &amp; more "><h1 class=x> <b>Acme</b> V&nbsp;belt</h1> price rm 1,234.50'
        '<div class="breadcrumbs"><ul><li>Home</li>&nbsp;&nbsp;<li>Belts/V</li> &gt; <li></li></ul></div><p>OUT OF STOCK</p>'
    )
    assert values(spark, P.meta_description, [html]) == ["Belt & more"]
    assert values(spark, P.title, [html, "<h1>a", None]) == ["Acme V belt", "", ""]
    assert values(spark, P.price_text, [html, "RM  5", "usd 3"]) == ["rm 1,234.50", "", ""]
    assert values(spark, P.availability, [html, "add to CART", ""]) == ["out_of_stock", "available", "unknown"]
    # A no-break space that was decoded late separates crumbs, plain spaces do not.
    assert values(spark, P.category_trail, [html, "<p>"]) == [["Home", "Belts", "V"], []]


def test_sku(spark):
    cell = "<b>SKU</b> <i> AB-12 </i>"
    in_text = "SKU: QX_77/3, in stock"
    itself = "<b>SKU</b> <i>SKU</i> then"
    assert values(spark, P.sku, [cell, in_text, itself, "none"])[:2] == ["AB-12", "QX_77/3"]
    assert values(spark, P.sku, ["none", None]) == ["", ""]
    assert values(spark, P.sku, [itself])[0].upper() != "SKU"


def test_brand(spark):
    def brand(name, sku):
        return values(spark, lambda c: P.brand(F.lit(name), c), [sku])[0]

    assert brand("Acme belt", "X-1") == "Acme"
    assert brand("V-belt Acme", "X-1-Gates") == "Gates"
    assert brand("V-belt", "") == ""
    assert brand("", "plain") == "plain"


def test_specs_last_value_first_position(spark):
    html = (
        "More Information<table class=t><tr><th>Size</th><td>1</td></tr><tr><td>Make</td><td>A&nbsp; B</td><td>c</td></tr>"
        "<tr><th>Empty</th><td></td></tr><tr><th>Size</th><td>2</td></tr><tr><td>single</td></tr></table>"
    )
    got = values(spark, P.specs, [html, "<table><tr><td>a</td><td>b</td></tr></table>"])
    assert [[tuple(p) for p in pairs] for pairs in got] == [[("Size", "2"), ("Make", "A B")], []]


def test_canonical_falls_back_to_the_page(spark):
    page = f"{BASE}/my/shop/page.html"
    given = [
        '<link rel="canonical" href="/my/shop/c.html"><meta property="og:url" content="/my/shop/o.html">',
        '<meta property="og:url" content="/my/shop/o.html">',
        '<link rel="canonical" href="/home"><meta property="og:url" content="/my/shop/o.html">',
        "",
    ]
    got = values(spark, lambda c: P.canonical_url(c, F.lit(page), BASE, PREFIX), given)
    assert got == [f"{BASE}/my/shop/c.html", f"{BASE}/my/shop/o.html", page, page]


def test_case_number_is_never_cut(spark):
    got = values(spark, lambda c: R.case_number(F.lit("V Belt"), c.cast("bigint")), ["1", "99999", "100000", "1234567"])
    assert got == ["v_belt_00001", "v_belt_99999", "v_belt_100000", "v_belt_1234567"]


def test_tolerant_json(spark):
    fallback = F.struct(F.lit(-1).alias("k"))
    got = values(spark, lambda c: R.read_json(c, "k int", fallback)["k"], ['{"k": 3}', "", None, "{bad", '{"j": 1}'])
    assert got == [3, -1, -1, -1, None]
    assert [len(v) for v in values(spark, R.parse_specs, ['{"b":"1","a":"2"}', None, "[]", "{bad"])] == [2, 0, 0, 0]


def test_usage(spark):
    given = [
        '{"input_tokens": 0, "inputTokens": 5, "output_tokens": "7"}',
        '{"total_tokens": 9, "output_tokens_details": {"reasoning_tokens": 2}}', "", "{bad", None,
    ]
    df = spark.createDataFrame([(v,) for v in given], "u string")
    read = df.select(F.from_json("u", R.USAGE_SCHEMA).alias("x"))
    rows = read.select(*[c.alias(n) for n, c in R.usage_columns(F.col("x")).items()]).collect()
    assert [tuple(r) for r in rows] == [(5, 7, 12, 0), (0, 0, 9, 2), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]


@pytest.mark.parametrize("raw, expected", [
    ("/my/shop/a/../b.html", "/my/shop/b.html"), ("../../my/shop/d.html", "/my/shop/d.html"),
    ("/x/./%2e%2E/my/shop/./c.html", "/my/shop/c.html"), ("/my/shop/é b{.html", "/my/shop/%C3%A9%20b%7B.html"),
    ("/my/shop/%41%2f.html", "/my/shop/%41%2f.html"), ("\\my\\shop\\e.html", "/my/shop/e.html"), ("/my/shop/f\n.html", "/my/shop/f.html"),
    ("/my/shop/g.html/.", "/my/shop/g.html"), ("/my/shop/h.html/..", ""), ("/" + "a/../" * 150 + "my/shop/k.html", "/my/shop/k.html"),
    ("/a" * 100 + "/.." * 100 + "/my/shop/l.html?x=../y", "/my/shop/l.html"), ("/my/shop/..../j.html", ""), ("/my/shop/m\U0001F600.html", "/my/shop/m%F0%9F%98%80.html"),
])
def test_addresses_are_resolved(spark, raw, expected):
    origin = BASE.rstrip("/")
    got = values(spark, lambda c: U.normalise_product_url(c, BASE, PREFIX), [raw])
    assert got == [origin + expected if expected else ""]


def test_code_units(spark):
    given = ["ab\U0001F600cd", "\U0001F600\U0001F600", "abcd", "", None, "a\U0001F600", "é" * 4]
    assert values(spark, X.code_units, given) == [6, 4, 4, 0, None, 3, 4]
    assert values(spark, lambda c: X.cut(c, 3), given) == ["ab", "\U0001F600", "abc", "", None, "a\U0001F600", "ééé"]
    assert values(spark, lambda c: X.clean_text(c, 2), given) == ["ab", "\U0001F600", "ab", "", "", "a", "éé"]


def test_any_phrase(spark):
    rng = random.Random(3)
    phrases = ["".join(rng.choices("ab c.-(]^\\é$", k=rng.randint(1, 5))) for _ in range(60)]
    texts = ["".join(rng.choices("abcd .-(]^\\é$", k=rng.randint(0, 12))) for _ in range(400)]
    for some in (phrases[:1], phrases[:4], phrases[:12], ["belt", "bel", "be lt", "x]y", "a-z"], [""]):
        got = values(spark, lambda c: c.rlike(X.any_phrase(some)), texts + some)  # noqa: B023
        assert got == [any(p in t for p in some) for t in texts + some]
