"""Column expressions over one page's HTML.

The patterns are fixed values: they decide which text counts as which field.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions.text import WS, decode_entities, js_trim, let, or_default, squash, strip_html, text
from caseloom.functions.urls import normalise_product_urls

# ASCII word boundaries; Java's \b also counts accented letters as word characters.
_START, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

PRODUCT_ANCHOR = f'(?i)<a{_END}[^>]*class="[^"]*{_START}product-item-link{_END}[^"]*"[^>]*>'
ANCHOR_HREF = f'(?i){_START}href="([^"]+)"'
ANY_HREF = '(?i)href="([^"]+)"'
PAGE_NUMBER = f"(?i)Page[{WS}]+([0-9]+){_END}"
META_DESCRIPTION = f'(?i)<meta[{WS}]+name="description"[{WS}]+content="([^"]+)"'
HEADING = r"(?i)<h1[^>]*>([\s\S]*?)</h1>"
PRICE = f"(?i)RM[{WS}]?[0-9,]+(?:\\.[0-9]{{2}})?"
SKU_CELL = f"(?i)SKU[\\s\\S]{{0,120}}?</[^>]+>[{WS}]*<[^>]+>([\\s\\S]*?)</[^>]+>"
SKU_CODE = r"(?i)SKU[\s\S]{0,120}?([A-Z0-9][A-Z0-9\-./_ ]{2,})"
SPEC_TABLE = r"(?i)More Information[\s\S]*?<table[^>]*>([\s\S]*?)</table>"
SPEC_ROW = r"(?i)<tr[^>]*>([\s\S]*?)</tr>"
SPEC_CELL = r"(?i)<t[dh][^>]*>([\s\S]*?)</t[dh]>"
# Starts behind the list's own tag, so that tag's text is no crumb.
BREADCRUMBS = r'(?i)class="breadcrumbs?[^>]*>([\s\S]*?)</ul>'
CANONICAL = '(?i)<link[^>]+rel="canonical"[^>]+href="([^"]+)"'
OG_URL = '(?i)property="og:url" content="([^"]+)"'


def _first(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text(html), pattern, group)


def _all(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text(html), F.lit(pattern), F.lit(group))


def _product_urls(hrefs: Column, base: str, prefix: str) -> Column:
    # Most links of a page lead elsewhere; one look drops those before anything is resolved.
    likely = F.filter(hrefs, lambda href: href.rlike(r"(?i)\.html|/catalog/product/view/id/"))
    urls = normalise_product_urls(likely, base, prefix)
    return F.array_distinct(F.filter(urls, lambda url: url != ""))


def product_links(html: Column, base: str, prefix: str) -> Column:
    """Distinct product URLs of a page: those of product anchors, or of any href when no anchor has one."""
    anchors = F.transform(_all(html, PRODUCT_ANCHOR, 0), lambda a: F.regexp_extract(a, ANCHOR_HREF, 1))
    every = _product_urls(_all(html, ANY_HREF), base, prefix)
    return let(_product_urls(anchors, base, prefix), lambda marked: F.when(F.size(marked) > 0, marked).otherwise(every))


def has_next_page(html: Column, page_no: Column) -> Column:
    """Whether the text names page ``page_no + 1`` or carries the pager's next label.

    All page numbers are pulled with one constant pattern, which is compiled once;
    a pattern built per row would be compiled per row.
    """
    following = (page_no + 1).cast("string")
    return let(
        strip_html(html),
        lambda shown: F.array_contains(_all(shown, PAGE_NUMBER), following) | shown.rlike("(?i)Page Next"),
    )


def meta_description(html: Column) -> Column:
    return js_trim(decode_entities(_first(html, META_DESCRIPTION)))


def title(html: Column) -> Column:
    return strip_html(_first(html, HEADING))


def price_text(html: Column) -> Column:
    return squash(_first(html, PRICE, 0))


def sku(html: Column) -> Column:
    """The cell behind the label, else the first code near it; the label itself is refused."""
    def usable(pattern: str) -> Column:
        return let(
            squash(strip_html(_first(html, pattern))),
            lambda value: F.when((value != "") & (F.upper(value) != "SKU"), value),
        )

    return F.coalesce(usable(SKU_CELL), usable(SKU_CODE), F.lit(""))


def specs(html: Column) -> Column:
    """Key/value pairs of the "More Information" table: last value wins, first position stays."""
    def pair(cells: Column) -> Column:
        return F.struct(
            squash(strip_html(F.get(cells, F.lit(0)))).alias("key"),
            squash(strip_html(F.get(cells, F.lit(1)))).alias("value"),
        )

    def settled(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
        return F.transform(
            keys,
            lambda k: F.struct(
                k.alias("key"),
                F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value"),
            ),
        )

    rows = F.transform(_all(_first(html, SPEC_TABLE), SPEC_ROW), lambda row: _all(row, SPEC_CELL))
    pairs = F.filter(F.transform(rows, pair), lambda p: (p["key"] != "") & (p["value"] != ""))
    return let(pairs, settled)


def availability(html: Column) -> Column:
    return (
        F.when(text(html).rlike("(?i)Add to Cart"), "available")
        .when(text(html).rlike("(?i)Out of stock"), "out_of_stock")
        .otherwise("unknown")
    )


def brand(name: Column, code: Column) -> Column:
    """First word of the title if purely ASCII letters and digits, else the last ``-`` part of the SKU."""
    word = F.get(F.split(squash(name), " "), F.lit(0))
    return F.when(word.rlike("^[A-Za-z0-9]+$"), word).otherwise(F.element_at(F.split(js_trim(code), "-"), -1))


def category_trail(html: Column) -> Column:
    crumbs = F.split(strip_html(_first(html, BREADCRUMBS)), f"[{WS}]{{2,}}|/|>")
    return F.filter(F.transform(crumbs, js_trim), lambda crumb: crumb != "")


def canonical_url(html: Column, page_url: Column, base: str, prefix: str) -> Column:
    """Canonical link, else og:url, else the page's own URL; a chosen value that is no product falls to the last."""
    chosen = or_default(_first(html, CANONICAL), or_default(_first(html, OG_URL), text(page_url)))
    usable = F.filter(normalise_product_urls(F.array(chosen, page_url), base, prefix), lambda url: url != "")
    return F.coalesce(F.get(usable, F.lit(0)), F.lit(""))
