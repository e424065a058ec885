"""URL column expressions. The shop's base address and path prefix are arguments."""

import re
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions.text import text

# Fixed value: products asked for per listing page.
PAGE_SIZE = 72

# Characters URL component encoding leaves alone but form encoding does not.
_COMPONENT = [("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")]


# Trimmed off a raw address: control characters and spaces.
_EDGES = "".join(map(chr, range(0x21)))


# A dot segment, and a character that a path may not hold as it is.
_DOT = "(?:\\.|%2[eE])"
DOTTED = f"/{_DOT}{{1,2}}(?:/|$)"
_SAFE = "!$-;=@-_a-z|~"
UNSAFE = f"[^{_SAFE}]"
_BITS = 62  # Flags in one number.


def without_dots(path: Column) -> Column:
    """A path that starts with a slash, its dot segments resolved; more ``..`` than segments stop at the root.

    Read from the end: each ``..`` drops the next segment that is no dot segment. A fold keeps
    the number still to drop and one flag a segment, packed into numbers, so nothing is copied
    that grows with the path but one number for every 62 segments.
    """
    def kinds(segments: Column) -> Column:
        kind = lambda x: F.when(x.rlike(f"^{_DOT}$"), 1).when(x.rlike(f"^{_DOT}{_DOT}$"), 2).otherwise(0)
        return F.transform(segments, kind)

    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    start = F.struct(
        zero.alias("drop"), zero.alias("n"), zero.alias("word"), F.array().cast("array<bigint>").alias("words")
    )

    def step(state: Column, kind: Column) -> Column:
        keep = (kind == 0) & (state["drop"] == 0)
        drop = state["drop"] + F.when(kind == 2, one).when((kind == 0) & (state["drop"] > 0), -one).otherwise(zero)
        word = state["word"] + F.when(keep, F.call_function("shiftleft", one, state["n"].cast("int"))).otherwise(zero)
        full = state["n"] == _BITS - 1
        return F.struct(
            drop.alias("drop"), F.when(full, zero).otherwise(state["n"] + 1).alias("n"), F.when(full, zero).otherwise(word).alias("word"),
            F.when(full, F.array_append(state["words"], word)).otherwise(state["words"]).alias("words"),
        )

    def joined(segments: Column) -> Column:
        flags = F.aggregate(kinds(segments), start, step, lambda state: F.array_append(state["words"], state["word"]))

        def kept(words: Column) -> Column:
            place = lambda i: F.getbit(F.element_at(words, (i / _BITS).cast("int") + 1), i % _BITS) == 1
            # An address that ends in a dot segment ends in a slash.
            last = F.when(F.element_at(kinds(F.slice(segments, 1, 1)), 1) > 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
            return F.concat(F.lit("/"), F.array_join(F.reverse(F.concat(last, F.filter(segments, lambda x, i: place(i)))), "/"))

        return F.element_at(F.transform(F.array(flags), kept), 1)

    return F.element_at(F.transform(F.array(F.reverse(F.split(F.substring(path, 2, 2**31 - 1), "/"))), joined), 1)


def escape_path(path: Column) -> Column:
    """Control characters, spaces, ``" < > ` { }`` and what is not ASCII as percent escapes; escapes stay."""
    def escaped(char: Column) -> Column:
        # In hexadecimal two digits make a byte.
        return F.when(char.rlike(UNSAFE), F.regexp_replace(F.hex(F.encode(char, "UTF-8")), "(..)", "%$1")).otherwise(char)

    runs = F.regexp_extract_all(path, F.lit(f"{UNSAFE}|[{_SAFE}]+"), F.lit(0))
    return F.array_join(F.transform(runs, escaped), "")


def normalise_product_urls(hrefs: Column, base: str, prefix: str) -> Column:
    """Raw addresses of an array to product URLs; the ones that are no product path become "".

    Two path shapes count: ``<prefix>/<name>.html`` and
    ``<prefix>/catalog/product/view/id/<digits>[/...]``. Query, fragment, trailing slashes,
    user part and default port go, scheme and host are lowered, the host is not checked. As
    in a browser's address, tabs and line breaks vanish, backslashes are slashes, dot segments
    (also written ``%2e``) are resolved, and what a path may not hold is percent-escaped.

    One pass per step, so that no step's expression is repeated inside the next.
    """
    parts = urlsplit(base)
    origin = f"{parts.scheme}://{parts.netloc}".lower()
    stem = re.escape(prefix.rstrip("/"))
    shape = f"^(?i){stem}/(?:[^/?#]+\\.html|catalog/product/view/id/[0-9]+(?:/.*)?)$"

    def slashed(raw: Column) -> Column:
        """Backslashes of the path as slashes, nothing else changed behind a query or fragment."""
        path = F.regexp_extract(raw, "^[^?#]*", 0)
        return F.concat(F.translate(path, "\\", "/"), F.substring(raw, F.length(path) + 1, F.length(raw)))

    def absolute(raw: Column) -> Column:
        return (
            F.when(raw.rlike("^(?i)https?://"), raw)
            .when(raw.startswith("//"), F.concat(F.lit(parts.scheme + ":"), raw))
            .when(raw.startswith("/"), F.concat(F.lit(origin), raw))
            .when(raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*:|^$"), F.lit(""))
            .otherwise(F.concat(F.lit(origin + "/"), raw))
        )

    def halves(address: Column) -> Column:
        authority = F.lower(F.regexp_extract(address, "^(?i)https?://[^/?#]*", 0))
        path = F.regexp_extract(address, "^(?i)https?://[^/?#]*(/[^?#]*)", 1)
        authority = F.regexp_replace(authority, "//[^@]*@", "//")
        authority = F.regexp_replace(authority, "^(http://[^:]*):80$|^(https://[^:]*):443$", "$1$2")
        return F.struct(authority.alias("authority"), path.alias("path"))

    def resolved(half: Column) -> Column:
        path = F.when(half["path"].rlike(DOTTED), without_dots(half["path"])).otherwise(half["path"])
        path = F.when(path.rlike(UNSAFE), escape_path(path)).otherwise(path)
        return F.struct(half["authority"].alias("authority"), F.rtrim(path, F.lit("/")).alias("path"))

    def accepted(half: Column) -> Column:
        return F.when(half["path"].rlike(shape), F.concat(half["authority"], half["path"])).otherwise(F.lit(""))

    trimmed = F.transform(hrefs, lambda href: F.translate(F.trim(text(href), F.lit(_EDGES)), "\t\n\r", ""))
    slashes = F.transform(trimmed, lambda raw: F.when(raw.contains("\\"), slashed(raw)).otherwise(raw))
    return F.transform(F.transform(F.transform(F.transform(slashes, absolute), halves), resolved), accepted)


def normalise_product_url(c: Column, base: str, prefix: str) -> Column:
    """The same for one address."""
    return F.element_at(normalise_product_urls(F.array(c), base, prefix), 1)


def url_component(c: Column) -> Column:
    """Component encoding: as form encoding, but a space is ``%20`` and ``! ' ( ) ~`` stay."""
    out = F.url_encode(text(c))
    for form, component in _COMPONENT:
        out = F.replace(out, F.lit(form), F.lit(component))
    return out


def source_url(source_type: Column, url: Column, query: Column, root: str) -> Column:
    """Address stored with the products of a source."""
    search = F.concat(F.lit(f"{root}/catalogsearch/result/?q="), url_component(query))
    return F.when(source_type == "search", search).otherwise(url)


def listing_url(
    source_type: Column, url: Column, query: Column, page_no: Column, root: str, page_size: int = PAGE_SIZE
) -> Column:
    """Address of one listing page of a source; the page number only appears from page two on."""
    searching = source_type == "search"
    target = F.when(searching, F.lit(f"{root}/catalogsearch/result/")).otherwise(url)
    first = F.when(searching, F.concat(F.lit("?q="), F.url_encode(text(query)), F.lit("&"))).when(
        url.contains("?"), F.lit("&")
    ).otherwise(F.lit("?"))
    page = F.when(page_no > 1, F.concat(F.lit("&p="), page_no.cast("string"))).otherwise(F.lit(""))
    return F.concat(target, first, F.lit(f"product_list_limit={page_size}"), page)
