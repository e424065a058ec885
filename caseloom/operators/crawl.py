"""From listing pages to the product URLs a source has shown."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.pages import has_next_page, product_links
from caseloom.functions.urls import listing_url


def listing_urls(sources: DataFrame, pages: int, root: str) -> DataFrame:
    """Addresses of the first ``pages`` listing pages of every source."""
    numbered = sources.withColumn("page_no", F.explode(F.sequence(F.lit(1), F.lit(pages))))
    address = listing_url(F.col("source_type"), F.col("url"), F.col("query"), F.col("page_no"), root)
    return numbered.withColumn("listing_url", address)


def extract_links(pages: DataFrame, base: str, prefix: str, keys: list[str]) -> DataFrame:
    """One row per distinct product URL of a page, with its position; a page without any keeps one NULL row."""
    found = F.posexplode_outer(product_links(F.col("html"), base, prefix)).alias("link_pos", "product_url")
    return pages.select(*keys, found)


def listing_links(listing_pages: DataFrame, base: str, prefix: str) -> DataFrame:
    """Links of listing pages ``(source_label, page_no, html)`` with the next-page flag; one scan, no shuffle."""
    flagged = listing_pages.withColumn("has_next", has_next_page(F.col("html"), F.col("page_no")))
    return extract_links(flagged, base, prefix, ["source_label", "page_no", "has_next"])


def first_seen(links: DataFrame) -> DataFrame:
    """Distinct URLs per source with the page and position that showed them first.

    Page and position travel as one number, which the hash aggregate can hold.
    """
    place = F.shiftleft(F.col("page_no").cast("bigint"), 32) + F.col("link_pos")
    return (
        links.filter(F.col("product_url").isNotNull())
        .groupBy("source_label", "product_url")
        .agg(F.min(place).alias("_place"))
        .select(
            "source_label", "product_url", F.shiftright("_place", 32).cast("int").alias("page_no"),
            F.col("_place").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("link_pos"),
        )
    )


def _page_flags(links: DataFrame, firsts: DataFrame) -> DataFrame:
    """Per listing page: whether it and its successor are present, its next flag and its count of new URLs.

    Each link row speaks for its page and, one page back, for that page having a
    successor, so gaps show without a window over all pages of a source.
    """
    nothing = F.lit(None).cast("boolean")
    speaks = F.array(
        F.struct(F.col("page_no"), F.lit(True).alias("present"), nothing.alias("followed"), F.col("has_next")),
        F.struct(
            (F.col("page_no") - 1).alias("page_no"), nothing.alias("present"), F.lit(True).alias("followed"),
            nothing.alias("has_next"),
        ),
    )
    flags = links.select("source_label", F.explode(speaks).alias("f")).select(
        "source_label", "f.*", F.lit(0).cast("bigint").alias("new_links")
    )
    news = firsts.select(
        "source_label", "page_no", nothing.alias("present"), nothing.alias("followed"), nothing.alias("has_next"),
        F.lit(1).cast("bigint").alias("new_links"),
    )
    return (
        flags.unionByName(news)
        .groupBy("source_label", "page_no")
        .agg(
            F.max("present").alias("present"),
            F.coalesce(F.max("followed"), F.lit(False)).alias("followed"),
            F.coalesce(F.max("has_next"), F.lit(False)).alias("has_next"),
            F.sum("new_links").alias("new_links"),
        )
        .filter("present")
    )


def _last_pages(flags: DataFrame, max_pages: int) -> DataFrame:
    """The page each source's crawl ends with: the first that brings nothing new, leads nowhere or meets the cap."""
    stop = (F.col("new_links") == 0) | ~F.col("has_next") | ~F.col("followed")
    if max_pages > 0:
        stop = stop | (F.col("page_no") >= max_pages)
    return (
        flags.groupBy("source_label")
        .agg(
            F.min(F.when(stop, F.col("page_no"))).alias("last_page"),
            F.min("page_no").alias("_from"),
        )
        .filter("_from <= 1")
        .drop("_from")
    )


def crawl_frontier(links: DataFrame, max_pages: int = 0) -> DataFrame:
    """Listing pages of each source that count, with their number of new URLs.

    Pages are taken in order from page one up to and including the first page that shows
    no unseen product, has no next page, is the last one stored, or reaches ``max_pages``
    (0 = no cap).
    """
    flags = _page_flags(links, first_seen(links))
    ends = _last_pages(flags, max_pages)
    return (
        flags.join(ends, "source_label")
        .filter(F.col("page_no") <= F.col("last_page"))
        .select("source_label", "page_no", "new_links")
    )


def seen_links(links: DataFrame, max_pages: int = 0) -> DataFrame:
    """Distinct URLs per source within its crawl frontier.

    Counted pages are a prefix, so a URL is in exactly when its first page is.
    """
    firsts = first_seen(links)
    ends = _last_pages(_page_flags(links, firsts), max_pages)
    return firsts.join(ends, "source_label").filter(F.col("page_no") <= F.col("last_page")).drop("last_page")
