"""The catalog sync: from listing links and stored pages to the next catalog snapshot."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.functions.urls import source_url
from caseloom.operators import catalog as C
from caseloom.operators.crawl import seen_links
from caseloom.operators.keyed import as_ntz
from caseloom.sources.dimensions import select_sources
from caseloom.sources.tables import stage, write_snapshot


@dataclass
class SyncResult:
    catalog: DataFrame
    seen: DataFrame
    products: DataFrame
    summary: DataFrame


def crawled_products(
    sources: DataFrame, seen: DataFrame, pages: DataFrame, hints: DataFrame, base: str, prefix: str, now
) -> DataFrame:
    """Catalog rows per source for the seen URLs, filtered by hints.

    Pages are reduced to their fields before anything is shuffled; HTML never travels.
    """
    records = C.drop_untitled(C.page_records(pages, base, prefix))
    found = seen.withColumnRenamed("product_url", "page_url").join(records, "page_url").join(sources, "source_label")
    latest = C.keep_last_product(found, ["source_label"], ["page_no", "link_pos"])
    return C.filter_by_hints(C.stamp_records(latest, now), hints)


def next_catalog(catalog: DataFrame, products: DataFrame, sources: DataFrame, now) -> DataFrame:
    """Catalog after writing the products and switching off what the synced categories no longer show.

    A product two sources found is taken from the later source. Stored rows stand before
    every source, so one last-per-URL pass over both is the upsert: one shuffle, and the
    extracted products are used once. What was written was seen under its own category and
    what was not written was seen under none, so reconciling only concerns the stored rows
    that came through: of those, the ones in a synced category.
    """
    stored = catalog.withColumn("source_pos", F.lit(-1))
    rows = stored.unionByName(products.select(*stored.columns))
    latest = C.keep_last_product(rows, [], ["source_pos"])
    synced = sources.select("app_category_slug", F.lit(True).alias("_synced")).distinct()
    missing = (F.col("source_pos") == -1) & F.col("_synced").isNotNull()
    return (
        latest.join(synced, "app_category_slug", "left")
        .withColumn("is_active", F.when(missing, F.lit(False)).otherwise(F.col("is_active")))
        .withColumn("last_synced_at", F.when(missing, as_ntz(now)).otherwise(F.col("last_synced_at")))
        .select(*catalog.columns)
    )


def catalog_sync(
    catalog: DataFrame, sources: DataFrame, links: DataFrame, pages: DataFrame, hints: DataFrame, base: str,
    prefix: str, now, categories: list[str] | None = None, max_pages: int = 0, staged: bool = False,
) -> SyncResult:
    """One sync run over stored pages.

    ``sources`` are ``(source_pos, app_category, app_category_slug, source_type, source_label,
    url, query)``, ``links`` ``(source_label, page_no, link_pos, product_url, has_next)`` as
    ``listing_links`` makes them, ``pages`` ``(url, html)``. With ``staged`` links, seen links and
    products are written once to the work folder, for when several outputs are used or the
    links are read off HTML.
    """
    chosen = select_sources(sources, categories)
    address = source_url(F.col("source_type"), F.col("url"), F.col("query"), base + prefix)
    chosen = chosen.withColumn("source_url", address).drop("url", "query")
    links = links.join(chosen.select("source_label"), "source_label", "left_semi")
    if staged:
        links = stage(links, "links")
    seen = seen_links(links, max_pages)
    if staged:
        seen = stage(seen, "seen")
    products = crawled_products(chosen, seen, pages, hints, base, prefix, now)
    if staged:
        products = stage(products, "products")
    return SyncResult(
        catalog=next_catalog(catalog.select(*schemas.PRODUCTS.names), products, chosen, now),
        seen=seen,
        products=products,
        summary=C.sync_summary(chosen, seen, products),
    )


def run_catalog_sync(
    result: SyncResult, catalog_root: str, version: int, runs: DataFrame, runs_root: str, run_id: str, started_at,
    finished_at,
) -> None:
    """Write the next catalog snapshot and then the run log that names the run."""
    write_snapshot(result.catalog, catalog_root, version, ["app_category_slug"])
    run = C.sync_run(result.summary, run_id, started_at, finished_at)
    write_snapshot(C.save_sync_runs(runs, run), runs_root, version)
