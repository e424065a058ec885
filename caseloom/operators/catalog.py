"""Product records and the catalog table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.functions import pages as P
from caseloom.functions.records import parse_specs
from caseloom.functions.text import any_phrase, classifier_text, or_default, product_search_text, slug
from caseloom.operators.keyed import as_ntz, keep_last, upsert


def page_records(pages: DataFrame, base: str, prefix: str, keep: list[str] | None = None) -> DataFrame:
    """Every product field of a page in one scan: ``(page_url, product_url, product_name, sku, ...)``."""
    html, url = F.col("html"), F.col("url")
    fields = pages.select(
        *(keep or []),
        url.alias("page_url"),
        P.canonical_url(html, url, base, prefix).alias("product_url"),
        P.title(html).alias("product_name"),
        P.sku(html).alias("sku"),
        P.price_text(html).alias("price_text"),
        P.availability(html).alias("availability"),
        P.meta_description(html).alias("short_description"),
        P.specs(html).alias("specs"),
        P.category_trail(html).alias("category_trail"),
    )
    named = fields.withColumn("brand", P.brand(F.col("product_name"), F.col("sku")))
    return named.withColumn(
        "product_slug", slug(or_default(F.col("product_name"), or_default(F.col("sku"), F.col("page_url"))))
    )


def drop_untitled(records: DataFrame) -> DataFrame:
    """Pages without a title yield no product."""
    return records.filter(F.col("product_name") != "")


def stamp_records(records: DataFrame, now) -> DataFrame:
    """Complete page records joined to their source into catalog rows."""
    moment = as_ntz(now)
    text = product_search_text(
        F.col("app_category"), F.col("source_label"), F.col("product_name"), F.col("sku"), F.col("brand"),
        F.col("short_description"), F.col("specs"),
    )
    return (
        records.withColumn("app_category_slug", slug(F.col("app_category")))
        .withColumn("currency", F.lit("MYR"))
        .withColumn("searchable_text", text)
        .withColumn("is_active", F.lit(True))
        .withColumn("source_updated_at", moment)
        .withColumn("last_synced_at", moment)
    )


def extract_products(pages: DataFrame, sources: DataFrame, base: str, prefix: str, now) -> DataFrame:
    """One catalog row per titled page ``(source_label, url, html)``."""
    records = drop_untitled(page_records(pages, base, prefix, keep=["source_label"]))
    return stamp_records(records.join(sources, "source_label"), now).select(*schemas.PRODUCTS.names)


def active_products(catalog: DataFrame, category_slug: str) -> DataFrame:
    return catalog.filter((F.col("app_category_slug") == category_slug) & F.col("is_active"))


def filter_by_hints(products: DataFrame, hints: DataFrame) -> DataFrame:
    """Rows whose text holds a hint phrase of their category; a category without hints keeps all.

    The hints are a hand-kept phrase list, read here. Each category's phrases become one
    pattern, so a row is read once however many phrases its category has.
    """
    phrases: dict[str, list[str]] = {}
    for row in hints.select("app_category_slug", "hint").collect():
        if row["app_category_slug"] is not None and row["hint"] is not None:
            phrases.setdefault(row["app_category_slug"], []).append(row["hint"])
    if not phrases:
        return products
    searched = classifier_text(
        F.col("product_name"), F.col("sku"), F.col("brand"), F.col("short_description"), F.col("category_trail"),
        F.col("specs"),
    )

    def found(text: Column) -> Column:
        column = F
        for category, words in sorted(phrases.items()):
            column = column.when(F.col("app_category_slug") == category, text.rlike(any_phrase(words)))
        return column.otherwise(True)

    return products.filter(F.element_at(F.transform(F.array(searched), found), 1))


def catalog_columns(catalog: DataFrame, *more: str) -> DataFrame:
    """The twelve columns a matching candidate carries; spec text of older snapshots is parsed."""
    specs = F.col("specs") if "specs" in catalog.columns else parse_specs(F.col("specs_json")).alias("specs")
    return catalog.select(
        "product_name", "sku", "brand", "product_url", "price_text", "currency", "availability", "short_description",
        specs, "searchable_text", "source_label", "last_synced_at", *more,
    )


def product_cards(products: DataFrame) -> DataFrame:
    """The nine-column view shown with a recommendation."""
    names = {
        "product_name": "productName", "sku": "sku", "brand": "brand", "product_url": "productUrl",
        "price_text": "priceText", "availability": "availability", "short_description": "shortDescription",
        "source_label": "sourceLabel", "last_synced_at": "lastSyncedAt",
    }
    return products.select(*[F.col(old).alias(new) for old, new in names.items()])


def upsert_products(catalog: DataFrame, products: DataFrame, order: list[str] | None = None) -> DataFrame:
    return upsert(catalog, products, "product_url", order)


def missing_products(catalog: DataFrame, seen: DataFrame, synced: DataFrame) -> DataFrame:
    """Catalog rows of a synced category whose URL was not seen under that category."""
    keys = ["app_category_slug", "product_url"]
    return catalog.join(synced.select("app_category_slug"), "app_category_slug", "left_semi").join(
        seen.select(*keys), keys, "left_anti"
    )


def deactivate_missing(catalog: DataFrame, seen: DataFrame, synced: DataFrame, now) -> DataFrame:
    """Catalog after reconciling: missing rows of synced categories go inactive and are stamped.

    Rows already inactive are stamped again, and a synced category with nothing seen is
    switched off as a whole. The row's current category decides.
    """
    keys = ["app_category_slug", "product_url"]
    synced = synced.select("app_category_slug", F.lit(True).alias("_synced")).distinct()
    seen = seen.select(*keys, F.lit(True).alias("_seen")).distinct()
    missing = F.col("_synced").isNotNull() & F.col("_seen").isNull()
    return (
        catalog.join(synced, "app_category_slug", "left")
        .join(seen, keys, "left")
        .withColumn("is_active", F.when(missing, F.lit(False)).otherwise(F.col("is_active")))
        .withColumn("last_synced_at", F.when(missing, as_ntz(now)).otherwise(F.col("last_synced_at")))
        .select(*catalog.columns)
    )


def seen_by_category(seen: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct URLs per category over all its sources."""
    return (
        seen.join(sources.select("source_label", "app_category_slug"), "source_label")
        .select("app_category_slug", "product_url")
        .distinct()
    )


def keep_last_product(products: DataFrame, per: list[str], order: list[str]) -> DataFrame:
    """Last record per product URL (within ``per``): a later link or source replaces an earlier one."""
    return keep_last(products, [*per, "product_url"], order)


def sync_summary(sources: DataFrame, seen: DataFrame, upserted: DataFrame) -> DataFrame:
    """URLs seen and products written per source; a source that found nothing counts 0."""
    def per_source(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("source_label").agg(F.count(F.lit(1)).alias(name))

    return (
        sources.select("source_label", "app_category", "source_pos")
        .join(per_source(seen, "products_seen"), "source_label", "left")
        .join(per_source(upserted, "products_upserted"), "source_label", "left")
        .fillna(0, ["products_seen", "products_upserted"])
    )


def sync_totals(summary: DataFrame) -> DataFrame:
    """Run totals; a product two sources found counts twice."""
    return summary.agg(
        F.coalesce(F.sum("products_seen"), F.lit(0)).alias("total_products_seen"),
        F.coalesce(F.sum("products_upserted"), F.lit(0)).alias("total_products_upserted"),
    )


def sync_run(summary: DataFrame, run_id: str, started_at, finished_at) -> DataFrame:
    """The log row of a run; its details document lists the sources in crawl order."""
    line = F.struct(
        "source_pos", F.col("app_category").alias("appCategory"), F.col("source_label").alias("sourceLabel"),
        F.col("products_seen").alias("productsSeen"), F.col("products_upserted").alias("productsUpserted"),
    )
    # One row per source of a hand-kept list, so the array is as short as that list.
    lines = summary.agg(
        F.sort_array(F.collect_list(line)).alias("lines"),
        F.coalesce(F.sum("products_seen"), F.lit(0)).alias("seen"),
        F.coalesce(F.sum("products_upserted"), F.lit(0)).alias("upserted"),
    )
    started = as_ntz(started_at)
    details = F.to_json(
        F.struct(
            F.lit(run_id).alias("runId"),
            F.date_format(started, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("startedAt"),
            F.transform("lines", lambda x: x.dropFields("source_pos")).alias("categories"),
            F.col("seen").alias("totalProductsSeen"),
            F.col("upserted").alias("totalProductsUpserted"),
        )
    )
    return lines.select(
        F.lit(run_id).alias("run_id"), F.lit("scheduled_catalog").alias("sync_scope"),
        F.lit("completed").alias("status"), details.alias("details_json"), started.alias("started_at"),
        as_ntz(finished_at).alias("finished_at"),
    )


def save_sync_runs(runs: DataFrame, run: DataFrame) -> DataFrame:
    return upsert(runs, run, "run_id")


DETAILS = (
    "startedAt string, categories array<struct<appCategory: string, sourceLabel: string, productsSeen: bigint, "
    "productsUpserted: bigint>>, totalProductsSeen bigint, totalProductsUpserted bigint, error string"
)


def sync_report(runs: DataFrame, trigger: str = "manual") -> DataFrame:
    """A text per run: totals and a line per source, or the error of a failed run."""
    d = F.from_json("details_json", DETAILS)
    source_lines = F.transform(
        d["categories"],
        lambda c: F.concat(
            F.lit("- "), c["appCategory"], F.lit(": seen "), c["productsSeen"].cast("string"),
            F.lit(", upserted "), c["productsUpserted"].cast("string"),
        ),
    )
    finished = F.date_format("finished_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    report = F.concat_ws(
        "\n",
        F.lit("Catalog sync completed successfully."),
        F.lit(""),
        F.lit(f"Trigger: {trigger}"),
        F.concat(F.lit("Started: "), or_default(d["startedAt"], "N/A")),
        F.concat(F.lit("Finished: "), or_default(finished, "N/A")),
        F.concat(F.lit("Total products seen: "), F.coalesce(d["totalProductsSeen"], F.lit(0)).cast("string")),
        F.concat(F.lit("Total products upserted: "), F.coalesce(d["totalProductsUpserted"], F.lit(0)).cast("string")),
        F.lit(""),
        F.lit("Categories:"),
        F.when(d["categories"].isNull(), "No category details.").otherwise(F.concat_ws("\n", source_lines)),
    )
    failed = F.concat_ws(
        "\n",
        F.lit("Catalog sync failed."),
        F.lit(""),
        F.lit(f"Trigger: {trigger}"),
        F.concat(F.lit("Time: "), or_default(finished, "N/A")),
        F.concat(F.lit("Error: "), or_default(d["error"], "Unknown error")),
    )
    return runs.select("run_id", F.when(F.col("status") == "failed", failed).otherwise(report).alias("report"))
