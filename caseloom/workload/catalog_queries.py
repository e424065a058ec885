"""Queries over the product catalog and its sync."""

from pyspark.sql import functions as F

from caseloom.functions import pages as P
from caseloom.operators import catalog as C
from caseloom.operators.crawl import seen_links
from caseloom.operators.keyed import newest_per_group
from caseloom.operators.match import render_products, top_k
from caseloom.plans.catalog_sync import catalog_sync
from caseloom.sources.dimensions import select_sources
from caseloom.workload import duck as D
from caseloom.workload import fixtures as fx
from caseloom.workload.page_queries import PAGE_FIELDS, SEEN, frontier, rendered
from caseloom.workload.registry import query

_HINT_ROWS = ", ".join(f"('{name}', '{hint}')" for name, words in fx.HINTS.items() for hint in words)


def hinted(text: str, slug: str) -> str:
    """Whether a text holds a hint of its category, or the category has none."""
    return (
        f"(not exists (select 1 from hints h where h.slug = {slug}) "
        f"or exists (select 1 from hints h where h.slug = {slug} and contains({text}, h.hint)))"
    )


HINTS = f"hints(slug, hint) as (values {_HINT_ROWS})"


@query("filter_by_hints", fx.oracle(f"""
with {HINTS}
select product_url from fx_products
where {hinted("lower(product_name || ' ' || sku || ' ' || brand)", "lower(app_category)")}"""))
def filter_by_hints(spark, sf_dir):
    return C.filter_by_hints(fx.catalog(spark, sf_dir), fx.hints(spark)).select("product_url")


@query("active_products", fx.oracle("""
select product_url, product_name, last_synced_at from fx_products where app_category = 'PROMO' and is_active"""))
def active_products(spark, sf_dir):
    found = C.active_products(fx.catalog(spark, sf_dir), "promo")
    return found.select("product_url", "product_name", "last_synced_at")


@query("product_cards", fx.oracle("""
select product_name as "productName", sku, brand, product_url as "productUrl", price_text as "priceText",
  'unknown' as availability, '' as "shortDescription", app_category as "sourceLabel",
  last_synced_at as "lastSyncedAt" from fx_products"""))
def product_cards(spark, sf_dir):
    return C.product_cards(fx.catalog(spark, sf_dir))


@query("newest_per_group", fx.oracle("""
select app_category_slug, product_url, position from (
  select lower(app_category) as app_category_slug, product_url,
    row_number() over (partition by app_category order by last_synced_at desc, product_url) as position
  from fx_products where is_active) where position <= 250"""))
def newest_per_group_query(spark, sf_dir):
    active = fx.catalog(spark, sf_dir).filter("is_active").select("app_category_slug", "product_url", "last_synced_at")
    best = newest_per_group(active, "app_category_slug", "last_synced_at", ["product_url"], 250, "position")
    return best.select("app_category_slug", "product_url", F.col("position").cast("bigint").alias("position"))


# Small and mid-size products arrive again with a new price, twice for the smallest; large ones are untouched.
_STOCK = "p_size <= 30"


@query("upsert_products", fx.oracle(f"""
with changes as (
  select product_url, product_name || ' v1' as product_name, p_size, 1 as pos from fx_products where p_size > 20
  union all select product_url, product_name || ' v2', p_size, 2 from fx_products where p_size > 40),
latest as (select product_url, arg_max(product_name, pos) as product_name from changes group by product_url)
select product_url, product_name, timestamp '{fx.NOW}' as last_synced_at, true as is_active from latest
union all
select product_url, product_name, last_synced_at, is_active from fx_products p
where {_STOCK} and not exists (select 1 from latest l where l.product_url = p.product_url)"""))
def upsert_products(spark, sf_dir):
    rows = fx.fixture(spark, sf_dir, "fx_products")
    catalog = fx.catalog(spark, sf_dir)
    sizes = rows.select("product_url", "p_size")
    stock = catalog.join(sizes.filter(_STOCK), "product_url", "left_semi")

    def batch(pos: int, wanted: str):
        rows = catalog.join(sizes.filter(wanted), "product_url", "left_semi")
        return (
            rows.withColumn("product_name", F.concat("product_name", F.lit(f" v{pos}")))
            .withColumn("is_active", F.lit(True))
            .withColumn("last_synced_at", F.lit(fx.NOW).cast("timestamp_ntz"))
            .withColumn("pos", F.lit(pos))
        )

    changes = batch(1, "p_size > 20").unionByName(batch(2, "p_size > 40"))
    written = C.upsert_products(stock, changes, ["pos"])
    return written.select("product_url", "product_name", "last_synced_at", "is_active")


# The seen URLs of the crawl decide; two categories are not synced.
_SYNCED = ["ECONOMY", "LARGE", "MEDIUM", "PROMO"]
_RECONCILE = f"""
{frontier('fx_sync_links')},{SEEN},
seen_slugs as (select distinct lower(s.app_category) as slug, product_url
  from seen join fx_sources s on s.source_label = seen.source_label),
judged as (select p.*, lower(app_category) as slug, app_category in ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO')
  and not exists (select 1 from seen_slugs s where s.slug = lower(p.app_category) and s.product_url = p.product_url)
  as missing from fx_products p)"""


def _reconcile_inputs(spark, sf_dir):
    sources = fx.sources(spark, sf_dir)
    seen = C.seen_by_category(seen_links(fx.fixture(spark, sf_dir, "fx_sync_links")), sources)
    return fx.catalog(spark, sf_dir), seen, select_sources(sources, _SYNCED)


@query("missing_products", fx.oracle(f"with {_RECONCILE} select slug as app_category_slug, product_url from judged where missing"))
def missing_products(spark, sf_dir):
    missing = C.missing_products(*_reconcile_inputs(spark, sf_dir))
    return missing.select("app_category_slug", "product_url")


@query("deactivate_missing", fx.oracle(f"""
with {_RECONCILE} select product_url, is_active and not missing as is_active,
  case when missing then timestamp '{fx.NOW}' else last_synced_at end as last_synced_at from judged"""))
def deactivate_missing(spark, sf_dir):
    after = C.deactivate_missing(*_reconcile_inputs(spark, sf_dir), fx.NOW)
    return after.select("product_url", "is_active", "last_synced_at")


# One record per source and URL, then the later source's record per URL.
_SYNC = f"""
{frontier('fx_sync_links')},{SEEN},{PAGE_FIELDS},{HINTS},
crawled as (
  select s.source_pos, s.app_category, lower(s.app_category) as slug, s.source_label, s.source_type,
    case when s.source_type = 'search' then 'https://shop.example.com/store/catalogsearch/result/?q='
      || replace(url_encode(s.query), '%21', '!') else s.url end as source_url, r.*
  from seen join records r on r.page_url = seen.product_url join fx_sources s on s.source_label = seen.source_label),
matched as (select * from crawled c where
  {hinted("lower(product_name || ' ' || sku || ' ' || brand || ' ' || short_description || ' ' || trail_words || ' ' || spec_words)", "c.slug")}),
written as (select * from (
  select *, row_number() over (partition by product_url order by source_pos desc) as rn from matched) where rn = 1),
totals as (
  select s.source_label, s.app_category, s.source_pos,
    (select count(*) from seen where seen.source_label = s.source_label) as products_seen,
    (select count(*) from matched m where m.source_label = s.source_label) as products_upserted
  from fx_sources s)"""


def sync(spark, sf_dir):
    pages = fx.product_pages(spark, sf_dir).select("url", "html")
    return catalog_sync(
        fx.catalog(spark, sf_dir), fx.sources(spark, sf_dir), fx.fixture(spark, sf_dir, "fx_sync_links"), pages,
        fx.hints(spark), fx.BASE, fx.PREFIX, fx.NOW,
    )


@query("catalog_sync", fx.oracle(f"""
with {_SYNC}
select product_url, app_category, slug as app_category_slug, source_type, source_label, source_url, product_name,
  product_slug, sku, brand, price_text, 'MYR' as currency, availability, short_description, specs,
  trail as category_trail,
  {D.words("app_category || ' ' || source_label || ' ' || product_name || ' ' || sku || ' ' || brand || ' ' || short_description || ' ' || spec_words")}
    as searchable_text, true as is_active, timestamp '{fx.NOW}' as last_synced_at
from written
union all
select product_url, app_category, lower(app_category), null, app_category, null, product_name, null, sku, brand,
  price_text, 'MYR', 'unknown', '', '', '', '',
  is_active and lower(app_category) not in (select lower(app_category) from fx_sources),
  case when lower(app_category) in (select lower(app_category) from fx_sources) then timestamp '{fx.NOW}'
    else last_synced_at end
from fx_products p where not exists (select 1 from written w where w.product_url = p.product_url)"""))
def catalog_sync_query(spark, sf_dir):
    return rendered(sync(spark, sf_dir).catalog).drop("source_updated_at")


@query("sync_summary", fx.oracle(f"""
with {_SYNC} select source_label, app_category, source_pos, products_seen, products_upserted from totals"""))
def sync_summary(spark, sf_dir):
    return sync(spark, sf_dir).summary


@query("sync_totals", fx.oracle(f"""
with {_SYNC} select cast(sum(products_seen) as bigint) as total_products_seen,
  cast(sum(products_upserted) as bigint) as total_products_upserted from totals"""))
def sync_totals(spark, sf_dir):
    return C.sync_totals(sync(spark, sf_dir).summary)


_DETAILS = """
  '{"runId":"run_2","startedAt":"2024-05-31T23:00:00.000Z","categories":['
  || string_agg('{"appCategory":"' || app_category || '","sourceLabel":"' || source_label || '","productsSeen":'
    || cast(products_seen as string) || ',"productsUpserted":' || cast(products_upserted as string) || '}', ','
    order by source_pos)
  || '],"totalProductsSeen":' || cast(cast(sum(products_seen) as bigint) as string)
  || ',"totalProductsUpserted":' || cast(cast(sum(products_upserted) as bigint) as string) || '}'"""
_RUNS = """
select 'run_' || lower(source_label) as run_id, 'scheduled_catalog' as sync_scope, 'completed' as status,
  '{}' as details_json, timestamp '2024-01-01 00:00:00' as started_at, timestamp '2024-01-01 01:00:00' as finished_at
from fx_sources
union all select 'run_2', 'old', 'failed', '{}', min(last_synced_at), null from fx_products"""


@query("save_sync_runs", fx.oracle(f"""
with {_SYNC}, runs as ({_RUNS})
select 'run_2' as run_id, 'scheduled_catalog' as sync_scope, 'completed' as status, {_DETAILS} as details_json,
  timestamp '2024-05-31 23:00:00' as started_at, timestamp '{fx.NOW}' as finished_at from totals
union all select * from runs where run_id <> 'run_2'"""))
def save_sync_runs(spark, sf_dir):
    run = C.sync_run(sync(spark, sf_dir).summary, "run_2", "2024-05-31 23:00:00", fx.NOW)
    runs = fx.derived(spark, sf_dir, _RUNS).withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))
    runs = runs.withColumn("finished_at", F.col("finished_at").cast("timestamp_ntz"))
    return C.save_sync_runs(runs, run)


@query("sync_report", fx.oracle(f"""
with {_SYNC}
select 'run_2' as run_id, 'Catalog sync completed successfully.' || chr(10) || chr(10) || 'Trigger: manual' || chr(10)
  || 'Started: 2024-05-31T23:00:00.000Z' || chr(10) || 'Finished: 2024-06-01T00:00:00.000Z' || chr(10)
  || 'Total products seen: ' || cast(cast(sum(products_seen) as bigint) as string) || chr(10)
  || 'Total products upserted: ' || cast(cast(sum(products_upserted) as bigint) as string) || chr(10) || chr(10)
  || 'Categories:' || chr(10)
  || string_agg('- ' || app_category || ': seen ' || cast(products_seen as string) || ', upserted '
    || cast(products_upserted as string), chr(10) order by source_pos) as report
from totals
union all select 'run_3', 'Catalog sync failed.' || chr(10) || chr(10) || 'Trigger: manual' || chr(10)
  || 'Time: 2024-06-01T00:00:00.000Z' || chr(10) || 'Error: timeout after ' || cast(count(*) as string) || ' runs' from totals
union all select 'run_4', 'Catalog sync completed successfully.' || chr(10) || chr(10) || 'Trigger: manual' || chr(10)
  || 'Started: N/A' || chr(10) || 'Finished: 2024-06-01T00:00:00.000Z' || chr(10) || 'Total products seen: 0' || chr(10)
  || 'Total products upserted: 0' || chr(10) || chr(10) || 'Categories:' || chr(10) || 'No category details.'"""))
def sync_report(spark, sf_dir):
    run = C.sync_run(sync(spark, sf_dir).summary, "run_2", "2024-05-31 23:00:00", fx.NOW)
    # The run as it is, as one that failed and as one without details.
    sources = F.size(F.from_json("details_json", C.DETAILS)["categories"]).cast("string")
    error = F.to_json(F.struct(F.concat(F.lit("timeout after "), sources, F.lit(" runs")).alias("error")))
    forms = [("run_2", F.col("status"), F.col("details_json")), ("run_3", F.lit("failed"), error), ("run_4", F.col("status"), F.lit("{}"))]
    each = F.array(*[F.struct(F.lit(i).alias("run_id"), s.alias("status"), d.alias("details_json")) for i, s, d in forms])
    runs = run.select(F.explode(each).alias("r"), "finished_at").select("r.*", "finished_at")
    return C.sync_report(runs)


_SPEC_LINE = """
spec_lines as (select url, string_agg(key || ': ' || value, '; ' order by pos) as line from spec_rows
  where pos <= 7 group by url)"""


@query("render_products", fx.oracle(f"""
with {PAGE_FIELDS},{_SPEC_LINE},
ranked as (select r.*, page_label as category, row_number() over (partition by page_label
  order by o.last_synced_at desc, r.product_url) as position from records r
  join fx_products o on o.product_url = r.page_url)
select category, 'Use these synced shop products as the preferred recommendation pool.' || chr(10)
  || 'If they fit the case, prioritize them over generic suggestions and reference their exact product names or SKU codes.'
  || chr(10) || string_agg(cast(position as string) || '. ' || product_name || ' | SKU: ' || sku || ' | Brand: ' || brand
    || ' | Price: ' || price_text || ' | Availability: ' || availability || ' | URL: ' || product_url || ' | Specs: '
    || l.line, chr(10) order by position) as block
from ranked join spec_lines l on l.url = ranked.page_url where position <= 5 group by category"""))
def render_products_query(spark, sf_dir):
    pages = fx.product_pages(spark, sf_dir)
    recency = fx.fixture(spark, sf_dir, "fx_products").select(F.col("product_url").alias("url"), "last_synced_at")
    # Ranked first, by what needs one field: the others are read off the kept pages only.
    titled = pages.where(P.title(F.col("html")) != "").select("source_label", "url").join(recency, "url")
    best = newest_per_group(titled, "source_label", "last_synced_at", ["url"], 5, "position")
    kept = pages.join(best.select("url", "position"), "url")
    ranked = C.page_records(kept, fx.BASE, fx.PREFIX, keep=["source_label", "position"]).withColumnRenamed("source_label", "category")
    return render_products(top_k(ranked), "category")
