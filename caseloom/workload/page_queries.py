"""Queries over pages and the crawl."""

from pyspark.sql import functions as F

from caseloom.functions import pages as P
from caseloom.operators import catalog as C
from caseloom.operators import crawl
from caseloom.operators.keyed import keep_last
from caseloom.sources.dimensions import select_sources
from caseloom.workload import duck as D
from caseloom.workload import fixtures as fx
from caseloom.workload.registry import query

_W = f"[{D.WS}]"


def first(e: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({e}, '(?i){pattern}', {group})"


TITLE = D.strip(first("html", r"<h1[^>]*>([\s\S]*?)</h1>"))
DESCRIPTION = D.trim(D.decode(first("html", rf'<meta{_W}+name="description"{_W}+content="([^"]+)"')))
PRICE = D.squash(first("html", rf"RM{_W}?[0-9,]+(?:\.[0-9]{{2}})?", 0))
_CELL = D.squash(D.strip(first("html", rf"SKU[\s\S]{{0,120}}?</[^>]+>{_W}*<[^>]+>([\s\S]*?)</[^>]+>")))
_CODE = D.squash(D.strip(first("html", r"SKU[\s\S]{0,120}?([A-Z0-9][A-Z0-9\-./_ ]{2,})")))
SKU = (
    f"case when {_CELL} <> '' and upper({_CELL}) <> 'SKU' then {_CELL} "
    f"when {_CODE} <> '' and upper({_CODE}) <> 'SKU' then {_CODE} else '' end"
)
AVAILABILITY = (
    "case when regexp_matches(html, 'Add to Cart', 'i') then 'available' "
    "when regexp_matches(html, 'Out of stock', 'i') then 'out_of_stock' else 'unknown' end"
)
CANONICAL = D.product_url(
    "coalesce(nullif(" + first("html", '<link[^>]+rel="canonical"[^>]+href="([^"]+)"') + ", ''), nullif("
    + first("html", 'property="og:url" content="([^"]+)"') + ", ''), url)",
    "/store",
)
TRAIL = (
    "list_filter(list_transform(regexp_split_to_array("
    + D.strip(first("html", r'class="breadcrumbs?[^>]*>([\s\S]*?)</ul>'))
    + f", '{_W}{{2,}}|/|>'), lambda x: {D.trim('x')}), lambda x: x <> '')"
)
# Spec pairs by row position; the last value of a key at its first position.
SPEC_ROWS = f"""
spec_cells as (
  select url, pos, regexp_extract_all(r, '(?i)<t[dh][^>]*>([\\s\\S]*?)</t[dh]>', 1) as cells
  from (select url, unnest(rows) as r, generate_subscripts(rows, 1) as pos
    from (select url, regexp_extract_all({first("html", r"More Information[\s\S]*?<table[^>]*>([\s\S]*?)</table>")},
      '(?i)<tr[^>]*>([\\s\\S]*?)</tr>', 1) as rows from page_rows))),
spec_pairs as (
  select url, pos, {D.squash(D.strip('cells[1]'))} as key, {D.squash(D.strip('cells[2]'))} as value
  from spec_cells where len(cells) >= 2),
spec_rows as (
  select url, key, arg_max(value, pos) as value, min(pos) as pos from spec_pairs
  where key <> '' and value <> '' group by url, key)"""
PAGE_ROWS = "page_rows as (select app_category as source_label, product_url as url, html from fx_product_pages)"
# All fields of a page, and the rows a run stamps.
PAGE_FIELDS = f"""{PAGE_ROWS},{SPEC_ROWS},
spec_text as (select url as spec_url, string_agg(key || ' ' || value, ' ' order by pos) as spec_words,
  string_agg(key || '=' || value, '; ' order by pos) as specs from spec_rows group by url),
fields as (
  select source_label as page_label, p.url as page_url, {CANONICAL} as product_url, {TITLE} as product_name,
    {SKU} as sku, {PRICE} as price_text, {AVAILABILITY} as availability, {DESCRIPTION} as short_description,
    array_to_string({TRAIL}, '>') as trail, array_to_string({TRAIL}, ' ') as trail_words,
    coalesce(spec_words, '') as spec_words, coalesce(specs, '') as specs
  from page_rows p left join spec_text s on spec_url = p.url),
records as (
  select *, case when regexp_matches(split_part(product_name, ' ', 1), '^[A-Za-z0-9]+$')
    then split_part(product_name, ' ', 1) else string_split(sku, '-')[-1] end as brand,
    {D.slug('product_name')} as product_slug
  from fields where product_name <> '')"""


def rendered(df):
    """Spec pairs and trail as text, as the check compares flat rows."""
    specs = F.concat_ws("; ", F.transform("specs", lambda s: F.concat_ws("=", s["key"], s["value"])))
    return df.withColumn("specs", specs).withColumn("category_trail", F.concat_ws(">", "category_trail"))


@query("page_titles", f"select page_id, {TITLE} as title, {DESCRIPTION} as description from pages")
def page_titles(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select(
        "page_id", P.title(F.col("html")).alias("title"), P.meta_description(F.col("html")).alias("description")
    )


@query("extract_links", fx.oracle(f"""
with marked as (
  select page_id, list_distinct(list_filter(list_transform(
    regexp_extract_all(html, '(?i)<a\\b[^>]*class="[^"]*\\bproduct-item-link\\b[^"]*"[^>]*>', 0),
    lambda a: {D.product_url(first("a", '\\bhref="([^"]+)"'), '/store')}), lambda u: u <> '')) as urls, html
  from fx_link_pages),
found as (
  select page_id, case when len(urls) > 0 then urls else list_distinct(list_filter(list_transform(
    regexp_extract_all(html, '(?i)href="([^"]+)"', 1), lambda h: {D.product_url('h', '/store')}),
    lambda u: u <> '')) end as urls
  from marked)
select page_id, unnest(urls) as product_url from found"""))
def extract_links(spark, sf_dir):
    pages = fx.fixture(spark, sf_dir, "fx_link_pages")
    links = crawl.extract_links(pages, fx.BASE, fx.PREFIX, ["page_id"])
    return links.filter("product_url is not null").select("page_id", "product_url")


@query("next_page_flags", fx.oracle(f"""
with shown as (select page_id, page_no, {D.strip('html')} as body from fx_pager_pages)
select page_id, regexp_matches(body, 'Page{_W}+' || cast(page_no + 1 as string) || '\\b', 'i')
  or regexp_matches(body, 'Page Next', 'i') as has_next from shown"""))
def next_page_flags(spark, sf_dir):
    pages = fx.fixture(spark, sf_dir, "fx_pager_pages")
    return pages.select("page_id", P.has_next_page(F.col("html"), F.col("page_no")).alias("has_next"))


@query("extract_specs", fx.oracle(f"with {PAGE_ROWS},{SPEC_ROWS} select url, key, value from spec_rows"))
def extract_specs(spark, sf_dir):
    pages = fx.product_pages(spark, sf_dir)
    return pages.select("url", F.explode(P.specs(F.col("html"))).alias("s")).select("url", "s.key", "s.value")


@query("extract_trails", fx.oracle(f"""
with {PAGE_ROWS}, trails as (select url, {TRAIL} as trail from page_rows)
select url, cast(generate_subscripts(trail, 1) as bigint) as position, unnest(trail) as crumb from trails"""))
def extract_trails(spark, sf_dir):
    crumbs = F.posexplode(P.category_trail(F.col("html"))).alias("at", "crumb")
    found = fx.product_pages(spark, sf_dir).select("url", crumbs)
    return found.select("url", (F.col("at") + 1).cast("bigint").alias("position"), "crumb")


@query("extract_products", fx.oracle(f"""
with {PAGE_FIELDS}
select s.app_category, {D.slug('s.app_category')} as app_category_slug, s.source_type, s.source_label, product_name,
  product_slug, sku, brand, product_url, price_text, 'MYR' as currency, availability, short_description, specs,
  trail as category_trail,
  {D.words("s.app_category || ' ' || s.source_label || ' ' || product_name || ' ' || sku || ' ' || brand || ' ' || short_description || ' ' || spec_words")}
    as searchable_text, true as is_active, timestamp '{fx.NOW}' as last_synced_at
from records r join fx_sources s on s.source_label = r.page_label"""))
def extract_products(spark, sf_dir):
    sources = fx.sources(spark, sf_dir).withColumn("source_url", F.col("url")).drop("url", "query")
    rows = C.extract_products(fx.product_pages(spark, sf_dir), sources, fx.BASE, fx.PREFIX, fx.NOW)
    return rendered(rows).drop("source_url", "source_updated_at")


@query("distinct_urls", fx.oracle("""
select source_label, product_url, min(page_no) as page_no from fx_listing_links group by 1, 2"""))
def distinct_urls(spark, sf_dir):
    return crawl.first_seen(fx.fixture(spark, sf_dir, "fx_listing_links")).drop("link_pos")


# The crawl, page by page: r counts how far a source got.
def frontier(links: str) -> str:
    return f"""
page_list as (select source_label, page_no, bool_or(has_next) as has_next from {links} group by 1, 2),
first_pages as (select source_label, product_url, min(page_no) as page_no from {links} group by 1, 2),
page_new as (select source_label, page_no, count(*) as new_links from first_pages group by 1, 2),
walk as (
  select p.source_label, p.page_no, coalesce(n.new_links, 0) as new_links,
    coalesce(n.new_links, 0) > 0 and p.has_next as goes_on,
    row_number() over (partition by p.source_label order by p.page_no) as nth
  from page_list p left join page_new n on n.source_label = p.source_label and n.page_no = p.page_no),
kept_pages as (
  select source_label, page_no, new_links from (
    select *, coalesce(bool_and(goes_on) over (partition by source_label order by page_no
      rows between unbounded preceding and 1 preceding), true) as reached from walk)
  where reached and nth = page_no)"""


@query("crawl_frontier", fx.oracle(f"""
with {frontier('fx_listing_links')} select source_label, page_no, new_links from kept_pages"""))
def crawl_frontier(spark, sf_dir):
    return crawl.crawl_frontier(fx.fixture(spark, sf_dir, "fx_listing_links"))


SEEN = """
seen as (select f.source_label, f.product_url, f.page_no from first_pages f
  join kept_pages k on k.source_label = f.source_label and k.page_no = f.page_no)"""


@query("seen_by_category", fx.oracle(f"""
with {frontier('fx_sync_links')},{SEEN}
select distinct {D.slug('s.app_category')} as app_category_slug, product_url
from seen join fx_sources s on s.source_label = seen.source_label"""))
def seen_by_category(spark, sf_dir):
    seen = crawl.seen_links(fx.fixture(spark, sf_dir, "fx_sync_links"))
    return C.seen_by_category(seen, fx.sources(spark, sf_dir))


@query("keep_last", fx.oracle("""
select product_url, page_no, source_label from (
  select *, row_number() over (partition by product_url order by page_no desc, source_label desc, link_pos desc) as rn
  from fx_listing_links) where rn = 1"""))
def keep_last_query(spark, sf_dir):
    links = fx.fixture(spark, sf_dir, "fx_listing_links").select("product_url", "page_no", "source_label", "link_pos")
    return keep_last(links, ["product_url"], ["page_no", "source_label", "link_pos"]).drop("link_pos")


@query("catalog_sources", fx.oracle(f"""
select source_pos, app_category, {D.slug('app_category')} as app_category_slug, source_type, source_label, url, query
from fx_sources"""))
def catalog_sources(spark, sf_dir):
    return fx.sources(spark, sf_dir)


@query("select_sources", fx.oracle("""
select source_label, source_type from fx_sources where app_category in ('PROMO', 'SMALL', 'LARGE')"""))
def select_sources_query(spark, sf_dir):
    chosen = select_sources(fx.sources(spark, sf_dir), ["PROMO", "SMALL", "LARGE"])
    return chosen.select("source_label", "source_type")
