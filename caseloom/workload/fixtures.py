"""Inputs derived from the given tables, in SQL that runs unchanged in Spark and DuckDB."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.functions.text import slug
from caseloom.sources.dimensions import category_hints, with_slug
from caseloom.sources.tables import conform

BASE = "https://shop.example.com"
PREFIX = "/store"
ROOT = BASE + PREFIX
NOW = "2024-06-01 00:00:00"

# The given tables with the columns used here; declared, so that no file is opened to learn a schema.
TABLES = {
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_mktsegment string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# Phrases by category slug; categories not named here keep every product.
HINTS = {"economy": ["ring", "bolt"], "large": ["red", "blue w"], "promo": ["small", "green"]}

FIXTURES = {
    "fx_cases": """
select d.doc_id, 'case_' || cast(d.doc_id as string) as case_number, d.source as category,
  case when coalesce(l.quality, d.doc_id % 2) = 1 then 'good' else 'bad' end as rating,
  case d.doc_id % 5 when 0 then 'Verified - Good' when 1 then 'Verified - Corrected'
    when 2 then 'Verified - Rejected' when 3 then 'Pending Expert Review' else '' end as case_status,
  d.text as user_comment, case when l.toxic = 1 then 'Checked' else '' end as expert_comment,
  'case_' || cast(d.doc_id as string) || '.pdf' as pdf_name, d.lang as reviewer_name,
  d.doc_id % 3 = 0 as learning_eligible, e.props as case_payload,
  case d.doc_id % 4 when 0 then '["a", "b"]' when 1 then '' when 2 then '[bad' end as referenced_case_numbers,
  e.ts as created_at, case when d.doc_id % 7 <> 0 then e.ts end as updated_at
from documents d left join labels l on d.doc_id = l.doc_id left join events e on e.event_id = d.doc_id""",
    # Every document saves a case, the labelled ones a second time under the label's rating.
    "fx_saves": """
select 'case_' || cast(d.doc_id as string) as case_number, 1 as save_no, d.source as category,
  case when d.lang = 'fr' then 'bad' else 'good' end as rating, 'new_' || cast(d.doc_id as string) || '.pdf' as pdf_name,
  d.text as user_comment, case when d.lang = 'es' then '' else 'Draft' end as case_status
from documents d
union all
select 'case_' || cast(l.doc_id as string), 2, case when l.toxic = 1 then '' else 'Label Check' end,
  case when l.quality = 1 then 'fine' else 'bad' end, 'label_' || cast(l.doc_id as string) || '.pdf',
  'again', 'AI Generated'
from labels l""",
    # One review per document, most of which are no case, and a second one per label.
    "fx_reviews": """
select 'case_' || cast(d.doc_id as string) as case_number, 1 as review_no,
  case d.doc_id % 6 when 0 then 'Verified - Good' when 1 then ' Verified - Corrected' when 2 then 'Archived'
    when 3 then 'Draft' when 4 then 'Verified - Rejected' else '' end as case_status,
  case when d.doc_id % 4 = 0 then 'Use the larger size' else ' ' end as corrected_recommendation,
  d.text as expert_comment, ' ' || d.source as expert_rating, 'high value' as knowledge_value,
  case when d.lang = 'en' then ' Ann  Lee ' else '' end as reviewer_name, d.lang <> 'es' as has_part,
  d.source || '.pdf' as pdf_name, case when d.lang = 'de' then 'queued' else '' end as upload_status
from documents d
union all
select 'case_' || cast(l.doc_id as string), 2, case when l.quality = 1 then 'Verified - Good' else 'Unknown' end,
  '', 'second look', '5', '', '', l.toxic = 0, 'second.pdf', ''
from labels l""",
    "fx_patches": """
select 'case_' || cast(d.doc_id as string) as case_number, 1 as patch_no, 'uploaded' as upload_status,
  case when d.lang = 'en' then '' when d.lang = 'de' then 'a.pdf' end as pdf_name,
  case when d.lang = 'fr' then 'https://files.example.com/' || d.source end as file_url
from documents d
union all
select 'case_' || cast(l.doc_id as string), 2, case when l.toxic = 1 then 'failed' end, null, 'second'
from labels l""",
    "fx_products": """
select p.p_partkey, p.p_type as app_category, p.p_name as product_name,
  'PN-' || cast(p.p_partkey as string) || '-' || replace(p.p_brand, '#', '') as sku,
  replace(p.p_brand, '#', '') as brand,
  'https://shop.example.com/store/' || replace(p.p_name, ' ', '-') || '-'
    || cast(p.p_partkey as string) || '.html' as product_url,
  'RM ' || cast(cast(floor(p.p_retailprice) as int) as string) || '.00' as price_text,
  p.p_partkey % 9 <> 0 as is_active, p.p_size, o.o_orderdate as last_synced_at
from part p left join orders o on o.o_orderkey = p.p_partkey""",
    "fx_product_pages": """
select p_partkey, product_url, app_category,
  '<html><head><meta name="description" content="' || product_name
  || ' &amp; parts"><link rel="canonical" href="' || product_url || '?ref=x"></head><body>'
  || '<div class="breadcrumbs"><ul><li>Home</li> &gt; <li>' || app_category
  || '</li></ul></div><h1 class="t">' || brand || ' ' || product_name || '</h1>'
  || '<b>SKU</b> <i>' || sku || '</i><p>' || price_text || '</p>'
  || case p_partkey % 3 when 0 then '<button>Add to Cart</button>'
       when 1 then '<p>Out of stock</p>' else '' end
  || '<h2>More Information</h2><table><tr><th>Brand</th><td>' || brand
  || '</td></tr><tr><th>Size</th><td> ' || cast(p_partkey % 50 as string)
  || '&nbsp;mm</td></tr><tr><th>Finish</th></tr><tr><th>Brand</th><td>' || brand || ' Ltd</td></tr></table></body></html>'
  as html
from fx_products""",
    "fx_listing_links": """
select p_type as source_label, 1 + cast(floor(p_size / 5.0) as int) as page_no, cast(p_partkey as int) as link_pos,
  'https://shop.example.com/store/p' || cast(p_partkey % 37 as string) || '.html' as product_url,
  cast(floor(p_size / 5.0) as int) < 8 as has_next
from part""",
    # Six category sources and one sale source that shows products of all of them.
    "fx_sync_links": """
select f.app_category as source_label, 1 + cast(floor(f.p_size / 10.0) as int) as page_no,
  cast(f.p_partkey as int) as link_pos, f.product_url, cast(floor(f.p_size / 10.0) as int) < 4 as has_next
from fx_products f
union all
select case when f.product_url <> '' then 'Sale' end, 1 + cast(floor(f.p_size / 10.0) as int), cast(f.p_partkey as int), f.product_url,
  cast(floor(f.p_size / 10.0) as int) < 1
from fx_products f""",
    "fx_sources": """
select cast(min(p_partkey) as int) as source_pos, p_type as app_category,
  case when p_type < 'M' then 'category' else 'search' end as source_type, p_type as source_label,
  case when p_type < 'M' then 'https://shop.example.com/store/' || lower(p_type) || '.html' end as url,
  case when p_type >= 'M' then '"' || lower(p_type) || ' part!"' end as query
from part group by p_type
union all
select cast(max(p_partkey) + 1 as int), max(p_type), 'search', 'Sale', null, 'sale' from part""",
    "fx_runs": """
select 'req_' || cast(event_id as string) as request_id,
  'user_' || cast(user_id as string) as user_name, event_type as category,
  case when event_type = 'error' then 'error' else 'success' end as status,
  cast(floor(value * 10) as int) as latency_ms,
  case when event_type = 'error' and event_id % 3 = 0 then 'Connection  timeout on node'
    when event_type = 'error' then 'Bad input' else '' end as error_message,
  case event_id % 4
    when 0 then '{"input_tokens": ' || cast(user_id as string) || ', "output_tokens": 7}'
    when 1 then '{"inputTokens": "3", "totalTokens": 9, "output_tokens_details": {"reasoning_tokens": 4}}'
    when 2 then '' else '{bad' end as usage_json,
  props, ts as created_at
from events""",
    # Failed runs logged again, twice, and purchases as new runs.
    "fx_run_changes": """
select 'req_' || cast(event_id as string) as request_id, 1 as attempt, 'error' as status,
  cast(floor(value) as int) as latency_ms, ts as created_at from events where event_type = 'error'
union all
select 'req_' || cast(event_id as string), 2, 'success', cast(floor(value * 2) as int), ts from events
where event_type = 'error'
union all
select 'req_buy_' || cast(event_id as string), 1, 'success', 1, ts from events where event_type = 'purchase'""",
    "fx_event_rows": """
select event_id, event_type as event_name, ' ' || props || '  ' as event_detail,
  case when event_type = 'error' then 'error' else '' end as level, 'user ' || cast(user_id as string) as category,
  'req_' || cast(event_id as string) as request_id, ts as created_at
from events""",
    "fx_evals": """
select 'case_' || cast(d.doc_id as string) as case_number, case when l.toxic = 1 then '' else d.source end as category,
  coalesce(cast(l.quality as string), 'unrated') as rating, d.text as evaluation_note, d.lang as user_name, e.ts as created_at
from documents d left join labels l on d.doc_id = l.doc_id left join events e on e.event_id = d.doc_id""",
    "fx_counters": """
select 'case_number_' || event_type as name, max(user_id) as last_value, max(ts) as updated_at
from events where event_type <> 'view' group by event_type""",
    "fx_match_targets": """
select item_id, case item_id % 4 when 0 then 'en' when 1 then 'de'
  when 2 then 'fr' else 'es' end as category, text
from benchmark""",
    "fx_match_candidates": """
select d.doc_id, d.lang as category, d.text as product_name,
  case when d.source = 'src3' then '' else d.text end as searchable_text, d.source <> 'src7' as is_active,
  e.ts as last_synced_at
from documents d left join events e on e.event_id = d.doc_id""",
    "fx_link_pages": """
select page_id, case page_id % 3 when 0 then '<a class="x product-item-link y" title="t" href="/store/p'
    || cast(page_id as string) || '.html?x=1#y">P</a>'
    when 1 then '<a class="product-item-link" href="/elsewhere.html">P</a>' else '' end
  || replace(html, 'href="/', 'href="/store/catalog/product/view/id/7/') as html
from pages""",
    "fx_pager_pages": """
select page_id, cast(1 + page_id % 4 as int) as page_no, html || '<p>Page <b>' || cast(2 + page_id % 3 as string)
  || '</b></p>' || case when page_id % 11 = 0 then '<span>Page Next</span>' else '' end as html
from pages""",
    "fx_urls": """
select 'page' as kind, page_id as id, url from pages
union all
select 'product', p_partkey, case p_partkey % 7 when 0 then product_url || '//'
  when 1 then replace(product_url, 'https://shop.example.com', '')
  when 2 then replace(product_url, 'https:', '')
  when 3 then replace(product_url, 'https://shop.example.com', 'HTTPS://me@Shop.Example.com:443') || '?a=b'
  when 4 then ' ' || product_url || '#frag '
  when 5 then replace(product_url, '/store/', '/store/catalog/product/view/id/12/')
  else replace(product_url, 'https://shop.example.com/', '') end
from fx_products
union all
select 'spelt', p_partkey, case p_partkey % 9 when 0 then replace(product_url, '/store/', '/x/y/../../store/./')
  when 1 then replace(product_url, '/store/', '/../%2e%2E/store/%2e/')
  when 2 then replace(product_url, '/store/', '/store/café {"') when 3 then replace(product_url, '.html', '%41.html?a/../b')
  when 4 then replace(replace(product_url, 'https://shop.example.com', ''), '/', chr(92))
  when 5 then replace(product_url, '/store/', '/store/' || chr(9) || chr(10)) || '/.'
  when 6 then replace(product_url, '/store/', '/store/catalog/product/view/id/12/a/../') || '/..'
  when 7 then product_url || '/..' else replace(product_url, '/store/', '/store/..../😀') end
from fx_products""",
}


def _needed(sql: str) -> list[str]:
    """The fixtures a statement uses, directly or not, in definition order."""
    wanted, todo = set(), [sql]
    while todo:
        for name in re.findall(r"\bfx_[a-z_]+", todo.pop()):
            if name in FIXTURES and name not in wanted:
                wanted.add(name)
                todo.append(FIXTURES[name])
    return [name for name in FIXTURES if name in wanted]


def oracle(sql: str) -> str:
    """A statement with the fixtures it uses put before it; it may start with further CTEs."""
    sql = sql.strip()
    parts = [f"{name} as ({FIXTURES[name]}\n)" for name in _needed(sql)]
    if not parts:
        return sql
    if sql.startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + sql[len("with "):]
    return "with " + ",\n".join(parts) + "\n" + sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a statement over fixtures and given tables."""
    full = oracle(sql)
    for name in TABLES:
        if re.search(rf"\b(?:from|join) {name}\b", full):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(full)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return derived(spark, sf_dir, f"select * from {name}")


def case_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The good and the bad case table."""
    rows = fixture(spark, sf_dir, "fx_cases").withColumn("category_slug", slug(F.col("category")))
    old = F.struct(
        *[F.lit("old.pdf" if n == "pdfName" else "Kim" if n == "reviewerName" else None).cast("string").alias(n)
          for n in schemas.COMPLETED_FIELDS]
    )
    rows = rows.withColumn("completed_case", F.when(F.col("learning_eligible"), old))
    full = conform(rows, schemas.CASES, {k: v for k, v in schemas.CASE_DEFAULTS.items() if k != "referenced_case_numbers"})
    return full.filter("rating = 'good'"), full.filter("rating = 'bad'")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product catalog, whole schema."""
    rows = fixture(spark, sf_dir, "fx_products")
    rows = rows.withColumn("app_category_slug", slug(F.col("app_category"))).withColumn(
        "source_label", F.col("app_category")
    )
    return conform(rows, schemas.PRODUCTS, schemas.PRODUCT_DEFAULTS)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_slug(fixture(spark, sf_dir, "fx_sources"))


def hints(spark: SparkSession) -> DataFrame:
    return category_hints(spark, HINTS)


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fx_product_pages").select(F.col("app_category").alias("source_label"), F.col("product_url").alias("url"), "html")
