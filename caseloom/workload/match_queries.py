"""Queries that rank by shared words."""

from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.functions.text import slug, tokens
from caseloom.operators import case_index as I
from caseloom.operators import cases as K
from caseloom.operators import match as M
from caseloom.sources.tables import conform, new_path, stage
from caseloom.workload import duck as D
from caseloom.workload import fixtures as fx
from caseloom.workload.registry import query
from caseloom.workload.text_queries import requests


def _scored(targets: str, pool: str) -> str:
    """Shared distinct words per pair of ``targets(target_id, scope, text)`` and ``pool(key, scope, recency, text)``."""
    return f"""
target_words as (select target_id, scope, unnest({D.tokens('text')}) as word from {targets}),
pool_words as (select key, scope, recency, unnest({D.tokens('text')}) as word from {pool}),
scored as (select t.target_id, p.key, p.recency, count(*) as score from target_words t
  join pool_words p on p.scope = t.scope and p.word = t.word group by 1, 2, 3),
ranked as (select *, row_number() over (partition by target_id order by score desc, recency desc, key) as position
  from scored)"""


# The result size of the overlap query.
SHOWN = 20


@query("token_overlap", fx.oracle(f"""
with pool as (select doc_id as key, category as scope, last_synced_at as recency, product_name as text from fx_match_candidates),
targets as (select item_id as target_id, category as scope, text from fx_match_targets),{_scored('targets', 'pool')}
select target_id, position, key, score from ranked where position <= {SHOWN}"""))
def token_overlap(spark, sf_dir):
    pool = M.candidate_pool(
        fx.fixture(spark, sf_dir, "fx_match_candidates"), "category", "doc_id", "last_synced_at",
        tokens(F.col("product_name")),
    )
    targets = fx.fixture(spark, sf_dir, "fx_match_targets").select(
        F.col("item_id").alias("target_id"), F.col("category").alias("scope"), tokens(F.col("text")).alias("words")
    )
    return M.token_overlap(targets, pool, SHOWN)


@query("recommend_products", fx.oracle(f"""
with products as (select 'https://shop.example.com/store/d' || cast(doc_id as string) || '.html' as url, * from fx_match_candidates),
pool as (select url as key, category as scope, last_synced_at as recency,
  coalesce(nullif(searchable_text, ''), product_name) as text from (
  select *, row_number() over (partition by category order by last_synced_at desc, url) as rn from products where is_active)
  where rn <= 250),
targets as (select item_id as target_id, category as scope, category || ' ' || text as text from fx_match_targets),
{_scored('targets', 'pool')}
select target_id as item_id, position, key as product_url, score, p.searchable_text, p.last_synced_at
from ranked join products p on p.url = key where position <= 5"""))
def recommend_products(spark, sf_dir):
    docs = fx.fixture(spark, sf_dir, "fx_match_candidates")
    url = F.concat(F.lit(fx.ROOT + "/d"), F.col("doc_id").cast("string"), F.lit(".html"))
    catalog = conform(
        docs.withColumn("product_url", url).withColumn("app_category_slug", F.col("category")),
        schemas.PRODUCTS, schemas.PRODUCT_DEFAULTS,
    )
    names = [f.name for f in schemas.REQUESTS["formData"].dataType.fields]
    form = F.struct(*[(F.col("text") if n == "problem" else F.lit(None).cast("string")).alias(n) for n in names])
    asked = conform(
        fx.fixture(spark, sf_dir, "fx_match_targets").withColumn("formData", form),
        schemas.T.StructType([schemas.T.StructField("item_id", schemas.L), *schemas.REQUESTS.fields]),
    )
    best = M.recommend_products(asked, catalog, "item_id")
    return best.select("item_id", "position", "product_url", "score", "searchable_text", "last_synced_at")


@query("similar_cases", fx.oracle(f"""
with pool as (select case_number as key, category as scope, coalesce(updated_at, created_at) as recency, user_comment as text
  from fx_cases where case_status in ('Verified - Good', 'Verified - Corrected')),
targets as (select cast(conv_id as string) || '/' || cast(turn as string) as target_id,
  'src' || cast(conv_id % 20 as string) as scope, role || ' seen ' || text as text from conversations),
{_scored('targets', 'pool')}
select target_id, position, key as case_number, score from ranked where position <= 5"""))
def similar_cases(spark, sf_dir):
    return M.similar_cases(case_targets(spark, sf_dir), searched(*fx.case_tables(spark, sf_dir)))


def case_targets(spark, sf_dir):
    """Every turn of a conversation asks for earlier cases."""
    turn = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    asked = requests(spark, sf_dir).withColumn("target", turn)
    category = F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string"))
    return M.request_words(asked, "target", slug(category))


def searched(good, bad):
    """What of the cases is searched; eligibility by the stored status of the fixture's rows."""
    eligible = F.col("case_status").isin(schemas.VERIFIED_GOOD, schemas.VERIFIED_CORRECTED)
    return good.unionByName(bad).select(
        F.col("category_slug").alias("scope"), "case_number", F.coalesce("updated_at", "created_at").alias("updated_at"),
        F.col("user_comment").alias("search_text"), eligible.alias("learning_eligible"),
    )


@query("similar_cases_indexed", fx.oracle(f"""
with saved as (select case_number, coalesce(nullif(category, ''), 'Other') as cat, user_comment, case_status from fx_saves where save_no = 2),
judged as (select case_number, trim(case_status) as verdict, review_no from fx_reviews
  where trim(case_status) in ('Verified - Good', 'Verified - Corrected', 'Verified - Rejected', 'Archived')
    and not (trim(case_status) = 'Verified - Corrected' and trim(corrected_recommendation) = '')),
last as (select case_number, arg_max(verdict, review_no) as verdict from judged group by case_number),
cases as (
  select c.case_number, c.category, c.user_comment, c.case_status, coalesce(c.updated_at, c.created_at) as moment
  from fx_cases c where c.case_number not in (select case_number from saved)
  union all select case_number, {D.slug('cat')}, user_comment, case_status, timestamp '{fx.NOW}' from saved),
pool as (select c.case_number as key, c.category as scope, c.user_comment as text,
    case when l.case_number is not null then timestamp '{fx.NOW}' else c.moment end as recency
  from cases c left join last l on l.case_number = c.case_number
  where coalesce(l.verdict, c.case_status) in ('Verified - Good', 'Verified - Corrected')),
targets as (select cast(conv_id as string) || '/' || cast(turn as string) as target_id,
  'src' || cast(conv_id % 20 as string) as scope, role || ' seen ' || text as text from conversations),
{_scored('targets', 'pool')}
select target_id, position, key as case_number, score from ranked where position <= 5"""))
def similar_cases_indexed(spark, sf_dir):
    """An index of all cases, kept up through a batch of saves that moves cases and a batch of reviews, then read."""
    good, bad = fx.case_tables(spark, sf_dir)
    path = new_path(spark, "case-postings")
    postings, live = I.index_cases(searched(good, bad), 0)
    I.add_postings(postings, path)
    saves = fx.fixture(spark, sf_dir, "fx_saves").filter("save_no = 2")
    incoming = conform(saves, schemas.T.StructType([*schemas.CASES.fields, saves.schema["save_no"]]))
    good, bad = K.save_cases(good, bad, incoming, ["save_no"], fx.NOW)
    postings, live = I.change_index(stage(live, "live-cases"), searched(good, bad), [saves], 1)
    I.add_postings(postings, path)
    rows = fx.fixture(spark, sf_dir, "fx_reviews")
    reviews = rows.withColumn("completed_case", F.lit(None).cast(good.schema["completed_case"].dataType))
    good, bad, _ = K.apply_reviews(good, bad, reviews, ["review_no"], fx.NOW)
    postings, live = I.change_index(stage(live, "live-cases"), searched(good, bad), [reviews], 2)
    I.add_postings(postings, path)
    return I.similar_by_index(case_targets(spark, sf_dir), I.read_postings(spark, path), stage(live, "live-cases"))
