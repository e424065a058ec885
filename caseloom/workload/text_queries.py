"""Queries over column transforms."""

from pyspark.sql import functions as F

from caseloom.functions import text as X
from caseloom.functions import urls as U
from caseloom.functions.records import read_json
from caseloom.schemas import FORM_FIELDS
from caseloom.operators import logs
from caseloom.operators.cases import reference_meta
from caseloom.operators.crawl import listing_urls
from caseloom.operators.requests import payload_counts, route_requests
from caseloom.workload import duck as D
from caseloom.workload import fixtures as fx
from caseloom.workload.registry import query


@query("slug_keys", f"""
select 'segment' as kind, c_custkey as id, {D.slug('c_mktsegment')} as slug from customer
union all select 'source', doc_id, {D.slug('source')} from documents
union all select 'text', doc_id, {D.slug('text')} from documents""")
def slug_keys(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    parts = [
        ("segment", fx.table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment"),
        ("source", docs, "doc_id", "source"),
        ("text", docs, "doc_id", "text"),
    ]
    frames = [
        df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), X.slug(F.col(name)).alias("slug"))
        for kind, df, key, name in parts
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("page_text", f"select page_id, {D.decode('html')} as decoded, {D.strip('html')} as body from pages")
def page_text(spark, sf_dir):
    html = F.col("html")
    return fx.table(spark, sf_dir, "pages").select(
        "page_id", X.decode_entities(html).alias("decoded"), X.strip_html(html).alias("body")
    )


@query("clean_text", f"""
select doc_id, left({D.squash('text')}, 500) as short, {D.squash('text')} as whole from documents""")
def clean_text(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", X.clean_text(F.col("text")).alias("short"), X.squash(F.col("text")).alias("whole"))


_LARGE = D.trim("replace(text || chr(13) || chr(10) || ' end ' || chr(160), chr(13) || chr(10), chr(10))")


@query("clean_large_text", f"select doc_id, left({_LARGE}, 6000) as body from documents")
def clean_large_text(spark, sf_dir):
    raw = F.concat(F.col("text"), F.lit("\r\n end  "))
    return fx.table(spark, sf_dir, "documents").select("doc_id", X.clean_large_text(raw).alias("body"))


# A fifth of the letters become characters of two code units.
_WIDE = "translate(coalesce(text, ''), 'aeiou', '\U0001F600eiou')"
_FITS = f"list_max(list_filter(range(0, 501), lambda p: {D.code_units('left(w, p::bigint)')} <= 500))"


@query("code_units", f"""
select doc_id, {D.code_units('w')} as units, left(w, {_FITS}::bigint) as short
from (select doc_id, {D.squash(_WIDE)} as w from documents)""")
def code_units(spark, sf_dir):
    """Sizes and cuts of texts in which one character often takes two code units."""
    wide = X.squash(F.translate(F.col("text"), "aeiou", "\U0001F600eiou"))
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", wide.alias("w"))
    return docs.select("doc_id", X.code_units(F.col("w")).alias("units"), X.clean_text(F.col("w")).alias("short"))


@query("clean_path", f"""
select page_id, left({D.trim("trim(regexp_replace(replace(replace('/' || url || '/', '/', chr(92)), chr(92), '/'), '/+', '/', 'g'), '/')")}, 500)
  as path from pages""")
def clean_path(spark, sf_dir):
    raw = F.replace(F.concat(F.lit("/"), F.col("url"), F.lit("/")), F.lit("/"), F.lit("\\"))
    return fx.table(spark, sf_dir, "pages").select("page_id", X.clean_path(raw).alias("path"))


@query("normalise_urls", fx.oracle(f"select kind, id, {D.product_url('url', '/store')} as product_url from fx_urls"))
def normalise_urls(spark, sf_dir):
    return fx.fixture(spark, sf_dir, "fx_urls").select(
        "kind", "id", U.normalise_product_url(F.col("url"), fx.BASE, fx.PREFIX).alias("product_url")
    )


@query("tokens", f"select doc_id, unnest({D.tokens('text')}) as token from documents")
def tokens(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("token"))


@query("parse_props", fx.oracle("""
select request_id, coalesce(try_cast(json_extract_string(try_cast(props as json), '$.k') as bigint), -1) as k,
  coalesce(json_extract_string(try_cast(nullif(usage_json, '') as json), '$.input_tokens'), 'none') as usage_input,
  coalesce(json_valid(nullif(usage_json, '')), false) as usage_valid
from fx_runs"""))
def parse_props(spark, sf_dir):
    props = read_json(F.col("props"), "k bigint", F.struct(F.lit(-1).cast("bigint").alias("k")))
    none = F.struct(F.lit("none").alias("input_tokens"), F.lit(False).alias("valid"))
    usage = read_json(F.col("usage_json"), "input_tokens string, valid boolean", none)
    return fx.fixture(spark, sf_dir, "fx_runs").select(
        "request_id", F.coalesce(props["k"], F.lit(-1).cast("bigint")).alias("k"),
        F.coalesce(usage["input_tokens"], F.lit("none")).alias("usage_input"),
        F.coalesce(usage["valid"], F.lit(True)).alias("usage_valid"),
    )


_USAGE = "try_cast(nullif(usage_json, '') as json)"


def _count(*paths: str) -> str:
    values = ", ".join(
        f"nullif(try_cast(json_extract_string({_USAGE}, '$.{p}') as bigint), 0)" for p in paths
    )
    return f"coalesce({values}, 0)"


@query("usage_columns", fx.oracle(f"""
select request_id, {_count('input_tokens', 'inputTokens')} as input_tokens,
  {_count('output_tokens', 'outputTokens')} as output_tokens,
  coalesce(nullif({_count('total_tokens', 'totalTokens')}, 0),
    {_count('input_tokens', 'inputTokens')} + {_count('output_tokens', 'outputTokens')}) as total_tokens,
  {_count('output_tokens_details.reasoning_tokens')} as reasoning_tokens
from fx_runs"""))
def usage_columns(spark, sf_dir):
    return logs.usage(fx.fixture(spark, sf_dir, "fx_runs"))


@query("transient_errors", fx.oracle(f"""
select request_id, {D.squash('error_message')} as error_message from fx_runs
where regexp_matches(lower({D.squash('error_message')}), 'failed to connect|connection timeout|connect etimedout|request timeout|timeout expired|could not connect')"""))
def transient_errors(spark, sf_dir):
    runs = logs.normalise_runs(fx.fixture(spark, sf_dir, "fx_runs"))
    return logs.transient_errors(runs).select("request_id", "error_message")


@query("reference_meta", fx.oracle("""
select case_number, case_status, case_status in ('Verified - Good', 'Verified - Corrected') as learning_eligible,
  case case_status when 'Verified - Good' then 'positive' when 'Verified - Corrected' then 'corrective' else '' end
    as reference_type
from fx_cases"""))
def reference_meta_query(spark, sf_dir):
    cases = fx.fixture(spark, sf_dir, "fx_cases").select("case_number", "case_status")
    return reference_meta(cases, "case_status")


@query("product_search_text", fx.oracle(f"""
select product_url,
  {D.words("app_category || ' ' || 'Shop list' || ' ' || product_name || ' ' || sku || ' ' || brand || ' Make ' || brand")}
    as searchable_text,
  lower(product_name || ' ' || sku || ' ' || brand || ' Home ' || app_category || ' Make ' || brand) as classifier_text
from fx_products"""))
def product_search_text(spark, sf_dir):
    c, none = F.col, F.lit("")
    specs = F.array(F.struct(F.lit("Make").alias("key"), c("brand").alias("value")))
    trail = F.array(F.lit("Home"), none, c("app_category"))
    return fx.fixture(spark, sf_dir, "fx_products").select(
        "product_url",
        X.product_search_text(
            c("app_category"), F.lit("Shop list"), c("product_name"), c("sku"), c("brand"), none, specs
        ).alias("searchable_text"),
        X.classifier_text(c("product_name"), c("sku"), c("brand"), none, trail, specs).alias("classifier_text"),
    )


@query("listing_urls", fx.oracle("""
select source_label, n.page_no, case when source_type = 'search'
    then 'https://shop.example.com/store/catalogsearch/result/?q='
      || replace(replace(url_encode(query), '%20', '+'), '~', '%7E') || '&product_list_limit=72'
    else url || '?product_list_limit=72' end
    || case when n.page_no > 1 then '&p=' || cast(n.page_no as string) else '' end as listing_url,
  case when source_type = 'search' then 'https://shop.example.com/store/catalogsearch/result/?q='
    || replace(url_encode(query), '%21', '!') else url end as source_url
from fx_sources, (values (1), (2), (3)) n(page_no)"""))
def listing_urls_query(spark, sf_dir):
    listed = listing_urls(fx.sources(spark, sf_dir), 3, fx.ROOT)
    address = U.source_url(F.col("source_type"), F.col("url"), F.col("query"), fx.ROOT)
    return listed.select("source_label", "page_no", "listing_url", address.alias("source_url"))


def requests(spark, sf_dir):
    """One request per conversation turn: its lines are chat updates, its sentences files."""
    role, text = F.col("role"), F.col("text")
    form = {"application": role, "problem": text}
    blank = F.lit(None).cast("string")
    updates = F.transform(
        F.split(text, "\n"),
        lambda line: F.struct(
            line.alias("text"), F.array(role, F.lit("seen")).alias("insights"),
            F.split(line, "\\. ").alias("files"),
        ),
    )
    return fx.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", role.alias("category"),
        F.struct(*[form.get(n, blank).alias(n) for n in FORM_FIELDS]).alias("formData"),
        updates.alias("chatUpdates"),
        F.create_map(F.lit("turn"), F.col("turn").cast("string")).alias("followUpAnswers"),
        F.array_repeat(F.lit("photo"), (F.col("turn") % 5).cast("int")).alias("formPhotos"),
    )


_LINES = "string_split(text, chr(10))"
_COUNTS = f"""conv_id, turn, cast(1 as bigint) as answers, cast(len({_LINES}) as bigint) as updates,
  cast(list_sum(list_transform({_LINES}, lambda x: len(string_split(x, '. ')))) as bigint) as files,
  cast(turn % 5 as bigint) as photos"""


@query("payload_counts", f"select {_COUNTS} from conversations")
def payload_counts_query(spark, sf_dir):
    return payload_counts(requests(spark, sf_dir)).select("conv_id", "turn", "answers", "updates", "files", "photos")


_FORM = ", ".join(
    f"'{n}': {'role' if n == 'application' else 'text' if n == 'problem' else 'cast(null as string)'}" for n in FORM_FIELDS
)
_DOCUMENT = f"""to_json({{'category': role, 'formData': {{{_FORM}}},
  'chatUpdates': list_transform({_LINES}, lambda x: {{'text': x, 'insights': [role, 'seen'], 'files': string_split(x, '. ')}}),
  'followUpAnswers': {{'turn': cast(turn as string)}}, 'formPhotos': list_transform(range(turn % 5), lambda x: 'photo')}})"""


@query("route_requests", f"""
with counted as (select {_COUNTS}, cast(length(cast({_DOCUMENT} as string)) as bigint) as text_size, role from conversations),
scored as (select *, least(6, text_size // 450) + least(4, answers) + least(5, updates) + least(5, files)
  + least(3, photos) as score from counted)
select conv_id, turn, text_size, score, case when role = 'system' then 'gpt-5.4-mini' when score >= 10 then 'gpt-5.4'
  else 'gpt-5.4-mini' end as tier from scored""")
def route_requests_query(spark, sf_dir):
    wanted = F.when(F.col("category") == "system", " GPT-5.4-mini").when(F.col("category") == "user", "auto")
    counted = payload_counts(requests(spark, sf_dir))
    routed = route_requests(counted.withColumn("requested", wanted.otherwise("other")), "requested")
    return routed.select("conv_id", "turn", "text_size", "score", "tier")


_CHAT = f"array_to_string(list_transform({_LINES}, lambda x: x || ' ' || role || ' seen'), ' ')"


@query("case_search_text", f"""
select conv_id, turn, {D.words(f"role || ' ' || role || ' ' || text || ' ' || {_CHAT}")} as search_text
from conversations""")
def case_search_text(spark, sf_dir):
    return requests(spark, sf_dir).select("conv_id", "turn", X.case_search_text().alias("search_text"))
