"""Queries over run, event and evaluation logs, and the overview."""

from pyspark.sql import functions as F

from caseloom.operators import logs
from caseloom.plans.admin import STATES, admin_summary, admin_summary_of_states, overview_states
from caseloom.sources.tables import append_table, new_path, stage
from caseloom import schemas
from caseloom.workload import duck as D
from caseloom.workload import fixtures as fx
from caseloom.workload.registry import query

_RUN_ROWS = f"""
select request_id, '' as case_number, category, {D.slug('category')} as category_slug, user_name, '' as model,
  'phase2-v1' as prompt_version, status, latency_ms, 0 as input_chars,
  coalesce(nullif(usage_json, ''), '{{}}') as usage_json, left({D.squash('error_message')}, 800) as error_message,
  'web' as source, props as recommendation_json, created_at from fx_runs"""
EVENT_ROWS = f"""
select event_name, left({D.squash('event_detail')}, 800) as event_detail, coalesce(nullif(level, ''), 'info') as level,
  '' as case_number, category, {D.slug('category')} as category_slug, request_id, created_at from fx_event_rows"""
_EVAL_ROWS = f"""
select case_number, coalesce(nullif(category, ''), 'Other') as category,
  {D.slug("coalesce(nullif(category, ''), 'Other')")} as category_slug, user_name, rating, evaluation_note,
  '' as source_run_request_id, '{{}}' as case_payload, '{{}}' as ai_response, created_at from fx_evals"""


def runs(spark, sf_dir):
    rows = fx.fixture(spark, sf_dir, "fx_runs").withColumnRenamed("props", "recommendation_json")
    return logs.normalise_runs(rows)


def events(spark, sf_dir):
    return logs.normalise_events(fx.fixture(spark, sf_dir, "fx_event_rows"))


def evals(spark, sf_dir):
    return logs.normalise_evals(fx.fixture(spark, sf_dir, "fx_evals"))


@query("normalise_runs", fx.oracle(_RUN_ROWS))
def normalise_runs(spark, sf_dir):
    return runs(spark, sf_dir)


@query("normalise_events", fx.oracle(EVENT_ROWS))
def normalise_events(spark, sf_dir):
    return events(spark, sf_dir)


@query("normalise_evals", fx.oracle(_EVAL_ROWS))
def normalise_evals(spark, sf_dir):
    return evals(spark, sf_dir)


@query("event_append", fx.oracle(EVENT_ROWS))
def event_append(spark, sf_dir):
    """Two appends to one new table, read back."""
    path = new_path(spark, "events")
    rows = events(spark, sf_dir)
    append_table(rows.filter("level = 'error'"), path)
    append_table(rows.filter("level <> 'error'"), path)
    return spark.read.schema(schemas.EVENT_LOGS).parquet(path)


@query("recent_runs", fx.oracle(f"""
select request_id, case_number, category, user_name, model, prompt_version, status, latency_ms, input_chars,
  case when json_valid(usage_json) then json_extract_string(usage_json, '$.totalTokens') end as usage_total,
  error_message, created_at
from ({_RUN_ROWS}) order by created_at desc, request_id limit 12"""))
def recent_runs(spark, sf_dir):
    recent = logs.recent_runs(runs(spark, sf_dir))
    total = F.try_variant_get("usage_json", "$.totalTokens", "string")
    return recent.withColumn("usage_total", total).drop("usage_json")


@query("recent_events", fx.oracle(f"""
select event_name, event_detail, level, case_number, category, request_id, created_at
from ({EVENT_ROWS}) order by created_at desc, request_id limit 12"""))
def recent_events(spark, sf_dir):
    return logs.recent_events(events(spark, sf_dir))


@query("recent_evals", fx.oracle(f"""
select case_number, category, user_name, rating, evaluation_note, source_run_request_id, created_at
from ({_EVAL_ROWS}) order by created_at desc nulls last, case_number limit 12"""))
def recent_evals(spark, sf_dir):
    return logs.recent_evals(evals(spark, sf_dir))


@query("capped_log", fx.oracle("select request_id, created_at from fx_runs order by created_at desc, request_id limit 150"))
def capped_log(spark, sf_dir):
    return logs.capped_log(runs(spark, sf_dir).select("request_id", "created_at"), ["request_id"])


def _health(source: str, timed: str) -> str:
    return f"""
select count(*) filter (where status = 'success') as successful_runs,
  count(*) filter (where status <> 'success') as failed_runs,
  coalesce(cast(round(avg(latency_ms) filter (where {timed})) as bigint), 0) as avg_latency_ms from {source}"""


_OK = "status = 'success'"
_NEWEST = "(select * from fx_runs order by created_at desc, request_id limit 6)"


@query("run_health", fx.oracle(_health(_NEWEST, _OK)))
def run_health(spark, sf_dir):
    return logs.run_health(runs(spark, sf_dir))


@query("run_health_all", fx.oracle(
    f"select 'successes' as scope, * from ({_health('fx_runs', _OK)}) "
    f"union all select 'all', * from ({_health('fx_runs', 'true')})"
))
def run_health_all(spark, sf_dir):
    rows = runs(spark, sf_dir)
    ok = logs.run_health_all(rows).withColumn("scope", F.lit("successes"))
    return ok.unionByName(logs.run_health_all(rows, False).withColumn("scope", F.lit("all")))


_COUNTS = """
select (select count(*) from fx_cases where rating = 'good') as good_cases,
  (select count(*) from fx_cases where rating = 'bad') as bad_cases,
  (select count(*) from fx_products) as product_catalog_items, (select count(*) from fx_runs) as ai_runs,
  (select count(*) from fx_event_rows) as event_logs, (select count(*) from fx_evals) as eval_cases"""


@query("table_counts", fx.oracle(_COUNTS))
def table_counts(spark, sf_dir):
    good, bad = fx.case_tables(spark, sf_dir)
    return logs.table_counts(
        {"good_cases": good, "bad_cases": bad, "product_catalog_items": fx.catalog(spark, sf_dir),
         "ai_runs": runs(spark, sf_dir), "event_logs": events(spark, sf_dir), "eval_cases": evals(spark, sf_dir)}
    )


@query("upsert_runs", fx.oracle("""
with latest as (select request_id, arg_max(status, attempt) as status, arg_max(latency_ms, attempt) as latency_ms,
  max(created_at) as created_at from fx_run_changes group by request_id)
select * from latest
union all select request_id, status, latency_ms, created_at from fx_runs r
where not exists (select 1 from latest l where l.request_id = r.request_id)"""))
def upsert_runs(spark, sf_dir):
    changes = fx.fixture(spark, sf_dir, "fx_run_changes")
    full = logs.normalise_runs(changes, keep=["attempt"])
    after = logs.upsert_runs(runs(spark, sf_dir), full, ["attempt"])
    return after.select("request_id", "status", "latency_ms", "created_at")


_TOP = "order by updated_at desc nulls last, case_number limit 200"


def _unpivoted(section: str, item: str, columns: str, rows: str) -> str:
    """Every column of ``rows`` as a row of text; unpivoting drops nulls, so they go through as a mark."""
    texts = ", ".join(f"coalesce(cast({c} as string), '(null)') as {c}" for c in columns.split())
    return (
        f"select '{section}', _item, field, nullif(value, '(null)') from (unpivot (select {item} as _item, {texts} from {rows})"
        f" on columns(* exclude (_item)) into name field value value)"
    )


# The usage documents of the runs as a variant prints them: no blanks, keys in order.
_USAGE = """case when usage_json like '%totalTokens%'
  then '{"inputTokens":"3","output_tokens_details":{"reasoning_tokens":4},"totalTokens":9}'
  when json_valid(usage_json) then cast(json(usage_json) as string) else '{}' end"""
_RUN_VIEW = (
    "request_id case_number category user_name model prompt_version status latency_ms input_chars usage_json "
    "error_message created_at"
)
_EVENT_VIEW = "event_name event_detail level case_number category request_id created_at"
_EVAL_VIEW = "case_number category user_name rating evaluation_note source_run_request_id created_at"


_OVERVIEW = fx.oracle(f"""
with counts as ({_COUNTS}), health as ({_health(_NEWEST, _OK)}),
listed as ((select * from fx_cases where rating = 'good' {_TOP}) union all
  (select * from fx_cases where rating = 'bad' {_TOP})),
statuses as (select coalesce(nullif(case_status, ''), 'AI Generated') as case_status, count(*) as cases from listed group by 1),
run_view as (select * replace ({_USAGE} as usage_json) from ({_RUN_ROWS}) order by created_at desc, request_id limit 6),
event_view as (select * from ({EVENT_ROWS}) order by created_at desc, request_id limit 6),
eval_view as (select * from ({_EVAL_ROWS}) order by created_at desc nulls last, case_number limit 6)
select '' as section, '' as item, '' as field, '' as value where false
union all {_unpivoted('totals', "''", 'good_cases bad_cases product_catalog_items ai_runs event_logs eval_cases', 'counts')}
union all {_unpivoted('recent_health', "''", 'successful_runs failed_runs avg_latency_ms', 'health')}
union all {_unpivoted('status_counts', 'case_status', 'case_status cases', 'statuses')}
union all {_unpivoted('recent_runs', 'request_id', _RUN_VIEW, 'run_view')}
union all {_unpivoted('recent_events', 'request_id', _EVENT_VIEW, 'event_view')}
union all {_unpivoted('recent_evals', 'case_number', _EVAL_VIEW, 'eval_view')}""")


@query("admin_summary", _OVERVIEW)
def admin_summary_query(spark, sf_dir):
    return admin_summary(*overview_tables(spark, sf_dir).values())


def overview_tables(spark, sf_dir):
    good, bad = fx.case_tables(spark, sf_dir)
    tables = [good, bad, fx.catalog(spark, sf_dir), runs(spark, sf_dir), events(spark, sf_dir), evals(spark, sf_dir)]
    return dict(zip(STATES, tables))


@query("admin_summary_states", _OVERVIEW)
def admin_summary_states(spark, sf_dir):
    """Each table arrives in batches, each batch leaves a state, and the overview reads the states alone."""
    states = {}
    for name, rows in overview_tables(spark, sf_dir).items():
        key = STATES[name][2][0]
        states[name] = stage(overview_states(name, rows, F.pmod(F.xxhash64(key), F.lit(5))), "states")
    return admin_summary_of_states(states)
