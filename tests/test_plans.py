"""Plans the jobs are meant to have."""

import re

import pytest
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.operators import cases, logs
from caseloom.operators.catalog import page_records, upsert_products
from caseloom.operators.crawl import listing_links
from caseloom.plans import admin
from caseloom.plans.catalog_sync import next_catalog
from caseloom.sources.dimensions import catalog_sources
from caseloom.sources.tables import new_path, read_pages, read_table
from caseloom.workload.log_queries import overview_tables
from tests.helpers import dicts

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark):
    """Empty stored tables: enough for the planner."""
    def make(name):
        path = new_path(spark, name)
        spark.createDataFrame([], schemas.TABLES[name]).write.parquet(path)
        return read_table(spark, name, path)

    return make


def test_list_reads_only_its_columns(spark, stored):
    good, bad = stored("historical_case_good"), stored("historical_case_bad")
    plan = _plan(cases.list_cases(good, bad, status="Archived", category="Belt"))
    assert plan.count("TakeOrderedAndProject") == 2
    assert "case_payload" not in plan and "ai_response" not in plan
    assert "EqualTo(case_status,Archived)" in plan and "EqualTo(category,Belt)" in plan


def test_newest_runs_sort_before_parsing(spark, stored):
    plan = _plan(logs.recent_runs(stored("ai_run_logs")))
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_counts_read_no_columns(spark, stored):
    plan = _plan(logs.table_counts({"runs": stored("ai_run_logs"), "events": stored("app_event_logs")}))
    assert plan.count("ReadSchema: struct<>") == 2


def test_small_changes_leave_the_table_in_place(spark, stored):
    """An upsert of few rows probes the catalog where it lies: no exchange of the table."""
    catalog = stored("product_catalog")
    changes = stored("product_catalog")
    plan = _plan(upsert_products(catalog, changes))
    assert "BroadcastHashJoin" in plan and "hashpartitioning(product_url" not in plan


def test_few_reviews_leave_the_tables_in_place(spark, stored):
    good, bad = stored("historical_case_good"), stored("historical_case_bad")
    patches = good.select("case_number", "completed_case", F.lit(1).alias("patch_no"))
    after, _, _ = cases.patch_completed(good, bad, patches, ["patch_no"], "2024-06-01 00:00:00")
    # The patches are grouped and the good table is joined to them where it lies.
    scans = [line for line in _plan(after).splitlines() if "SortMergeJoin" in line]
    assert scans == []


def test_sync_shuffles_the_catalog_once(spark, stored):
    products = stored("product_catalog").withColumn("source_pos", F.lit(1))
    sources = catalog_sources(spark, "https://shop.example.com")
    plan = _plan(next_catalog(stored("product_catalog"), products, sources, "2024-06-01 00:00:00"))
    assert len(re.findall(r"Exchange hashpartitioning\(product_url", plan)) == 1


def test_pages_are_read_without_a_shuffle(spark):
    path = new_path(spark, "pages")
    spark.createDataFrame([], schemas.PAGES).write.parquet(path)
    pages = read_pages(spark, path)
    assert "Exchange" not in _plan(page_records(pages, "https://shop.example.com", "/store"))
    listed = pages.withColumn("source_label", F.lit("x")).withColumn("page_no", F.lit(1))
    plan = _plan(listing_links(listed, "https://shop.example.com", "/store"))
    assert "Exchange" not in plan and "ReadSchema: struct<html:string>" in plan


@pytest.mark.parametrize("batches", [1, 7])
def test_overview_from_states(spark, batches):
    """Any split into batches, folded at once or in two steps, gives what the tables give."""
    tables = overview_tables(spark, SF)
    want = dicts(admin.admin_summary(*tables.values()), "section", "item", "field", "value")
    states = {}
    for name, rows in tables.items():
        n, recency, tie, columns = admin.STATES[name]
        found = admin.overview_states(name, rows, F.pmod(F.xxhash64(tie[0]), F.lit(batches)))
        # Half of the states are merged first and stand for one batch from then on.
        total, top = logs.merge_states(found.filter("batch % 2 = 0"), n, tie, recency)
        folded = top.agg(F.collect_list(F.struct(*columns)).alias("newest")).join(total).select(F.lit(-1).cast("bigint").alias("batch"), "rows", "newest")
        states[name] = found.filter("batch % 2 = 1").select(F.col("batch").cast("bigint"), "rows", "newest").unionByName(folded)
    assert dicts(admin.admin_summary_of_states(states), "section", "item", "field", "value") == want
