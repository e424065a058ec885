"""Queries that run a stream over the events table to its end and read what it wrote."""

from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.sources.tables import new_path, read_snapshot
from caseloom.streaming import jobs
from caseloom.workload import fixtures as fx
from caseloom.workload.case_queries import NUMBERED
from caseloom.workload.log_queries import EVENT_ROWS
from caseloom.workload.registry import query

def _events(spark, sf_dir):
    return jobs.file_stream(spark, sf_dir, fx.TABLES["events"], glob="events.parquet")


def event_rows(stream):
    """Raw events as the event log's input; the same mapping as the batch fixture."""
    return stream.select(
        F.col("event_type").alias("event_name"),
        F.concat(F.lit(" "), "props", F.lit("  ")).alias("event_detail"),
        F.when(F.col("event_type") == "error", "error").otherwise("").alias("level"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("category"),
        F.concat(F.lit("req_"), F.col("event_id").cast("string")).alias("request_id"),
        F.col("ts").alias("created_at"),
    )


def run_rows(stream):
    """Raw events as run rows: one request per user, so later events replace earlier ones."""
    return stream.select(
        F.concat(F.lit("user_run_"), F.col("user_id").cast("string")).alias("request_id"),
        F.col("event_type").alias("category"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.floor(F.col("value") * 10).cast("int").alias("latency_ms"),
        F.col("ts").alias("created_at"),
    )


@query("stream_events", fx.oracle(EVENT_ROWS))
def stream_events(spark, sf_dir):
    sink = new_path(spark, "stream-events")
    jobs.stream_events(event_rows(_events(spark, sf_dir)), sink, new_path(spark, "progress")).awaitTermination()
    return spark.read.schema(schemas.EVENT_LOGS).parquet(sink)


@query("stream_runs", fx.oracle("""
select request_id, category, category_slug, status, latency_ms, created_at from (
  select 'user_run_' || cast(user_id as string) as request_id, event_type as category, event_type as category_slug,
    case when event_type = 'error' then 'error' else 'success' end as status,
    cast(floor(value * 10) as int) as latency_ms, ts as created_at,
    row_number() over (partition by user_id order by ts desc, floor(value * 10) desc) as rn from events)
where rn = 1"""))
def stream_runs(spark, sf_dir):
    root = new_path(spark, "stream-runs")
    source = run_rows(_events(spark, sf_dir))
    jobs.stream_runs(source, root, new_path(spark, "progress"), ["created_at", "latency_ms"]).awaitTermination()
    current = jobs.current_runs(spark, root)
    return current.select("request_id", "category", "category_slug", "status", "latency_ms", "created_at")


@query("stream_case_numbers", fx.oracle(
    "with none as (select '' as name, 0 as last_value where false)" + NUMBERED.format(counters="none")
))
def stream_case_numbers(spark, sf_dir):
    root = new_path(spark, "stream-numbers")
    source = _events(spark, sf_dir).select("event_id", F.col("event_type").alias("category"), "ts")
    jobs.stream_case_numbers(source, root, new_path(spark, "progress"), "ts", ["event_id"], fx.NOW).awaitTermination()
    schema = spark.createDataFrame([], "event_id bigint, category string, case_number string").schema
    return jobs.assigned_requests(spark, root, schema)


# Requests of even users come first and once more with the others.
_REPEATED = NUMBERED.format(counters="none").replace("order by e.ts, e.event_id", "order by e.user_id % 2, e.ts, e.event_id")


@query("stream_repeated_requests", fx.oracle(
    "with none as (select '' as name, 0 as last_value where false)," + f"numbered as ({_REPEATED})"
    + """
select n.event_id, n.case_number, t.last_value from numbered n
join (select event_type, count(*) as last_value from events group by event_type) t on t.event_type = n.category"""
))
def stream_repeated_requests(spark, sf_dir):
    """Two batches of requests, the second of which holds those of the first again: numbers stay, counters do not move for them."""
    root, folder, progress = (new_path(spark, f"repeated-{n}") for n in ("numbers", "requests", "progress"))
    events = fx.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("category"), "ts")
    for part in (events.filter("user_id % 2 = 0"), events.unionByName(events.filter("user_id % 2 = 1"))):
        part.write.mode("append").parquet(folder)
        source = jobs.file_stream(spark, folder, events.schema)
        jobs.stream_case_numbers(source, root, progress, "ts", ["event_id"], fx.NOW, "event_id").awaitTermination()
    schema = spark.createDataFrame([], "event_id bigint, category string, case_number string").schema
    counters = read_snapshot(spark, f"{root}/counters", schemas.SEQUENCES)
    name = F.concat(F.lit("case_number_"), "category")
    assigned = jobs.assigned_requests(spark, root, schema).withColumn("name", name)
    return assigned.join(counters, "name").select("event_id", "case_number", "last_value")
