"""Streams over several micro-batches, with restart and replay."""

import pytest
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.operators.cases import assign_case_numbers
from caseloom.operators.keyed import keep_last
from caseloom.operators.logs import normalise_events, normalise_runs
from caseloom.sources.tables import new_path, read_snapshot, versions
from caseloom.streaming import jobs
from caseloom.workload import fixtures as fx
from caseloom.workload.stream_queries import event_rows, run_rows
from tests.helpers import dicts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def arrivals(spark):
    """Events in four files that arrive in time order."""
    events = fx.table(spark, SF, "events")
    quarter = F.ntile(4).over(fx_window())
    folder = new_path(spark, "arrivals")
    parts = events.withColumn("q", quarter)
    return events, parts, folder


def fx_window():
    from pyspark.sql import Window

    return Window.orderBy("ts", "event_id")


def _deliver(parts, folder, q):
    parts.filter(F.col("q") == q).drop("q").coalesce(1).write.mode("append").parquet(folder)


def test_streams_over_four_batches(spark, arrivals):
    events, parts, folder = arrivals
    sink, runs_root, numbers_root = (new_path(spark, n) for n in ("sink", "runs", "numbers"))
    marks = [new_path(spark, "marks") for _ in range(3)]
    for q in (1, 2, 3, 4):
        _deliver(parts, folder, q)
        source = jobs.file_stream(spark, folder, fx.TABLES["events"])
        jobs.stream_events(event_rows(source), sink, marks[0]).awaitTermination()
        jobs.stream_runs(run_rows(source), runs_root, marks[1], ["created_at", "latency_ms"]).awaitTermination()
        asked = source.select("event_id", F.col("event_type").alias("category"), "ts")
        jobs.stream_case_numbers(asked, numbers_root, marks[2], "ts", ["event_id"], fx.NOW).awaitTermination()

    logged = spark.read.schema(schemas.EVENT_LOGS).parquet(sink)
    expected = normalise_events(event_rows(events))
    assert dicts(logged, *logged.columns) == dicts(expected, *expected.columns)

    assert len(versions(spark, runs_root)) == 4
    latest = keep_last(normalise_runs(run_rows(events)), ["request_id"], ["created_at", "latency_ms"])
    assert dicts(jobs.current_runs(spark, runs_root), "request_id") == dicts(latest, "request_id")
    compacted = new_path(spark, "compacted")
    jobs.compact_runs(spark, runs_root, compacted)
    assert dicts(jobs.current_runs(spark, compacted), "request_id") == dicts(latest, "request_id")

    schema = spark.createDataFrame([], "event_id bigint, case_number string").schema
    got = dicts(jobs.assigned_requests(spark, numbers_root, schema), "event_id")
    none = spark.createDataFrame([], schemas.SEQUENCES)
    asked = events.select("event_id", F.col("event_type").alias("category"), "ts")
    whole = assign_case_numbers(asked, none, "ts", ["event_id"]).select("event_id", "case_number")
    assert got == dicts(whole, "event_id")


def test_a_replayed_batch_changes_nothing(spark, arrivals):
    """The progress of the last batch is lost, so the batch runs again under its id."""
    _, parts, _ = arrivals
    folder, root, mark = new_path(spark, "arrivals"), new_path(spark, "numbers"), new_path(spark, "marks")

    def run():
        source = jobs.file_stream(spark, folder, fx.TABLES["events"])
        asked = source.select("event_id", F.col("event_type").alias("category"), "ts")
        jobs.stream_case_numbers(asked, root, mark, "ts", ["event_id"], fx.NOW).awaitTermination()
        return dicts(jobs.assigned_requests(spark, root, schema), "event_id")

    schema = spark.createDataFrame([], "event_id bigint, case_number string").schema
    _deliver(parts, folder, 1)
    run()
    _deliver(parts, folder, 2)
    before = run()
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(mark).getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.delete(path(f"{mark}/commits/1"), False)
    fs.delete(path(f"{mark}/commits/.1.crc"), False)
    assert run() == before
    assert versions(spark, f"{root}/counters") == [0, 1]


def test_an_unfinished_version_does_not_count(spark):
    root = new_path(spark, "versions")
    spark.range(3).write.parquet(f"{root}/v={0:012d}")
    spark.range(3).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{root}/v={1:012d}")
    assert versions(spark, root) == [0]
    assert versions(spark, root + "-none") == []


def test_a_request_that_comes_again_keeps_its_number(spark):
    """In its own batch, in a later one, and when that batch runs again."""
    root, folder, mark = (new_path(spark, n) for n in ("numbers", "requests", "marks"))
    shape = "id string, category string, ts int"

    def run(rows):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(folder)
        source = jobs.file_stream(spark, folder, shape)
        jobs.stream_case_numbers(source, root, mark, "ts", ["id"], fx.NOW, "id").awaitTermination()
        given = jobs.assigned_requests(spark, root, spark.createDataFrame([], "id string, case_number string").schema)
        counters = read_snapshot(spark, f"{root}/counters", schemas.SEQUENCES)
        return {r["id"]: r["case_number"] for r in given.collect()}, {r["name"]: r["last_value"] for r in counters.collect()}

    assert run([("a", "x", 2), ("b", "x", 1), ("a", "x", 5)]) == ({"b": "x_00001", "a": "x_00002"}, {"case_number_x": 2})
    both = {"b": "x_00001", "a": "x_00002", "c": "x_00003", "d": "y_00001"}
    assert run([("b", "y", 9), ("a", "x", 0), ("c", "x", 7), ("d", "y", 8)]) == (both, {"case_number_x": 3, "case_number_y": 1})
    assert run([("c", "x", 1), ("d", "x", 1)]) == (both, {"case_number_x": 3, "case_number_y": 1})
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(mark).getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.delete(path(f"{mark}/commits/2"), False)
    fs.delete(path(f"{mark}/commits/.2.crc"), False)
    assert run([("e", "y", 1)]) == (both | {"e": "y_00002"}, {"case_number_x": 3, "case_number_y": 2})
