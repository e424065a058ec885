"""Continuous ingest with Structured Streaming.

Every stateful write goes to ``v=<batch id>``: a batch that is run again after a
failure replaces its own version and reads only those below it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from caseloom import schemas
from caseloom.operators.cases import advance_sequences, assign_case_numbers
from caseloom.operators.keyed import keep_last
from caseloom.operators.logs import normalise_events, normalise_runs
from caseloom.sources.tables import read_snapshot, stage, versions, write_snapshot


def file_stream(
    spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1000, glob: str = "*"
) -> DataFrame:
    """A stream over Parquet files arriving in a folder."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", glob)
        .parquet(path)
    )


def stream_events(source: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append normalised events; stateless, exactly once by the file sink's log."""
    return (
        normalise_events(source)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", sink)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_runs(source: DataFrame, root: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Keyed upsert of run rows as a log of changes.

    A batch writes only the last row per request it holds, never the whole table;
    ``current_runs`` merges on read and ``compact_runs`` folds the log.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        write_snapshot(keep_last(normalise_runs(batch), ["request_id"], order), root, batch_id)

    return (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_runs(spark: SparkSession, root: str) -> DataFrame:
    """The run table a change log stands for: per request the row of the latest batch."""
    schema = StructType([*schemas.RUN_LOGS.fields, schemas.T.StructField("v", schemas.L)])
    found = versions(spark, root)
    if not found:
        return spark.createDataFrame([], schemas.RUN_LOGS)
    paths = [f"{root}/v={v:012d}" for v in found]
    changes = spark.read.schema(schema).option("basePath", root).parquet(*paths)
    return keep_last(changes, ["request_id"], ["v"]).drop("v")


def compact_runs(spark: SparkSession, root: str, target: str) -> None:
    """Write the current state as the first version of a new log."""
    write_snapshot(current_runs(spark, root), target, 0)


def unnumbered(batch: DataFrame, given: DataFrame | None, key: str, moment: str, tie: list[str]) -> DataFrame:
    """The first request of each ``key`` in a batch, without those that ``given`` holds already."""
    first = F.min_by(F.struct(*batch.columns), F.struct(F.col(moment), *tie)).alias("_first")
    fresh = batch.groupBy(F.col(key).alias("_key")).agg(first)
    if given is not None:
        # What was given out is cut to the batch's keys first, so only keys that came again are carried on.
        again = given.select(F.col(key).alias("_key")).join(fresh.select("_key"), "_key", "left_semi").distinct()
        fresh = fresh.join(again, "_key", "left_anti")
    return fresh.select("_first.*")


def stream_case_numbers(
    source: DataFrame, root: str, checkpoint: str, moment: str, tie: list[str], now=None, key: str | None = None
) -> StreamingQuery:
    """Hand out case numbers per micro-batch, gap-free over all of them.

    Assigned requests go to ``root/assigned``, the counters (one row per category) to
    ``root/counters``. ``now`` stamps the counters; by default the batch's own clock. With
    ``key``, the column that names a request, a request that arrives again, in its batch or
    in a later one, keeps the number it has and moves no counter.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counters = read_snapshot(spark, f"{root}/counters", schemas.SEQUENCES, below=batch_id)
        if counters is None:
            counters = spark.createDataFrame([], schemas.SEQUENCES)
        if key:
            earlier = [v for v in versions(spark, f"{root}/assigned") if v < batch_id]
            asked = StructType([batch.schema[key]])
            given = spark.read.schema(asked).parquet(*[f"{root}/assigned/v={v:012d}" for v in earlier]) if earlier else None
            batch = stage(unnumbered(batch, given, key, moment, tie), "unnumbered")
        write_snapshot(assign_case_numbers(batch, counters, moment, tie), f"{root}/assigned", batch_id)
        stamp = F.localtimestamp() if now is None else now
        write_snapshot(advance_sequences(counters, batch, stamp), f"{root}/counters", batch_id)

    return (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def assigned_requests(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """All requests numbered so far."""
    paths = [f"{root}/assigned/v={v:012d}" for v in versions(spark, f"{root}/assigned")]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
