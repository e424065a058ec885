"""Run, event and evaluation records and their roll-ups."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caseloom import schemas
from caseloom.functions.records import USAGE_SCHEMA, is_transient, read_variant, usage_columns
from caseloom.functions.text import clean_text, or_default, slug, text
from caseloom.operators.keyed import newest, newest_per_group, union_all, upsert
from caseloom.sources.tables import conform

# Fixed value: prompt version of a run that names none.
PROMPT_VERSION = "phase2-v1"
# Rows shown in a log view, and kept in a capped log.
SHOWN, CAPPED = 12, 150


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).try_cast("int"), F.lit(0))


def normalise_runs(df: DataFrame, prompt_version: str = PROMPT_VERSION, keep: list[str] | None = None) -> DataFrame:
    """Run rows as stored: defaults for blanks, category key, numbers cast, error text cleaned; ``keep`` adds columns as they are."""
    kept = [df.schema[name] for name in keep or []]
    df = conform(df, StructType([*schemas.RUN_LOGS.fields, *kept]))
    return df.select(
        "request_id",
        text(F.col("case_number")).alias("case_number"),
        text(F.col("category")).alias("category"),
        slug(F.col("category")).alias("category_slug"),
        text(F.col("user_name")).alias("user_name"),
        text(F.col("model")).alias("model"),
        or_default(F.col("prompt_version"), prompt_version).alias("prompt_version"),
        or_default(F.col("status"), "unknown").alias("status"),
        _number("latency_ms").alias("latency_ms"),
        _number("input_chars").alias("input_chars"),
        or_default(F.col("usage_json"), "{}").alias("usage_json"),
        clean_text(F.col("error_message"), 800).alias("error_message"),
        or_default(F.col("source"), "web").alias("source"),
        F.nullif(F.col("recommendation_json"), F.lit("")).alias("recommendation_json"),
        "created_at",
        *(keep or []),
    )


def normalise_events(df: DataFrame) -> DataFrame:
    """Event rows as stored."""
    df = conform(df, schemas.EVENT_LOGS)
    return df.select(
        clean_text(or_default(F.col("event_name"), "event"), 120).alias("event_name"),
        clean_text(F.col("event_detail"), 800).alias("event_detail"),
        clean_text(or_default(F.col("level"), "info"), 20).alias("level"),
        text(F.col("case_number")).alias("case_number"),
        text(F.col("category")).alias("category"),
        slug(F.col("category")).alias("category_slug"),
        text(F.col("request_id")).alias("request_id"),
        "created_at",
    )


def normalise_evals(df: DataFrame) -> DataFrame:
    """Evaluation rows as stored."""
    df = conform(df, schemas.EVALS)
    category = or_default(F.col("category"), "Other")
    return df.select(
        "case_number",
        category.alias("category"),
        slug(category).alias("category_slug"),
        text(F.col("user_name")).alias("user_name"),
        text(F.col("rating")).alias("rating"),
        text(F.col("evaluation_note")).alias("evaluation_note"),
        text(F.col("source_run_request_id")).alias("source_run_request_id"),
        or_default(F.col("case_payload"), "{}").alias("case_payload"),
        or_default(F.col("ai_response"), "{}").alias("ai_response"),
        "created_at",
    )


def run_summary(runs: DataFrame) -> DataFrame:
    """The twelve-column run view, usage as an open document."""
    return runs.select(
        "request_id", "case_number", "category", "user_name", "model", "prompt_version", "status", "latency_ms",
        "input_chars", read_variant(F.col("usage_json")).alias("usage_json"), "error_message", "created_at",
    )


def recent_runs(runs: DataFrame, n: int = SHOWN) -> DataFrame:
    """Top-n first: the documents of all other rows are never parsed."""
    return run_summary(newest(runs, n, "created_at", ["request_id"]))


def recent_events(events: DataFrame, n: int = SHOWN, tie: list[str] | None = None) -> DataFrame:
    shown = ["event_name", "event_detail", "level", "case_number", "category", "request_id", "created_at"]
    return newest(events.select(*shown), n, "created_at", tie or ["request_id", "event_name", "event_detail"])


def recent_evals(evals: DataFrame, n: int = SHOWN) -> DataFrame:
    shown = [
        "case_number", "category", "user_name", "rating", "evaluation_note", "source_run_request_id", "created_at",
    ]
    return newest(evals.select(*shown), n, "created_at", ["case_number", "source_run_request_id"])


def capped_log(df: DataFrame, tie: list[str], cap: int = CAPPED) -> DataFrame:
    return newest(df, cap, "created_at", tie)


def usage(runs: DataFrame) -> DataFrame:
    """Token counts of every run. The document is read in a step of its own, so once for all its fields."""
    read = runs.select("request_id", F.from_json("usage_json", USAGE_SCHEMA).alias("usage"))
    return read.select("request_id", *[c.alias(n) for n, c in usage_columns(F.col("usage")).items()])


def transient_errors(runs: DataFrame) -> DataFrame:
    """Runs whose error passes once the database is awake."""
    return runs.filter(is_transient(F.col("error_message")))


def _health(runs: DataFrame, timed: Column) -> DataFrame:
    ok = F.col("status") == "success"
    mean = F.round(F.avg(F.when(timed, F.col("latency_ms")))).cast("bigint")
    return runs.agg(
        F.count(F.when(ok, 1)).alias("successful_runs"),
        F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias("failed_runs"),
        F.coalesce(mean, F.lit(0)).alias("avg_latency_ms"),
    )


def run_health(runs: DataFrame, n: int = 6) -> DataFrame:
    """Outcome counts and mean latency of successes over the newest ``n`` runs only."""
    columns = runs.select("request_id", "status", "latency_ms", "created_at")
    return _health(newest(columns, n, "created_at", ["request_id"]), F.col("status") == "success")


def run_health_all(runs: DataFrame, successes_only: bool = True) -> DataFrame:
    """The same over the whole log; ``successes_only=False`` averages the latency of all runs."""
    return _health(runs, (F.col("status") == "success") if successes_only else F.lit(True))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the row count of each table; each scan reads no column."""
    counts = union_all(
        [df.agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name)) for name, df in tables.items()]
    )
    return counts.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables])


def upsert_runs(runs: DataFrame, new: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Every column is replaced on a match, ``created_at`` included."""
    return upsert(runs, new, "request_id", order)


def batch_states(rows: DataFrame, batch: Column, n: int, tie: list[str], columns: list[str], recency: str = "created_at") -> DataFrame:
    """What each batch of rows adds to the overview: ``(batch, rows, newest)``, ``newest`` being its newest ``n`` rows.

    States of disjoint batches merge in any order and any grouping, see ``merge_states``. The
    rows are ones that stay: of an append-only log, or of one snapshot of a table that changes.
    """
    rows = rows.select(batch.alias("batch"), *columns)
    counts = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"))
    top = newest_per_group(rows, "batch", recency, tie, n).groupBy("batch").agg(F.collect_list(F.struct(*columns)).alias("newest"))
    return counts.join(top, "batch")


def merge_states(states: DataFrame, n: int, tie: list[str], recency: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """The row count over all batches, and their newest ``n`` rows; folding merged states again gives the same."""
    total = states.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    return total, newest(states.select(F.inline("newest")), n, recency, tie)
