"""The overview of all tables, from the tables or from partial states of their batches."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.functions.text import or_default
from caseloom.operators import logs
from caseloom.operators.cases import status_counts
from caseloom.operators.keyed import union_all

# What a state keeps of the newest rows of each table: how many by default, order among equal times, columns.
LISTED = 200
STATES = {
    "good_cases": (LISTED, "updated_at", ["case_number"], ["case_number", "case_status", "updated_at"]),
    "bad_cases": (LISTED, "updated_at", ["case_number"], ["case_number", "case_status", "updated_at"]),
    "product_catalog_items": (1, "last_synced_at", ["product_url"], ["product_url", "last_synced_at"]),
    "ai_runs": (6, "created_at", ["request_id"], [
        "request_id", "case_number", "category", "user_name", "model", "prompt_version", "status", "latency_ms", "input_chars",
        "usage_json", "error_message", "created_at",
    ]),
    "event_logs": (6, "created_at", ["request_id", "event_name", "event_detail"], [
        "event_name", "event_detail", "level", "case_number", "category", "request_id", "created_at",
    ]),
    "eval_cases": (6, "created_at", ["case_number", "source_run_request_id"], [
        "case_number", "category", "user_name", "rating", "evaluation_note", "source_run_request_id", "created_at",
    ]),
}


def _sections(counts: DataFrame, statuses: DataFrame, runs: DataFrame, events: DataFrame, evals: DataFrame, shown: int) -> DataFrame:
    """One plan; ``item`` is a row's key, empty where a section is one row."""
    def unpivoted(df: DataFrame, section: str, item: Column) -> DataFrame:
        """Every column of every row as text; open documents as JSON."""
        fields = [
            F.struct(F.lit(name).alias("k"), (F.to_json(name) if kind == "variant" else F.col(name).cast("string")).alias("v"))
            for name, kind in df.dtypes
        ]
        pairs = df.select(item.alias("item"), F.explode(F.array(*fields)).alias("p"))
        return pairs.select(F.lit(section).alias("section"), "item", F.col("p.k").alias("field"), F.col("p.v").alias("value"))

    return union_all(
        [
            unpivoted(counts, "totals", F.lit("")),
            unpivoted(logs.run_health(runs, shown), "recent_health", F.lit("")),
            unpivoted(statuses, "status_counts", F.col("case_status")),
            unpivoted(logs.recent_runs(runs, shown), "recent_runs", F.col("request_id")),
            unpivoted(logs.recent_events(events, shown), "recent_events", F.col("request_id")),
            unpivoted(logs.recent_evals(evals, shown), "recent_evals", F.col("case_number")),
        ]
    )


def admin_summary(
    good: DataFrame, bad: DataFrame, catalog: DataFrame, runs: DataFrame, events: DataFrame, evals: DataFrame,
    shown: int = 6,
) -> DataFrame:
    """Totals, run health, status counts and the newest log rows, whole, as ``(section, item, field, value)``."""
    counts = logs.table_counts(
        {"good_cases": good, "bad_cases": bad, "product_catalog_items": catalog, "ai_runs": runs,
         "event_logs": events, "eval_cases": evals}
    )
    return _sections(counts, status_counts(good, bad, LISTED), runs, events, evals, shown)


def overview_states(name: str, rows: DataFrame, batch: Column) -> DataFrame:
    """States of one of the overview's tables, a row for each batch."""
    n, recency, tie, columns = STATES[name]
    return logs.batch_states(rows, batch, n, tie, columns, recency)


def admin_summary_of_states(states: dict[str, DataFrame], shown: int = 6) -> DataFrame:
    """The same overview from states ``(batch, rows, newest)`` of all six tables, which are not read."""
    merged = {name: logs.merge_states(states[name], n, tie, recency) for name, (n, recency, tie, _) in STATES.items()}
    totals = union_all([total.withColumn("name", F.lit(name)) for name, (total, _) in merged.items()])
    counts = totals.agg(*[F.max(F.when(F.col("name") == name, F.col("rows"))).alias(name) for name in STATES])
    listed = merged["good_cases"][1].unionByName(merged["bad_cases"][1])
    status = or_default(F.col("case_status"), schemas.CASE_DEFAULTS["case_status"]).alias("case_status")
    statuses = listed.groupBy(status).agg(F.count(F.lit(1)).alias("cases"))
    return _sections(counts, statuses, *(merged[name][1] for name in ("ai_runs", "event_logs", "eval_cases")), shown)
