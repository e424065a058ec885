"""Table schemas, column defaults and the fixed domain values.

Timestamps are ``timestamp_ntz`` holding UTC. JSON documents whose keys are not
known stay text; the ones the jobs read are typed (specs, trail, completed case).
"""

from pyspark.sql import types as T

S, L, I, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampNTZType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


# The case status domain.
DRAFT = "Draft"
AI_GENERATED = "AI Generated"
PENDING_REVIEW = "Pending Expert Review"
VERIFIED_GOOD = "Verified - Good"
VERIFIED_CORRECTED = "Verified - Corrected"
VERIFIED_REJECTED = "Verified - Rejected"
ARCHIVED = "Archived"
CASE_STATUSES = [
    DRAFT, AI_GENERATED, PENDING_REVIEW, VERIFIED_GOOD, VERIFIED_CORRECTED, VERIFIED_REJECTED, ARCHIVED,
]
# The statuses a review may set.
REVIEW_STATUSES = [VERIFIED_GOOD, VERIFIED_CORRECTED, VERIFIED_REJECTED, ARCHIVED]

# Fields of the completed-case document, all text.
COMPLETED_FIELDS = [
    "pdfName", "sqlFolderPath", "sharePointFolderPath", "sharePointLibrary", "sharePointRootFolder",
    "generatedAt", "uploadStatus", "finalStatus", "reviewerName", "reviewedAt", "sharePointFileUrl",
    "sharePointItemId", "uploadedAt",
]
COMPLETED = _struct(*[(name, S) for name in COMPLETED_FIELDS])

SPECS = T.ArrayType(_struct(("key", S), ("value", S)))

SEQUENCES = _struct(("name", S), ("last_value", L), ("updated_at", TS))

# One schema serves both rating tables.
CASES = _struct(
    ("case_number", S), ("pdf_name", S), ("category", S), ("category_slug", S), ("folder_path", S),
    ("rating", S), ("feedback_text", S), ("user_comment", S), ("case_status", S), ("expert_decision", S),
    ("expert_rating", S), ("expert_comment", S), ("corrected_recommendation", S), ("knowledge_value", S),
    ("reviewer_name", S), ("learning_eligible", B), ("reference_type", S), ("refer_historical_cases", B),
    ("referenced_case_numbers", S), ("case_payload", S), ("ai_response", S), ("completed_case", COMPLETED),
    ("reviewed_at", TS), ("created_at", TS), ("updated_at", TS),
)
CASE_DEFAULTS = {
    "feedback_text": "", "user_comment": "", "case_status": AI_GENERATED, "expert_decision": "",
    "expert_rating": "", "expert_comment": "", "corrected_recommendation": "", "knowledge_value": "",
    "reviewer_name": "", "learning_eligible": False, "reference_type": "", "refer_historical_cases": False,
    "referenced_case_numbers": "[]", "case_payload": "{}", "ai_response": "{}",
}
# Columns written by a review; saving a case again leaves them alone.
REVIEW_COLUMNS = [
    "expert_decision", "expert_rating", "expert_comment", "corrected_recommendation", "knowledge_value",
    "reviewer_name", "learning_eligible", "reference_type", "reviewed_at",
]

PRODUCTS = _struct(
    ("app_category", S), ("app_category_slug", S), ("source_type", S), ("source_label", S), ("source_url", S),
    ("product_name", S), ("product_slug", S), ("sku", S), ("brand", S), ("product_url", S), ("price_text", S),
    ("currency", S), ("availability", S), ("short_description", S), ("specs", SPECS),
    ("category_trail", T.ArrayType(S)), ("searchable_text", S), ("is_active", B), ("source_updated_at", TS),
    ("last_synced_at", TS),
)
PRODUCT_DEFAULTS = {
    "sku": "", "brand": "", "price_text": "", "currency": "MYR", "availability": "unknown",
    "short_description": "", "searchable_text": "", "is_active": True,
}

SYNC_RUNS = _struct(
    ("run_id", S), ("sync_scope", S), ("status", S), ("details_json", S), ("started_at", TS), ("finished_at", TS),
)

RUN_LOGS = _struct(
    ("request_id", S), ("case_number", S), ("category", S), ("category_slug", S), ("user_name", S), ("model", S),
    ("prompt_version", S), ("status", S), ("latency_ms", I), ("input_chars", I), ("usage_json", S),
    ("error_message", S), ("source", S), ("recommendation_json", S), ("created_at", TS),
)

EVENT_LOGS = _struct(
    ("event_name", S), ("event_detail", S), ("level", S), ("case_number", S), ("category", S),
    ("category_slug", S), ("request_id", S), ("created_at", TS),
)

EVALS = _struct(
    ("case_number", S), ("category", S), ("category_slug", S), ("user_name", S), ("rating", S),
    ("evaluation_note", S), ("source_run_request_id", S), ("case_payload", S), ("ai_response", S),
    ("created_at", TS),
)

PAGES = _struct(("url", S), ("html", S))

SOURCES = _struct(
    ("source_pos", I), ("app_category", S), ("source_type", S), ("source_label", S), ("url", S), ("query", S),
)
HINTS = _struct(("app_category_slug", S), ("hint", S))

# A case request as it arrives.
FORM_FIELDS = [
    "application", "problem", "additionalInfo", "existing", "type", "load", "environment", "priority", "industry",
]
REQUESTS = _struct(
    ("category", S),
    ("formData", _struct(*[(name, S) for name in FORM_FIELDS])),
    ("chatUpdates", T.ArrayType(_struct(("text", S), ("insights", T.ArrayType(S)), ("files", T.ArrayType(S))))),
    ("followUpAnswers", T.MapType(S, S)),
    ("formPhotos", T.ArrayType(S)),
)

# Stored tables by name, for read_table.
TABLES = {
    "case_sequences": SEQUENCES,
    "historical_case_good": CASES,
    "historical_case_bad": CASES,
    "product_catalog": PRODUCTS,
    "product_sync_runs": SYNC_RUNS,
    "ai_run_logs": RUN_LOGS,
    "app_event_logs": EVENT_LOGS,
    "eval_cases": EVALS,
}
