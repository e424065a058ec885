"""Case tables: views, filters, saving, review, numbering.

Two tables hold the cases, one per rating. Status, category and case number are
compared exactly; the search term is matched without regard to case.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.functions.records import (
    case_number,
    folder_path,
    learning_eligible,
    read_json,
    read_variant,
    reference_type,
    sequence_key,
)
from caseloom.functions.text import WS_CHARS, clean_large_text, clean_text, js_trim, or_default, slug, text
from caseloom.operators.keyed import as_ntz, number_in_order, upsert

# Rows listed when no limit is given, and at most, per table.
LISTED, MOST_LISTED = 60, 250
# Reasons a row is turned away.
NO_STATUS = "A verified case status is required."
NO_CORRECTION = "Corrected recommendation is required for Verified - Corrected."
NOT_FOUND = "Case not found."
REQUIRED_CASE = {"case_number": "casePayload.caseNumber is required.", "pdf_name": "pdfName is required."}
REQUIRED_EVAL = {"case_number": "caseNumber is required."}
REQUIRED_CATEGORY = {"category": "category is required."}  # Of a case-number request; looked at trimmed.
_UPLOAD = "Completed PDF upload data is incomplete."
REQUIRED_UPLOAD = {"filename": _UPLOAD, "folder_path": _UPLOAD, "data": _UPLOAD}  # Looked at trimmed.

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _status() -> Column:
    return or_default(F.col("case_status"), schemas.AI_GENERATED).alias("case_status")


def _blank(name: str) -> Column:
    return text(F.col(name)).alias(name)


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)).alias(name)


def _updated() -> Column:
    return F.coalesce(F.col("updated_at"), F.col("created_at")).alias("updated_at")


def case_detail(df: DataFrame, table: str) -> DataFrame:
    """Whole case rows: blanks for missing text, documents parsed, tagged with their table."""
    numbers = read_json(F.col("referenced_case_numbers"), "array<string>", F.array().cast("array<string>"))
    return df.select(
        "case_number", "pdf_name", "category", "category_slug", "folder_path", "rating", "feedback_text",
        _blank("user_comment"), _status(), _blank("expert_decision"), _blank("expert_rating"),
        _blank("expert_comment"), _blank("corrected_recommendation"), _blank("knowledge_value"),
        _blank("reviewer_name"), _flag("learning_eligible"), _blank("reference_type"),
        _flag("refer_historical_cases"), numbers.alias("referenced_case_numbers"),
        read_variant(F.col("case_payload")).alias("case_payload"),
        read_variant(F.col("ai_response")).alias("ai_response"),
        "completed_case", "reviewed_at", "created_at", _updated(), F.lit(table).alias("source_table"),
    )


def case_summary(df: DataFrame) -> DataFrame:
    """The fifteen-column list view; wide documents are never read."""
    return df.select(
        "case_number", "category", "category_slug", "rating", _status(), _blank("user_comment"),
        _blank("expert_decision"), _blank("expert_rating"), _blank("reviewer_name"), _flag("learning_eligible"),
        _blank("reference_type"), "created_at", _updated(), "reviewed_at", _blank("pdf_name"),
    )


def filter_cases(df: DataFrame, status: str = "", category: str = "", search: str = "") -> DataFrame:
    """Optional equality on status and category and a contains-search over four columns.

    ``%`` and ``_`` in the search term act as wildcards; a backslash is an ordinary character.
    """
    status, category = (status or "").strip(WS_CHARS), (category or "").strip(WS_CHARS)
    search = re.sub(f"[{WS_CHARS}]+", " ", search or "").strip(" ")[:120]
    if status:
        df = df.filter(F.col("case_status") == status)
    if category:
        df = df.filter(F.col("category") == category)
    if search:
        pattern = "%" + search.replace("\\", "\\\\") + "%"
        hit = F.lit(False)
        for name in ("case_number", "category", "user_comment", "expert_comment"):
            hit = hit | F.col(name).ilike(pattern)
        df = df.filter(hit)
    return df


def list_cases(
    good: DataFrame, bad: DataFrame, status: str = "", category: str = "", search: str = "", limit: int | None = LISTED
) -> DataFrame:
    """Newest cases of both tables. The limit holds for each table, so up to twice as many rows come back."""
    limit = max(1, min(limit or LISTED, MOST_LISTED))

    def branch(df: DataFrame) -> DataFrame:
        rows = filter_cases(df, status, category, search)
        return case_summary(rows.orderBy(F.col("updated_at").desc(), "case_number").limit(limit))

    return branch(good).unionByName(branch(bad)).orderBy(F.col("updated_at").desc(), "case_number")


def status_counts(good: DataFrame, bad: DataFrame, limit: int = 200) -> DataFrame:
    """Cases per status over the newest ``limit`` rows of each table."""
    return list_cases(good, bad, limit=limit).groupBy("case_status").agg(F.count(F.lit(1)).alias("cases"))


def lookup_cases(good: DataFrame, bad: DataFrame, keys: DataFrame) -> DataFrame:
    """Whole rows of the asked case numbers; a number in both tables is taken from the good one."""
    keys = keys.select("case_number")
    in_good = good.join(keys, "case_number", "left_semi")
    in_bad = bad.join(keys, "case_number", "left_semi").join(in_good.select("case_number"), "case_number", "left_anti")
    return case_detail(in_good, "historical_case_good").unionByName(case_detail(in_bad, "historical_case_bad"))


def _split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def split_valid_rows(df: DataFrame, required: dict[str, str], trimmed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with the message of their first blank required column."""
    reason = F.lit(None).cast("string")
    for name, message in reversed(required.items()):
        value = js_trim(F.col(name)) if trimmed else text(F.col(name))
        reason = F.when(value == "", message).otherwise(reason)
    return _split(df, reason)


def split_valid_reviews(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted reviews, and rejected ones with the reason."""
    status = js_trim(F.col("case_status"))
    no_correction = (status == schemas.VERIFIED_CORRECTED) & (js_trim(F.col("corrected_recommendation")) == "")
    reason = F.when(~status.isin(schemas.REVIEW_STATUSES), NO_STATUS).when(no_correction, NO_CORRECTION)
    return _split(reviews.withColumn("case_status", status), reason)


def remove_from_other(other: DataFrame, incoming: DataFrame) -> DataFrame:
    """The opposite rating's table without the cases now saved elsewhere."""
    return other.join(incoming.select("case_number"), "case_number", "left_anti")


def save_cases(
    good: DataFrame, bad: DataFrame, incoming: DataFrame, order: list[str], now
) -> tuple[DataFrame, DataFrame]:
    """Both tables after saving ``incoming`` in ``order``.

    A rating other than "bad" is good. Saving a case again under its rating keeps
    ``created_at`` and everything a review wrote; under the other rating it moves and
    loses both. A batch that moves a case away and back loses them as well, as the saves
    one by one would.
    """
    moment = as_ntz(now)
    rating = F.when(F.col("rating") == "bad", "bad").otherwise("good")
    category = or_default(F.col("category"), "Other")
    fields = {
        "pdf_name": text(F.col("pdf_name")),
        "category": category,
        "category_slug": slug(category),
        "folder_path": folder_path(rating, category, F.col("pdf_name")),
        "rating": rating,
        "feedback_text": text(F.col("feedback_text")),
        "user_comment": text(F.col("user_comment")),
        "case_status": or_default(F.col("case_status"), schemas.PENDING_REVIEW),
        "refer_historical_cases": F.coalesce(F.col("refer_historical_cases"), F.lit(False)),
        "referenced_case_numbers": or_default(F.col("referenced_case_numbers"), "[]"),
        "case_payload": or_default(F.col("case_payload"), "{}"),
        "ai_response": or_default(F.col("ai_response"), "{}"),
        "completed_case": F.col("completed_case"),
    }
    last = (
        incoming.groupBy("case_number")
        .agg(
            F.max_by(F.struct(*[c.alias(n) for n, c in fields.items()]), F.struct(*order)).alias("_row"),
            (F.min(rating) != F.max(rating)).alias("_moved"),
        )
        .select("case_number", "_row.*", "_moved")
    )

    def after(table: DataFrame, value: str) -> DataFrame:
        kept = [*schemas.REVIEW_COLUMNS, "created_at"]
        mine = last.filter(F.col("rating") == value)
        old = table.select("case_number", F.lit(True).alias("_found"), *[F.col(c).alias(f"_old_{c}") for c in kept])
        old = old.join(last.select("case_number"), "case_number", "left_semi")
        again = F.col("_found") & ~F.col("_moved")
        fresh = {name: "" for name in kept} | {
            "learning_eligible": False, "reviewed_at": F.lit(None).cast("timestamp_ntz"), "created_at": moment,
        }
        written = mine.join(old, "case_number", "left").select(
            "case_number", *fields, moment.alias("updated_at"),
            *[
                F.when(again, F.col(f"_old_{c}"))
                .otherwise(fresh[c] if isinstance(fresh[c], Column) else F.lit(fresh[c])).alias(c)
                for c in kept
            ],
        )
        return remove_from_other(table, last).unionByName(written.select(*table.columns))

    return after(good, "good"), after(bad, "bad")


def clean_reviews(reviews: DataFrame, root_folder: str = "") -> DataFrame:
    """Reviews cut and defaulted; the completed-case part, if there is one, always carries its seven fields."""
    c = F.col("completed_case")
    cleaned = F.struct(
        clean_text(c["pdfName"], 255).alias("pdfName"),
        clean_text(c["sqlFolderPath"], 400).alias("sqlFolderPath"),
        clean_text(c["sharePointFolderPath"], 500).alias("sharePointFolderPath"),
        clean_text(c["sharePointLibrary"], 120).alias("sharePointLibrary"),
        clean_text(or_default(c["sharePointRootFolder"], root_folder), 120).alias("sharePointRootFolder"),
        clean_text(c["generatedAt"], 80).alias("generatedAt"),
        clean_text(or_default(c["uploadStatus"], "pending"), 40).alias("uploadStatus"),
    )
    return (
        reviews.withColumn("case_number", js_trim(F.col("case_number")))
        .withColumn("expert_rating", js_trim(F.col("expert_rating")))
        .withColumn("expert_comment", clean_large_text(F.col("expert_comment"), 6000))
        .withColumn("corrected_recommendation", clean_large_text(F.col("corrected_recommendation"), 6000))
        .withColumn("knowledge_value", clean_text(F.col("knowledge_value"), 20))
        .withColumn("reviewer_name", clean_text(F.col("reviewer_name"), 255))
        .withColumn("completed_case", F.when(c.isNotNull(), cleaned))
    )


REVIEW_FIELDS = [
    "case_status", "expert_rating", "expert_comment", "corrected_recommendation", "knowledge_value", "reviewer_name",
]
REVIEW_COMPLETED = [
    "pdfName", "sqlFolderPath", "sharePointFolderPath", "sharePointLibrary", "sharePointRootFolder", "generatedAt",
    "uploadStatus",
]


def _known(good: DataFrame, bad: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Changes for the good table, for the bad table (good wins), and for no case at all.

    The tables are first cut to the changed numbers, so with few changes neither is shuffled.
    """
    keys = changes.select("case_number")
    in_good = good.select("case_number").join(keys, "case_number", "left_semi")
    in_bad = bad.select("case_number").join(keys, "case_number", "left_semi")
    elsewhere = changes.join(in_good, "case_number", "left_anti")
    return (
        changes.join(in_good, "case_number", "left_semi"),
        elsewhere.join(in_bad, "case_number", "left_semi"),
        elsewhere.join(in_bad, "case_number", "left_anti"),
    )


def apply_reviews(
    good: DataFrame, bad: DataFrame, reviews: DataFrame, order: list[str], now, root_folder: str = ""
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables after the reviews, and the rejected reviews with their reason.

    The last review of a case wins. The completed-case fields come from the last review
    that has that part; its reviewer is the last one named, or else stays.
    """
    accepted, rejected = split_valid_reviews(reviews)
    when = F.struct(*order)
    has_part = F.col("completed_case").isNotNull()
    named = has_part & (F.col("reviewer_name") != "")
    part = F.struct(
        *[F.col(f"completed_case.{name}").alias(name) for name in REVIEW_COMPLETED],
        F.col("case_status").alias("finalStatus"),
    )
    latest = (
        clean_reviews(accepted, root_folder)
        .groupBy("case_number")
        .agg(
            F.max_by(F.struct(*REVIEW_FIELDS), when).alias("_review"),
            F.max_by(part, F.when(has_part, when)).alias("_part"),
            F.max_by("reviewer_name", F.when(named, when)).alias("_reviewer"),
        )
    )
    to_good, to_bad, unknown = _known(good, bad, latest)
    moment = as_ntz(now)

    def after(table: DataFrame, changes: DataFrame) -> DataFrame:
        hit, review = F.col("_review").isNotNull(), F.col("_review")
        old, part = F.col("completed_case"), F.col("_part")
        merged = {name: part[name] for name in [*REVIEW_COMPLETED, "finalStatus"]} | {
            "reviewerName": F.coalesce(F.col("_reviewer"), text(old["reviewerName"])),
            "reviewedAt": F.date_format(moment, ISO),
        }
        document = F.struct(*[merged.get(name, old[name]).alias(name) for name in schemas.COMPLETED_FIELDS])
        new = {name: review[name] for name in REVIEW_FIELDS} | {
            "expert_decision": review["case_status"],
            "learning_eligible": learning_eligible(review["case_status"]),
            "reference_type": reference_type(review["case_status"]),
            "completed_case": F.when(part.isNotNull(), document).otherwise(old),
            "reviewed_at": moment,
            "updated_at": moment,
        }
        return table.join(changes, "case_number", "left").select(
            *[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns]
        )

    turned_away = rejected.select("case_number", "reason").unionByName(
        unknown.select("case_number", F.lit(NOT_FOUND).alias("reason"))
    )
    return after(good, to_good), after(bad, to_bad), turned_away


def patch_completed(
    good: DataFrame, bad: DataFrame, patches: DataFrame, order: list[str], now
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables after patching completed-case fields, and the patches for unknown cases.

    A NULL field is absent and leaves the old value; a blank one is present and replaces it.
    """
    when = F.struct(*order)
    fields = [F.col(f"completed_case.{name}") for name in schemas.COMPLETED_FIELDS]
    latest = patches.groupBy("case_number").agg(
        F.struct(
            *[
                F.max_by(field, F.when(field.isNotNull(), when)).alias(name)
                for name, field in zip(schemas.COMPLETED_FIELDS, fields)
            ]
        ).alias("_patch")
    )
    to_good, to_bad, unknown = _known(good, bad, latest)
    moment = as_ntz(now)

    def after(table: DataFrame, changes: DataFrame) -> DataFrame:
        hit, patch, old = F.col("_patch").isNotNull(), F.col("_patch"), F.col("completed_case")
        document = F.struct(*[F.coalesce(patch[n], old[n]).alias(n) for n in schemas.COMPLETED_FIELDS])
        new = {"completed_case": document, "updated_at": moment}
        return table.join(changes, "case_number", "left").select(
            *[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns]
        )

    return after(good, to_good), after(bad, to_bad), unknown.select("case_number", F.lit(NOT_FOUND).alias("reason"))


def assign_case_numbers(requests: DataFrame, sequences: DataFrame, moment: str, tie: list[str]) -> DataFrame:
    """Requests ``(category, ...)`` with the next case numbers of their category, in arrival order."""
    keyed = requests.withColumn("sequence_key", sequence_key(F.col("category")))
    offsets = sequences.select(F.col("name").alias("sequence_key"), F.col("last_value").alias("start"))
    numbered = number_in_order(keyed, "sequence_key", moment, tie, "sequence", offsets)
    return numbered.withColumn("case_number", case_number(F.col("category"), F.col("sequence")))


def advance_sequences(sequences: DataFrame, requests: DataFrame, now) -> DataFrame:
    """Counters after handing out one number per request; a count per category, no numbering needed."""
    used = requests.groupBy(sequence_key(F.col("category")).alias("name")).agg(F.count(F.lit(1)).alias("_used"))
    changes = used.join(sequences.select("name", "last_value"), "name", "left").select(
        "name", (F.coalesce(F.col("last_value"), F.lit(0)) + F.col("_used")).alias("last_value"),
        as_ntz(now).alias("updated_at"),
    )
    return upsert(sequences, changes, "name")


def current_sequences(cases: DataFrame) -> DataFrame:
    """The last number given out per sequence, read off the case numbers."""
    number = F.regexp_extract(F.col("case_number"), "_([0-9]+)$", 1).try_cast("bigint")
    key = F.concat(F.lit("case_number_"), F.regexp_replace(F.col("case_number"), "_[0-9]+$", ""))
    return (
        cases.select(key.alias("name"), number.alias("last_value"))
        .filter("last_value is not null")
        .groupBy("name")
        .agg(F.max("last_value").alias("last_value"))
    )


def reference_meta(df: DataFrame, decision: str) -> DataFrame:
    """Adds what a decision means for learning."""
    return df.withColumn("learning_eligible", learning_eligible(F.col(decision))).withColumn(
        "reference_type", reference_type(F.col(decision))
    )
