"""Saving, reviewing, patching and numbering cases."""

import pytest
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.functions.routing import complexity, requested_tier, tier_of
from caseloom.operators import cases as K
from caseloom.operators.requests import payload_counts
from caseloom.sources.tables import conform
from tests.helpers import at, dicts

NOW = "2024-06-01 00:00:00"


def _table(spark, rows, columns="case_number string, rating string, expert_comment string, created_at timestamp_ntz"):
    return conform(spark.createDataFrame(rows, columns), schemas.CASES, schemas.CASE_DEFAULTS)


def _incoming(spark, rows):
    df = spark.createDataFrame(
        rows, "case_number string, rating string, category string, case_status string, pdf_name string, save_no int"
    )
    return conform(df, schemas.T.StructType([*schemas.CASES.fields, df.schema["save_no"]]))


@pytest.fixture
def tables(spark):
    good = _table(spark, [("c1", "good", "seen", at(1)), ("c2", "good", "seen", at(2)), ("c3", "good", "seen", at(3)),
                          ("c9", "good", "seen", at(9))])
    bad = _table(spark, [("c4", "bad", "seen", at(4)), ("c5", "bad", "seen", at(5))])
    return good, bad


def test_save_cases(spark, tables):
    incoming = _incoming(spark, [
        ("c1", "good", "V Belt", "", "a.pdf", 1),       # same rating again
        ("c2", "bad", None, "Draft", "b.pdf", 1),       # moves
        ("c3", "bad", "X", "Draft", "c.pdf", 1),        # moves away and back
        ("c3", "fine", "Y", "Draft", "d.pdf", 2),
        ("c4", "bad", "X", "Draft", "e.pdf", 1),
        ("n1", "bad", "X", None, "f.pdf", 1),
    ])
    good, bad = K.save_cases(*tables, incoming, ["save_no"], NOW)
    assert good.columns == schemas.CASES.names
    def view(df):
        return {r["case_number"]: (r["category"], r["case_status"], r["folder_path"], r["expert_comment"],
                                   str(r["created_at"])) for r in dicts(df, "case_number")}

    assert view(good) == {
        "c1": ("V Belt", "Pending Expert Review", "historical-case-good/v_belt/a.pdf", "seen", str(at(1))),
        "c3": ("Y", "Draft", "historical-case-good/y/d.pdf", "", NOW),
        "c9": (None, "AI Generated", None, "seen", str(at(9))),
    }
    assert view(bad) == {
        "c2": ("Other", "Draft", "historical-case-bad/other/b.pdf", "", NOW),
        "c4": ("X", "Draft", "historical-case-bad/x/e.pdf", "seen", str(at(4))),
        "c5": (None, "AI Generated", None, "seen", str(at(5))),
        "n1": ("X", "Pending Expert Review", "historical-case-bad/x/f.pdf", "", NOW),
    }


REVIEW = ("case_number string, case_status string, corrected_recommendation string, reviewer_name string, "
          "expert_comment string, expert_rating string, knowledge_value string, review_no int, "
          "completed_case struct<" + ", ".join(f"{n}: string" for n in K.REVIEW_COMPLETED) + ">")


def _part(**given):
    return tuple(given.get(n) for n in K.REVIEW_COMPLETED)


def _with_document(df, **fields):
    document = F.struct(*[F.lit(fields.get(n)).cast("string").alias(n) for n in schemas.COMPLETED_FIELDS])
    return df.withColumn("completed_case", document)


def test_apply_reviews(spark, tables):
    good, bad = tables
    good = _with_document(good, pdfName="old.pdf", sharePointFileUrl="u", reviewerName="Kim")
    bad = bad.unionByName(_table(spark, [("c1", "bad", "twin", at(7))]))
    reviews = spark.createDataFrame([
        ("c1", "Verified - Good", None, " Ann\t Lee ", "ok\r\n", " 5 ", "high  value indeed really", 1,
         _part(pdfName=" new .pdf")),
        ("c1", "Verified - Corrected", " use B ", "", "", None, None, 2, None),
        ("c2", "Verified - Rejected", None, "", None, None, None, 1, _part(uploadStatus="done")),
        ("c3", "Verified - Corrected", "  ", "", None, None, None, 1, None),
        ("c4", "Draft", None, "", None, None, None, 1, None),
        ("c5", " Archived ", None, "Bo", None, None, None, 1, None),
        ("zz", "Archived", None, "Bo", None, None, None, 1, None),
    ], REVIEW)
    good, bad, rejected = K.apply_reviews(good, bad, reviews, ["review_no"], NOW, "Root")
    rows = {r["case_number"]: r for r in dicts(good, "case_number")}
    c1 = rows["c1"]
    assert (c1["case_status"], c1["expert_decision"], c1["reference_type"]) == (
        "Verified - Corrected", "Verified - Corrected", "corrective")
    assert (c1["learning_eligible"], c1["corrected_recommendation"], c1["reviewer_name"]) == (True, "use B", "")
    document = c1["completed_case"]
    # The first review's part stays merged in: its seven fields and status, its reviewer, the old file address.
    assert (document["pdfName"], document["finalStatus"], document["reviewerName"]) == (
        "new .pdf", "Verified - Good", "Ann Lee")
    assert (document["uploadStatus"], document["sharePointRootFolder"], document["sharePointFileUrl"]) == (
        "pending", "Root", "u")
    assert document["reviewedAt"] == "2024-06-01T00:00:00.000Z"
    assert (rows["c2"]["completed_case"]["reviewerName"], rows["c2"]["completed_case"]["pdfName"]) == ("Kim", "")
    assert rows["c2"]["learning_eligible"] is False
    assert rows["c3"]["reviewed_at"] is None and rows["c3"]["expert_comment"] == "seen"
    others = {r["case_number"]: r for r in dicts(bad, "case_number")}
    assert others["c1"]["expert_comment"] == "twin" and others["c1"]["reviewed_at"] is None  # good table wins
    assert others["c5"]["case_status"] == "Archived" and others["c5"]["completed_case"] is None
    assert {(r["case_number"], r["reason"]) for r in dicts(rejected, "case_number")} == {
        ("c3", K.NO_CORRECTION), ("c4", K.NO_STATUS), ("zz", K.NOT_FOUND)}


def test_patch_completed(spark, tables):
    good, bad = tables
    good = _with_document(good, pdfName="old.pdf", uploadStatus="pending")
    fields = ", ".join(f"{n}: string" for n in schemas.COMPLETED_FIELDS)
    def patch(**given):
        return tuple(given.get(n) for n in schemas.COMPLETED_FIELDS)

    patches = spark.createDataFrame([
        ("c1", 1, patch(pdfName="", sharePointItemId="7")), ("c1", 2, patch(uploadStatus="uploaded")),
        ("c4", 1, patch(uploadedAt="t")), ("zz", 1, patch()),
    ], f"case_number string, patch_no int, completed_case struct<{fields}>")
    good, bad, unknown = K.patch_completed(good, bad, patches, ["patch_no"], NOW)
    rows = {r["case_number"]: r for r in dicts(good.unionByName(bad), "case_number")}
    c1 = rows["c1"]["completed_case"]
    assert (c1["pdfName"], c1["uploadStatus"], c1["sharePointItemId"], c1["uploadedAt"]) == ("", "uploaded", "7", None)
    assert rows["c4"]["completed_case"]["uploadedAt"] == "t"
    assert str(rows["c1"]["updated_at"]) == NOW and rows["c2"]["updated_at"] is None
    assert rows["c2"]["completed_case"]["pdfName"] == "old.pdf"
    assert dicts(unknown, "case_number") == [{"case_number": "zz", "reason": K.NOT_FOUND}]


def test_search_wildcards_and_backslash(spark):
    df = _table(spark, [("a_1", "good", "50% off", None), ("b-1", "good", "c:\\dir", None), ("c1", "good", None, None)])
    def found(term):
        return [r["case_number"] for r in dicts(K.filter_cases(df, search=term), "case_number")]

    assert found("A_1") == ["a_1"]
    assert found("_1") == ["a_1", "b-1", "c1"]
    assert found("c:\\D") == ["b-1"]
    assert found("  ") == ["a_1", "b-1", "c1"]


def test_list_limit_holds_per_table(spark):
    good = _table(spark, [(f"g{i}", "good", "", at(i)) for i in range(5)]).withColumn("updated_at", F.col("created_at"))
    bad = _table(spark, [(f"b{i}", "bad", "", at(i)) for i in range(5)]).withColumn("updated_at", F.col("created_at"))
    got = [r["case_number"] for r in K.list_cases(good, bad, limit=2).collect()]
    assert got == ["b4", "g4", "b3", "g3"]
    assert K.list_cases(good, bad, limit=-3).count() == 2
    assert K.list_cases(good, bad, limit=0).count() == 10


def test_required_columns(spark):
    df = spark.createDataFrame([("a", "x"), ("", "x"), ("b", None), (" ", "x")], "case_number string, pdf_name string")
    accepted, rejected = K.split_valid_rows(df, K.REQUIRED_CASE)
    assert {r["case_number"] for r in dicts(accepted, "case_number")} == {"a", " "}
    assert {r["reason"] for r in dicts(rejected, "case_number")} == set(K.REQUIRED_CASE.values())
    _, trimmed = K.split_valid_rows(df, {"case_number": "category is required."}, trimmed=True)
    assert trimmed.count() == 2


def test_numbers_and_counters_agree(spark):
    rows = [("V Belt", at(5), 1), ("chain", at(1), 2), ("v-belt", at(1), 3), ("V Belt", at(200), 4), ("", at(2), 5)]
    requests = spark.createDataFrame(rows, "category string, ts timestamp_ntz, id int")
    counters = spark.createDataFrame([("case_number_v_belt", 99998, None), ("case_number_x", 3, None)], schemas.SEQUENCES)
    got = K.assign_case_numbers(requests, counters, "ts", ["id"])
    assert {r["id"]: r["case_number"] for r in got.collect()} == {
        3: "v_belt_99999", 1: "v_belt_100000", 4: "v_belt_100001", 2: "chain_00001", 5: "other_00001",
    }
    after = K.advance_sequences(counters, requests, NOW)
    assert {r["name"]: r["last_value"] for r in after.collect()} == {
        "case_number_v_belt": 100001, "case_number_x": 3, "case_number_chain": 1, "case_number_other": 1,
    }
    read_off = K.current_sequences(got)
    assert {r["name"]: r["last_value"] for r in read_off.collect()} == {
        "case_number_v_belt": 100001, "case_number_chain": 1, "case_number_other": 1,
    }


def test_payload_counts_and_tiers(spark):
    files = ([], None, ["a", "b"])
    rows = [
        (1, "x", None, [("t", ["i"], f) for f in files], {"q1": "a", "q2": ""}, ["p"]),
        (2, None, None, None, None, None),
    ]
    requests = spark.createDataFrame(rows, schemas.T.StructType([schemas.T.StructField("id", schemas.I), *schemas.REQUESTS.fields]))
    got = dicts(payload_counts(requests), "id")
    assert [(r["answers"], r["updates"], r["files"], r["photos"]) for r in got] == [(2, 3, 2, 1), (0, 0, 0, 0)]
    counts = spark.createDataFrame(
        [(449, 4, 5, 0, 0, " Auto"), (450, 9, 9, 0, 0, ""), (9000, 0, 0, 9, 9, "GPT-5.4-mini"), (9000, 0, 9, 9, 0, "big")],
        "t bigint, a bigint, u bigint, f bigint, p bigint, want string",
    )
    score = complexity(F.col("t"), F.col("a"), F.col("u"), F.col("f"), F.col("p"))
    got = counts.select(score.alias("s"), tier_of(score).alias("t"), requested_tier(F.col("want"), score).alias("r"))
    assert [tuple(r) for r in got.collect()] == [
        (9, "gpt-5.4-mini", "gpt-5.4-mini"), (10, "gpt-5.4", "gpt-5.4"), (14, "gpt-5.4", "gpt-5.4-mini"),
        (16, "gpt-5.4", "gpt-5.4"),
    ]
