"""Queries over the case tables."""

from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.operators import cases as K
from caseloom.sources.tables import conform
from caseloom.workload import duck as D
from caseloom.workload import fixtures as fx
from caseloom.workload.registry import query

_STATUS = "coalesce(nullif(case_status, ''), 'AI Generated') as case_status"
_UPDATED = "coalesce(updated_at, created_at) as updated_at"
_DETAIL = f"""case_number, category, rating, user_comment, {_STATUS}, expert_comment, reviewer_name, learning_eligible,
  case when coalesce(referenced_case_numbers, '') like '["%' then 'a,b' else '' end as referenced,
  try_cast(json_extract_string(case_payload, '$.k') as bigint) as payload_k, created_at, {_UPDATED}"""


def _flat_detail(df):
    """Detail rows with their documents as text, as the check compares flat rows."""
    return df.select(
        "case_number", "category", "rating", "user_comment", "case_status", "expert_comment", "reviewer_name",
        "learning_eligible", F.concat_ws(",", "referenced_case_numbers").alias("referenced"),
        F.try_variant_get("case_payload", "$.k", "bigint").alias("payload_k"), "created_at", "updated_at",
        "source_table",
    )


@query("case_detail", fx.oracle(f"""
select {_DETAIL}, case when rating = 'good' then 'historical_case_good' else 'historical_case_bad' end as source_table
from fx_cases"""))
def case_detail(spark, sf_dir):
    good, bad = fx.case_tables(spark, sf_dir)
    rows = K.case_detail(good, "historical_case_good").unionByName(K.case_detail(bad, "historical_case_bad"))
    return _flat_detail(rows)


_SUMMARY = f"""case_number, category, {D.slug('category')} as category_slug, rating, {_STATUS}, user_comment,
  '' as expert_decision, '' as expert_rating, reviewer_name, learning_eligible, '' as reference_type, created_at,
  {_UPDATED}, cast(null as timestamp) as reviewed_at, pdf_name"""


@query("case_summary", fx.oracle(f"select {_SUMMARY} from fx_cases"))
def case_summary(spark, sf_dir):
    good, bad = fx.case_tables(spark, sf_dir)
    return K.case_summary(good.unionByName(bad))


@query("filter_cases", fx.oracle("""
select 'search' as filter, case_number from fx_cases where case_number ilike '%an_e%' or category ilike '%an_e%'
  or user_comment ilike '%an_e%' or expert_comment ilike '%an_e%'
union all select 'status', case_number from fx_cases where case_status = 'Verified - Good' and category = 'src3'
union all select 'none', case_number from fx_cases"""))
def filter_cases(spark, sf_dir):
    good, bad = fx.case_tables(spark, sf_dir)
    every = good.unionByName(bad)

    def tagged(name, df):
        return df.select(F.lit(name).alias("filter"), "case_number")

    return (
        tagged("search", K.filter_cases(every, search="  AN_e "))
        .unionByName(tagged("status", K.filter_cases(every, " Verified - Good ", "src3")))
        .unionByName(tagged("none", K.filter_cases(every)))
    )


def _listed(where: str, limit: int) -> str:
    return " union all ".join(
        f"(select {_SUMMARY} from (select * from fx_cases where rating = '{r}' and {where} "
        f"order by updated_at desc nulls last, case_number limit {limit}))" for r in ("good", "bad")
    )


@query("list_cases", fx.oracle(_listed("case_status = 'Verified - Good'", 60)))
def list_cases(spark, sf_dir):
    return K.list_cases(*fx.case_tables(spark, sf_dir), status="Verified - Good")


@query("status_counts", fx.oracle(f"""
select case_status, count(*) as cases from ({_listed("true", 200)}) group by case_status"""))
def status_counts(spark, sf_dir):
    return K.status_counts(*fx.case_tables(spark, sf_dir))


@query("lookup_cases", fx.oracle(f"""
with stored as (
  select *, case when rating = 'good' then 'historical_case_good' else 'historical_case_bad' end as source_table
  from fx_cases
  union all select * replace ('bad' as rating), 'historical_case_bad' from fx_cases where rating = 'good' and expert_comment = 'Checked'),
ranked as (select *, row_number() over (partition by case_number order by source_table desc) as rn from stored
  where case_number in (select case_number from fx_saves where category = 'Label Check' or rating = 'bad'))
select {_DETAIL}, source_table from ranked where rn = 1"""))
def lookup_cases(spark, sf_dir):
    """Some good cases stand in the bad table as well; the good row is the answer."""
    good, bad = fx.case_tables(spark, sf_dir)
    both = good.filter("expert_comment = 'Checked'").withColumn("rating", F.lit("bad"))
    keys = fx.fixture(spark, sf_dir, "fx_saves").filter("category = 'Label Check' or rating = 'bad'")
    return _flat_detail(K.lookup_cases(good, bad.unionByName(both), keys))


@query("conform_cases", fx.oracle("""
select case_number, case_status, expert_decision, learning_eligible, reviewed_at, user_comment, created_at from (
  select 'case_' || cast(d.doc_id as string) as case_number, 'AI Generated' as case_status, '' as expert_decision,
    false as learning_eligible, cast(null as timestamp) as reviewed_at,
    coalesce(case when l.toxic = 1 then null else d.text end, '') as user_comment, cast(null as timestamp) as created_at
  from documents d left join labels l on d.doc_id = l.doc_id)"""))
def conform_cases(spark, sf_dir):
    labels, docs = fx.table(spark, sf_dir, "labels"), fx.table(spark, sf_dir, "documents")
    rows = docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("case_"), F.col("doc_id").cast("string")).alias("case_number"),
        F.when(F.coalesce(F.col("toxic"), F.lit(0)) != 1, F.col("text")).alias("user_comment"),
        F.col("source").alias("category"),
    )
    full = conform(rows, schemas.CASES, schemas.CASE_DEFAULTS)
    return full.select(
        "case_number", "case_status", "expert_decision", "learning_eligible", "reviewed_at", "user_comment", "created_at"
    )


@query("conform_nested", fx.oracle("""
select case_number, pdfname, uploadstatus, reviewername, first_key, first_value, n_specs, quality_of, toxic_of, added from (
  select 'case_' || cast(d.doc_id as string) as case_number, d.source || '.pdf' as pdfname,
    case when d.lang = 'de' then 'queued' end as uploadstatus, cast(null as string) as reviewername,
    d.lang as first_key, cast(d.doc_id as string) as first_value, cast(2 as bigint) as n_specs,
    cast(l.quality as string) as quality_of, cast(l.toxic as string) as toxic_of, cast(null as string) as added
  from documents d left join labels l on l.doc_id = d.doc_id)"""))
def conform_nested(spark, sf_dir):
    """Stored documents whose nested fields are in another order, missing, unknown, or of another type."""
    labels, docs = fx.table(spark, sf_dir, "labels"), fx.table(spark, sf_dir, "documents")
    d = docs.join(labels, "doc_id", "left")
    marks = F.struct(F.col("toxic").alias("t"), F.lit(1).alias("unknown"), F.col("quality").alias("q"))
    stored = d.select(
        F.concat(F.lit("case_"), F.col("doc_id").cast("string")).alias("case_number"),
        F.struct(
            F.when(F.col("lang") == "de", "queued").alias("uploadStatus"), F.col("doc_id").alias("unknown"),
            F.concat("source", F.lit(".pdf")).alias("PDFNAME"),
        ).alias("completed"),
        F.array(
            F.struct(F.col("doc_id").alias("value"), F.col("lang").alias("key")), F.struct(F.lit(0).cast("bigint").alias("value"), F.lit("k").alias("key"))
        ).alias("specs"),
        F.create_map(F.lit("marks"), marks).alias("seen"),
    )
    wanted = schemas.T.StructType.fromDDL(
        "case_number string, completed struct<pdfName: string, uploadStatus: string, reviewerName: string>, "
        "specs array<struct<key: string, value: string>>, seen map<string, struct<q: string, t: string, added: string>>"
    )
    rows, mark = conform(stored, wanted), F.col("seen")["marks"]
    return rows.select(
        "case_number", F.col("completed.pdfName").alias("pdfname"), F.col("completed.uploadStatus").alias("uploadstatus"),
        F.col("completed.reviewerName").alias("reviewername"), F.col("specs")[0]["key"].alias("first_key"),
        F.col("specs")[0]["value"].alias("first_value"), F.size("specs").cast("bigint").alias("n_specs"),
        mark["q"].alias("quality_of"), mark["t"].alias("toxic_of"), mark["added"].alias("added"),
    )


_REASON = """case when trim(case_status) not in ('Verified - Good', 'Verified - Corrected', 'Verified - Rejected', 'Archived')
    then 'A verified case status is required.'
  when trim(case_status) = 'Verified - Corrected' and trim(corrected_recommendation) = ''
    then 'Corrected recommendation is required for Verified - Corrected.' end"""


@query("split_valid_reviews", fx.oracle(f"""
select case_number, review_no, trim(case_status) as case_status, {_REASON} as reason from fx_reviews"""))
def split_valid_reviews(spark, sf_dir):
    accepted, rejected = K.split_valid_reviews(fx.fixture(spark, sf_dir, "fx_reviews"))
    both = accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)
    return both.select("case_number", "review_no", "case_status", "reason")


@query("split_valid_cases", fx.oracle("""
select case_number, pdf_name, case when case_number = '' then 'casePayload.caseNumber is required.'
  when coalesce(pdf_name, '') = '' then 'pdfName is required.' end as reason
from (select case when lang = 'es' then '' else cast(doc_id as string) end as case_number,
  case when source = 'src1' then null when source = 'src2' then '' else source end as pdf_name from documents)"""))
def split_valid_cases(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").select(
        F.when(F.col("lang") == "es", "").otherwise(F.col("doc_id").cast("string")).alias("case_number"),
        F.when(F.col("source") == "src1", None).when(F.col("source") == "src2", "").otherwise(F.col("source"))
        .alias("pdf_name"),
    )
    accepted, rejected = K.split_valid_rows(rows, K.REQUIRED_CASE)
    return accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)


@query("save_cases", fx.oracle(f"""
with cleaned as (select *, case when rating = 'bad' then 'bad' else 'good' end as side,
  coalesce(nullif(category, ''), 'Other') as cat from fx_saves),
last as (select * from (select *, row_number() over (partition by case_number order by save_no desc) as rn,
  min(side) over (partition by case_number) <> max(side) over (partition by case_number) as moved from cleaned)
  where rn = 1),
written as (
  select l.case_number, l.side as rating, l.cat as category, {D.slug('l.cat')} as category_slug, l.pdf_name,
    'historical-case-' || l.side || '/' || {D.slug('l.cat')} || '/' || l.pdf_name as folder_path, l.user_comment,
    coalesce(nullif(l.case_status, ''), 'Pending Expert Review') as case_status,
    c.case_number is not null and not l.moved as again,
    c.expert_comment, c.reviewer_name, c.learning_eligible, c.created_at
  from last l left join fx_cases c on c.case_number = l.case_number and c.rating = l.side)
select case_number, rating, category, category_slug, pdf_name, folder_path, user_comment, case_status,
  case when again then expert_comment else '' end as expert_comment,
  case when again then reviewer_name else '' end as reviewer_name,
  case when again then learning_eligible else false end as learning_eligible,
  case when again then created_at else timestamp '{fx.NOW}' end as created_at, timestamp '{fx.NOW}' as updated_at
from written
union all
select case_number, rating, category, {D.slug('category')}, pdf_name, null, user_comment, case_status, expert_comment,
  reviewer_name, learning_eligible, created_at, updated_at
from fx_cases c where not exists (select 1 from last l where l.case_number = c.case_number)"""))
def save_cases(spark, sf_dir):
    good, bad = fx.case_tables(spark, sf_dir)
    saves = fx.fixture(spark, sf_dir, "fx_saves")
    incoming = conform(saves, schemas.T.StructType([*schemas.CASES.fields, saves.schema["save_no"]]))
    good, bad = K.save_cases(good, bad, incoming, ["save_no"], fx.NOW)
    return good.unionByName(bad).select(
        "case_number", "rating", "category", "category_slug", "pdf_name", "folder_path", "user_comment", "case_status",
        "expert_comment", "reviewer_name", "learning_eligible", "created_at", "updated_at",
    )


@query("apply_reviews", fx.oracle(f"""
with judged as (select *, {_REASON} as reason, trim(case_status) as verdict, trim(regexp_replace(reviewer_name, ' +', ' ', 'g')) as who
  from fx_reviews),
ok as (select * from judged where reason is null),
last as (select * from (select *, row_number() over (partition by case_number order by review_no desc) as rn from ok)
  where rn = 1),
part as (select * from (select *, row_number() over (partition by case_number order by review_no desc) as rn from ok
  where has_part) where rn = 1),
named as (select case_number, arg_max(who, review_no) as who from ok where has_part and who <> '' group by case_number)
select c.case_number, c.rating, coalesce(l.verdict, c.case_status) as case_status, coalesce(l.verdict, '') as expert_decision,
  coalesce(trim(l.expert_rating), '') as expert_rating,
  case when l.case_number is null then c.expert_comment else left({D.trim('l.expert_comment')}, 6000) end as expert_comment,
  coalesce(trim(l.corrected_recommendation), '') as corrected_recommendation,
  coalesce(l.who, c.reviewer_name) as reviewer_name,
  case when l.verdict is null then c.learning_eligible else l.verdict in ('Verified - Good', 'Verified - Corrected') end
    as learning_eligible,
  case l.verdict when 'Verified - Good' then 'positive' when 'Verified - Corrected' then 'corrective' else '' end
    as reference_type,
  case when p.case_number is not null then p.pdf_name when c.learning_eligible then 'old.pdf' end as done_pdf,
  case when p.case_number is not null then coalesce(nullif(p.upload_status, ''), 'pending') end as done_status,
  p.verdict as done_final,
  case when p.case_number is not null then coalesce(n.who, case when c.learning_eligible then 'Kim' else '' end)
    when c.learning_eligible then 'Kim' end as done_reviewer,
  case when p.case_number is not null then '2024-06-01T00:00:00.000Z' end as done_at,
  case when l.case_number is not null then timestamp '{fx.NOW}' end as reviewed_at,
  case when l.case_number is not null then timestamp '{fx.NOW}' else c.updated_at end as updated_at,
  cast(null as string) as reason
from fx_cases c left join last l on l.case_number = c.case_number left join part p on p.case_number = c.case_number
  left join named n on n.case_number = c.case_number
union all
select case_number, null, null, null, null, null, null, null, null, null, null, null, null, null, null, null, null, reason
from judged where reason is not null
union all
select case_number, null, null, null, null, null, null, null, null, null, null, null, null, null, null, null, null,
  'Case not found.' from last l where not exists (select 1 from fx_cases c where c.case_number = l.case_number)"""))
def apply_reviews(spark, sf_dir):
    rows = fx.fixture(spark, sf_dir, "fx_reviews")
    blank = F.lit(None).cast("string")
    part = F.struct(
        *[
            {"pdfName": F.col("pdf_name"), "uploadStatus": F.col("upload_status")}.get(name, blank).alias(name)
            for name in K.REVIEW_COMPLETED
        ]
    )
    reviews = rows.withColumn("completed_case", F.when(F.col("has_part"), part))
    good, bad = fx.case_tables(spark, sf_dir)
    good, bad, rejected = K.apply_reviews(good, bad, reviews, ["review_no"], fx.NOW)
    c = F.col("completed_case")
    after = good.unionByName(bad).select(
        "case_number", "rating", "case_status", "expert_decision", "expert_rating", "expert_comment",
        "corrected_recommendation", "reviewer_name", "learning_eligible", "reference_type",
        c["pdfName"].alias("done_pdf"), c["uploadStatus"].alias("done_status"), c["finalStatus"].alias("done_final"),
        c["reviewerName"].alias("done_reviewer"), c["reviewedAt"].alias("done_at"), "reviewed_at", "updated_at",
        F.lit(None).cast("string").alias("reason"),
    )
    return after.unionByName(rejected, allowMissingColumns=True)


@query("patch_completed", fx.oracle(f"""
with latest as (select case_number,
    arg_max(upload_status, patch_no) filter (where upload_status is not null) as upload_status,
    arg_max(pdf_name, patch_no) filter (where pdf_name is not null) as pdf_name,
    arg_max(file_url, patch_no) filter (where file_url is not null) as file_url
  from fx_patches group by case_number)
select c.case_number, coalesce(l.upload_status, null) as done_status,
  coalesce(l.pdf_name, case when c.learning_eligible then 'old.pdf' end) as done_pdf, l.file_url as done_url,
  case when c.learning_eligible then 'Kim' end as done_reviewer,
  case when l.case_number is null then c.updated_at else timestamp '{fx.NOW}' end as updated_at, null as reason
from fx_cases c left join latest l on l.case_number = c.case_number
union all
select case_number, null, null, null, null, null, 'Case not found.' from latest l
where not exists (select 1 from fx_cases c where c.case_number = l.case_number)"""))
def patch_completed(spark, sf_dir):
    rows = fx.fixture(spark, sf_dir, "fx_patches")
    given = {"uploadStatus": "upload_status", "pdfName": "pdf_name", "sharePointFileUrl": "file_url"}
    patch = F.struct(
        *[(F.col(given[n]) if n in given else F.lit(None).cast("string")).alias(n) for n in schemas.COMPLETED_FIELDS]
    )
    good, bad = fx.case_tables(spark, sf_dir)
    patches = rows.select("case_number", "patch_no", patch.alias("completed_case"))
    good, bad, unknown = K.patch_completed(good, bad, patches, ["patch_no"], fx.NOW)
    c = F.col("completed_case")
    after = good.unionByName(bad).select(
        "case_number", c["uploadStatus"].alias("done_status"), c["pdfName"].alias("done_pdf"),
        c["sharePointFileUrl"].alias("done_url"), c["reviewerName"].alias("done_reviewer"), "updated_at",
        F.lit(None).cast("string").alias("reason"),
    )
    return after.unionByName(unknown, allowMissingColumns=True)


NUMBERED = """
select r.event_id, r.event_type as category,
  r.event_type || '_' || case when n < 100000 then lpad(cast(n as string), 5, '0') else cast(n as string) end as case_number
from (select e.event_id, e.event_type, coalesce(c.last_value, 0)
    + row_number() over (partition by e.event_type order by e.ts, e.event_id) as n
  from events e left join {counters} c on c.name = 'case_number_' || e.event_type) r"""


def case_requests(spark, sf_dir):
    """Every event asks for a number in its type's sequence."""
    return fx.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("category"), "ts")


@query("assign_case_numbers", fx.oracle(NUMBERED.format(counters="fx_counters")))
def assign_case_numbers(spark, sf_dir):
    counters = fx.fixture(spark, sf_dir, "fx_counters")
    numbered = K.assign_case_numbers(case_requests(spark, sf_dir), counters, "ts", ["event_id"])
    return numbered.select("event_id", "category", "case_number")


@query("advance_sequences", fx.oracle(f"""
select 'case_number_' || e.event_type as name, coalesce(max(c.last_value), 0) + count(*) as last_value,
  timestamp '{fx.NOW}' as updated_at
from events e left join fx_counters c on c.name = 'case_number_' || e.event_type group by e.event_type"""))
def advance_sequences(spark, sf_dir):
    counters = fx.fixture(spark, sf_dir, "fx_counters")
    return K.advance_sequences(counters, case_requests(spark, sf_dir), fx.NOW)


@query("current_sequences", fx.oracle("""
select 'case_number_case' as name, max(doc_id) as last_value from fx_cases"""))
def current_sequences(spark, sf_dir):
    good, bad = fx.case_tables(spark, sf_dir)
    return K.current_sequences(good.unionByName(bad))


@query("split_valid_requests", """
select 'eval' as kind, cast(doc_id as bigint) as id,
  case when lang = 'fr' then 'caseNumber is required.' end as reason from documents
union all select 'number', event_id, case when event_type in ('error', 'view') then 'category is required.' end from events
union all select 'upload', page_id, case when page_id % 5 < 3 then 'Completed PDF upload data is incomplete.' end from pages""")
def split_valid_requests(spark, sf_dir):
    """The rules of evaluations, case-number requests and uploads, each over a table of its own."""
    def judged(kind, key, rows, required, trimmed=False):
        accepted, rejected = K.split_valid_rows(rows, required, trimmed)
        both = accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)
        return both.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "reason")

    docs, events, pages = (fx.table(spark, sf_dir, name) for name in ("documents", "events", "pages"))
    evals = docs.select("doc_id", F.when(F.col("lang") != "fr", F.col("source")).alias("case_number"))
    blank = F.when(F.col("event_type") == "error", "  ").when(F.col("event_type") != "view", F.col("event_type"))
    uploads = pages.select(
        "page_id", *[F.when(F.col("page_id") % 5 != i, F.col("url")).otherwise(" ").alias(name) for i, name in enumerate(K.REQUIRED_UPLOAD)]
    )
    return (
        judged("eval", "doc_id", evals, K.REQUIRED_EVAL)
        .unionByName(judged("number", "event_id", events.select("event_id", blank.alias("category")), K.REQUIRED_CATEGORY, True))
        .unionByName(judged("upload", "page_id", uploads, K.REQUIRED_UPLOAD, True))
    )
