"""The corpus pipeline: documents to token ids in five stages, each written and read again.

Stages keep the columns of ``documents`` (whatever further columns there are), but for the
last, which returns ``doc_id``, ``n_tokens`` and ``ids``. What each does with
null or empty texts, null ids and repeated rows: the classifier scores an empty text like
any other; among near duplicates repeated rows are copies and one stays, wordless texts
are no copies of each other unless their id is the same as well; null texts stay null
through the third stage; the mixture places every row; an empty text gives begin and end
id. An empty table passes through as an empty table. Columns may have any name. Of repeated
rows with one id and text, but other values elsewhere, any one stays.

A stage's result has to be written before the next stage is called: that call removes the
intermediate tables which the stage before has staged.
"""

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import bloom_cascade, byte_cnn, chunk_table, ngram_join, pii_bootstrap, temperature_mixing
from caseloom.llm.common import bounded_batches, table
from caseloom.sources.tables import collected, release, stage

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
NEAR_WORDS, NEAR_PERCENT = 5, 80
REPETITION_LIMIT = 2.0


#: Tables that the stage called last has staged.
_staged: list[str] = []


def _freeing(step: Callable) -> Callable:
    """A stage that first removes what the one before it staged: that one's result is written by then."""

    @functools.wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _staged)
        with collected() as made:
            out = step(spark, docs, sf_dir)
        _staged.extend(made)
        return out

    return run


@_freeing
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier fitted on the labelled ones scores 0.5 or more."""
    bounded_batches(spark)
    network = byte_cnn.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(byte_cnn.score_column(network, F.col("text")) >= 0.5)


@_freeing
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 80 % of the five-word n-grams hold together: the one of smallest id."""
    key = F.xxhash64("doc_id", "text")
    keyed = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("id"), "text")
    groups = ngram_join.jaccard_components(keyed.select(F.col("key").alias("doc_id"), "text"), NEAR_WORDS, NEAR_PERCENT)
    members = keyed.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"))
    members = stage(members.join(groups.select(F.col("doc_id").alias("key"), "component_id").distinct(), "key"), "members")
    first = F.min(F.struct(F.col("id").isNull(), "id", "key", "rows")).alias("first")
    kept = stage(members.groupBy("component_id").agg(first).select("first.key", "first.rows"), "kept")
    # All other rows are kept as they are; only these are looked up, which may shuffle their texts.
    other = members.select("key", "rows").join(kept.where("rows = 1").select("key"), "key", "left_anti")
    likely = bloom_cascade.likely_among(stage(other.select(F.col("key").alias("g1"), F.xxhash64("key").alias("g2")), "not-kept"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row"), key.alias("key"))
    whole = whole.withColumn("likely", likely("key", F.xxhash64("key")))
    sure, doubted = whole.where("not likely").select("row"), whole.where("likely").select("row", "key")
    single = doubted.join(kept.where("rows = 1").select("key"), "key", "left_semi").select("row").unionByName(sure)
    # Repeated rows: one of each, combined before the shuffle; no other text is shuffled for it.
    repeated = doubted.join(kept.where("rows > 1").select("key"), "key", "left_semi").groupBy("key").agg(F.first("row").alias("row"))
    return single.unionByName(repeated.select("row")).select("row.*")


@_freeing
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` follows the text."""
    clean = pii_bootstrap.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in clean.columns else clean


@_freeing
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture places them; the largest source once, no source more than twice."""
    return temperature_mixing.realise(docs, repetition_limit=REPETITION_LIMIT)


@_freeing
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with begin and end id."""
    encoded = chunk_table.encode_texts(docs, PIECE_MODEL)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("personal_data", personal_data),
    ("temperature_mixing", mixed),
    ("sentencepiece_ids", tokens),
]

#: No SQL: a trained network and a tokenizer's merges are not SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
