"""An inverted index of case words, kept beside the case tables.

Postings ``(scope, word, key, recency, version)`` are only ever added: whoever touches a case,
by a save, a review or a patch, has its words written again under the change's version.
``live`` names the valid version of each learning-eligible case, so postings of a case that
moved, was rejected or reads differently now are passed over. Both grow with what changes, and
a batch of requests reads the buckets of its own words and no case text.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.text import tokens
from caseloom.operators.keyed import union_all
from caseloom.operators.match import BEST, FIRST_WALK, best_of, candidate_pool, pool_postings
from caseloom.schemas import T
from caseloom.sources.tables import stage

# Folders that stored postings are dealt into by word.
BUCKETS = 256


def _bucket():
    return F.pmod(F.xxhash64("scope", "word"), F.lit(BUCKETS)).cast("int")


def index_cases(cases: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """Postings and live versions of cases ``(scope, case_number, updated_at, search_text, learning_eligible)``."""
    eligible = cases.filter("learning_eligible")
    pool = candidate_pool(eligible, "scope", "case_number", "updated_at", tokens(F.col("search_text")))
    valid = F.lit(version).cast("bigint").alias("version")
    return pool_postings(pool).select("*", valid), eligible.select(F.col("case_number").alias("key"), valid)


def change_index(live: DataFrame, cases: DataFrame, touched: list[DataFrame], version: int) -> tuple[DataFrame, DataFrame]:
    """The postings to add and the live versions after changes to the ``case_number``s of ``touched``.

    ``cases`` is the state after the changes, of which only touched cases are read; ``version``
    must be above all earlier ones. These are written, so that the changes are not computed for the postings and the versions both.
    """
    numbers = union_all([t.select("case_number") for t in touched]).distinct()
    columns = ["scope", "case_number", "updated_at", "search_text", "learning_eligible"]
    changed = cases.filter("learning_eligible").select(columns).join(numbers, "case_number", "left_semi")
    added, fresh = index_cases(stage(changed, "changed-cases"), version)
    kept = live.join(numbers.withColumnRenamed("case_number", "key"), "key", "left_anti")
    return added, kept.unionByName(fresh)


def add_postings(postings: DataFrame, path: str) -> None:
    """Append postings to a stored index, in folders by word and in order of words within a file."""
    dealt = postings.withColumn("bucket", _bucket()).repartition("bucket", "scope", "word")
    dealt.sortWithinPartitions("bucket", "scope", "word").write.mode("append").partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str, key_type: str = "string") -> DataFrame:
    """The stored postings, with their ``bucket``."""
    fields = f"scope string, word string, key {key_type}, recency bigint, version bigint, bucket int"
    return spark.read.schema(T.StructType.fromDDL(fields)).parquet(path)


def live_postings(postings: DataFrame, live: DataFrame) -> DataFrame:
    """Postings, or cases put together from them, of valid versions; writing postings to a new folder compacts an index."""
    return postings.join(live, ["key", "version"], "left_semi")


def similar_by_index(targets: DataFrame, postings: DataFrame, live: DataFrame, k: int = BEST) -> DataFrame:
    """The best cases for targets ``(target_id, scope, words)``, as ``similar_cases`` gives them, from a stored index.

    Only folders and row groups of the targets' own words are read. Cases are put together from hashed words
    before their versions are looked up, so that one row a case meets ``live``.
    """
    asked = targets.select("scope", F.explode("words").alias("word")).distinct().withColumn("bucket", _bucket())
    own = postings.join(asked, ["bucket", "scope", "word"], "left_semi").groupBy("scope", "key", "recency", "version")
    cases = live_postings(own.agg(F.collect_list(F.xxhash64("word")).alias("words")), live)
    return best_of(targets, cases.drop("version"), k, FIRST_WALK).withColumnRenamed("key", "case_number")
