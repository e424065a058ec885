"""Case requests: payload counts and tier routing."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.routing import complexity, requested_tier
from caseloom.functions.text import code_units
from caseloom.schemas import REQUESTS


def payload_counts(requests: DataFrame) -> DataFrame:
    """Adds the sizes routing looks at: answers, chat updates, files over all updates, photos, text size."""
    files = F.aggregate(
        F.transform("chatUpdates", lambda u: F.coalesce(F.size(u["files"]), F.lit(0))),
        F.lit(0), lambda total, n: total + n,
    )

    def count(size: Column) -> Column:
        return F.coalesce(F.greatest(size, F.lit(0)), F.lit(0)).cast("bigint")

    return (
        requests.withColumn("answers", count(F.size(F.map_keys("followUpAnswers"))))
        .withColumn("updates", count(F.size("chatUpdates")))
        .withColumn("files", count(files))
        .withColumn("photos", count(F.size("formPhotos")))
        .withColumn("text_size", code_units(F.to_json(F.struct(*REQUESTS.names), {"ignoreNullFields": "false"})))
    )


def route_requests(counted: DataFrame, requested: str) -> DataFrame:
    """Adds complexity score and model tier to rows carrying the counts."""
    score = complexity(F.col("text_size"), F.col("answers"), F.col("updates"), F.col("files"), F.col("photos"))
    return counted.withColumn("score", score).withColumn("tier", requested_tier(F.col(requested), F.col("score")))
