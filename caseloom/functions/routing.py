"""Which model tier a request gets."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions.text import js_trim

# The tier names, and the score from which the large one is used.
LARGE_TIER, SMALL_TIER = "gpt-5.4", "gpt-5.4-mini"
LARGE_FROM = 10


def complexity(text_size: Column, answers: Column, updates: Column, files: Column, photos: Column) -> Column:
    """Sum of five capped counts; text counts one per 450 characters."""
    parts = [(F.floor(text_size / 450), 6), (answers, 4), (updates, 5), (files, 5), (photos, 3)]
    return sum((F.least(F.lit(cap).cast("bigint"), part.cast("bigint")) for part, cap in parts), F.lit(0))


def tier_of(score: Column) -> Column:
    return F.when(score >= LARGE_FROM, LARGE_TIER).otherwise(SMALL_TIER)


def requested_tier(requested: Column, score: Column) -> Column:
    """The tier asked for if it is a known one; blank, "auto" and unknown values go by score."""
    asked = F.lower(js_trim(requested))
    return F.when(asked.isin(LARGE_TIER, SMALL_TIER), asked).otherwise(tier_of(score))
