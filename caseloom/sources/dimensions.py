"""The two hand-kept dimensions: crawl sources and category hint phrases.

Both are parameters of a deployment. They enter as local relations, so Catalyst
knows their exact size and decides about broadcasting them by its own threshold.
"""

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caseloom.functions.text import slug
from caseloom.schemas import HINTS, SOURCES

# The source list as (category, type, label, path or query).
SOURCE_ROWS = [
    ("Belt", "category", "V-Belts", "mechanical/industrial-belts/v-belts.html"),
    ("Belt", "category", "Timing Belts Rubber", "mechanical/industrial-belts/timing-belts-rubber.html"),
    ("Belt", "category", "Timing Belts PU", "mechanical/industrial-belts/timing-belts-pu.html"),
    ("Belt", "category", "Ribbed Belts", "mechanical/industrial-belts/ribbed-belts.html"),
    ("Belt", "search", "Automotive Belt", '"automotive belt"'),
    ("Belt", "search", "Fan Belt", '"fan belt"'),
    ("Chain", "category", "Chain and Sprockets", "mechanical/chain-and-sprockets.html"),
    ("Coupling", "search", "Coupling", "coupling"),
    ("Gearbox", "search", "Gear Unit", '"gear unit"'),
    ("Gearbox", "search", "Gearmotor", "gearmotor"),
    ("Gearbox", "search", "Gear Motor", '"gear motor"'),
    ("Electric Motor", "search", "Electric Motor", '"electric motor"'),
]

# Phrases that mark a product as belonging to a category.
CATEGORY_HINTS = {
    "belt": [
        "belt", "v-belt", "v belt", "timing belt", "ribbed belt", "fan belt", "serpentine", "automotive belt",
        "power ace", "metric v", "raw edge cogged", "powerband", "double v", "hexagonal belt", "pu belt",
    ],
    "gearbox": [
        "gear unit", "gearmotor", "gear motor", "geared motor", "speed reducer", "reducer", "worm gear",
        "helical gear", "planetary gear", "emga",
    ],
    "chain": ["roller chain", "connecting link", "offset link", "attachment chain", "sprocket", "chain"],
    "coupling": ["coupling", "jaw coupling", "grid coupling", "disc coupling", "flexible coupling"],
    "electric_motor": ["electric motor", "motor", "ac motor", "dc motor", "induction motor", "servo motor"],
}


def local_table(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """Rows of text and integer columns as a local relation (by way of Arrow; a list would become an RDD scan)."""
    kinds = {"string": pa.string(), "int": pa.int32()}
    columns = {
        field.name: pa.array([row[i] for row in rows], kinds[field.dataType.simpleString()])
        for i, field in enumerate(schema.fields)
    }
    return spark.createDataFrame(pa.table(columns))


def catalog_sources(
    spark: SparkSession, root: str, rows: Iterable[tuple[str, str, str, str]] = SOURCE_ROWS
) -> DataFrame:
    """The source dimension in crawl order; ``root`` is the shop root the category paths hang from."""
    data = [
        (pos, category, kind, label, f"{root}/{target}" if kind == "category" else None,
         target if kind == "search" else None)
        for pos, (category, kind, label, target) in enumerate(rows)
    ]
    return with_slug(local_table(spark, data, SOURCES))


def with_slug(sources: DataFrame) -> DataFrame:
    return sources.withColumn("app_category_slug", slug(F.col("app_category")))


def select_sources(sources: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """The sources of the asked categories; no categories means all."""
    return sources.filter(F.col("app_category").isin(categories)) if categories else sources


def category_hints(spark: SparkSession, hints: dict[str, list[str]] | None = None) -> DataFrame:
    """The hint dimension as (app_category_slug, hint) rows."""
    hints = CATEGORY_HINTS if hints is None else hints
    return local_table(spark, [(name, hint) for name, words in hints.items() for hint in words], HINTS)
