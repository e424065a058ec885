"""Column expressions for case, run and event records."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caseloom.functions.text import js_trim, or_default, slug, text
from caseloom.schemas import SPECS, VERIFIED_CORRECTED, VERIFIED_GOOD

# Keys of a usage document, in either spelling; kept as text because providers differ on quoting.
USAGE_SCHEMA = (
    "input_tokens string, inputTokens string, output_tokens string, outputTokens string, "
    "total_tokens string, totalTokens string, output_tokens_details struct<reasoning_tokens: string>"
)

# Phrases of an error that passes once the database is awake.
TRANSIENT_PHRASES = [
    "failed to connect", "connection timeout", "connect etimedout", "request timeout", "timeout expired",
    "could not connect",
]


def read_json(c: Column, schema: str | StructType, fallback: Column) -> Column:
    """Typed JSON read; NULL, blank or malformed text, or another type, gives the fallback. The text is parsed once."""
    kind = schema.simpleString() if isinstance(schema, StructType) else schema
    if ":" not in kind and "<" not in kind and " " in kind:
        kind = "struct<" + ", ".join(": ".join(part.split()) for part in kind.split(",")) + ">"
    return F.coalesce(F.try_variant_get(F.try_parse_json(F.nullif(c, F.lit(""))), "$", kind), fallback)


def read_variant(c: Column, fallback: str = "{}") -> Column:
    """Open JSON document as a variant."""
    return F.coalesce(F.try_parse_json(F.nullif(c, F.lit(""))), F.parse_json(F.lit(fallback)))


def parse_specs(c: Column) -> Column:
    """Spec object text as ordered key/value pairs."""
    return F.coalesce(F.map_entries(F.from_json(c, "map<string,string>")), F.array()).cast(SPECS)


def usage_columns(usage: Column) -> dict[str, Column]:
    """Token counts of a document read with ``USAGE_SCHEMA``.

    Either key spelling, the first that is not zero; the total from its parts when absent.
    """

    def count(*names: str) -> Column:
        values = [F.nullif(usage[name].try_cast("bigint"), F.lit(0)) for name in names]
        return F.coalesce(*values, F.lit(0).cast("bigint"))

    given, produced = count("input_tokens", "inputTokens"), count("output_tokens", "outputTokens")
    total = F.coalesce(F.nullif(count("total_tokens", "totalTokens"), F.lit(0)), given + produced)
    reasoning = usage["output_tokens_details"]["reasoning_tokens"].try_cast("bigint")
    return {
        "input_tokens": given,
        "output_tokens": produced,
        "total_tokens": total,
        "reasoning_tokens": F.coalesce(reasoning, F.lit(0).cast("bigint")),
    }


def learning_eligible(decision: Column) -> Column:
    return js_trim(decision).isin(VERIFIED_GOOD, VERIFIED_CORRECTED)


def reference_type(decision: Column) -> Column:
    verdict = js_trim(decision)
    return (
        F.when(verdict == VERIFIED_GOOD, "positive").when(verdict == VERIFIED_CORRECTED, "corrective").otherwise("")
    )


def sequence_key(category: Column) -> Column:
    return F.concat(F.lit("case_number_"), slug(category))


def case_number(category: Column, number: Column) -> Column:
    """Slug, ``_`` and at least five digits; larger numbers are not cut."""
    return F.format_string("%s_%05d", slug(category), number)


def folder_path(rating: Column, category: Column, pdf_name: Column) -> Column:
    return F.concat_ws("/", F.concat(F.lit("historical-case-"), rating), slug(category), text(pdf_name))


def is_transient(message: Column) -> Column:
    return F.lower(text(message)).rlike("|".join(TRANSIENT_PHRASES))


def product_line(position: Column) -> Column:
    """One numbered text line of a ranked product row; the first six specs follow when there are any."""
    pairs = F.concat_ws(
        "; ",
        F.transform(F.slice(F.col("specs"), 1, 6), lambda s: F.concat_ws(": ", s["key"], s["value"])),
    )
    return F.concat(
        position.cast("string"), F.lit(". "), text(F.col("product_name")),
        F.lit(" | SKU: "), or_default(F.col("sku"), "N/A"),
        F.lit(" | Brand: "), or_default(F.col("brand"), "N/A"),
        F.lit(" | Price: "), or_default(F.col("price_text"), "N/A"),
        F.lit(" | Availability: "), or_default(F.col("availability"), "unknown"),
        F.lit(" | URL: "), text(F.col("product_url")),
        F.when(pairs != "", F.concat(F.lit(" | Specs: "), pairs)).otherwise(F.lit("")),
    )
