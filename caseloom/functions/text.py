"""Text column expressions.

Java's ``\\s`` and Spark's ``trim`` know less whitespace than the data carries
(no-break space and its relatives), so one explicit class is used throughout.
All functions treat NULL as blank and return text, never NULL. Cuts count
characters, so none is ever halved.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Body of a character class. The rare characters sit behind one range test, which most characters fail at once.
WS = r" \t-\r[\x{A0}-\x{FEFF}&&[\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]"
# The same characters themselves, for trimming.
WS_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Entities in decoding order. "&amp;" comes second, so a doubly encoded "&amp;lt;" decodes fully.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it.

    Common parts of conditional branches and lambdas are not shared by the planner, which
    would run a pattern over a page once per mention.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def or_default(c: Column, default: str | Column) -> Column:
    """``c`` unless it is NULL or blank text."""
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(default))


def js_trim(c: Column) -> Column:
    return F.trim(text(c), F.lit(WS_CHARS))


def squash(c: Column) -> Column:
    """Whitespace runs to one space, edges trimmed."""
    return F.trim(F.regexp_replace(text(c), f"[{WS}]+", " "))


def slug(c: Column) -> Column:
    """Key form of a label: ASCII letters and digits, other runs one ``_``; blank becomes "other"."""
    key = F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "_"), F.lit("_"))
    return or_default(key, "other")


def decode_entities(c: Column) -> Column:
    out = text(c)
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def strip_html(c: Column) -> Column:
    """Tags to spaces, collapsed and trimmed, then decoded; decoding last keeps the spaces of ``&nbsp;``."""
    return decode_entities(squash(F.regexp_replace(text(c), "<[^>]+>", " ")))


def code_units(c: Column) -> Column:
    """Length in UTF-16 code units: a character beyond U+FFFF counts twice."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")


def cut(c: Column, size: int) -> Column:
    """The longest prefix of at most ``size`` UTF-16 code units; a character that would be halved goes."""
    def by_units(prefix: Column) -> Column:
        units = F.encode(prefix, "UTF-16BE")
        # The first byte of the last unit that fits tells whether a pair begins there.
        opens = F.hex(F.substring(units, 2 * size - 1, 1)).between("D8", "DB")
        kept = F.when(opens, F.substring(units, 1, 2 * size - 2)).otherwise(F.substring(units, 1, 2 * size))
        astral = prefix.rlike("[\\x{10000}-\\x{10FFFF}]")
        return F.when(astral, F.decode(kept, "UTF-16BE")).otherwise(prefix)

    # As many characters hold at least as many units, so all else happens on a bounded prefix.
    return F.element_at(F.transform(F.array(F.left(c, F.lit(size))), by_units), 1)


def clean_text(c: Column, size: int = 500) -> Column:
    return cut(squash(c), size)


def clean_large_text(c: Column, size: int = 6000) -> Column:
    """Trimmed and cut, inner whitespace kept apart from CRLF becoming LF."""
    return cut(js_trim(F.replace(text(c), F.lit("\r\n"), F.lit("\n"))), size)


def clean_path(c: Column, size: int = 500) -> Column:
    """Forward slashes only, no doubled, leading or trailing ones."""
    path = F.regexp_replace(F.replace(text(c), F.lit("\\"), F.lit("/")), "/+", "/")
    return cut(js_trim(F.trim(path, F.lit("/"))), size)


def searchable(c: Column) -> Column:
    """Lower case, everything but ASCII letters and digits collapsed to single spaces."""
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    """Distinct runs of three or more ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def join_present(*parts: Column) -> Column:
    """Non-blank parts joined by single spaces (``concat_ws`` skips the NULLs)."""
    return F.concat_ws(" ", *[F.nullif(part, F.lit("")) for part in parts])


def spec_words(specs: Column) -> Column:
    """``key value`` of every spec, joined by spaces."""
    return F.concat_ws(" ", F.transform(specs, lambda s: F.concat_ws(" ", s["key"], s["value"])))


def product_search_text(
    category: Column, label: Column, name: Column, sku: Column, brand: Column, description: Column, specs: Column
) -> Column:
    return searchable(join_present(category, label, name, sku, brand, description, spec_words(specs)))


def classifier_text(
    name: Column, sku: Column, brand: Column, description: Column, trail: Column, specs: Column
) -> Column:
    """Text the hint phrases are looked up in; punctuation stays."""
    return F.lower(
        join_present(name, sku, brand, description, F.concat_ws(" ", F.filter(trail, lambda t: t != "")),
                     spec_words(specs))
    )


def any_phrase(phrases: list[str]) -> str:
    """A pattern that finds any of the phrases.

    Phrases are merged by their beginnings, so at each place of a text only the branches of
    what was read so far are tried: the cost does not follow the number of phrases. A phrase
    that begins with another one is found by that one.
    """
    tree: dict = {}
    for phrase in sorted(set(phrases)):
        node = tree
        for char in phrase:
            if "" in node:
                break
            node = node.setdefault(char, {})
        else:
            node[""] = {}

    def quoted(char: str) -> str:
        return char if char.isalnum() or char.isspace() or ord(char) > 127 else "\\" + char

    def pattern(node: dict) -> str:
        if "" in node:
            return ""
        branches = []
        for char, below in node.items():
            chain = quoted(char)
            # A run without branches needs no group of its own.
            while len(below) == 1 and "" not in below:
                char, below = next(iter(below.items()))
                chain += quoted(char)
            branches.append(chain + pattern(below))
        if len(branches) == 1:
            return branches[0]
        # One look at the next character rules out places where no branch goes on.
        return f"(?=[{''.join(map(quoted, node))}])(?:{'|'.join(branches)})"

    return pattern(tree)


def _chat_text(updates: Column) -> Column:
    return F.concat_ws(
        " ",
        F.transform(updates, lambda u: F.concat(text(u["text"]), F.lit(" "), F.concat_ws(" ", u["insights"]))),
    )


def _request_text(fields: list[str]) -> Column:
    form = [text(F.col(f"formData.{name}")) for name in fields]
    return F.concat_ws(" ", text(F.col("category")), *form, _chat_text(F.col("chatUpdates")))


def case_search_text() -> Column:
    """Search text of a request row: category, nine form fields, chat text and insights."""
    return searchable(
        _request_text(
            ["application", "problem", "additionalInfo", "existing", "type", "load", "environment", "priority",
             "industry"]
        )
    )


def recommendation_text() -> Column:
    """Target text of a request row for product matching; load and industry are left out."""
    return _request_text(["application", "problem", "additionalInfo", "existing", "type", "environment", "priority"])
