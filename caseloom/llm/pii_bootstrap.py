"""Personal data in whole texts: fixed base patterns, then bootstrapped contextual extraction.

Base spans come from four regular expressions with checks. They seed the bootstrap, each
as a whole and by the words it covers: every word with a digit is a possible identifier,
its lexical pattern is the word before it and its own shape. A pattern is scored by the
mean score of its instances, an instance by the patterns that hold it (noisy or); seeds
score 1 and stay so. After a few rounds, high-scoring patterns that several different
seeds support are accepted. What they hold supports patterns of the next generation,
with the score it has from accepted patterns, wherever else it occurs; generations go on
until one accepts nothing new. Occurrences of accepted patterns are spans of kind "id".
Only DataFrame functions are used.

The expressions are written so that Java's matcher is linear in the text: possessive
repeats where giving back cannot help, and a match may start within a run only at its
first character (or where the previous match ended). They match what the plain forms in
``PLAIN`` match.

Defined results: a null text counts as empty and has no spans; a null ``doc_id`` stays
null; repeated rows give one result each, tied to the row and not to its id; of two
overlapping spans of different kinds both are reported; an empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.bloom_cascade import mark_likely
from caseloom.sources.tables import stage

#: Fixed patterns of the base kinds, in the order in which kinds are listed.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LINEAR = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to occur in it; cheaper than the pattern.
HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
KINDS = [*LINEAR, "id"]
SPAN = "array<struct<kind:string,start:int,end:int>>"
FOUND = "array<struct<start:int,end:int,m:string,before:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """All matches with their places (code points, end exclusive) and the text since the match before."""
    zipped = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")),
    )

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), x["gap"].alias("before"))
        return F.when(x["m"].isNull(), done).otherwise(F.struct(end.alias("at"), F.concat(done["out"], F.array(one)).alias("out")))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out"))
    return F.aggregate(zipped, first, step, lambda done: done["out"])


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def part(i: Column) -> Column:
        value = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = value * 2
        return F.when(i % 2 == 0, value).otherwise(doubled - F.when(doubled > 9, 9).otherwise(0))

    parts = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), part)
    return F.aggregate(parts, F.lit(0), lambda a, b: a + b) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    """The check a match must pass."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, "[.]"), lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by kind as listed and then by start."""
    kinds = []
    for kind, pattern in LINEAR.items():
        likely = F.contains(text, F.lit(HINT[kind])) & text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}" if kind == "card" else pattern)
        kinds.append(F.when(likely, _kept(text, kind, pattern)).otherwise(F.array().cast(SPAN)))
    return F.concat(*kinds)


def _kept(text: Column, kind: str, pattern: str) -> Column:
    passed = F.filter(_matches(text, pattern), lambda x: _holds(kind, x["m"]))
    return F.transform(passed, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _candidates(text: Column) -> Column:
    """Words of any length that hold a digit or an at sign, less the marks around them, with the word before."""
    def one(x: Column) -> Column:
        lead = F.length(F.regexp_extract(x["m"], "^[^A-Za-z0-9+]*", 0))
        core = F.regexp_replace(F.regexp_replace(x["m"], "^[^A-Za-z0-9+]+", ""), "(?<![^A-Za-z0-9])[^A-Za-z0-9]++$", "")
        start = x["start"] + lead
        return F.struct(
            start.alias("start"),
            (start + F.length(core)).alias("end"),
            core.alias("core"),
            F.lower(F.regexp_extract(x["before"], r"(?<!\S)(\S++)\s++$", 1)).alias("before"),
        )

    return F.when(text.rlike("[0-9@]"), F.transform(_matches(text, TOKEN), one)).otherwise(F.array().cast("array<struct<start:int,end:int,core:string,before:string>>"))


def scan(docs: DataFrame) -> DataFrame:
    """``row`` (stands for the input row), ``doc_id``, ``base`` spans and ``words`` that may be identifiers, written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return stage(read.select("row", "doc_id", base_spans(F.col("text")).alias("base"), _candidates(F.col("text")).alias("words")), "pii-scan")


def occurrences(found: DataFrame) -> DataFrame:
    """One row for each possible identifier: its place, pattern, instance and whether a base span covers part of it.

    A base span over several words is a further row, with their text as its instance. Patterns and instances
    of many characters go by their digest: they are only ever compared.
    """
    meets = lambda s, w: (s["start"] < w["end"]) & (w["start"] < s["end"])
    entry = lambda start, end, core, before, seed: F.struct(start.alias("start"), end.alias("end"), core.alias("core"), before.alias("before"), seed.alias("seed"))
    words = F.filter("words", lambda w: w["end"] > w["start"])
    single = F.transform(words, lambda w: entry(w["start"], w["end"], w["core"], w["before"], F.exists("base", lambda s: meets(s, w))))
    single = F.filter(single, lambda w: w["seed"] | w["core"].rlike("[0-9]"))
    covered = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.filter(words, lambda w: meets(s, w)).alias("words")))
    several = F.transform(
        F.filter(covered, lambda s: F.size(s["words"]) > 1),
        lambda s: entry(s["start"], s["end"], F.array_join(F.transform(s["words"], lambda w: w["core"]), " "), s["words"][0]["before"], F.lit(True)),
    )
    each = found.where("size(words) > 0").select("row", F.explode(F.concat(single, several)).alias("w"))
    shape = F.concat_ws(":", F.regexp_replace(F.regexp_replace("w.core", "[0-9]+", "9"), "[A-Za-z]+", "a"), F.length("w.core"))
    pattern = F.concat_ws(" ", "w.before", shape)
    return each.select("row", "w.start", "w.end", _short(pattern).alias("pattern"), _short(F.col("w.core")).alias("instance"), "w.seed")


def _short(value: Column) -> Column:
    """A string as it is, or its SHA-256 where it is longer than one."""
    return F.when(F.length(value) <= 64, value).otherwise(F.concat(F.lit("sha256:"), F.sha2(value, 256)))


def _any_of(scores: Column) -> Column:
    """Noisy or over a group."""
    return 1 - F.exp(F.sum(F.log(F.greatest(1 - scores, F.lit(1e-9)))))


def score_patterns(graph: DataFrame, rounds: int = 3, prior: float = 1.0) -> DataFrame:
    """``pattern``, ``score`` and ``support`` (different instances that are believed already).

    ``graph`` holds each ``pattern`` and ``instance`` once, with the ``belief`` in the instance that the
    rounds start from and do not fall below. Sums combine before every shuffle.
    """
    scored = graph.groupBy("instance").agg(F.max("belief").alias("s"))
    for _ in range(rounds):
        patterns = stage(
            graph.join(scored, "instance")
            .groupBy("pattern")
            .agg((F.sum("s") / (F.count("*") + prior)).alias("score"), F.count_if(F.col("belief") > 0).alias("support")),
            "pii-patterns",
        )
        scored = graph.join(patterns, "pattern").groupBy("instance").agg(F.greatest(F.max("belief"), _any_of(F.col("score"))).alias("s"))
    return patterns


def accepted_patterns(found: DataFrame, least_score: float, least_support: int) -> DataFrame:
    """``pattern`` and ``score`` of the patterns that any generation accepts; the last one adds none."""
    edges = stage(found.groupBy("pattern", "instance").agg(F.max("seed").cast("double").alias("seed")), "pii-graph")
    graph, accepted, known = edges.withColumnRenamed("seed", "belief"), None, 0
    while True:
        good = score_patterns(graph).where((F.col("score") >= least_score) & (F.col("support") >= least_support)).select("pattern", "score")
        good = good if accepted is None else good.unionByName(accepted).groupBy("pattern").agg(F.max("score").alias("score"))
        accepted = stage(good, "pii-accepted")
        before, known = known, accepted.count()
        if known == before:
            return accepted
        held = edges.join(accepted, "pattern").groupBy("instance").agg(_any_of(F.col("score")).alias("held"))
        graph = edges.join(held, "instance", "left").select("pattern", "instance", F.greatest("seed", F.coalesce("held", F.lit(0.0))).alias("belief"))
        graph = stage(graph, "pii-graph")


def discover(found: DataFrame, least_score: float = 0.6, least_support: int = 3) -> DataFrame:
    """``row`` and its spans of kind "id": what accepted patterns hold beside the base spans. Rows of equal texts may go by one ``row``."""
    seen = stage(occurrences(found), "pii-words")
    good = accepted_patterns(seen, least_score, least_support).select("pattern")
    spans = F.struct(F.lit("id").alias("kind"), "start", "end")
    return seen.where("not seed").join(good, "pattern").groupBy("row").agg(F.sort_array(F.collect_set(spans)).alias("ids"))


def find(docs: DataFrame, least_score: float = 0.6, least_support: int = 3) -> DataFrame:
    """``doc_id``, ``base`` and ``all`` spans of every document."""
    found = scan(docs)
    ids = discover(found, least_score, least_support)
    joined = found.select("row", "doc_id", "base").join(ids, "row", "left")
    return joined.select("doc_id", "base", F.concat("base", F.coalesce("ids", F.array().cast(SPAN))).alias("all"))


def listed(spans: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans that ``find`` returns."""
    counts = [F.size(F.filter("base", lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in LINEAR]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("all").alias("spans"))


def redact(docs: DataFrame, least_score: float = 0.6, least_support: int = 3) -> DataFrame:
    """The rows of ``docs``, each span in ``text`` replaced by its kind in angle brackets; of overlapping
    spans the first (at one place the longest) is named and all are taken out. Null texts stay null."""
    columns = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(F.xxhash64(F.lit(1), text).alias("g1"), F.xxhash64(F.lit(2), text).alias("g2"))  # Equal texts have equal spans.
    found = stage(docs.select(row.alias("row"), base_spans(text).alias("base"), _candidates(text).alias("words")), "pii-scan")
    ids = stage(discover(found, least_score, least_support).select("row.g1", "row.g2", "ids"), "pii-ids")
    # Only texts with spans of kind "id" are shuffled, and the few that a bounded filter takes for such.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("r"), "text", row.alias("row")).select("r", "text", "row.g1", "row.g2")
    rows = mark_likely(rows, ids.select("g1", "g2"))
    none = F.array().cast(SPAN)
    hit = rows.where("likely").join(ids, ["g1", "g2"], "left").select("r", "text", F.coalesce("ids", none).alias("ids"))
    joined = hit.unionByName(rows.where("not likely").select("r", "text", none.alias("ids")))
    joined = joined.select("r", "text", F.concat(base_spans(text), "ids").alias("spans"))
    order = F.array_sort("spans", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))

    def step(done: Column, s: Column) -> Column:
        cut = F.struct(s["end"].alias("at"), F.concat(done["out"], F.substring("text", done["at"] + 1, s["start"] - done["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"))
        wider = F.struct(F.greatest(done["at"], s["end"]).alias("at"), done["out"].alias("out"))
        return F.when(s["start"] >= done["at"], cut).otherwise(wider)

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(order, first, step, lambda d: F.concat(d["out"], F.substring("text", d["at"] + 1, F.length("text"))))
    return joined.select(*[(F.when(F.size("spans") == 0, F.col("text")).otherwise(clean) if c == "text" else F.col(f"r.`{c}`")).alias(c) for c in columns])
