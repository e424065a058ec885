"""Temperature mixing of sources.

A source's share of all tokens is raised to an exponent and normalised. The exponent is
bisected (64 sections a round, each evaluated by Spark) for a target entropy of the
weights, for a limit on how often a source is repeated, or for both (the larger exponent
holds). The budget then gives every source a quota of tokens. A quota is realised as
whole passes over the source and one part of a pass. Each pass is a block permutation:
documents are dealt into blocks by hash, the blocks are put in an order of their own for
each pass, and so are the documents within a block; only block totals are summed along a
source. ``slot`` says where in the mixture (0 to 1) a block begins, so that reading by
``slot`` keeps the weights all along.

Without a budget it is the least that keeps every source whole, so no document is lost.

Tokens are words. Defined results: a null or empty text has no tokens and belongs to
every whole pass; a null ``source`` is a source of its own; a null ``doc_id`` stays null;
repeated rows are placed one by one; sources without any token get one whole pass; an
empty table gives no rows.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.sources.tables import stage

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 512
SECTIONS = 64


def count_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_tokens(sized: DataFrame) -> DataFrame:
    """``source``, ``tokens`` and ``docs`` of each source."""
    return sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))


def solve_exponent(sources: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None, budget: float | None = None, most: float = 8.0, rounds: int = 6) -> float:
    """The least exponent from 0 to ``most`` whose weights have at most the target entropy (in nats)
    and repeat no source more than the limit; 1 keeps the shares as they are (and is the result
    if neither target is given or no source has a token).

    Raises ValueError where a target is out of reach, or both cannot be met by one exponent:
    entropy falls with the exponent, repetition is least at 1 and grows on either side.
    """
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total or (target_entropy is None and repetition_limit is None):
        return 1.0
    share = F.log(F.col("tokens") / F.lit(float(total)))

    def met(low: float, step: float, n: int, entropy_target: float | None, limit: float | None) -> list[int]:
        """Which of the exponents ``low + i * step`` meet the given targets."""
        tried = sources.where("tokens > 0").select(share.alias("l"), "tokens", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i"))
        exponent = F.lit(low) + F.col("i") * F.lit(step)
        power = F.exp(F.col("l") * exponent)
        rows = (
            tried.groupBy("i")
            .agg(
                F.sum(power).alias("z"),
                F.sum(power * F.col("l") * exponent).alias("zl"),
                F.max(power / F.col("tokens")).alias("most"),
                F.min(power / F.col("tokens")).alias("least"),
            )
            .collect()  # n + 1 rows.
        )
        good = []
        for r in rows:
            entropy = math.log(r.z) - r.zl / r.z
            # Without a budget the least repeated source is kept whole once.
            repeats = r.most / r.least if budget is None else budget * r.most / r.z
            if (entropy_target is None or entropy <= entropy_target + 1e-9) and (limit is None or repeats <= limit * (1 + 1e-9)):
                good.append(r.i)
        return good

    def least(name: str, entropy_target: float | None, limit: float | None) -> float:
        low, high = 0.0, most
        for _ in range(rounds):
            step = (high - low) / SECTIONS
            good = met(low, step, SECTIONS, entropy_target, limit)
            if not good:
                raise ValueError(f"no exponent up to {most} meets the {name}")
            if min(good) == 0:
                return low
            low, high = low + (min(good) - 1) * step, low + min(good) * step
        return high

    found = max(
        least("target entropy", target_entropy, None) if target_entropy is not None else 0.0,
        least("repetition limit", None, repetition_limit) if repetition_limit is not None else 0.0,
    )
    if not met(found, 0.0, 0, target_entropy, repetition_limit):
        raise ValueError("no exponent meets the target entropy and the repetition limit together")
    return found


def quotas(sources: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """``source``, ``tokens``, ``docs``, ``weight`` and the ``quota`` of tokens of each source."""
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    power = F.when(F.col("tokens") > 0, F.exp(F.log(F.col("tokens") / F.lit(float(total))) * exponent)).otherwise(0.0)
    powered = sources.withColumn("power", power)
    sums = powered.agg(F.sum("power"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("power")))).first()
    whole = float(budget) if budget is not None else (sums[1] or 0.0) * (sums[0] or 1.0)
    weight = F.col("power") / F.lit(sums[0] or 1.0)
    quota = F.round(weight * F.lit(whole)).cast("long")
    if budget is None:
        quota = F.greatest(quota, F.col("tokens"))
    return powered.select("source", "tokens", "docs", weight.alias("weight"), quota.alias("quota"))


def _block_of(plan: DataFrame, seed: int) -> tuple[DataFrame, Column]:
    """What dealing needs of the plan, its sources as ``_s``; the block of a ``key`` of a source."""
    passes = F.when(F.col("tokens") > 0, F.floor((F.col("quota") - 1) / F.greatest("tokens", F.lit(1))).cast("int")).otherwise(0)
    plan = plan.select(
        F.col("source").alias("_s"), "tokens", "quota", F.greatest(passes, F.lit(0)).alias("last"), F.ceil(F.col("docs") / F.lit(BLOCK)).cast("int").alias("blocks")
    )
    return plan, F.pmod(F.xxhash64("key", F.lit(seed)), F.col("blocks")).cast("int")


def _in_blocks(sized: DataFrame, plan: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """``sized`` with its source's plan and ``block``, written; and for every block and pass its ``size`` in tokens and the tokens ``before`` it."""
    plan, block = _block_of(plan, seed)
    dealt = sized.join(plan, F.col("source").eqNullSafe(F.col("_s"))).withColumn("block", block)
    dealt = stage(dealt.drop("blocks"), "mixing-dealt")
    totals = dealt.groupBy("_s", "block", "tokens", "quota", "last").agg(F.sum("n_tokens").alias("size"))
    each = totals.withColumn("pass", F.explode(F.sequence(F.lit(0), "last")))
    order = Window.partitionBy("_s", "pass").orderBy(F.xxhash64("block", "pass", F.lit(seed)), "block").rowsBetween(Window.unboundedPreceding, -1)
    return dealt, each.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("pass") * F.col("tokens"))


def place(sized: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """Every placing of a row: the columns of ``sized`` (``row``, ``key``, ``source``, ``n_tokens`` and others),
    ``pass``, ``block``, ``rank`` within the block and ``slot``."""
    dealt, begun = _in_blocks(sized, plan, seed)
    # A block that begins behind the quota holds nothing but, in the first pass, documents without tokens.
    kept = begun.where("before < quota or pass = 0").select(F.col("_s").alias("_s2"), F.col("block").alias("_b"), "pass", "before")
    placed = dealt.join(kept, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("block") == F.col("_b")))
    inside = Window.partitionBy("_s", "block", "pass").orderBy(F.xxhash64("key", "pass", F.lit(seed + 1)), "key", "n_tokens")
    ahead = F.col("before") + F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slot = F.when(F.col("quota") > 0, F.col("before") / F.col("quota")).otherwise(0.0)
    return (
        placed.select("*", ahead.alias("ahead"), F.row_number().over(inside).alias("rank"), slot.alias("slot"))
        .where("ahead < quota or (pass = 0 and n_tokens = 0)")
        .select(*sized.columns, "pass", "block", "rank", "slot")
    )


def _planned(sized: DataFrame, target_entropy, repetition_limit, budget) -> DataFrame:
    sources = stage(source_tokens(sized), "mixing-sources")
    return quotas(sources, solve_exponent(sources, target_entropy, repetition_limit, budget), budget)


def mixture(docs: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None, budget: float | None = None, seed: int = 17) -> DataFrame:
    """``doc_id``, ``source``, ``n_tokens``, ``pass``, ``block``, ``rank`` and ``slot`` of every placing of a document."""
    key = F.xxhash64("doc_id", "text")
    sized = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), key.alias("key"), count_tokens(F.col("text")).alias("n_tokens")), "mixing-sizes")
    placed = place(sized, _planned(sized, target_entropy, repetition_limit, budget), seed)
    return placed.select("doc_id", "source", "n_tokens", "pass", "block", "rank", "slot")


def realise(docs: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None, budget: float | None = None, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` as often as the mixture places them, with the columns of ``docs``.

    A pass takes nearly all blocks whole: their rows follow from the block alone. Only rows of blocks
    that a quota cuts are shuffled, to be looked up one by one. ``docs`` is read twice and not written.
    """
    columns = docs.columns
    source, key = F.col("source").cast("string"), F.xxhash64("doc_id", "text")
    sized = stage(docs.select(source.alias("source"), key.alias("key"), count_tokens(F.col("text")).alias("n_tokens")), "mixing-sizes")
    plan = _planned(sized, target_entropy, repetition_limit, budget)
    dealt, begun = _in_blocks(sized, plan, seed)
    whole = F.expr("before + size < quota or (pass = 0 and before + size <= quota)")
    begun = stage(begun.where("before < quota or pass = 0").withColumn("whole", whole), "mixing-passes")
    blocks = stage(begun.groupBy("_s", "block").agg(F.count_if("whole").cast("int").alias("whole"), F.count_if(~F.col("whole")).cast("int").alias("cut")), "mixing-blocks")

    # Equal rows of a cut block are one entry; ``taken`` of them fit under the quota.
    cuts = begun.where("not whole").select(F.col("_s").alias("_s2"), F.col("block").alias("_b"), "pass", "before")
    entries = dealt.join(cuts, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("block") == F.col("_b")))
    entries = entries.groupBy("_s", "block", "pass", "before", "quota", "key", "n_tokens").agg(F.count("*").alias("rows"))
    inside = Window.partitionBy("_s", "block", "pass").orderBy(F.xxhash64("key", "pass", F.lit(seed + 1)), "key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    entries = entries.withColumn("room", F.expr("quota - before") - F.coalesce(F.sum(F.expr("rows * n_tokens")).over(inside), F.lit(0)))
    taken = F.expr("if(n_tokens = 0, if(room > 0 or pass = 0, rows, 0), least(rows, greatest(0, ceil(room / greatest(n_tokens, 1)))))")
    entries = stage(entries.groupBy(F.col("_s").alias("_s3"), F.col("key").alias("_k")).agg(F.collect_list(taken).alias("taken")), "mixing-cut")

    sources, block = _block_of(plan, seed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("r"), source.alias("source"), key.alias("key"))
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("_s"))).select("r", "source", "key", block.alias("block"))
    rows = rows.join(blocks.withColumnRenamed("block", "_b"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    placed = rows.where("cut = 0").select("r", F.col("whole").alias("copies"))
    one_of = F.row_number().over(Window.partitionBy("source", "key").orderBy("key"))
    partly = rows.where("cut > 0").select("r", "source", "key", "whole", one_of.alias("nth"))
    partly = partly.join(entries, F.col("source").eqNullSafe(F.col("_s3")) & (F.col("key") == F.col("_k")))
    partly = partly.select("r", F.expr("whole + size(filter(taken, t -> t >= nth))").alias("copies"))
    copied = placed.unionByName(partly).where("copies > 0")
    return copied.select("r", F.explode(F.sequence(F.lit(1), "copies"))).select(*[F.col(f"r.`{c}`").alias(c) for c in columns])
