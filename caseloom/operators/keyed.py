"""Keyed building blocks: last write per key, newest rows, upsert, numbering in order.

A key may hold a third of all rows, so no step gathers a raw group in one task:
the ranked filters keep their limit on the map side (Catalyst plans
``WindowGroupLimit``), sums combine before the shuffle, and numbering works on
range partitions that cut through groups.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.sources.tables import stage

# Slices a group is spread over before its newest rows are picked.
SLICES = 64


def as_ntz(moment) -> Column:
    """A UTC moment (datetime, text or column) as ``timestamp_ntz``."""
    if isinstance(moment, Column):
        return moment.cast("timestamp_ntz")
    return F.lit(str(moment)).cast("timestamp_ntz")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last one by ``order``."""
    latest = Window.partitionBy(*keys).orderBy(*[F.col(name).desc() for name in order])
    return df.withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1").drop("_rank")


def newest(df: DataFrame, n: int, recency: str, tie: list[str]) -> DataFrame:
    """The newest ``n`` rows of a table (at least one is asked for), newest first."""
    return df.orderBy(F.col(recency).desc(), *tie).limit(max(1, n))


def newest_per_group(
    df: DataFrame, group: str, recency: str, tie: list[str], n: int = 250, position: str | None = None
) -> DataFrame:
    """The newest ``n`` rows of every group.

    Done twice: within slices of a group, then over what the slices kept. A hot group
    is thus sorted by many tasks and the last one sees at most ``n`` rows per slice. Any
    assignment of rows to slices gives the same rows, so the scan's partition serves.
    """
    order = [F.col(recency).desc(), *[F.col(name) for name in tie]]
    name = position or "_position"
    sliced = df.withColumn("_slice", F.spark_partition_id() % SLICES)
    within = Window.partitionBy(group, "_slice").orderBy(*order)
    sliced = sliced.withColumn("_local", F.row_number().over(within)).filter(F.col("_local") <= n)
    overall = Window.partitionBy(group).orderBy(*order)
    out = sliced.drop("_slice", "_local").withColumn(name, F.row_number().over(overall)).filter(F.col(name) <= n)
    return out if position else out.drop(name)


def upsert(
    target: DataFrame, changes: DataFrame, key: str, order: list[str] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """New state of ``target`` after writing ``changes`` by ``key``.

    Every non-key column is replaced on a match, except those in ``keep``, which survive;
    unmatched changes are inserted. ``order`` tells which of several changes to one key is
    last. The target is only ever probed by key, so when the changes are small enough for
    Catalyst to broadcast them it is not shuffled at all; otherwise both sides shuffle on
    the key, which is unique.
    """
    if order:
        changes = keep_last(changes, [key], order)
    rows = changes.select(*target.columns)
    touched = rows.select(key)
    untouched = target.join(touched, key, "left_anti")
    if keep:
        kept = target.select(key, F.lit(True).alias("_matched"), *[F.col(c).alias(f"_old_{c}") for c in keep])
        kept = kept.join(touched, key, "left_semi")
        rows = rows.join(kept, key, "left").select(
            *[
                F.when(F.col("_matched"), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c)
                for c in target.columns
            ]
        )
    return untouched.unionByName(rows)


def number_in_order(
    df: DataFrame, group: str, moment: str, tie: list[str], number: str = "number",
    offsets: DataFrame | None = None,
) -> DataFrame:
    """Gap-free numbers 1, 2, 3, ... per group in arrival order; ``offsets(group, start)`` shifts a group.

    The rows are put in order over range partitions of even size and written with their
    place. The cuts may fall anywhere, also inside a group or among equal moments, so
    neither a group nor a burst of arrivals lands in one task. A number is then the distance
    to the group's first place, for which one row per partition and one per group suffice.
    """
    order = [group, moment, *tie]
    placed = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ordered",
    )
    # An id holds the partition in its upper bits and the row within it in the lower 33.
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND(F.lit(2**33 - 1)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    # No more rows than shuffle partitions, so the hint is safe.
    starts = F.broadcast(starts)
    # One row per partition and group; a group's first place is the least of its rows'.
    met = placed.groupBy("_part", group).agg(F.min("_row").alias("_row")).join(starts, "_part")
    firsts = met.groupBy(F.col(group).alias("_group")).agg(F.min(F.col("_start") + F.col("_row") - 1).alias("_before"))
    if offsets is not None:
        shift = offsets.select(F.col(group).alias("_shifted"), "start")
        firsts = firsts.join(shift, F.col("_group").eqNullSafe(F.col("_shifted")), "left").select(
            "_group", (F.col("_before") - F.coalesce(F.col("start"), F.lit(0))).alias("_before")
        )
    # Back to the rows by partition and group, so that a hot group stays split.
    shifts = met.join(firsts, F.col(group).eqNullSafe(F.col("_group"))).select(
        F.col("_part").alias("_part2"), "_group", (F.col("_start") - F.col("_before")).alias("_shift")
    )
    own = (F.col("_part") == F.col("_part2")) & F.col(group).eqNullSafe(F.col("_group"))
    return (
        placed.join(shifts, own)
        .withColumn(number, (F.col("_row") + F.col("_shift")).cast("bigint"))
        .drop("_at", "_part", "_row", "_part2", "_group", "_shift")
    )
