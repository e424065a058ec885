"""Connected components of an undirected graph, as Spark joins on edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.sources.tables import stage


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node of ``edges`` (``a``, ``b``: long).

    Alternates the large-star and small-star steps (Kiveris et al., "Connected Components
    in MapReduce and Beyond", 2014) until each node hangs on its root. A step keeps one
    row for each edge at most, minima combine before the shuffle, and every round is
    written to the shared folder. Loops are ignored; no edges give no rows.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = stage(hung.unionByName(least.withColumnRenamed("m", "b")).distinct(), "edges")
        # Finished when every edge leads to a node that leads nowhere, and each node has one.
        inner = small.select(F.col("b").alias("a")).distinct().join(small, "a", "left_semi").limit(1).count()
        edges = small
        if not inner and not small.groupBy("a").count().where("count > 1").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
