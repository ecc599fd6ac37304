"""Connected components of a graph held as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partslake.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for each node of ``edges`` (a, b).

    Alternates two steps until nothing changes: every node hands its larger neighbours to
    its smallest one, then its smaller ones. Each step is an aggregate of the smallest
    neighbour per node, combined before the shuffle, joined back to the rows; a node with
    very many neighbours is split by the adaptive skew join. The number of rounds grows
    with the logarithm of the longest chain. Each round is written to the shared folder.
    """
    rows = edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rows = cut_lineage(rows)
    while True:
        both = rows.union(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.filter(F.col("b") > F.col("a")).join(low, "a")
            .select(F.col("m").alias("a"), "b").filter(F.col("a") < F.col("b")).distinct()
        )
        # each node (now b) keeps its smallest neighbour and links its other ones to that
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(down, "b")
            .select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
            .select("e.a", "e.b").filter(F.col("a") < F.col("b")).distinct()
        )
        small = cut_lineage(small)
        # finished when every node hangs on a root: no node is both above and below another
        if small.select("a").distinct().join(small.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count() == 0 and (
            small.groupBy("b").count().filter(F.col("count") > 1).limit(1).count() == 0
        ):
            break
        rows = small
    roots = small.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
