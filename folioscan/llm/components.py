"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import stored


def connected(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that the edges (a, b) lead to, for every node named.

    Every step replaces edges by at most as many and halves the paths, so few steps
    suffice. Nodes with very many edges are summarised by a minimum before any join, and
    the join splits their rows.
    """
    edges = stored(edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).filter("a <> b").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        # Large star: neighbours above a node move to the least of its neighbourhood.
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col(
            "m").alias("b")).filter("a <> b").distinct()
        # Small star: a node and its neighbours below move to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                              F.struct("a", F.col("m").alias("b")))).alias("e")
        ).select("e.a", "e.b").filter("a <> b").distinct()
        new = stored(small, "edges")
        if not new.select("a").groupBy("a").count().filter("count > 1").limit(1).count() and (
            not new.alias("x").join(new.alias("y"), F.col("x.b") == F.col("y.a")).limit(1).count()
        ):
            break  # every node has one edge, and it leads to a node without one
        edges = new
    roots = new.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return new.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
