"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayrick.llm import common


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node reachable) of every node that has an edge.

    Edges are rewired, round by round: every node's neighbours are joined to the smallest
    of them (large ones first, then small ones), until each node hangs on its root. Rows
    never outnumber the edges, and aggregates are combined before the shuffle. Each round
    is written to the shared folder.
    """
    now = common.materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    count = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of a node go to the smallest node around it
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: smaller neighbours of a node, and the node, go to the smallest of them
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = common.materialize(small.where("u != v").distinct(), "edges")
        # Stars stay as they are, and nothing else does: then a round gives the same edges.
        n = after.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if count == n or after.isEmpty():
            break
        now, count = after, n
    roots = after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
