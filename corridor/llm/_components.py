"""Connected components by contraction, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of ``edges`` (a, b): equal comp for nodes
    that a path joins.

    Each round every node merges into the node of its neighbourhood (itself
    included) that comes first in an order drawn anew per round; edges are
    renamed and loops and repeats dropped.  A constant share of the nodes goes
    each round, on chains as on stars, so rounds grow with the logarithm of
    the longest path.  Each round's tables are written to the shared folder,
    so lineage stays short."""
    ends = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "cc-edges")
    nodes = ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct().select("node", F.col("node").alias("comp"))
    step = 0
    while not ends.isEmpty():
        both = ends.union(ends.select("b", "a"))

        def order(c):
            return F.struct(F.xxhash64(F.col(c), F.lit(step)).alias("h"), F.col(c).alias("n"))

        into = stored(both.groupBy("a").agg(F.min(order("b")).alias("m"))
                      .select(F.col("a").alias("old"), F.least(F.col("m"), order("a"))["n"].alias("new")), "cc-into")
        nodes = stored(nodes.join(into, F.col("comp") == F.col("old"), "left")
                       .select("node", F.coalesce("new", "comp").alias("comp")), "cc-nodes")
        ends = stored(ends.join(into.select(F.col("old").alias("a"), F.col("new").alias("a2")), "a")
                      .join(into.select(F.col("old").alias("b"), F.col("new").alias("b2")), "b")
                      .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
                      .where("a <> b").distinct(), "cc-edges")
        step += 1
    return nodes
