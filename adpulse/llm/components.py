"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adpulse.llm.runtime import keep


def _ordered(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node.

    Each round maps every node to the smallest node next to it, follows that
    map once more, and contracts the graph by it, so that even a path loses
    most of its nodes in a round.  Only the contracted edges go on.  All steps
    are joins of written tables and partial aggregations: a node with very many
    edges is summed up before its shuffle, and its rows in a join are split by
    the adaptive skew join.  Loops and repeated edges are harmless; without
    edges the result is empty.
    """
    spark = edges.sparkSession
    rest = keep(edges.select(*_ordered(F.col("a"), F.col("b"))).where("a < b").distinct(), "edges")
    found = None
    while not rest.isEmpty():
        ends = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = keep(ends.groupBy("a").agg(F.min("b").alias("b"))
                    .select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "near")
        far = near.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = keep(near.join(far, "root").select("node", F.col("next").alias("root")), "step")
        if found is None:
            found = step
        else:
            onward = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = keep(found.join(onward, "root", "left")
                         .select("node", F.coalesce("next", "root").alias("root")), "roots")
        ra = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        rb = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = keep(rest.join(ra, "a").join(rb, "b").select(*_ordered(F.col("ra"), F.col("rb")))
                    .where("a < b").distinct(), "edges")
    if found is None:
        return spark.createDataFrame([], "node long, root long")
    return found
