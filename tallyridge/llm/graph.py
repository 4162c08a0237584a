"""Connected components over edges held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyridge.llm.common import Scratch


def _least_neighbours(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(u, m)``: written out, so that the join with the edges of a hub can be split."""
    return scratch.table(edges.groupBy("u").agg(F.min("v").alias("m")), name)


def _settled(edges: DataFrame) -> bool:
    """Whether each node has either one edge downwards or only ones from above."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str, most_rounds: int = 50) -> DataFrame:
    """``(node, component)`` of all nodes of ``edges(u, v)``; a component is called by its smallest node.

    Alternates large and small stars, each a grouped minimum and a join, until every node has one
    edge, to its component's smallest node. Every round is written to the shared folder; the one
    before it is dropped. Loops are ignored; no edges give no rows.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    state = scratch.table(pairs, f"{name}-0")
    for k in range(1, most_rounds + 1):
        if _settled(state):
            break
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbours(both, scratch, f"{name}-{k}-large")
        stars = scratch.table(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")), f"{name}-{k}-stars")
        least = _least_neighbours(stars, scratch, f"{name}-{k}-small")
        small = stars.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        state = scratch.table(small, f"{name}-{k}")
        scratch.drop(*(f"{name}-{part}" for part in (f"{k}-large", f"{k}-stars", f"{k}-small", str(k - 1))))
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    roots = state.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
