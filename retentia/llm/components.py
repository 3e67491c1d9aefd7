"""Connected components of an edge table by alternating star contractions.

Each round replaces edges by edges to smaller neighbours (``large star`` then
``small star``); it ends when every edge points at its component's smallest
node. The rounds use only grouped minima and joins, so a node with millions of
neighbours is never gathered in one place, and each round's edges are written to
the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge to another one; ``edges`` has long columns u, v."""
    state = materialize(edges.select("u", "v").where("u != v").distinct(), "edges")
    mark = None
    while True:
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                state.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        mark = now
        state = materialize(_small_star(_large_star(state)).where("u != v").distinct(), "edges")
