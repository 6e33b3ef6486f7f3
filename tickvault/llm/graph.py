"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickvault.llm.common import materialise


def _towards_minimum(edges: DataFrame, smaller: bool) -> DataFrame:
    """Link the neighbours of every node (the smaller or the larger ones) to their minimum."""
    if smaller:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = around.join(least, "u")
    if smaller:
        out = linked.select(F.col("v").alias("u"), "m").unionByName(least)
    else:
        out = linked.where("v > u").select(F.col("v").alias("u"), "m")
    return out.where("u <> m").select("u", F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge in ``edges`` (u, v); root is the least node.

    Each round is written, so a lost executor costs one round, and the number of rounds
    grows with the logarithm of the number of nodes.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .distinct(), "components")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))), F.lit(0))).first()
        if state[0] == 0 or tuple(state) == seen:
            break
        seen = tuple(state)
        now = materialise(_towards_minimum(_towards_minimum(now, smaller=False), smaller=True), "components")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
