"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each neighbour (large: the larger ones; small: the smaller ones and the vertex itself)
    is tied to the least of the neighbourhood."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        far = F.col("b") > F.col("a")
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        far = F.lit(True)
    # the least neighbour is aggregated before the shuffle, so a hub is no single task's work
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    tied = around.filter(far).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not large:
        tied = tied.unionByName(least.select("a", F.col("least").alias("b")))
    return tied.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least vertex reachable from each vertex of the edges (a, b).

    Loops and repeated edges do no harm; no edges give no rows. Every round is stored, so a
    lost executor costs at most one round.
    """
    now = stored(edges.filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        now = stored(_star(_star(now, True), False), "stars")
        # edges as a set: their number and a sum of their hashes
        seen = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        mark = tuple(seen)
