"""Connected components by alternating large-star and small-star steps on a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import lookup, written


def _starred(links: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours of each node on its least neighbour: the larger ones, or itself and the smaller ones."""
    ways = links.select("u", "v")
    if large:
        ways = ways.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = ways.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    joined = lookup(ways, least, ["u"], "inner")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
            least.select("u", F.col("least").alias("v"))
        )
    return moved.filter("u <> v").distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """``node`` and ``component``, its least node, for all nodes of the links (u, v). Integer nodes.

    Ends when no link changes any more: then every node but the least hangs on the least.
    """
    greater, smaller = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = written(links.filter("u <> v").select(greater, smaller).distinct(), "components")
    before = None
    for _ in range(most):
        now = written(_starred(_starred(now, True), False), "components")
        state = now.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
