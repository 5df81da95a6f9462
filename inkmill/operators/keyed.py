"""Keyed work that stays balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lookup_by_key(rows: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of ``rows`` with ``answers``, one answer per key, where one key may hold much of ``rows``.

    The answers are dealt out anew, so both sides of the join are exchanges of its own: adaptive
    execution splits the partition of a hot key, and broadcasts the answers only when it has seen that
    they are small.
    """
    return rows.join(answers.hint("rebalance"), keys, "left")


def with_position(
    df: DataFrame, groups: list[str], order: Column, name: str = "position", width: int = 100_000
) -> DataFrame:
    """Number the rows of each group from 1 by an integer order that is unique in the group.

    No group is sorted as a whole: rows are cut into ranges of at most ``width`` rows, only the
    range counts are summed up per group, and the numbering inside a range adds its offset.
    """
    ranged = df.withColumn("_order", order.cast("bigint")).withColumn(
        "_range", F.floor(F.col("_order") / F.lit(width))
    )
    before = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*groups, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = W.partitionBy(*groups, "_range").orderBy("_order")
    return (
        ranged.join(offsets, [*groups, "_range"])
        .withColumn(name, F.col("_before") + F.row_number().over(inside))
        .select(*df.columns, name)
    )
