"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (long columns a, b): root is the least node of its component.

    Rounds of large and small stars until nothing changes; their number grows
    with the logarithm of the largest component. Work and state are grouped
    counts and joins over the edges, never a component in one task.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum((F.xxhash64("a", "b") % 1_000_000_007).cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: greater neighbours go to the least of all neighbours and the node itself.
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = now.join(least, now["b"] == least["n"]).select(now["a"], F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its lesser neighbours go to the least of these.
        lowest = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(lowest, large["a"] == lowest["n"]).select(large["b"].alias("a"), F.col("m").alias("b")).unionByName(lowest.select(F.col("n").alias("a"), F.col("m").alias("b")))
        now = checkpointed(small.where("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
