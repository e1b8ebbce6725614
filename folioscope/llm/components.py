"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import written


def roots(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of an edge.

    Each round links every node's larger neighbours to its smallest neighbour,
    then its smaller ones; what is left after the last round are stars around
    the roots. Minima are aggregated before the join back, so a hub is one row
    on one side. Rounds grow with the logarithm of a component's size; each is
    written to the shared folder."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, before = written(now, "edges"), None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select("v", "v").distinct())
        before = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # the smallest neighbour of u among those below it; every edge points down
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(below, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(
            joined.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "edges")
