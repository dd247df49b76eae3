"""Connected components of a table of links, by hooking to the smallest neighbour and jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The number of rounds grows with the logarithm of a component's diameter; beyond this many something is wrong.
MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps: each round links a node's neighbours to the smallest among them, so the table
    never has more links than it began with, and ends as stars around the smallest nodes. Each round is a written table.
    """
    spark = links.sparkSession
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    pairs, sign = common.materialise(pairs, "links"), None
    for _ in range(MOST_ROUNDS):
        with common.temporary(spark):
            # large-star: the larger neighbours of a node, to the smallest of itself and its neighbours
            both = pairs.union(pairs.select(F.col("b"), F.col("a")))
            low = common.materialise(both.groupBy("a").agg(F.min("b").alias("low")), "lows")
            low = low.select("a", F.least("a", "low").alias("low"))
            large = both.where("b > a").join(low, "a").select(F.col("low").alias("a"), "b").where("a < b").distinct()
            large = common.materialise(large, "large-star")
            # small-star: the smaller neighbours of a node and itself, to the smallest of them
            low = common.materialise(large.groupBy("b").agg(F.min("a").alias("low")), "lows")
            small = large.join(low, "b")
            small = small.select(F.col("low").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
            pairs = common.kept(small, "small-star")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("component"))
