"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for the nodes of ``links`` (a, b).

    Each round first hangs every node's larger neighbours on its smallest one, then its smaller
    neighbours.  Minima have partial aggregates, so a hub doesn't gather its links in one task;
    the join that brings them back is an equi-join that Spark can split.  Rounds, about the
    logarithm of the longest path, end when nothing changes.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = materialize(links, "nodes")
    before = None
    while True:
        sign = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (sign.n, sign.s) == before or not sign.n:
            break
        before = sign.n, sign.s
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").union(low.select(F.col("a").alias("x"), "m"))
        fewer = materialize(small.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "small-star")
        discard(links, large)
        links = fewer
    pairs = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.union(pairs.select(F.col("component").alias("node"), "component").distinct())
