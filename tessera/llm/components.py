"""Connected components of a table of links, by alternating star contraction.

Each round joins every node to the smallest of its neighbours: first larger neighbours, then
smaller ones. A round is a few shuffles of the links that are left; links shrink to stars in
about as many rounds as the logarithm of the longest path. Minima are taken by partial
aggregation and joined back, so a node with very many links is split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """links: a > b. Large star: every node's larger neighbours go to its smallest neighbour (or itself). Small star: a node's smaller neighbours and itself go to the smallest."""
    if larger:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        out = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) longs, a <> b -> (node, component): each node that has a link, and the smallest node it reaches. Rows with nulls are left out; repeated links and either direction do no harm."""
    now = checkpointed(links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).filter("a <> b").distinct())
    state = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == state or not found[0]:
            break
        state = tuple(found)
        now = checkpointed(_star(_star(now, True), False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
