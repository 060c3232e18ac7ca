"""Classes of things that are linked with one another, directly or by others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.session import cut


def components(links: DataFrame) -> DataFrame:
    """Rows (node, least) of the nodes in `links` (a, b): the smallest node of each one's class, by alternating stars.

    In a large star every node links its larger neighbours to the smallest node around it, in a small star the smaller ones and itself; both
    keep the classes, and in the end each node is linked to the smallest one only. The number of rounds grows with the logarithm of the nodes. Minima are
    combined before the shuffle, so a node with very many links is no burden there; in the joins it is split by the adaptive skew join.
    Null ends, links to oneself and repeated links change nothing; no links, no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v and a is not null and b is not null")
    edges = cut(edges.distinct())
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("least")).union(edges.select("v", "v").distinct())
        before = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut(small.select("u", "m").union(small.where("v <> m").select("v", "m")).toDF("u", "v").distinct())
