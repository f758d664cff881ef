"""Connected components of a link table, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import kit


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of `links` (a, b) the smallest node that it reaches.

    Alternating star steps: every node links its larger neighbours to the smallest node it knows (large star), then its
    smaller ones (small star). Links never grow in number, a chain of n nodes takes about log n rounds, and each round
    is written to the shared folder. Nodes with many links are pre-aggregated by minimum before they are shuffled.
    """
    edges = kit.stored(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    state = None
    while True:
        # large star: larger neighbours of v link to the smallest of v and its neighbours
        both = edges.select(F.col("hi").alias("v"), F.col("lo").alias("u")).union(edges.select(F.col("lo").alias("v"), F.col("hi").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: smaller neighbours of v, and v, link to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").union(least.select("hi", F.col("m").alias("lo"))).distinct()
        edges = kit.stored(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        state = now
