"""Connected components of links, by union-find turned into joins: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the component's smallest node, itself included) of every node that ``links`` (a, b) names.

    A large star hangs each node's larger neighbours on the smallest of its neighbourhood, a small star the
    smaller ones; both keep what is connected connected, and after O(log^2 n) rounds every node hangs on its
    component's smallest. Each round is two grouped minima and joins, written to the shared folder; no component
    is gathered anywhere. Links that are stars already, which the first minima tell, take no round. Links with a null end and of a node to itself count as none; repeated ones as one.
    """
    edges = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        around = written(both.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")), "around")
        # In a star each node has larger neighbours only, or a single one.
        if around.filter("least < u AND n > 1").isEmpty():
            break
        least = around.select("u", F.least("least", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(hung.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
