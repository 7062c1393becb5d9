"""Connected components by alternating star steps; nodes are of any type that can be ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docdelta.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reachable.

    Large steps hang a node's larger neighbours on the smallest one; small steps do so with the
    smaller neighbours. The rounds grow as the logarithm of the longest path. Each round's links are
    a written table, so no lineage builds up and no link reaches the driver.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stored(edges, "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = stored(small.where("u <> v").distinct(), "links")
        if not new.join(edges, ["u", "v"], "left_anti").limit(1).count() and new.count() == edges.count():
            return new.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        edges = new
