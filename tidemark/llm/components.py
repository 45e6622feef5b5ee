"""Connected components of a link table, by hooking roots to smaller roots on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b); component is the smallest node reachable.

    Each round hooks every root that has a smaller neighbour to the smallest one, then points roots at the
    ends of those hooks. All of it is joins and minima over tables in the shared folder; nothing goes to the driver
    but whether a round changed anything. Empty links give an empty table; loops and repeated links are harmless.
    """
    links = links.filter("a is not null and b is not null and a <> b")
    labels = staged(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("component", F.col("node")), "labels")
    while True:
        left = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        right = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        links = staged(links.join(left, "a").join(right, "b").filter("ca <> cb").select(F.greatest("ca", "cb").alias("a"), F.least("ca", "cb").alias("b")).distinct(), "links")
        if links.isEmpty():
            return labels
        hooks = staged(links.groupBy(F.col("a").alias("component")).agg(F.min("b").alias("root")), "hooks")
        while True:
            further = hooks.select(F.col("component").alias("root"), F.col("root").alias("beyond"))
            jumped = staged(hooks.join(further, "root", "left").select("component", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("component", "root")
            if jumped.filter("moved").isEmpty():
                break
        labels = staged(labels.join(hooks, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
