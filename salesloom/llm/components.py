"""Connected components by alternating star operations on a table of links.

Every node is linked to the smallest node it knows, first among its larger neighbours (large
star), then among its smaller ones (small star), until nothing changes: a logarithmic number
of rounds, also for chains. A hub is never gathered: its minimum is a partial aggregation and
the join that spreads it is one that Spark splits at run time when a key is hot. Each round is
a written table, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import store


def _state(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with a link; ``component`` is the smallest node reachable.

    Links between a node and itself, repeated links and links in both directions are fine;
    links with a null end are left out. Without links the result is empty.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    now = store(links.where(f"`{a}` <> `{b}`").select(u.alias("u"), v.alias("v")).distinct(), "links")
    before = _state(now)
    while before[0]:
        both = now.select(F.col("u").alias("n"), F.col("v").alias("w")).unionByName(now.select(F.col("v").alias("n"), F.col("u").alias("w")))
        least = store(both.groupBy("n").agg(F.min("w").alias("m")).select("n", F.least("n", "m").alias("m")), "least")
        large = store(both.join(least, "n").where("w > n").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = store(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = store(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = _state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
