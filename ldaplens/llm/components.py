"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ldaplens.llm import common


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node of ``links``; the root is the smallest node it reaches.

    Each round points every node at the smallest node of its neighbourhood, by a grouped minimum and a
    join that can be split where a node has many links. Rounds are written to the shared folder; their
    number grows with the logarithm of the longest chain. Links from a node to itself give its own root.
    """
    spark = links.sparkSession
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = common.written(both.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        # large star: larger neighbours of u point to the smallest of u's neighbourhood
        sym = edges.union(edges.select("v", "u"))
        least = sym.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and u itself point to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = common.written(small, "edges")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == mark:
            break
        mark = now
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends.union(ends.select(F.col("root").alias("node"), "root")).union(both.where("u = v").select("u", "v")).groupBy("node").agg(F.min("root").alias("root"))
