"""Connected components by alternating stars, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, dealt_anew


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v), of any ordered type; root is the smallest node it reaches.

    Each round links the larger neighbours of a node, then its smaller ones, to the smallest (large and small
    star). Groups are only ever reduced to their minimum before the shuffle, and the minima are dealt anew for the joins,
    so that the edges of a hub can be split among tasks."""

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = edges.where("u <> v and u is not null and v is not null")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = mark(e)
    while seen[0]:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(dealt_anew(low, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(dealt_anew(low, "u"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e"))
        e = cut(small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct())
        now = mark(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
