"""Connected components by alternating large-star and small-star steps on tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the least node of its component.

    A step sends each node's larger neighbours (large star) or its smaller ones (small star) to its least
    neighbour. Minima are aggregated map-side, and the join with them has plain exchanges of tables on
    both sides, so a node with very many edges is split. Ends when all edges lead to roots.
    """

    def star(e: DataFrame, small: bool, tag: str) -> DataFrame:
        both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")) if small else e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-min-{tag}")
        joined = both.join(least, "u")
        if small:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        else:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return scratch.table(out.where("a <> b").distinct(), f"{name}-{tag}")

    now = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    k = 0
    while not now.join(now.select(F.col("b").alias("a")), "a", "left_semi").unionByName(now.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("other")).where("b <> other").select("a", "b")).isEmpty():
        k += 1
        now = star(star(now, False, f"{k}l"), True, f"{k}s")
    pairs = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return scratch.table(pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct()), f"{name}-roots")
