"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.workspace import Workspace


def connected(edges: DataFrame, work: Workspace, label: str = "cc") -> DataFrame:
    """(a, b) edges -> (node, root): root is the smallest node of the component. Isolated nodes don't occur.

    Each round is two aggregations with map-side minima and two joins that AQE may split where a node is hot; it is
    written out, so lineage stays short. The edges always form as many components as at the start, and the rounds end
    when every edge points at a root.
    """
    now = work.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}0")
    mark, k = None, 0
    while True:
        k += 1
        # large star: neighbours above u go to the smallest of u and its neighbours
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = work.save(large, f"{label}l{k}")
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        now = work.save(small, f"{label}s{k}")
        got = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.countDistinct("a").alias("d")).first()
        if mark == (got["n"], got["x"]) or (got["n"] == got["d"] and now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (got["n"], got["x"])
