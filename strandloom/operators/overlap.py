"""Overlap of assemblies by shared reads, merging of depth tables, length cut-offs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_mapping(mappings: DataFrame) -> DataFrame:
    """(read, contig): the mapping of the highest ``ord`` per read."""
    return mappings.groupBy("read").agg(F.max_by("contig", "ord").alias("contig"))


def contig_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(contig_a, contig_b, overlap, total, pct): reads of each contig of A by their contig in B, ``*`` if there is none."""
    j = a.withColumnRenamed("contig", "contig_a").join(b.withColumnRenamed("contig", "contig_b"), "read", "left")
    n = j.groupBy("contig_a", F.coalesce(F.col("contig_b").cast("string"), F.lit("*")).alias("contig_b")).agg(F.count(F.lit(1)).alias("overlap"))
    total = a.groupBy(F.col("contig").alias("contig_a")).agg(F.count(F.lit(1)).alias("total"))
    return n.join(total, "contig_a").select("contig_a", "contig_b", "overlap", "total", (100.0 * F.col("overlap") / F.col("total")).alias("pct"))


def bin_overlap(overlaps: DataFrame, bins_a: DataFrame, bins_b: DataFrame, least: float = 0.001) -> DataFrame:
    """(bin_a, bin_b, overlap, share): contig overlaps summed by bin; shares of the bin's reads above ``least``."""
    x = overlaps.join(bins_a.select(F.col("contig").alias("contig_a"), F.col("bin").alias("bin_a")), "contig_a")
    x = x.join(bins_b.select(F.col("contig").cast("string").alias("contig_b"), F.col("bin").alias("bin_b")), "contig_b", "left")
    n = x.groupBy("bin_a", F.coalesce(F.col("bin_b").cast("string"), F.lit("*")).alias("bin_b")).agg(F.sum("overlap").alias("overlap"))
    share = F.col("overlap") / F.sum("overlap").over(Window.partitionBy("bin_a"))  # as many rows as bins meet
    return n.select("bin_a", "bin_b", "overlap", share.alias("share")).filter(F.col("share") > least)


def merge_abundances(tables: list[DataFrame]) -> DataFrame:
    """(contig, length, total, m0, v0, m1, v1, ...): depth tables (contig, length, mean, var) side by side; total is the sum of means.

    Every table must name the same contigs once each, with the same lengths; the first that doesn't is an error.
    """
    out = None
    for k, t in enumerate(tables):
        t = t.select("contig", F.col("length").alias(f"length{k}"), F.col("mean").alias(f"m{k}"), F.col("var").alias(f"v{k}"))
        out = t if out is None else out.join(t, "contig", "full_outer")
    same = F.lit(True)
    for k in range(1, len(tables)):
        same = same & F.coalesce(F.col("length0") == F.col(f"length{k}"), F.lit(False))
    checked = F.when(same, F.col("length0")).otherwise(F.raise_error(F.concat(F.lit("depth tables differ at contig "), F.col("contig").cast("string"))))
    total = sum((F.col(f"m{k}") for k in range(1, len(tables))), F.col("m0"))
    return out.select("contig", checked.cast("long").alias("length"), total.alias("total"), *[F.col(f"{c}{k}") for k in range(len(tables)) for c in ("m", "v")])


def length_histogram(contigs: DataFrame) -> DataFrame:
    return contigs.groupBy("length").agg(F.count(F.lit(1)).alias("contigs"))


def min_length_for(contigs: DataFrame, most: int) -> DataFrame:
    """One row, ``min_len``: the smallest length of which, or longer, there are at most ``most`` contigs; null if even the longest are more.

    The running count goes over distinct lengths, not over contigs.
    """
    run = length_histogram(contigs).select("length", F.sum("contigs").over(Window.orderBy(F.desc("length"))).alias("n"))
    return run.filter(F.col("n") <= most).agg(F.min("length").alias("min_len"))


def partition_by_length(contigs: DataFrame, large: int = 2500, small: int = 1000) -> DataFrame:
    return contigs.withColumn("size_class", F.when(F.col("length") >= large, "large").when(F.col("length") >= small, "small").otherwise("discarded"))


def rank_methods(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """``rows`` with the rank of ``value`` within ``keys`` for every way to treat ties; ``first`` goes by ``order``."""
    w = Window.partitionBy(*keys).orderBy(value)
    low, ties = F.rank().over(w), F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return rows.select(*keys, order, value, low.alias("r_min"), (low + ties - 1).alias("r_max"), (low + (ties - 1) / 2.0).alias("r_average"), F.dense_rank().over(w).alias("r_dense"), F.row_number().over(Window.partitionBy(*keys).orderBy(value, order)).alias("r_first"))


def stride_sample(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """At most ``most`` evenly spaced rows of each group in its order: rows floor(t * n / most) for t = 0, 1, ...; all, if fewer."""
    w = Window.partitionBy(*keys)
    x = rows.select("*", (F.row_number().over(w.orderBy(order)) - 1).alias("_i"), F.count(F.lit(1)).over(w).alias("_n"))
    step = F.col("_n") / F.lit(float(most))
    t = F.ceil(F.col("_i") / step)
    return x.filter((F.col("_n") <= most) | ((t < most) & (F.floor(t * step) == F.col("_i")))).drop("_i", "_n")
