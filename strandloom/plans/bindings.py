"""How the driver's tables stand in for contigs, depths, binnings, markers and alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gold(spark, d) -> DataFrame:
    """Customers as sequences, nations as genomes."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_nationkey").alias("genome"), (1000 + F.floor(F.abs("c_acctbal"))).cast("long").alias("length"))


def predicted(spark, d) -> DataFrame:
    """A customer's first order names its bin."""
    from strandloom.operators.evaluate import first_wins

    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("seq"), F.col("o_orderpriority").alias("bin"), "o_orderkey")
    return first_wins(rows, "seq", "o_orderkey", "bin")


def segments(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_mktsegment").alias("bin"))


def part_contigs(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("seq"), (1000 + F.col("p_size") * 100).cast("long").alias("length"))


def part_bins(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_type").alias("bin"))


def part_depth(spark, d) -> DataFrame:
    """(seq, sample, depth): quantity shipped per part and return state."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("seq"), F.concat("l_returnflag", "l_linestatus").alias("sample")).agg(F.sum("l_quantity").alias("depth"))


def supplier_depth(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("seq"), F.concat("l_returnflag", "l_linestatus").alias("sample")).agg(F.sum("l_quantity").alias("depth"))


def event_markers(spark, d) -> DataFrame:
    """Events as contigs; the key in their properties as the marker."""
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").alias("marker"))


def event_bins(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("bin"))


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.col("label").cast("long").alias("label"))
