"""Coverage and links of alignments as they arrive. Both are sums, so update mode is exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import alignments as L


def covered(alignments: DataFrame, contigs: DataFrame, edge: int = 75, min_mapq: int = 0, identity: float = 97) -> DataFrame:
    """(contig, sample, total): covered bases of a stream of alignments against a static table of contigs."""
    used = L.usable(L.measured(alignments, contigs), min_mapq, identity)
    got = used.select("contig", "sample", L.covered_bases(F.col("ops"), F.col("pos"), F.col("length"), F.lit(edge), F.col("subs")).alias("c"))
    return got.groupBy("contig", "sample").agg(F.sum("c").alias("total"))


def linked(alignments: DataFrame, contigs: DataFrame, min_mapq: int = 0, identity: float = 97) -> DataFrame:
    """(i, j, cnt): read links between contigs, running counts."""
    return L.pair_links(L.usable(L.measured(alignments, contigs), min_mapq, identity))


def windowed(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts by keys and tumbling window; events later than ``late`` are left out and the window's state is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def start(frame: DataFrame, sink: str, checkpoint: str, mode: str = "update", name: str | None = None):
    """Start the query; ``sink`` is ``memory`` or a table's folder written batch by batch."""
    w = frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if sink == "memory":
        return w.format("memory").queryName(name or "coverage").start()
    return w.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{sink}/batch={k}")).start()
