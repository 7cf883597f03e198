"""Writers of the formats of the trade. Each takes a DataFrame and a folder; text is written by Spark's own sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequences import wrapped


def tsv(rows: DataFrame, path: str, header: bool = True) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", header).option("emptyValue", "").option("nullValue", "NA").csv(path)


def _renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(c).alias(n) for c, n in names.items() if c in rows.columns])


def members(rows: DataFrame, path: str) -> None:
    """(bin_num, seq, depth[, confidence])."""
    tsv(_renamed(rows, {"bin_num": "BinNum", "seq": "SequenceName", "depth": "TotalDepth", "confidence": "Confidence"}), path)


def bins(rows: DataFrame, path: str) -> None:
    tsv(_renamed(rows, {"bin_num": "BinNum", "num_contigs": "NumContigs", "total_length": "TotalLength", "coverage": "LengthWeightedAvgCoveage", "file_name": "FileName", "completeness": "Completeness", "contamination": "Contamination", "tier": "Tier", "lineage": "Taxonomy"}), path)


def matrix(rows: DataFrame, path: str) -> None:
    tsv(_renamed(rows, {"seq": "ContigName", "cluster": "ClusterId"}), path)


def confidence(rows: DataFrame, path: str) -> None:
    tsv(_renamed(rows, {"seq": "ContigName", "bin_num": "BinNum", "confidence": "Confidence", "second_bin": "SecondBinNum", "second_score": "SecondScore"}), path)


def bioboxes(rows: DataFrame, path: str, sample: str = "sample") -> None:
    """Header lines and (seq, bin, length) as one bioboxes text."""
    head = rows.sparkSession.createDataFrame([(0, f"@Version:0.9.1\n@SampleID:{sample}\n@@SEQUENCEID\tBINID\t_LENGTH")], "k int, value string")
    body = rows.select(F.lit(1).alias("k"), F.concat_ws("\t", F.col("seq").cast("string"), F.col("bin").cast("string"), F.col("length").cast("string")).alias("value"))
    head.unionByName(body).repartitionByRange("k", "value").sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)


def fasta_record(name: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), wrapped(seq))


def bin_fasta(rows: DataFrame, path: str) -> None:
    """(bin, name, seq[, label]): a folder per bin."""
    label = F.concat_ws(" ", "name", "label") if "label" in rows.columns else F.col("name")
    rows.select(F.col("bin").alias("bin"), fasta_record(label, F.col("seq")).alias("value")).write.mode("overwrite").partitionBy("bin").text(path)


def fasta(rows: DataFrame, path: str) -> None:
    rows.select(fasta_record(F.col("name"), F.col("seq")).alias("value")).write.mode("overwrite").text(path)


def fastq(rows: DataFrame, path: str) -> None:
    rows.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.mode("overwrite").text(path)


def depth_table(cov: DataFrame, samples: list[str], path: str, variances: bool = False) -> None:
    """(contig, sample, length, mean[, var]) as the usual depth table, one row a contig."""
    cols = [c for s in samples for c in ([F.max(F.when(F.col("sample") == s, F.col("mean"))).cast("float").alias(s)] + ([F.max(F.when(F.col("sample") == s, F.col("var"))).cast("float").alias(f"{s}-var")] if variances else []))]
    out = cov.groupBy(F.col("contig").alias("contigName"), F.col("length").alias("contigLen")).agg(F.sum("mean").cast("float").alias("totalAvgDepth"), *cols)
    tsv(out, path)


def gc_histogram(rows: DataFrame, path: str) -> None:
    tsv(_renamed(rows, {"gc": "GC", "windows": "Ref", "reads": "Reads", "coverage": "Coverage", "mean": "Mean", "var": "Variance"}), path)


def amber(rows: DataFrame, path: str) -> None:
    f = lambda c: F.format_string("%.6f", c)
    out = rows.select(F.col("bin").alias("BINID"), F.col("genome").alias("most_abundant_genome"), f("purity").alias("Purity (bp)"), f("completeness").alias("Completeness (bp)"), F.col("total_length"), F.col("tp_length"), F.col("seq_count").alias("total_seq_counts"))
    tsv(out, path)


def qc(rows: DataFrame, path: str) -> None:
    tsv(_renamed(rows, {"bin": "Bin", "contigs": "Contigs", "distinct_markers": "DistinctMarkers", "extra_copies": "ExtraCopies", "completeness": "Completeness", "contamination": "Contamination", "tier": "Tier"}), path)


def paired_matrix(rows: DataFrame, path: str) -> None:
    """(contig, mate, share): coverage of each contig by reads whose mate is on another one."""
    tsv(_renamed(rows, {"contig": "contigIdx", "mate": "contigIdxMate", "share": "AvgCoverage"}), path)


def consensus(rows: DataFrame, per_bin: DataFrame, path: str) -> None:
    """Members (bin_num, seq) and quality (bin_num, completeness, contamination, contigs, source, tier) of a consensus."""
    tsv(_renamed(rows, {"bin_num": "BinNum", "seq": "SequenceName"}), f"{path}/members")
    f = lambda c: F.format_string("%.2f", c)
    tsv(per_bin.select(F.col("bin_num").alias("BinNum"), f("completeness").alias("Completeness"), f("contamination").alias("Contamination"), F.col("contigs").alias("n_contigs"), "source", "tier"), f"{path}/qc")


def variants(rows: DataFrame, path: str) -> None:
    tsv(rows, path)


def stability(contigs: DataFrame, bins_: DataFrame, path: str) -> None:
    """Three tables of (seq, bin, length, prob, state[, alternative, alt_prob]) and (bin, certified): every contig that was
    judged, bins, ambiguous contigs. Where there is no alternative, its bin is -1."""
    has = "alternative" in contigs.columns
    other = F.coalesce(F.col("alternative").cast("string"), F.lit("-1")) if has else F.lit("-1")
    share = F.coalesce(F.col("alt_prob"), F.lit(0.0)) if has else F.lit(0.0)
    judged = contigs.filter("prob is not null")

    def yes(c: Column) -> Column:
        return F.when(c, "Y").otherwise("N")

    def shares(c: Column) -> Column:
        return F.format_string("%.3f", c)

    first = [F.col("seq").alias("ContigName"), F.col("bin").alias("BinNum"), F.col("length").alias("Length"), shares(F.col("prob")).alias("AssignmentProb")]
    last = [other.alias("AlternativeBin"), shares(share).alias("AltProb")]
    tsv(judged.select(*first, yes(F.col("state") == "core").alias("Core"), yes(F.col("state") == "ambiguous").alias("Ambiguous"), *last), f"{path}/stable_members")
    tsv(judged.filter("state = 'ambiguous'").select(*first, *last), f"{path}/ambiguous_contigs")
    sums = judged.groupBy("bin").agg(F.sum("length").alias("total"), F.sum(F.when(F.col("state") == "core", F.col("length")).otherwise(0)).alias("core"), (F.sum(F.col("prob") * F.col("length")) / F.sum("length")).alias("mean"))
    tsv(sums.join(bins_.select("bin", "certified"), "bin").select(F.col("bin").alias("BinNum"), F.col("total").alias("TotalBp"), F.col("core").alias("CoreBp"), shares(F.col("core") / F.col("total")).alias("CoreFraction"), shares(F.col("mean")).alias("MeanAssignmentProb"), yes(F.col("certified")).alias("Certified")), f"{path}/bin_stability")


def mobile_elements(rows: DataFrame, path: str) -> None:
    tsv(_renamed(rows, {"seq": "ContigName", "length": "Length", "circular": "Circular", "dtr": "DTRlen", "bin_num": "BinNum"}), path)


def sorted_alignments(rows: DataFrame, path: str) -> None:
    """Coordinate-sorted Parquet: range partitions play the part of the index."""
    from strandloom.operators.alignments import sort_rank

    sort_rank(rows).write.mode("overwrite").parquet(path)


def save_stage(spark: SparkSession, tables: dict[str, DataFrame], folder: str, version: int = 1) -> None:
    """Stage tables to start from again, and what they are."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.createDataFrame([(version, sorted(tables))], "version int, tables array<string>").write.mode("overwrite").json(f"{folder}/meta")
