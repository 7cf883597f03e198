"""Readers of the formats of the trade, as DataFrames. Every reader keeps a file-order number where order has meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.sequences import name_of


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, ord, line): ord is ascending within a file and stable for a given set of files."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", "\r$", "").alias("line"))


def fasta(spark: SparkSession, path: str | list[str], full_header: bool = False) -> DataFrame:
    """(file, ord, name, seq): records split at ``>``, lines joined. Compressed files are read whole, plain ones in splits."""
    rec = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", "^>", "").alias("r")).filter(F.trim("r") != "")
    head = F.regexp_replace(F.substring_index("r", "\n", 1), "\r$", "")
    body = F.when(F.instr("r", "\n") > 0, F.regexp_replace(F.expr("substring(r, instr(r, '\n') + 1)"), "[\r\n]", "")).otherwise(F.lit(""))
    return rec.select("file", "ord", name_of(head, full_header).alias("name"), body.alias("seq"))


def first_names(contigs: DataFrame) -> DataFrame:
    """Of contigs that share a name, the first in file order."""
    rest = [c for c in contigs.columns if c not in ("name", "ord")]
    return contigs.groupBy("name").agg(F.min("ord").alias("ord"), *[F.min_by(c, "ord").alias(c) for c in rest]).select(*contigs.columns)


def fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, ord, name, seq, qual) of plain or compressed files of any size; ord counts the reads of a file from 0.

    Lines are numbered within their split, and the splits' line counts, a row per split, are added up; four lines make a
    read. Blank lines count, as a read may have no bases; only those after the last read go. A file whose lines aren't a
    multiple of four is an error, raised when the reads are used.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("line"))
    numbered = text.withColumn("at", F.row_number().over(Window.partitionBy("file", "block").orderBy("id")) - 1)
    counts = text.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("file").orderBy("block")
    before = counts.select("file", "block", (F.sum("n").over(w) - F.col("n")).alias("before"))
    each = numbered.join(before, ["file", "block"]).select("file", (F.col("at") + F.col("before")).alias("k"), "line")
    last = each.filter("line <> ''").groupBy("file").agg((F.floor(F.max("k") / 4) * 4 + 4).alias("upto"))
    each = each.join(last, "file").filter("k < upto")
    part = lambda k: F.max(F.when(F.pmod(F.col("k"), F.lit(4)) == k, F.col("line")))
    reads = each.groupBy("file", F.floor(F.col("k") / 4).alias("ord")).agg(part(0).alias("head"), part(1).alias("seq"), part(3).alias("qual"), F.count(F.lit(1)).alias("lines"))
    whole = F.when(F.col("lines") == 4, F.col("seq")).otherwise(F.raise_error(F.concat("file", F.lit(": not four lines a read"))))
    return reads.select("file", "ord", F.regexp_extract(F.substr("head", F.lit(2)), r"^\S*", 0).alias("name"), whole.alias("seq"), "qual")


def sample_name(path: Column) -> Column:
    """The file's name without folders and without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]*$", "")


def depth_table(spark: SparkSession, path: str, variances: bool = True, min_length: int = 0) -> DataFrame:
    """(name, length, depth[]): rows whose length isn't a number go, as do repeated names after the first; variances are skipped."""
    head = spark.read.text(path).first()
    width = len(head[0].split("\t")) if head else 0
    first = 3 if variances else 2
    at = list(range(first, width, 2 if variances else 1))
    parts = lines(spark, path).filter(~F.col("line").startswith("contigName")).select("ord", F.split("line", "\t").alias("p"))
    length = F.get("p", F.lit(1)).try_cast("double")
    rows = parts.select("ord", F.regexp_extract(F.get("p", F.lit(0)), r"^[^ \t]*", 0).alias("name"), length.cast("long").alias("length"), F.array(*[F.coalesce(F.get("p", F.lit(k)).try_cast("double"), F.lit(0.0)) for k in at]).alias("depth"))
    rows = rows.filter(F.col("length").isNotNull() & (F.col("length") >= min_length))
    return rows.groupBy("name").agg(F.min_by(F.struct("length", "depth"), "ord").alias("x")).select("name", "x.length", "x.depth")


def sam(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Contigs (contig, length) from the headers, and alignments, of plain or gzip SAM text. The file is the sample."""
    ls = lines(spark, path)
    sample = sample_name(F.col("file"))
    sq = ls.filter(F.col("line").startswith("@SQ"))
    contigs = sq.select(F.regexp_extract("line", r"\tSN:([^\t]+)", 1).alias("contig"), F.regexp_extract("line", r"\tLN:([0-9]+)", 1).try_cast("long").alias("length")).distinct()
    p = ls.filter(~F.col("line").startswith("@") & (F.col("line") != "")).select(sample.alias("sample"), "ord", "line", F.split("line", "\t").alias("p")).filter(F.size("p") >= 11)
    g = lambda k: F.get("p", F.lit(k))
    contig = F.when(g(2) != "*", g(2))
    mate = F.when(g(6) == "=", contig).when(g(6) != "*", g(6))
    nm = F.regexp_extract("line", r"\tNM:i:([0-9]+)", 1)
    return contigs, p.select("sample", "ord", g(0).alias("qname"), g(1).try_cast("int").alias("flag"), contig.alias("contig"), g(3).try_cast("int").alias("pos"), g(4).try_cast("int").alias("mapq"), g(5).alias("cigar"), mate.alias("mate_contig"), g(7).try_cast("int").alias("mate_pos"), g(9).alias("seq"), g(10).alias("qual"), F.when(nm != "", nm.try_cast("int")).alias("nm"))


def bioboxes(spark: SparkSession, path: str) -> DataFrame:
    """(ord, seq, bin, length): columns by the ``@@`` line; two plain columns, or a ``BinNum`` table, without one."""
    ls = lines(spark, path)
    header = ls.filter(F.col("line").startswith("@@")).orderBy("ord").first()
    body = ls.filter(~F.col("line").startswith("@") & ~F.col("line").startswith("#") & (F.trim("line") != ""))
    p = F.split("line", "\t")
    if header:
        names = [x.upper() for x in header["line"][2:].split("\t")]
        at = {n: names.index(n) if n in names else None for n in ("SEQUENCEID", "BINID", "_LENGTH")}
        order = (at["SEQUENCEID"], at["BINID"], at["_LENGTH"] if at["_LENGTH"] is not None else (names.index("LENGTH") if "LENGTH" in names else None))
    else:
        first = body.orderBy("ord").first()
        turned = bool(first and first["line"].startswith("BinNum"))
        body = body.filter(~F.col("line").startswith("BinNum"))
        order = (1, 0, None) if turned else (0, 1, None)
    col = lambda k: F.get(p, F.lit(k)) if k is not None else F.lit(None).cast("string")
    return body.select("ord", col(order[0]).alias("seq"), col(order[1]).alias("bin"), col(order[2]).try_cast("long").alias("length")).filter("seq is not null and bin is not null and bin <> ''")


def markers(spark: SparkSession, path: str, most: int = 64) -> tuple[DataFrame, int | None]:
    """(seq, marker) with repeats from ``contig<tab>marker...``, and the set size from its comment."""
    ls = lines(spark, path)
    size = ls.select(F.regexp_extract("line", r"^#\s*marker_set_size\s*=\s*([0-9]+)", 1).alias("n")).filter("n <> ''").first()
    p = ls.filter(~F.col("line").startswith("#") & (F.trim("line") != "")).select(F.split("line", "\t").alias("p"))
    hits = p.select(F.get("p", F.lit(0)).alias("seq"), F.explode(F.slice("p", 2, most - 1)).alias("marker")).filter("marker <> ''")
    return hits, int(size["n"]) if size else None


def marker_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(seq, marker) from the transposed file ``marker<tab>contig...``."""
    p = lines(spark, path).filter(~F.col("line").startswith("#") & (F.trim("line") != "")).select(F.split("line", "\t").alias("p"))
    return p.select(F.get("p", F.lit(0)).alias("marker"), F.explode(F.slice("p", 2, F.size("p"))).alias("seq")).filter("seq <> ''").select("seq", "marker")


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(seq, lineage, ord)."""
    p = lines(spark, path).filter(~F.col("line").startswith("#")).select("ord", F.split("line", "\t", 2).alias("p")).filter(F.size("p") == 2)
    return p.select(F.get("p", F.lit(0)).alias("seq"), F.get("p", F.lit(1)).alias("lineage"), "ord")


def gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) and path steps (path, pos, seg) of an assembly graph; orientation is dropped."""
    p = lines(spark, path).select(F.split("line", "\t").alias("p"))
    g = lambda k: F.get("p", F.lit(k))
    links = p.filter((g(0) == "L") & (F.size("p") >= 5)).select(g(1).alias("a"), g(3).alias("b"))
    steps = p.filter((g(0) == "P") & (F.size("p") >= 3)).select(g(1).alias("path"), F.posexplode(F.split(g(2), ",")).alias("pos", "s")).select("path", "pos", F.regexp_replace("s", "[+-]$", "").alias("seg"))
    return links, steps


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(out, reads1, reads2); reads2 is null for interleaved reads."""
    p = lines(spark, path).filter(~F.col("line").startswith("#") & (F.trim("line") != "")).select("ord", F.split(F.trim("line"), r"\s+").alias("p"))
    return p.select("ord", F.get("p", F.lit(0)).alias("out"), F.get("p", F.lit(1)).alias("reads1"), F.get("p", F.lit(2)).alias("reads2"))


def path_list(spark: SparkSession, path: str) -> list[str]:
    return [r["line"] for r in lines(spark, path).filter(F.trim("line") != "").orderBy("ord").collect()]


def name_lists(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(bin, name) from a list of names per bin; the first bracket of each kind is mangled as in file names."""
    ls = lines(spark, paths).filter(F.trim("line") != "")
    name = F.expr("regexp_replace(regexp_replace(line, '^([^\\\\[]*)\\\\[', '$1_'), '^([^\\\\]]*)\\\\]', '$1')")
    return ls.select(F.regexp_extract("file", "([^/]*)$", 1).alias("bin"), name.alias("name"))


def numbered(contigs: DataFrame) -> DataFrame:
    """contig_id in file order, for files small enough to be ordered as one."""
    return contigs.withColumn("contig_id", F.row_number().over(Window.orderBy("ord")) - 1)


def load_stage(spark: SparkSession, folder: str, names: list[str], version: int = 1) -> dict[str, DataFrame]:
    """Stage tables saved by :func:`strandloom.sources.writers.save_stage`; another version is an error."""
    meta = spark.read.json(f"{folder}/meta").first()
    if meta is None or meta["version"] != version:
        raise ValueError(f"{folder} holds version {meta and meta['version']}, not {version}")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}
