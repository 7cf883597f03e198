"""From alignments to coverage, links and variants.

alignments(sample, qname, flag, contig, pos, mapq, cigar, mate_contig, mate_pos, seq, nm): pos is 1-based as in SAM.
contigs(contig, length).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Flags: unmapped, secondary, failed quality, duplicate. Supplementary records count.
SKIPPED = 0x704
PAIRED, PROPER, MATE_UNMAPPED, REVERSE = 0x1, 0x2, 0x8, 0x10


def cigar_ops(cigar: Column) -> Column:
    """[(op, n)] of a CIGAR string; empty for ``*`` and for anything malformed."""
    each = F.regexp_extract_all(cigar, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    none = F.array().cast("array<struct<op:string,n:int>>")

    def ops(parts: Column) -> Column:
        both = F.transform(parts, lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.substr(x, F.lit(1), F.length(x) - 1).cast("int").alias("n")))
        return F.when(F.array_join(parts, "") == cigar, both).otherwise(none)

    return F.get(F.transform(F.array(each), ops), F.lit(0))  # the parts are used twice, but made once


#: Sums over a CIGAR: name -> operations.
SUMS = {"m": "M=X", "ins": "I", "del": "D", "clip": "S", "skip": "N", "align_len": "MDN=X", "x": "X"}


def op_sums(ops: Column) -> Column:
    """The struct of all SUMS, in one pass."""
    zero = F.struct(*[F.lit(0).alias(k) for k in SUMS])
    return F.aggregate(ops, zero, lambda s, x: F.struct(*[(s[k] + F.when(x["op"].isin(*v), x["n"]).otherwise(0)).alias(k) for k, v in SUMS.items()]))


def clip_overhang(ops: Column, pos: Column, length: Column, seq_len: Column) -> Column:
    """``ops`` (op, n) with everything from the operation that passes the contig's end on soft-clipped.

    Left as they are where the end isn't passed, or where the clipped read wouldn't have the read's length.
    """
    read, ref = ("M", "I", "S", "=", "X"), ("M", "D", "N", "=", "X")
    grown = lambda s, x, kinds: F.when(x["op"].isin(*kinds), x["n"]).otherwise(0)
    start = F.struct(F.lit(False).alias("over"), (pos - 1).cast("int").alias("ref"), F.lit(0).alias("read"), F.array().cast("array<struct<op:string,n:int>>").alias("out"))

    def step(s, x):
        at = s["ref"] + grown(s, x, ref)
        over = s["over"] | (at > length)
        cut = F.when(s["over"], s["out"]).when(at > length, F.concat(s["out"], F.array(F.struct(F.lit("S").alias("op"), (seq_len - s["read"]).cast("int").alias("n"))))).otherwise(F.concat(s["out"], F.array(F.struct(x["op"].alias("op"), x["n"].alias("n")))))
        return F.struct(over.alias("over"), F.when(over, s["ref"]).otherwise(at).alias("ref"), (s["read"] + F.when(over, 0).otherwise(grown(s, x, read))).alias("read"), cut.alias("out"))

    return F.aggregate(ops, start, step, lambda s: F.when(s["over"] & (s["read"] <= seq_len), s["out"]).otherwise(ops))


def measured(alignments: DataFrame, contigs: DataFrame, repair: bool = False) -> DataFrame:
    """Alignments of known contigs with their counts of bases: ops, exact, subs, ins, del, clip, skip, align_len, seq_len.

    The CIGAR is read once: a generator makes the operations and their sums, so that no later filter is pushed through it as
    a copy of the expression. With ``repair``, reads that pass their contig's end are soft-clipped there.
    """
    a = alignments.join(contigs, "contig")
    ops = cigar_ops(F.col("cigar"))
    if repair:
        ops = F.when(F.col("pos").between(1, F.col("length")) & (F.col("seq") != "*"), F.get(F.transform(F.array(ops), lambda o: clip_overhang(o, F.col("pos"), F.col("length"), F.length("seq"))), F.lit(0))).otherwise(ops)
    each = F.inline_outer(F.transform(F.array(ops), lambda o: F.struct(o.alias("ops"), op_sums(o).alias("_s"))))
    a = a.select("*", each).select(*a.columns, "ops", "_s.*")
    subs = F.greatest(F.coalesce(F.col("nm") - F.col("ins") - F.col("del"), F.col("x")), F.col("x"))
    a = a.withColumn("subs", subs).withColumn("exact", F.col("m") - F.col("subs"))
    return a.withColumn("seq_len", F.when(F.col("seq") == "*", F.col("m") + F.col("ins") + F.col("clip")).otherwise(F.length("seq")))


def consistent() -> Column:
    """The record's own numbers agree: read length, alignment length, edits."""
    c = F.col
    return (c("align_len") > 0) & (c("exact") >= 0) & (c("seq_len") == c("exact") + c("subs") + c("ins") + c("clip")) & (c("align_len") - c("skip") == c("exact") + c("subs") + c("del")) & (c("pos") >= 1) & (c("pos") - 1 + c("align_len") <= c("length"))


def usable(rows: DataFrame, min_mapq: int = 0, percent_identity: float = 97) -> DataFrame:
    """Records that count: flags, mapping quality, a valid mate, consistency and identity."""
    mate_ok = (F.col("flag").bitwiseAND(PAIRED) == 0) | (F.col("flag").bitwiseAND(MATE_UNMAPPED) != 0) | F.col("mate_contig").isNotNull()
    n = F.col("exact") + F.col("subs") + F.col("ins") + F.col("del")
    return rows.filter((F.col("flag").bitwiseAND(SKIPPED) == 0) & (F.col("mapq") >= min_mapq) & mate_ok & consistent() & (n > 0) & (100.0 * F.col("exact") >= percent_identity * n))


def failed_mapping(passes: Column, mate_passes: Column) -> Column:
    """The read or its mate is unmapped, its contig doesn't pass, or it is paired but not properly or with a contig that doesn't."""
    flag = F.col("flag")
    paired, proper = flag.bitwiseAND(PAIRED) != 0, flag.bitwiseAND(PROPER) != 0
    return (flag.bitwiseAND(0x4 | MATE_UNMAPPED) != 0) | ~F.coalesce(passes, F.lit(False)) | (paired & (~proper | ~F.coalesce(mate_passes, F.lit(False))))


def at_edge(start: Column, length: Column, edge: Column | int) -> Column:
    """A read that starts (from 0) within ``edge`` bases of an end of its contig, or lies on one no longer than that."""
    e = edge if isinstance(edge, Column) else F.lit(edge)
    return (length <= e) | (start < e) | (start + e >= length)


def edge_of(rows: DataFrame, max_edge: int = 75, first: int = 4000) -> DataFrame:
    """(sample, edge): a third of the mean length of the first mapped reads, at most ``max_edge``. Needs ``ord``."""
    w = Window.partitionBy("sample").orderBy("ord")
    r = rows.filter(F.col("flag").bitwiseAND(SKIPPED) == 0).select("sample", "ord", "seq_len").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= first)
    return r.groupBy("sample").agg(F.floor(F.floor(F.avg("seq_len")) / 3).cast("int").alias("e")).select("sample", F.least(F.col("e"), F.lit(max_edge)).alias("edge"))


def covered_bases(ops: Column, pos: Column, length: Column, edge: Column, subs: Column) -> Column:
    """Matched bases outside the contig's edges, less substitutions, not below zero."""
    step = lambda s, x: F.when(x["op"].isin("M", "=", "X"), F.struct((s["at"] + x["n"]).alias("at"), (s["got"] + x["n"] - F.when(length > 2 * edge, F.least(F.greatest(edge - s["at"], F.lit(0)), x["n"]) + F.least(F.greatest(s["at"] + x["n"] - (length - edge), F.lit(0)), x["n"])).otherwise(0)).cast("long").alias("got"))).when(x["op"].isin("D", "N"), F.struct((s["at"] + x["n"]).alias("at"), s["got"].alias("got"))).otherwise(s)
    start = F.struct((pos - 1).cast("long").alias("at"), F.lit(0).cast("long").alias("got"))
    return F.greatest(F.aggregate(ops, start, lambda s, x: step(s, F.struct(x["op"].alias("op"), x["n"].cast("long").alias("n"))), lambda s: s["got"]) - subs, F.lit(0))


def mean_depth(total: Column, length: Column, edge: Column) -> Column:
    """Covered bases over the length between the edges, or over all of it where the edges would leave nothing."""
    inner = F.when(length > 2 * edge + 1, length - 2 * edge).otherwise(length)
    d = F.when(inner <= 2, F.lit(0.0)).otherwise(total / inner)
    return F.when(d > 1e6, F.lit(0.0)).otherwise(d)


def coverage(used: DataFrame, edges: DataFrame, contigs: DataFrame) -> DataFrame:
    """(contig, sample, mean) for every contig and sample; contigs without reads have 0."""
    got = used.join(F.broadcast(edges), "sample").select("contig", "sample", covered_bases(F.col("ops"), F.col("pos"), F.col("length"), F.col("edge"), F.col("subs")).alias("c"))
    sums = got.groupBy("contig", "sample").agg(F.sum("c").alias("total"))
    grid = contigs.join(F.broadcast(edges))  # a row per sample
    return grid.join(sums, ["contig", "sample"], "left").select("contig", "sample", "length", mean_depth(F.coalesce("total", F.lit(0)), F.col("length"), F.col("edge")).alias("mean"))


def total_depth(cov: DataFrame, edge: int = 75) -> DataFrame:
    """(contig, total): length-weighted mean over samples, times their number."""
    inner = F.when(F.col("length") > 2 * edge + 1, F.col("length") - 2 * edge).otherwise(F.col("length"))
    return cov.groupBy("contig").agg((F.sum(F.col("mean") * inner) / F.sum(inner) * F.count(F.lit(1))).alias("total"))


def base_runs(used: DataFrame, *keep: str) -> DataFrame:
    """(contig, sample, keep, start, n): the reference runs that match operations cover, 0-based."""
    step = lambda s, x: F.when(x["op"].isin("M", "=", "X"), F.struct((s["at"] + x["n"]).alias("at"), F.concat(s["runs"], F.array(F.struct(s["at"].alias("start"), x["n"].alias("n")))).alias("runs"))).when(x["op"].isin("D", "N"), F.struct((s["at"] + x["n"]).alias("at"), s["runs"].alias("runs"))).otherwise(s)
    start = F.struct((F.col("pos") - 1).cast("int").alias("at"), F.array().cast("array<struct<start:int,n:int>>").alias("runs"))
    return used.select("contig", "sample", *keep, F.inline(F.aggregate("ops", start, step, lambda s: s["runs"])))


def depth_steps(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, depth): constant stretches of depth, from run ends and a running sum; no base is exploded."""
    first = F.col("start").cast("long")
    ends = runs.select(*keys, F.inline(F.array(F.struct(first.alias("p"), F.lit(1).alias("d")), F.struct((first + F.col("n")).alias("p"), F.lit(-1).alias("d")))))
    at = ends.groupBy(*keys, "p").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("p")
    s = at.select(*keys, F.col("p").alias("start"), F.lead("p").over(w).alias("end"), F.sum("d").over(w).alias("depth"))
    return s.filter("end is not null and depth > 0")


def depth_moments(steps: DataFrame, contigs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and sample variance of per-base depth over the whole contig, zeros included."""
    n = F.col("end") - F.col("start")
    s = steps.groupBy(*keys).agg(F.sum(n * F.col("depth")).alias("s"), F.sum(n * F.col("depth") * F.col("depth")).alias("q"))
    j = s.join(contigs, "contig")
    mean = F.col("s") / F.col("length")
    return j.select(*keys, mean.alias("mean"), F.when(F.col("length") > 1, F.greatest((F.col("q") - F.col("s") * mean) / (F.col("length") - 1), F.lit(0.0))).otherwise(F.lit(0.0)).alias("var"))


def weighted_moments(used: DataFrame, contigs: DataFrame, weight: float = 1.0) -> DataFrame:
    """(contig, sample, mean, var) of per-base depth, each base weighed by its reads' mean mapping quality q.

    The weight is (1 - 10 ** (-q / 10)) ** weight: 0 for q = 0, and 1 where nothing is mapped.
    """
    keys, first = ["contig", "sample"], F.col("start").cast("long")
    runs = base_runs(used, "mapq")
    ends = runs.select(*keys, F.inline(F.array(F.struct(first.alias("p"), F.lit(1).alias("d"), F.col("mapq").cast("long").alias("q")), F.struct((first + F.col("n")).alias("p"), F.lit(-1).alias("d"), (-F.col("mapq")).cast("long").alias("q")))))
    at = ends.groupBy(*keys, "p").agg(F.sum("d").alias("d"), F.sum("q").alias("q"))
    w = Window.partitionBy(*keys).orderBy("p")
    s = at.select(*keys, (F.lead("p").over(w) - F.col("p")).alias("n"), F.sum("d").over(w).alias("d"), F.sum("q").over(w).alias("q")).filter("n is not null and d > 0")
    s = s.select(*keys, "n", "d", F.when(F.col("q") > 0, F.pow(1 - F.pow(F.lit(10.0), -(F.col("q") / F.col("d")) / 10), F.lit(weight))).otherwise(F.lit(0.0)).alias("w"))
    nw, d = F.col("n") * F.col("w"), F.col("d")
    g = s.groupBy(*keys).agg(F.sum(nw).alias("nw"), F.sum(nw * d).alias("nwd"), F.sum(nw * d * d).alias("nwdd"), F.sum("n").alias("n")).join(contigs, "contig")
    mean, total = F.col("nwd") / F.col("length"), F.col("nw") + F.col("length") - F.col("n")
    square = F.col("nwdd") - 2 * mean * F.col("nwd") + mean * mean * total
    return g.select(*keys, mean.alias("mean"), (F.greatest(square, F.lit(0.0)) / F.when(total > 2, total - 1).otherwise(F.col("length") - 1)).alias("var"))


def gc_windows(bases: DataFrame, width: int) -> DataFrame:
    """(gc, windows, mean, var): full windows of (contig, pos, is_gc, depth), one per step, by whole percent of GC."""
    w = Window.partitionBy("contig").orderBy("pos").rowsBetween(0, width - 1)
    x = bases.select(F.sum("is_gc").over(w).alias("g"), F.avg("depth").over(w).alias("d"), F.count(F.lit(1)).over(w).alias("n")).filter(F.col("n") == width)
    return x.groupBy(F.floor(F.lit(100.0) * F.col("g") / width + 0.5).cast("int").alias("gc")).agg(F.count(F.lit(1)).alias("windows"), F.avg("d").alias("mean"), F.coalesce(F.var_samp("d"), F.lit(0.0)).alias("var"))


def perfect_kmers(runs: DataFrame, most: int = 256) -> DataFrame:
    """(k, kmers): k-mers inside exact runs (n) for k up to ``most``: sum of n - k + 1.

    Runs are counted by length first, so the product has at most ``most`` rows per distinct length.
    """
    by = runs.groupBy("n").agg(F.count(F.lit(1)).alias("c")).filter("n > 0")
    return by.select("n", "c", F.explode(F.sequence(F.lit(1), F.least(F.col("n").cast("int"), F.lit(most)))).alias("k")).groupBy("k").agg(F.sum(F.col("c") * (F.col("n") - F.col("k") + 1)).alias("kmers"))


def paired_coverage(pairs: DataFrame, contigs: DataFrame) -> DataFrame:
    """(contig, mate, share): overlap of reads whose mate is on another contig, over the contig's length."""
    return pairs.groupBy("contig", "mate").agg(F.sum("overlap").alias("s")).join(contigs, "contig").select("contig", "mate", (F.col("s") / F.col("length")).alias("share"))


def pair_links(used: DataFrame) -> DataFrame:
    """(i, j, cnt) with i < j: every read that counts and whose mate is on another contig; a good pair counts twice."""
    x = used.filter((F.col("flag").bitwiseAND(PAIRED) != 0) & F.col("mate_contig").isNotNull() & (F.col("mate_contig") != F.col("contig")))
    return x.groupBy(F.least("contig", "mate_contig").alias("i"), F.greatest("contig", "mate_contig").alias("j")).agg(F.count(F.lit(1)).alias("cnt"))


# -- variants

ALLELES = ("A", "C", "G", "T")


def pileup(bases: DataFrame) -> DataFrame:
    """(contig, sample, pos, A, C, G, T) of (contig, sample, pos, base)."""
    return bases.groupBy("contig", "sample", "pos").agg(*[F.count_if(F.col("base") == b).alias(b) for b in ALLELES])


def variant_sites(piles: DataFrame, min_depth: int = 5, min_af: float = 0.05) -> DataFrame:
    """Sites of enough depth: total, major and second allele, diversity, and whether it is a variant. Ties go by allele order."""
    total = sum((F.col(b) for b in ALLELES[1:]), F.col(ALLELES[0]))
    ranked = F.array_sort(F.array(*[F.struct((-F.col(b)).alias("n"), F.lit(k).alias("k"), F.lit(b).alias("b")) for k, b in enumerate(ALLELES)]))
    x = piles.withColumn("total", total).filter(F.col("total") >= min_depth).withColumn("r", ranked)
    n = F.col("total")
    squares = sum(((F.col(b) / n) * (F.col(b) / n) for b in ALLELES[1:]), (F.col(ALLELES[0]) / n) * (F.col(ALLELES[0]) / n))
    minor = n + F.get("r", F.lit(0))["n"]
    return x.select("contig", "sample", "pos", "total", F.get("r", F.lit(0))["b"].alias("major"), F.get("r", F.lit(1))["b"].alias("alt"), (-F.get("r", F.lit(1))["n"]).alias("alt_count"), F.when(n > 1, n / (n - 1.0) * (1 - squares)).otherwise(F.lit(0.0)).alias("pi"), ((minor / n >= min_af) & (minor >= 2)).alias("is_snv"))


def variant_stats(sites: DataFrame) -> DataFrame:
    return sites.groupBy("contig", "sample").agg(F.count(F.lit(1)).alias("covered"), F.count_if("is_snv").alias("nsnv"), F.sum("pi").alias("pi_sum"))


def deepest_sites(sites: DataFrame, most: int = 96) -> DataFrame:
    w = Window.partitionBy("contig", "sample").orderBy(F.desc("total"), "pos")
    return sites.filter("is_snv").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).drop("r")


def read_bases(used: DataFrame) -> DataFrame:
    """(contig, sample, pos, base): the read's letters at the reference positions of match operations."""
    step = lambda s, x: F.when(x["op"].isin("M", "=", "X"), F.struct((s["r"] + x["n"]).alias("r"), (s["q"] + x["n"]).alias("q"), F.concat(s["out"], F.array(F.struct(s["r"].alias("r"), s["q"].alias("q"), x["n"].alias("n")))).alias("out"))).when(x["op"].isin("D", "N"), F.struct((s["r"] + x["n"]).alias("r"), s["q"].alias("q"), s["out"].alias("out"))).when(x["op"].isin("I", "S"), F.struct(s["r"].alias("r"), (s["q"] + x["n"]).alias("q"), s["out"].alias("out"))).otherwise(s)
    start = F.struct((F.col("pos") - 1).cast("int").alias("r"), F.lit(0).alias("q"), F.array().cast("array<struct<r:int,q:int,n:int>>").alias("out"))
    runs = used.filter("seq <> '*'").select("contig", "sample", "seq", F.inline(F.aggregate("ops", start, step, lambda s: s["out"])))
    each = runs.select("contig", "sample", "r", F.posexplode(F.split(F.substr(F.col("seq"), F.col("q") + 1, F.col("n")), "")).alias("k", "base"))
    return each.filter(F.upper("base").isin(*ALLELES)).select("contig", "sample", (F.col("r") + F.col("k")).alias("pos"), F.upper("base").alias("base"))


def sort_rank(rows: DataFrame) -> DataFrame:
    """Coordinate order: contig, position, reverse strand, input order; unmapped last. Range partitions, then a local sort."""
    return rows.orderBy(F.col("contig").asc_nulls_last(), "pos", F.col("flag").bitwiseAND(REVERSE) != 0, "ord")


def ranked(rows: DataFrame, keys: list, save) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the order of the keys: range partitions, local numbers, and a prefix sum of their sizes."""
    parts = save(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    base = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))  # a row per range
    local = parts.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    return local.join(base, "_part").withColumn("rank", F.col("_base") + F.col("_k")).drop("_part", "_base", "_k")


# -- seeding: the relational half of read mapping


def seed_votes(read_seeds: DataFrame, ref_seeds: DataFrame, band: int = 31, most_hits: int = 500) -> DataFrame:
    """(read, contig, diagonal, votes, rank): the two best diagonals of each read.

    read_seeds(read, key, rpos), ref_seeds(key, contig, cpos). Seeds with more than ``most_hits`` places say nothing.
    """
    rare = ref_seeds.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most_hits).select("key")
    hits = read_seeds.join(ref_seeds.join(rare, "key", "left_semi"), "key")
    votes = hits.groupBy("read", "contig", F.floor((F.col("cpos") - F.col("rpos")) / band).cast("long").alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy("read").orderBy(F.desc("votes"), "contig", "diagonal")
    return votes.withColumn("rank", F.row_number().over(w)).filter("rank <= 2")
