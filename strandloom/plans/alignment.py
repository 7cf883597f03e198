"""Queries about alignments, coverage, variants, overlaps and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.operators import alignments as L
from strandloom.operators import overlap as O
from strandloom.operators import strains as T
from strandloom.workspace import Workspace

from . import bindings as B
from .features import _DNA, dna, rounded

EDGE = 75


def _coverage(s, d):
    """Quantities as covered bases of parts; return flags as samples."""
    l = B.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("contig"), F.col("l_returnflag").alias("sample")).agg((F.sum("l_quantity") * 100).alias("total"))
    p = B.part_contigs(s, d).withColumnRenamed("seq", "contig")
    return l.join(p, "contig").select("contig", "sample", "length", L.mean_depth(F.col("total"), F.col("length"), F.lit(EDGE)).alias("mean"))


def _alignments(s, d):
    """Line items as records: a match, an insertion, a match, a deletion and a match on the part's contig."""
    l = B.table(s, d, "lineitem")
    q = F.col("l_quantity").cast("int")
    return l.select(
        F.col("l_linestatus").alias("sample"),
        F.col("l_orderkey").cast("string").alias("qname"),
        F.when(F.col("l_returnflag") == "R", 0x411).otherwise(0x1).alias("flag"),
        F.col("l_partkey").alias("contig"),
        (F.pmod(F.col("l_suppkey") * 37, F.lit(900)) + 1).cast("int").alias("pos"),
        F.round(F.col("l_discount") * 600).cast("int").alias("mapq"),
        F.concat(q, F.lit("M2I"), q + 10, F.lit("M1D"), F.lit("40M")).alias("cigar"),
        F.col("l_suppkey").alias("mate_contig"),
        F.lit("*").alias("seq"),
        (3 + F.pmod(F.col("l_suppkey"), F.lit(3))).cast("int").alias("nm"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


def _used(s, d):
    contigs = B.part_contigs(s, d).withColumnRenamed("seq", "contig")
    return L.usable(L.measured(_alignments(s, d), contigs), 12, 95), contigs


def _sam_coverage(s, d):
    used, contigs = _used(s, d)
    edges = s.createDataFrame([("F", 30), ("O", 40)], "sample string, edge int")
    return rounded(L.coverage(used, edges, contigs), "mean")


def _depth_moments(s, d):
    used, contigs = _used(s, d)
    return rounded(L.depth_moments(L.depth_steps(L.base_runs(used), ["contig", "sample"]), contigs, ["contig", "sample"]), "mean", "var")


def _perfect(s, d):
    used, _ = _used(s, d)
    return L.perfect_kmers(L.base_runs(used).select("n"))


def _clip_repair(s, d):
    """Reads near the ends of their contigs, with the CIGAR that is left of each."""
    contigs = B.part_contigs(s, d).withColumnRenamed("seq", "contig")
    a = _alignments(s, d).join(contigs, "contig").withColumn("pos", (F.col("length") - 60 - F.pmod(F.col("mate_contig"), F.lit(80)) + 1).cast("int"))
    q = F.regexp_extract("cigar", "^([0-9]+)M", 1).cast("int")
    cut = L.clip_overhang(F.col("ops"), F.col("pos"), F.col("length"), 2 * q + 52)
    a = a.withColumn("ops", F.explode(F.array(L.cigar_ops(F.col("cigar"))))).withColumn("ops", cut)
    return a.select("ord", F.array_join(F.transform("ops", lambda x: F.concat(x["n"], x["op"])), "").alias("cigar"))


def _weighted_moments(s, d):
    used, contigs = _used(s, d)
    return rounded(L.weighted_moments(used, contigs, 2.0), "mean", "var")


def _read_classes(s, d):
    """Line items as reads with a mate, by the reason that keeps them out of an extraction of mapped reads."""
    p = B.part_contigs(s, d)
    own, mate = p.select(F.col("seq").alias("l_partkey"), F.col("length").alias("n1")), p.select(F.col("seq").alias("l_suppkey"), F.col("length").alias("n2"))
    flag = 1 + 2 * F.pmod("l_orderkey", F.lit(2)) + F.when(F.pmod("l_linenumber", F.lit(5)) == 0, 8).otherwise(0)
    r = B.table(s, d, "lineitem").join(own, "l_partkey").join(mate, "l_suppkey").select("n1", "n2", flag.cast("int").alias("flag"), (F.col("l_quantity") * 60).cast("long").alias("p1"), (F.col("l_discount") * 30000).cast("long").alias("p2"))
    kind = F.when(L.failed_mapping(F.col("n1") >= 1500, F.col("n2") >= 1500), "failed").when(L.at_edge(F.col("p1"), F.col("n1"), 200), "edge").when(L.at_edge(F.col("p2"), F.col("n2"), 200), "mate at edge").otherwise("kept")
    return r.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("reads"))


def _piles(s, d):
    base = F.substr(F.lit("ACGT"), (F.pmod(F.col("l_quantity").cast("int"), F.lit(4)) + 1).cast("int"), F.lit(1))
    l = B.table(s, d, "lineitem").select(F.col("l_suppkey").alias("contig"), F.concat("l_returnflag", "l_linestatus").alias("sample"), F.month("l_shipdate").alias("pos"), base.alias("base"))
    return L.variant_sites(L.pileup(l), 5, 0.05)


def _sites(s, d):
    order = F.array(*[F.lit(x) for x in ("AF", "AO", "NF", "NO", "RF", "RO")])
    return L.deepest_sites(_piles(s, d), 96).withColumn("sample", (F.array_position(order, F.col("sample")) - 1).cast("int"))


def _trajectories(s, d):
    t = T.contig_trajectories(_sites(s, d), 6)
    return rounded(t.select("contig", "sites", F.posexplode("v").alias("sample", "v")), "v")


def _strains(s, d):
    sites = _sites(s, d)
    bins = B.table(s, d, "supplier").select(F.col("s_suppkey").alias("contig"), F.col("s_nationkey").alias("bin"))
    return T.estimate_strains(sites.join(bins, "contig"), 6)


def _mappings(s, d, contig):
    l = B.table(s, d, "lineitem").select(F.col("l_orderkey").alias("read"), F.col(contig).alias("contig"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"))
    return O.last_mapping(l)


def _overlap(s, d):
    a = _mappings(s, d, "l_partkey")
    b = _mappings(s, d, "l_suppkey")
    known = B.table(s, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("read"))
    return O.contig_overlap(a, b.join(known, "read", "left_semi"))


def _bin_overlap(s, d):
    a = B.table(s, d, "part").select(F.col("p_partkey").alias("contig"), F.col("p_brand").alias("bin"))
    b = B.table(s, d, "supplier").select(F.col("s_suppkey").alias("contig"), F.col("s_nationkey").alias("bin"))
    return rounded(O.bin_overlap(_overlap(s, d), a, b), "share")


def _merge(s, d):
    contigs = B.table(s, d, "supplier").select(F.col("s_suppkey").alias("contig"), (1000 + F.floor(F.abs("s_acctbal"))).cast("long").alias("length"))
    l = B.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("contig"), "l_returnflag").agg(F.avg("l_quantity").alias("mean"), F.var_samp("l_quantity").alias("var"))
    tables = [contigs.join(l.filter(F.col("l_returnflag") == f), "contig", "left").select("contig", "length", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("var", F.lit(0.0)).alias("var")) for f in "ANR"]
    return rounded(O.merge_abundances(tables), "total", "m0", "v0", "m1", "v1", "m2", "v2")


def _sort_rank(s, d):
    l = B.table(s, d, "events").select(F.when(F.col("event_type") != "view", F.col("user_id")).alias("contig"), F.floor("value").cast("long").alias("pos"), (F.pmod(F.col("event_id"), F.lit(2)) * 16).cast("int").alias("flag"), F.col("event_id").alias("ord"))
    rev = F.col("flag").bitwiseAND(L.REVERSE) != 0
    return L.ranked(l, [F.col("contig").asc_nulls_last(), F.col("pos"), rev, F.col("ord")], Workspace(s, "rank").save).select("ord", "rank")


def _seeds(s, d):
    l = B.table(s, d, "lineitem")
    reads = l.filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("read"), F.col("l_partkey").alias("key"), F.col("l_quantity").cast("long").alias("rpos"))
    refs = l.filter("l_linenumber >= 3").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("contig"), F.floor(F.col("l_extendedprice") / 100).cast("long").alias("cpos"))
    return L.seed_votes(reads, refs)


def _identity(s, d):
    l = B.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") * 4).cast("int").alias("exact"), F.pmod("l_suppkey", F.lit(5)).cast("int").alias("subs"), F.pmod("l_partkey", F.lit(3)).cast("int").alias("ins"), F.pmod("l_orderkey", F.lit(4)).cast("int").alias("del"))
    l = l.withColumn("skip", F.lit(7)).withColumn("align_len", F.col("exact") + F.col("subs") + F.col("del") + 7).withColumn("seq_len", F.col("exact") + F.col("subs") + F.col("ins") + 5)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(c, 6).alias(n) for n, c in S.identity_variants().items()])


def _gc(s, d):
    e = B.table(s, d, "events")
    w = L.Window.partitionBy("user_id").orderBy("event_id")
    bases = e.select(F.col("user_id").alias("contig"), F.row_number().over(w).alias("pos"), F.col("event_type").isin("click", "purchase").cast("int").alias("is_gc"), F.col("value").alias("depth"))
    return rounded(L.gc_windows(bases, 20), "mean", "var", n=4)


def _filters(s, d):
    """How many records each rule leaves, one after another."""
    contigs = B.part_contigs(s, d).withColumnRenamed("seq", "contig")
    m = L.measured(_alignments(s, d), contigs)
    n = F.col("exact") + F.col("subs") + F.col("ins") + F.col("del")
    flag, mapq = F.col("flag").bitwiseAND(L.SKIPPED) == 0, F.col("mapq") >= 12
    ok, good = L.consistent(), 100.0 * F.col("exact") >= 95 * n
    return m.groupBy("sample").agg(F.count(F.lit(1)).alias("all_records"), F.count_if(flag).alias("after_flag"), F.count_if(flag & mapq).alias("after_mapq"), F.count_if(flag & mapq & ok).alias("after_checks"), F.count_if(flag & mapq & ok & good).alias("after_identity"))


QUERIES = {
    "length_partition": lambda s, d: O.partition_by_length(B.part_contigs(s, d)),
    "length_histogram": lambda s, d: O.length_histogram(B.part_contigs(s, d)),
    "min_len_for_max_scaffolds": lambda s, d: O.min_length_for(B.part_contigs(s, d), 500),
    "depth_mean": lambda s, d: rounded(_coverage(s, d), "mean"),
    "depth_total": lambda s, d: rounded(L.total_depth(_coverage(s, d), EDGE), "total"),
    "sam_read_filter": _filters,
    "sam_coverage": _sam_coverage,
    "per_base_moments": _depth_moments,
    "sam_clip_repair": _clip_repair,
    "mapq_weighted_moments": _weighted_moments,
    "read_classes": _read_classes,
    "rank_methods": lambda s, d: O.rank_methods(B.table(s, d, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size", "p_partkey"),
    "stride_sample": lambda s, d: O.stride_sample(B.table(s, d, "part").select("p_type", "p_partkey"), ["p_type"], "p_partkey", 3),
    "linear_quantiles": lambda s, d: rounded(B.table(s, d, "lineitem").groupBy("l_suppkey").agg(*[F.percentile("l_extendedprice", k / 10).alias(f"q{k}") for k in (1, 5, 9)]), "q1", "q5", "q9"),
    "perfect_kmers": _perfect,
    "pair_links": lambda s, d: L.pair_links(_used(s, d)[0]),
    "paired_contig_coverage": lambda s, d: rounded(L.paired_coverage(B.table(s, d, "lineitem").select(F.col("l_partkey").alias("contig"), F.col("l_suppkey").alias("mate"), F.col("l_quantity").alias("overlap")), B.part_contigs(s, d).withColumnRenamed("seq", "contig")), "share"),
    "gc_window_hist": _gc,
    "snv_pileup_stats": lambda s, d: rounded(L.variant_stats(_piles(s, d)), "pi_sum"),
    "snv_top_sites": lambda s, d: rounded(L.deepest_sites(_piles(s, d), 5), "pi").drop("is_snv"),
    "strain_estimate": _strains,
    "snv_trajectories": _trajectories,
    "contig_overlap": lambda s, d: rounded(_overlap(s, d), "pct"),
    "bin_overlap_rollup": _bin_overlap,
    "merge_abundances": _merge,
    "coordinate_sort_rank": _sort_rank,
    "seed_diagonal_votes": _seeds,
    "percent_identity": _identity,
    "dtr_scan": lambda s, d: dna(s, d).select("id", S.terminal_repeat(F.col("seq"), 8, 200).alias("dtr")),
    "reverse_complement": lambda s, d: dna(s, d).select("id", S.reverse_complement(F.col("seq")).alias("rc"), S.gc_percent(F.col("seq")).alias("gc")),
    "shred": lambda s, d: S.shreds(dna(s, d).withColumnRenamed("id", "name"), 500, 1),
}

_AL = """al AS (SELECT l_linestatus AS sample, l_partkey AS contig, l_suppkey AS mate, CASE WHEN l_returnflag = 'R' THEN 1041 ELSE 1 END AS flag, CAST((l_suppkey * 37) % 900 AS INT) AS p0, CAST(round(l_discount * 600) AS INT) AS mapq, CAST(l_quantity AS INT) AS q, 3 + l_suppkey % 3 AS nm,
  1000 + p_size * 100 AS length FROM lineitem JOIN part ON l_partkey = p_partkey),
ms AS (SELECT *, 2 * q + 50 AS m, nm - 3 AS subs, 2 * q + 50 - (nm - 3) AS exact, 2 * q + 51 AS alen FROM al),
used AS (SELECT * FROM ms WHERE flag & 1796 = 0 AND mapq >= 12 AND p0 + alen <= length AND 100.0 * exact >= 95 * (m + 3)),
runs AS (SELECT contig, sample, length, p0 AS s, q AS n FROM used UNION ALL SELECT contig, sample, length, p0 + q, q + 10 FROM used UNION ALL SELECT contig, sample, length, p0 + 2 * q + 11, 40 FROM used)"""
_COV = f"cov AS (SELECT l_partkey AS contig, l_returnflag AS sample, 1000 + p_size * 100 AS length, sum(l_quantity) * 100 / (1000 + p_size * 100 - {2 * EDGE}) AS mean FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey, l_returnflag, p_size)"
_PILE = """pile AS (SELECT l_suppkey AS contig, l_returnflag || l_linestatus AS sample, month(l_shipdate) AS pos, count(*) FILTER (CAST(l_quantity AS INT) % 4 = 0) AS a, count(*) FILTER (CAST(l_quantity AS INT) % 4 = 1) AS c,
  count(*) FILTER (CAST(l_quantity AS INT) % 4 = 2) AS g, count(*) FILTER (CAST(l_quantity AS INT) % 4 = 3) AS t FROM lineitem GROUP BY ALL),
al AS (SELECT contig, sample, pos, n, b, a + c + g + t AS total, row_number() OVER (PARTITION BY contig, sample, pos ORDER BY n DESC, b) AS r, sum(n * n) OVER (PARTITION BY contig, sample, pos) AS sq
  FROM (SELECT *, unnest(['A', 'C', 'G', 'T']) AS b, unnest([a, c, g, t]) AS n FROM pile)),
site AS (SELECT x.contig, x.sample, x.pos, x.total, x.b AS major, y.b AS alt, y.n AS alt_count, CASE WHEN x.total > 1 THEN x.total / (x.total - 1.0) * (1 - x.sq / (x.total * x.total)) ELSE 0 END AS pi,
  (x.total - x.n) / x.total >= 0.05 AND x.total - x.n >= 2 AS is_snv FROM al x JOIN al y ON x.contig = y.contig AND x.sample = y.sample AND x.pos = y.pos WHERE x.r = 1 AND y.r = 2 AND x.total >= 5)"""
_MAPS = """ra AS (SELECT l_orderkey AS read, arg_max(l_partkey, struct_pack(x := l_linenumber, y := l_partkey, z := l_suppkey)) AS contig_a, arg_max(l_suppkey, struct_pack(x := l_linenumber, y := l_partkey, z := l_suppkey)) AS contig_b FROM lineitem GROUP BY 1),
ov AS (SELECT contig_a, coalesce(CASE WHEN o_orderstatus <> 'P' THEN CAST(contig_b AS VARCHAR) END, '*') AS contig_b, count(*) AS overlap FROM ra LEFT JOIN orders ON read = o_orderkey GROUP BY ALL),
tot AS (SELECT contig_a, sum(overlap) AS total FROM ov GROUP BY 1)"""

ORACLES = {
    "length_partition": "SELECT p_partkey AS seq, CAST(1000 + p_size * 100 AS BIGINT) AS length, CASE WHEN 1000 + p_size * 100 >= 2500 THEN 'large' WHEN 1000 + p_size * 100 >= 1000 THEN 'small' ELSE 'discarded' END AS size_class FROM part",
    "length_histogram": "SELECT CAST(1000 + p_size * 100 AS BIGINT) AS length, count(*) AS contigs FROM part GROUP BY 1",
    "min_len_for_max_scaffolds": "SELECT CAST(min(length) AS BIGINT) AS min_len FROM (SELECT 1000 + p_size * 100 AS length, sum(count(*)) OVER (ORDER BY 1000 + p_size * 100 DESC) AS n FROM part GROUP BY 1) WHERE n <= 500",
    "depth_mean": f"WITH {_COV} SELECT contig, sample, CAST(length AS BIGINT) AS length, round(mean, 6) + 0.0 AS mean FROM cov",
    "depth_total": f"WITH {_COV} SELECT contig, round(sum(mean * (length - 150)) / sum(length - 150) * count(*), 6) + 0.0 AS total FROM cov GROUP BY contig",
    "sam_read_filter": f"WITH {_AL} SELECT sample, count(*) AS all_records, count(*) FILTER (flag & 1796 = 0) AS after_flag, count(*) FILTER (flag & 1796 = 0 AND mapq >= 12) AS after_mapq, count(*) FILTER (flag & 1796 = 0 AND mapq >= 12 AND p0 + alen <= length) AS after_checks, count(*) FILTER (flag & 1796 = 0 AND mapq >= 12 AND p0 + alen <= length AND 100.0 * exact >= 95 * (m + 3)) AS after_identity FROM ms GROUP BY sample",
    "sam_coverage": f"""WITH {_AL}, e AS (SELECT 'F' AS sample, 30 AS edge UNION ALL SELECT 'O', 40),
c AS (SELECT u.contig, u.sample, greatest(0, list_sum(list_transform([[u.p0, u.q], [u.p0 + u.q, u.q + 10], [u.p0 + 2 * u.q + 11, 40]], lambda x: x[2] - least(greatest(e.edge - x[1], 0), x[2]) - least(greatest(x[1] + x[2] - (u.length - e.edge), 0), x[2]))) - u.subs) AS c FROM used u JOIN e ON u.sample = e.sample),
t AS (SELECT contig, sample, sum(c) AS total FROM c GROUP BY ALL)
SELECT p_partkey AS contig, e.sample, CAST(1000 + p_size * 100 AS BIGINT) AS length, round(coalesce(t.total, 0) / (1000 + p_size * 100 - 2 * e.edge), 6) + 0.0 AS mean FROM part CROSS JOIN e LEFT JOIN t ON t.contig = p_partkey AND t.sample = e.sample""",
    "per_base_moments": f"""WITH {_AL}, b AS (SELECT contig, sample, length, unnest(range(CAST(s AS BIGINT), CAST(s + n AS BIGINT))) AS p FROM runs), d AS (SELECT contig, sample, length, p, count(*) AS d FROM b GROUP BY ALL),
m AS (SELECT contig, sample, length, sum(d) AS s, sum(d * d) AS q FROM d GROUP BY ALL)
SELECT contig, sample, round(s / length, 6) + 0.0 AS mean, round((q - s * (s / length)) / (length - 1), 6) + 0.0 AS var FROM m""",
    "sam_clip_repair": """WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS ord, CAST(l_quantity AS INT) AS q, 1000 + p_size * 100 AS n, 1000 + p_size * 100 - 60 - l_suppkey % 80 AS p FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT ord, CASE WHEN p + q > n THEN (2 * q + 52) || 'S' WHEN p + 2 * q + 10 > n THEN q || 'M2I' || (q + 50) || 'S' WHEN p + 2 * q + 11 > n THEN q || 'M2I' || (q + 10) || 'M40S'
  WHEN p + 2 * q + 51 > n THEN q || 'M2I' || (q + 10) || 'M1D40S' ELSE q || 'M2I' || (q + 10) || 'M1D40M' END AS cigar FROM a""",
    "mapq_weighted_moments": f"""WITH {_AL.replace("SELECT contig, sample, length,", "SELECT mapq, contig, sample, length,")}, b AS (SELECT contig, sample, length, mapq, unnest(range(CAST(s AS BIGINT), CAST(s + n AS BIGINT))) AS p FROM runs),
d AS (SELECT contig, sample, length, p, count(*) AS d, avg(mapq) AS mq FROM b GROUP BY ALL), w AS (SELECT *, CASE WHEN mq > 0 THEN (1 - 10.0 ** (-mq / 10)) ** 2 ELSE 0 END AS w FROM d),
m AS (SELECT contig, sample, length, sum(w * d) / length AS mean, sum(w) + length - count(*) AS total, count(*) AS n FROM w GROUP BY contig, sample, length)
SELECT m.contig, m.sample, round(any_value(m.mean), 6) + 0.0 AS mean, round((sum(w.w * (w.d - m.mean) ** 2) + any_value((m.length - m.n) * m.mean ** 2)) / any_value(CASE WHEN m.total > 2 THEN m.total - 1 ELSE m.length - 1 END), 6) + 0.0 AS var
FROM m JOIN w ON m.contig = w.contig AND m.sample = w.sample GROUP BY m.contig, m.sample""",
    "read_classes": """WITH r AS (SELECT l_orderkey % 2 = 1 AND l_linenumber % 5 <> 0 AND 1000 + a.p_size * 100 >= 1500 AND 1000 + b.p_size * 100 >= 1500 AS good, CAST(l_quantity * 60 AS BIGINT) AS p1, CAST(floor(l_discount * 30000) AS BIGINT) AS p2, 1000 + a.p_size * 100 AS n1, 1000 + b.p_size * 100 AS n2
  FROM lineitem JOIN part a ON l_partkey = a.p_partkey JOIN part b ON l_suppkey = b.p_partkey)
SELECT CASE WHEN NOT good THEN 'failed' WHEN p1 < 200 OR p1 + 200 >= n1 THEN 'edge' WHEN p2 < 200 OR p2 + 200 >= n2 THEN 'mate at edge' ELSE 'kept' END AS class, count(*) AS reads FROM r GROUP BY 1""",
    "rank_methods": """SELECT p_brand, p_partkey, p_size, CAST(rank() OVER w AS INT) AS r_min, rank() OVER w + count(*) OVER (PARTITION BY p_brand, p_size) - 1 AS r_max, rank() OVER w + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS r_average,
  CAST(dense_rank() OVER w AS INT) AS r_dense, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS INT) AS r_first FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)""",
    "stride_sample": """WITH x AS (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_type) AS n FROM part)
SELECT p_type, p_partkey FROM x WHERE n <= 3 OR i IN (SELECT CAST(floor(t * (n / 3.0::DOUBLE)) AS BIGINT) FROM range(3) r(t))""",
    "linear_quantiles": "SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.1), 6) + 0.0 AS q1, round(quantile_cont(l_extendedprice, 0.5), 6) + 0.0 AS q5, round(quantile_cont(l_extendedprice, 0.9), 6) + 0.0 AS q9 FROM lineitem GROUP BY 1",
    "perfect_kmers": f"WITH {_AL}, k AS (SELECT n, unnest(range(1, CAST(least(n, 256) AS BIGINT) + 1)) AS k FROM runs WHERE n > 0) SELECT CAST(k AS INT) AS k, CAST(sum(n - k + 1) AS BIGINT) AS kmers FROM k GROUP BY k",
    "pair_links": f"WITH {_AL} SELECT least(contig, mate) AS i, greatest(contig, mate) AS j, count(*) AS cnt FROM used WHERE contig <> mate GROUP BY ALL",
    "paired_contig_coverage": "SELECT l_partkey AS contig, l_suppkey AS mate, round(sum(l_quantity) / (1000 + p_size * 100), 6) + 0.0 AS share FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey, l_suppkey, p_size",
    "gc_window_hist": """WITH b AS (SELECT user_id AS contig, event_id, CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS g, value AS d FROM events),
w AS (SELECT sum(g) OVER w AS g, avg(d) OVER w AS d, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY contig ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING))
SELECT CAST(floor(100.0 * g / 20 + 0.5) AS INT) AS gc, count(*) AS windows, round(avg(d), 4) + 0.0 AS mean, round(coalesce(var_samp(d), 0), 4) + 0.0 AS var FROM w WHERE n = 20 GROUP BY 1""",
    "snv_pileup_stats": f"WITH {_PILE} SELECT contig, sample, count(*) AS covered, count(*) FILTER (is_snv) AS nsnv, round(sum(pi), 6) + 0.0 AS pi_sum FROM site GROUP BY ALL",
    "snv_trajectories": f"""WITH {_PILE},
st AS (SELECT contig, pos, list_position(['AF', 'AO', 'NF', 'NO', 'RF', 'RO'], sample) - 1 AS k, major, alt, alt_count, total FROM site WHERE is_snv QUALIFY row_number() OVER (PARTITION BY contig, sample ORDER BY total DESC, pos) <= 96),
cn AS (SELECT contig, pos, arg_max(alt, struct_pack(t := total, k := -k)) AS canon FROM st GROUP BY ALL HAVING count(*) >= 2),
x AS (SELECT st.contig, st.pos, k, CASE WHEN alt = canon THEN alt_count / total WHEN major = canon THEN 1 - alt_count / total ELSE 0.0::DOUBLE END AS x FROM st JOIN cn ON st.contig = cn.contig AND st.pos = cn.pos),
m AS (SELECT contig, pos, avg(x) AS m FROM x GROUP BY ALL),
f AS (SELECT m.contig, m.pos, g.k, coalesce(x.x, m.m) AS f FROM m CROSS JOIN (SELECT unnest(range(6)) AS k) g LEFT JOIN x ON x.contig = m.contig AND x.pos = m.pos AND x.k = g.k),
c AS (SELECT contig, pos, k, f - avg(f) OVER (PARTITION BY contig, pos) AS c FROM f),
n AS (SELECT *, sum(c * c) OVER (PARTITION BY contig, pos) AS n FROM c),
dir AS (SELECT contig, pos, k, c / sqrt(n) AS d FROM n WHERE n >= 1e-9),
ref AS (SELECT contig, k, arg_min(d, pos) AS d FROM dir GROUP BY ALL),
sg AS (SELECT a.contig, a.pos, CASE WHEN sum(a.d * r.d) < -1e-9 THEN -1 ELSE 1 END AS g FROM dir a JOIN ref r ON a.contig = r.contig AND a.k = r.k GROUP BY ALL),
s AS (SELECT a.contig, a.k, sum(a.d * g) AS s, count(*) AS sites FROM dir a JOIN sg ON a.contig = sg.contig AND a.pos = sg.pos GROUP BY ALL),
t AS (SELECT *, sum(s * s) OVER (PARTITION BY contig) AS q FROM s)
SELECT contig, sites, CAST(k AS INT) AS sample, round(s / sqrt(q), 6) + 0.0 AS v FROM t WHERE q >= 1e-12""",
    "snv_top_sites": f"WITH {_PILE} SELECT contig, sample, CAST(pos AS INT) AS pos, total, major, alt, alt_count, round(pi, 6) + 0.0 AS pi FROM site WHERE is_snv QUALIFY row_number() OVER (PARTITION BY contig, sample ORDER BY total DESC, pos) <= 5",
    "contig_overlap": f"WITH {_MAPS} SELECT ov.contig_a, ov.contig_b, ov.overlap, CAST(tot.total AS BIGINT) AS total, round(100.0 * overlap / total, 6) + 0.0 AS pct FROM ov JOIN tot ON ov.contig_a = tot.contig_a",
    "bin_overlap_rollup": f"""WITH {_MAPS}, n AS (SELECT p_brand AS bin_a, coalesce(CAST(s_nationkey AS VARCHAR), '*') AS bin_b, CAST(sum(overlap) AS BIGINT) AS overlap FROM ov JOIN part ON contig_a = p_partkey LEFT JOIN supplier ON contig_b = CAST(s_suppkey AS VARCHAR) GROUP BY ALL),
s AS (SELECT *, overlap / sum(overlap) OVER (PARTITION BY bin_a) AS share FROM n) SELECT bin_a, bin_b, overlap, round(share, 6) + 0.0 AS share FROM s WHERE share > 0.001""",
    "merge_abundances": """WITH l AS (SELECT l_suppkey AS contig, l_returnflag AS f, avg(l_quantity) AS mean, var_samp(l_quantity) AS var FROM lineitem GROUP BY ALL)
SELECT s_suppkey AS contig, 1000 + CAST(floor(abs(s_acctbal)) AS BIGINT) AS length, round(coalesce(a.mean, 0) + coalesce(n.mean, 0) + coalesce(r.mean, 0), 6) + 0.0 AS total,
  round(coalesce(a.mean, 0), 6) + 0.0 AS m0, round(coalesce(a.var, 0), 6) + 0.0 AS v0, round(coalesce(n.mean, 0), 6) + 0.0 AS m1, round(coalesce(n.var, 0), 6) + 0.0 AS v1, round(coalesce(r.mean, 0), 6) + 0.0 AS m2, round(coalesce(r.var, 0), 6) + 0.0 AS v2
FROM supplier LEFT JOIN l a ON a.contig = s_suppkey AND a.f = 'A' LEFT JOIN l n ON n.contig = s_suppkey AND n.f = 'N' LEFT JOIN l r ON r.contig = s_suppkey AND r.f = 'R'""",
    "coordinate_sort_rank": "SELECT event_id AS ord, row_number() OVER (ORDER BY CASE WHEN event_type <> 'view' THEN user_id END NULLS LAST, CAST(floor(value) AS BIGINT), event_id % 2 = 1, event_id) AS rank FROM events",
    "seed_diagonal_votes": """WITH r AS (SELECT l_orderkey AS read, l_partkey AS key, CAST(l_quantity AS BIGINT) AS rpos FROM lineitem WHERE l_linenumber <= 2), f AS (SELECT l_partkey AS key, l_suppkey AS contig, CAST(floor(l_extendedprice / 100) AS BIGINT) AS cpos FROM lineitem WHERE l_linenumber >= 3),
ok AS (SELECT * FROM f WHERE key IN (SELECT key FROM f GROUP BY key HAVING count(*) <= 500)),
v AS (SELECT read, contig, CAST(floor((cpos - rpos) / 31) AS BIGINT) AS diagonal, count(*) AS votes FROM r JOIN ok ON r.key = ok.key GROUP BY ALL)
SELECT read, contig, diagonal, votes, CAST(row_number() OVER (PARTITION BY read ORDER BY votes DESC, contig, diagonal) AS INT) AS rank FROM v QUALIFY rank <= 2""",
    "percent_identity": """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity * 4 AS INT) AS e, l_suppkey % 5 AS s, l_partkey % 3 AS i, l_orderkey % 4 AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(e / (e + s + i + d), 6) AS id_all, round(e / (e + s), 6) AS id_no_gaps, round(e / (e + s + i), 6) AS id_no_del, round(e / (e + s + d), 6) AS id_no_ins,
  round(e / (e + s + d), 6) AS id_aligned, round(e / (e + s + i + 5), 6) AS id_read, round(e / greatest(e + s + d, e + s + i + 5), 6) AS id_longer, round(e / least(e + s + d, e + s + i + 5), 6) AS id_shorter FROM x""",
    "dtr_scan": f"WITH {_DNA} SELECT id, CAST(coalesce(list_max(list_filter(range(8, least(200, length(seq) // 2) + 1), lambda w: left(seq, w) = right(seq, w))), 0) AS INT) AS dtr FROM dna",
    "reverse_complement": f"WITH {_DNA} SELECT id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc, CASE WHEN length(seq) > 0 THEN CAST(floor(100.0 * length(regexp_replace(seq, '[AT]', '', 'g')) / length(seq) + 0.5) AS INT) END AS gc FROM dna",
    "shred": f"""WITH {_DNA}, n AS (SELECT id, seq, greatest(length(seq) - 500, 0) AS last FROM dna), p AS (SELECT id, seq, unnest(list_distinct(list_append(range(0, last + 1, 50), last))) AS start FROM n)
SELECT id AS name, CAST(start AS INT) AS start, 1 AS copy, substr(seq, CAST(start + 1 AS BIGINT), 500) AS seq FROM p""",
}
