import math

from pyspark.sql import functions as F

from strandloom.operators import alignments as L
from strandloom.operators import overlap as O
from strandloom.operators import strains as T
from strandloom.sources import readers, writers

SAM = """@HD\tVN:1.6
@SQ\tSN:c1\tLN:1000
@SQ\tSN:c2\tLN:500
r1\t0\tc1\t101\t60\t100M\t*\t0\t0\t{a}\t*\tNM:i:0
r2\t0\tc1\t1\t60\t5S\t*\t0\t0\tAAAAA\t*\tNM:i:0
r3\t4\t*\t0\t0\t*\t*\t0\t0\tAAAAA\t*
r4\t1\tc1\t201\t60\t50M2D50M\tc2\t10\t0\t{a}\t*\tNM:i:3
r5\t1\tc2\t10\t60\t100M\tc1\t201\t0\t{a}\t*\tNM:i:0
r6\t0\tc1\t301\t60\t100M\t*\t0\t0\t{a}\t*\tNM:i:20
""".format(a="A" * 100)


def read(spark, tmp_path):
    (tmp_path / "s1.sam").write_text(SAM)
    contigs, al = readers.sam(spark, str(tmp_path / "s1.sam"))
    return contigs, al, L.usable(L.measured(al, contigs))


def test_reads_that_count(spark, tmp_path):
    _, al, used = read(spark, tmp_path)
    assert al.count() == 6
    assert {r["qname"] for r in used.collect()} == {"r1", "r4", "r5"}  # soft clips only, unmapped and unlike ones go


def test_coverage_trims_edges_and_substitutions(spark, tmp_path):
    contigs, al, used = read(spark, tmp_path)
    edges = L.edge_of(L.measured(al, contigs))
    assert edges.first()["edge"] == 33 - 6  # five reads of 100, 5, 100, 100, 100: a third of 81
    cov = {r["contig"]: r["mean"] for r in L.coverage(used, edges, contigs).collect()}
    assert math.isclose(cov["c1"], (100 + 100 - 1) / (1000 - 54))
    assert math.isclose(cov["c2"], (100 - 18) / (500 - 54))


def test_mean_depth_by_hand(spark):
    df = spark.createDataFrame([(8500, 1000, 50), (100, 101, 50), (5, 2, 0), (10**10, 1000, 0)], "t long, n long, e int")
    got = [r["d"] for r in df.select(L.mean_depth(F.col("t"), F.col("n"), F.col("e")).alias("d")).collect()]
    assert math.isclose(got[0], 8500 / 900) and math.isclose(got[1], 100 / 101) and got[2:] == [0.0, 0.0]


def test_both_mates_count_for_a_link(spark, tmp_path):
    _, _, used = read(spark, tmp_path)
    assert [(r["i"], r["j"], r["cnt"]) for r in L.pair_links(used).collect()] == [("c1", "c2", 2)]


def test_depth_steps_against_every_base(spark, tmp_path):
    contigs, _, used = read(spark, tmp_path)
    depth = [0] * 1000
    for s, n in ((100, 100), (200, 50), (252, 50)):
        for p in range(s, s + n):
            depth[p] += 1
    mean = sum(depth) / 1000
    var = sum((x - mean) ** 2 for x in depth) / 999
    r = L.depth_moments(L.depth_steps(L.base_runs(used), ["contig", "sample"]), contigs, ["contig", "sample"]).filter("contig = 'c1'").first()
    assert math.isclose(r["mean"], mean) and math.isclose(r["var"], var)


def test_gc_windows_longer_than_the_contig(spark):
    b = spark.createDataFrame([("c", p, 1, 1.0) for p in range(5)], "contig string, pos int, is_gc int, depth double")
    assert L.gc_windows(b, 6).count() == 0 and L.gc_windows(b, 5).first()["gc"] == 100


def test_variant_rules(spark):
    p = spark.createDataFrame([("c", "s", 1, 6, 4, 0, 0), ("c", "s", 2, 19, 1, 0, 0), ("c", "s", 3, 3, 1, 0, 0)], "contig string, sample string, pos int, A long, C long, G long, T long")
    r = {x["pos"]: x for x in L.variant_sites(p).collect()}
    assert set(r) == {1, 2} and math.isclose(r[1]["pi"], 10 / 9 * 0.48) and r[1]["is_snv"] and not r[2]["is_snv"]
    assert (r[1]["major"], r[1]["alt"], r[1]["alt_count"]) == ("A", "C", 4)


def test_read_bases_follow_the_cigar(spark):
    df = spark.createDataFrame([("c", "s", "ACGTAC", 1, [("S", 1), ("M", 2), ("I", 1), ("D", 3), ("M", 2)])], "contig string, sample string, seq string, pos int, ops array<struct<op:string,n:int>>")
    assert {(r["pos"], r["base"]) for r in L.read_bases(df).collect()} == {(0, "C"), (1, "G"), (5, "A"), (6, "C")}


def test_two_strains(spark):
    import random

    random.seed(1)
    share = [0.1, 0.5, 0.9, 0.3]
    rows = [(1, "c", p, s, "A", "C", round(share[s] * 100) + random.randint(-2, 2), 100) for p in range(30) for s in range(4)]
    r = T.estimate_strains(spark.createDataFrame(rows, "bin long, contig string, pos int, sample int, major string, alt string, alt_count long, total long"), 4).first()
    assert r["strains"] == 2 and r["sites"] == 30 and abs(r["minor"][2] - 0.9) < 0.05


def test_merge_refuses_other_lengths(spark):
    import pytest

    a = spark.createDataFrame([("c", 10, 1.0, 0.0)], "contig string, length long, mean double, var double")
    b = spark.createDataFrame([("c", 11, 1.0, 0.0)], "contig string, length long, mean double, var double")
    assert O.merge_abundances([a, a]).first()["total"] == 2.0
    with pytest.raises(Exception, match="differ at contig c"):
        O.merge_abundances([a, b]).collect()


def test_min_length(spark):
    c = spark.createDataFrame([(n,) for n in (10, 10, 20, 30)], "length long")
    assert O.min_length_for(c, 2).first()["min_len"] == 20
    assert O.min_length_for(c, 3).first()["min_len"] == 20
    assert O.min_length_for(c, 0).first()["min_len"] is None


def test_depth_table_round_trip(spark, tmp_path):
    cov = spark.createDataFrame([("c1", "a", 1000, 2.5, 0.5), ("c1", "b", 1000, 1.0, 0.1)], "contig string, sample string, length long, mean double, var double")
    writers.depth_table(cov, ["a", "b"], str(tmp_path / "d"), True)
    r = readers.depth_table(spark, str(tmp_path / "d" / "*.csv")).first()
    assert (r["name"], r["length"], r["depth"]) == ("c1", 1000, [2.5, 1.0])


def test_ranks_without_one_big_sort(spark, work):
    df = spark.createDataFrame([(i * 7919 % 1000, i) for i in range(500)], "k int, ord int")
    got = {r["ord"]: r["rank"] for r in L.ranked(df, [F.col("k"), F.col("ord")], work.save).collect()}
    want = {i: n + 1 for n, (_, i) in enumerate(sorted((i * 7919 % 1000, i) for i in range(500)))}
    assert got == want


def test_reads_that_pass_the_end_are_clipped_there(spark):
    rows = [("100M", 951, 1000, 100), ("40M10D60M", 951, 1000, 100), ("100M", 901, 1000, 100), ("5S", 1, 1000, 5), ("30M5I20M", 971, 1000, 55), ("100M", 951, 1000, 0)]
    df = spark.createDataFrame(rows, "cigar string, pos int, n long, seq_len int").withColumn("ops", L.cigar_ops(F.col("cigar")))
    out = df.select(F.array_join(F.transform(L.clip_overhang(F.col("ops"), F.col("pos"), F.col("n"), F.col("seq_len")), lambda x: F.concat(x["n"], x["op"])), "").alias("c"))
    assert [r["c"] for r in out.collect()] == ["100S", "40M10D60S", "100M", "5S", "30M5I20S", "0S"]


def test_the_cigar_is_parsed_once(spark, tmp_path):
    contigs, al, used = read(spark, tmp_path)
    assert used._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [r["o"] for r in spark.createDataFrame([("3M",), ("3M?",), ("*",), (None,)], "c string").select(F.size(L.cigar_ops(F.col("c"))).alias("o")).collect()] == [1, 0, 0, 0]


def test_weights_by_mapping_quality(spark):
    used = spark.createDataFrame([("c", "s", 1, 10, [("M", 4)]), ("c", "s", 3, 0, [("M", 4)])], "contig string, sample string, pos int, mapq int, ops array<struct<op:string,n:int>>")
    r = L.weighted_moments(used, spark.createDataFrame([("c", 10)], "contig string, length long")).first()
    w = lambda q: 1 - 10 ** (-q / 10) if q else 0.0
    base = [(1, w(10))] * 2 + [(2, w(5))] * 2 + [(1, 0.0)] * 2 + [(0, 1.0)] * 4
    mean = sum(d * x for d, x in base) / 10
    assert math.isclose(r["mean"], mean) and math.isclose(r["var"], sum(x * (d - mean) ** 2 for d, x in base) / (sum(x for _, x in base) - 1))
