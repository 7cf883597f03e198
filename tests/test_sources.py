import gzip

from strandloom.sources import readers as R
from strandloom.sources import writers as W


def test_fasta(spark, tmp_path):
    text = ">c1 with words\r\nACGT\r\nAC\r\n>c2\tx\nGG\n>c1 again\nTT\n>empty\n"
    (tmp_path / "a.fa").write_text(text)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(text)
    for name in ("a.fa", "b.fa.gz"):
        df = R.fasta(spark, str(tmp_path / name))
        assert [(r["name"], r["seq"]) for r in df.orderBy("ord").collect()] == [("c1", "ACGTAC"), ("c2", "GG"), ("c1", "TT"), ("empty", "")]
        assert {(r["name"], r["seq"]) for r in R.first_names(df).collect()} == {("c1", "ACGTAC"), ("c2", "GG"), ("empty", "")}
    assert R.fasta(spark, str(tmp_path / "a.fa"), True).orderBy("ord").first()["name"] == "c1 with words"


def test_fasta_is_written_in_lines_of_sixty(spark, tmp_path):
    df = spark.createDataFrame([("c", "A" * 130)], "name string, seq string")
    W.fasta(df, str(tmp_path / "o"))
    assert R.fasta(spark, str(tmp_path / "o")).first()["seq"] == "A" * 130


def test_depth_rules(spark, tmp_path):
    (tmp_path / "d.txt").write_text("contigName\tcontigLen\ttotalAvgDepth\ts1\ts1-var\ts2\ts2-var\na x\t2.5e+06\t3\t1\t9\t2\t9\na\t10\t0\t7\t0\t7\t0\nb\tnone\t0\t1\t0\t1\t0\nc\t50\t1\t1\t0\t0\t0\n")
    got = {r["name"]: (r["length"], r["depth"]) for r in R.depth_table(spark, str(tmp_path / "d.txt"), min_length=40).collect()}
    assert got == {"a": (2_500_000, [1.0, 2.0]), "c": (50, [1.0, 0.0])}
    (tmp_path / "n.txt").write_text("contigName\tcontigLen\ts1\ts2\na\t100\t1\t2\n")
    assert R.depth_table(spark, str(tmp_path / "n.txt"), variances=False).first()["depth"] == [1.0, 2.0]


def test_bioboxes_forms(spark, tmp_path):
    (tmp_path / "g").write_text("@Version:1\n@@BINID\tSEQUENCEID\t_LENGTH\ng1\ts1\t10\n")
    (tmp_path / "p").write_text("s1\tb1\n#x\ns2\t\n")
    (tmp_path / "m").write_text("BinNum\tSequenceName\n1\ts9\n")
    f = lambda n: [(r["seq"], r["bin"], r["length"]) for r in R.bioboxes(spark, str(tmp_path / n)).collect()]
    assert f("g") == [("s1", "g1", 10)] and f("p") == [("s1", "b1", None)] and f("m") == [("s9", "1", None)]
    W.bioboxes(spark.createDataFrame([("s1", 3, 10)], "seq string, bin long, length long"), str(tmp_path / "out"))
    assert f("out") == [("s1", "3", 10)]


def test_markers_and_seeds(spark, tmp_path):
    (tmp_path / "m").write_text("# marker_set_size=104\nc1\tm1\tm1\tm2\n")
    hits, n = R.markers(spark, str(tmp_path / "m"))
    assert n == 104 and sorted(r["marker"] for r in hits.collect()) == ["m1", "m1", "m2"]
    (tmp_path / "s").write_text("# x\n\nm1\tc1\tc2\n")
    assert {(r["seq"], r["marker"]) for r in R.marker_seeds(spark, str(tmp_path / "s")).collect()} == {("c1", "m1"), ("c2", "m1")}


def test_gfa_manifest_lists_fastq(spark, tmp_path):
    (tmp_path / "g").write_text("H\tVN:Z:1\nL\ta\t+\tb\t-\t0M\nP\tp\ta+,b-,c+\t*\n")
    links, steps = R.gfa(spark, str(tmp_path / "g"))
    assert [(r["a"], r["b"]) for r in links.collect()] == [("a", "b")]
    assert [r["seg"] for r in steps.orderBy("pos").collect()] == ["a", "b", "c"]
    (tmp_path / "man").write_text("o1 r1.fq r2.fq\no2 r.fq\n")
    assert [(r["out"], r["reads2"]) for r in R.manifest(spark, str(tmp_path / "man")).orderBy("ord").collect()] == [("o1", "r2.fq"), ("o2", None)]
    (tmp_path / "bin1").write_text("c[1][2]\nplain\n")
    assert {r["name"] for r in R.name_lists(spark, [str(tmp_path / "bin1")]).collect()} == {"c_1[2]", "plain"}
    assert R.path_list(spark, str(tmp_path / "bin1")) == ["c[1][2]", "plain"]
    with gzip.open(tmp_path / "r.fq.gz", "wt") as f:
        f.write("@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+\nII\n")
    assert [(r["name"], r["seq"], r["qual"]) for r in R.fastq(spark, str(tmp_path / "r.fq.gz")).orderBy("ord").collect()] == [("r1", "ACGT", "IIII"), ("r2", "GG", "II")]
    (tmp_path / "tax").write_text("c1\td__B;p__X\nbad\n")
    assert [(r["seq"], r["lineage"]) for r in R.taxonomy(spark, str(tmp_path / "tax")).collect()] == [("c1", "d__B;p__X")]


def test_stages_are_loaded_by_version(spark, tmp_path):
    import pytest

    W.save_stage(spark, {"edges": spark.range(3).toDF("i")}, str(tmp_path / "st"))
    assert R.load_stage(spark, str(tmp_path / "st"), ["edges"])["edges"].count() == 3
    with pytest.raises(ValueError):
        R.load_stage(spark, str(tmp_path / "st"), ["edges"], 2)


def test_fastq_over_many_splits(spark, tmp_path):
    reads = [(f"r{i}", "ACGT"[: 1 + i % 4] * 5, "@" * (5 * (1 + i % 4))) for i in range(3000)]  # a quality may look like a name
    (tmp_path / "r.fq").write_text("".join(f"@{n} x\r\n{s}\n+\n{q}\n" for n, s, q in reads))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "b.fq").write_text("@r\nA\n+\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = R.fastq(spark, str(tmp_path / "r.fq"))
        assert spark.read.text(str(tmp_path / "r.fq")).rdd.getNumPartitions() > 10
        assert [(r["name"], r["seq"], r["qual"]) for r in df.orderBy("ord").collect()] == reads
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    try:
        R.fastq(spark, str(tmp_path / "bad")).collect()
        raise RuntimeError("no error")
    except Exception as e:  # noqa: BLE001
        assert "not four lines a read" in str(e)


def test_names_of_samples(spark):
    df = spark.createDataFrame([("a/b/c.sorted.bam",), ("x",), ("/d/y.sam",)], "p string")
    assert [r["s"] for r in df.select(R.sample_name(df.p).alias("s")).collect()] == ["c.sorted", "x", "y"]


def test_consensus_and_paired_tables(spark, tmp_path):
    from strandloom.sources import writers

    m = spark.createDataFrame([(1, "c1")], "bin_num int, seq string")
    q = spark.createDataFrame([(1, 95.0, 1.25, 1, 0, "HQ")], "bin_num int, completeness double, contamination double, contigs long, source int, tier string")
    writers.consensus(m, q, str(tmp_path / "r"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "r/qc")).first().asDict() == {"BinNum": "1", "Completeness": "95.00", "Contamination": "1.25", "n_contigs": "1", "source": "0", "tier": "HQ"}
    writers.paired_matrix(spark.createDataFrame([(0, 1, 0.5)], "contig int, mate int, share double"), str(tmp_path / "p"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "p")).columns == ["contigIdx", "contigIdxMate", "AvgCoverage"]


def test_stability_tables(spark, tmp_path):
    each = spark.createDataFrame([("a", 1, 3000, 0.9, "core", None, None), ("b", 1, 1000, 0.25, "ambiguous", 2, 0.5), ("c", 1, 500, None, "member", None, None)], "seq string, bin int, length long, prob double, state string, alternative int, alt_prob double")
    bins = spark.createDataFrame([(1, False)], "bin int, certified boolean")
    W.stability(each, bins, str(tmp_path / "s"))

    def read(name):
        return [tuple(r) for r in spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "s" / name)).collect()]

    assert sorted(read("stable_members")) == [("a", "1", "3000", "0.900", "Y", "N", "-1", "0.000"), ("b", "1", "1000", "0.250", "N", "Y", "2", "0.500")]
    assert read("ambiguous_contigs") == [("b", "1", "1000", "0.250", "2", "0.500")]
    assert read("bin_stability") == [("1", "4000", "3000", "0.750", "0.738", "N")]
    W.stability(each.drop("alternative", "alt_prob"), bins, str(tmp_path / "s"))
    assert {r[6] for r in read("stable_members")} == {"-1"}


def test_fastq_reads_without_bases(spark, tmp_path):
    (tmp_path / "z.fq").write_text("@a\n\n+\n\n@b\nAC\n+\nII\n@c\n\n+\n\n\n\n")
    assert [(r["ord"], r["name"], r["seq"], r["qual"]) for r in R.fastq(spark, str(tmp_path / "z.fq")).orderBy("ord").collect()] == [(0, "a", "", ""), (1, "b", "AC", "II"), (2, "c", "", "")]
