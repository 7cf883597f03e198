"""Planted genomes through the whole plan, and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.config import BinConfig
from strandloom.operators import tuning
from strandloom.plans.binning import bin_contigs
from strandloom.streaming import coverage as SC


def test_planted_genomes_come_back(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows, depth, truth = [], [], {}
    profiles = rng.lognormal(2, 1, (3, 6))
    def grown(steps, n):
        """A sequence whose next base hangs on the last three, as the genome's table has it."""
        at, out = int(rng.integers(64)), []
        for u in rng.random(n):
            b = int((u > steps[at]).sum())
            out.append("ACGT"[min(b, 3)])
            at = (at * 4 + min(b, 3)) % 64
        return "".join(out)

    for g in range(3):
        steps = rng.dirichlet(np.ones(4), 64).cumsum(axis=1)
        for c in range(14):
            i = g * 100 + c
            n = int(rng.integers(3000, 5000)) if c < 12 else 1500
            rows.append((i, f"c{i}", grown(steps, n)))
            depth.append((f"c{i}", (profiles[g] * rng.lognormal(0, 0.03, 6)).tolist()))
            truth[i] = g
    contigs = spark.createDataFrame(rows, "id long, name string, seq string")
    depths = spark.createDataFrame(depth, "name string, depth array<double>")
    out = bin_contigs(spark, contigs, depths, BinConfig(max_edges=8, sketch_m=200, min_bin_size=10_000, min_recruit_cluster=5, min_edge_score=0.6, sim_cutoff=0.05))
    got = {r["seq"]: r["bin"] for r in out.bins.collect()}
    assert len(got) >= 34
    for b in set(got.values()):
        genomes = [truth[s] for s, x in got.items() if x == b]
        assert len(set(genomes)) == 1
    # the graph from bands of registers gives the same kind of bins
    banded = bin_contigs(spark, contigs, depths, BinConfig(max_edges=8, sketch_m=200, min_bin_size=10_000, min_recruit_cluster=5, min_edge_score=0.6, sim_cutoff=0.05, index_from=0, band_registers=4))
    sure = {r["seq"]: r["bin"] for r in banded.bins.collect()}
    assert len(sure) >= 34 and all(len({truth[s] for s, x in sure.items() if x == b}) == 1 for b in set(sure.values()))
    # swept, united and certified: the same genomes, held in every run
    monkeypatch.setattr(tuning, "perturbations", lambda base: [base])
    cfg = BinConfig(max_edges=8, sketch_m=200, min_bin_size=10_000, min_recruit_cluster=5, min_edge_score=0.6, sim_cutoff=0.05, select="modularity", grid="0:1;0.2:1", clustering="mlpa", certify=True, cert_dropped=1)
    tuned = bin_contigs(spark, contigs, depths, cfg, trajectories=spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.0, 1.0])], "contig long, v array<double>"))
    held = tuned.stable.collect()
    assert held and all(truth[r["seq"]] == truth[r["bin"]] for r in held) and sum(r["state"] == "core" for r in held) >= 0.8 * len(held)
    assert tuned.stable_bins.filter("certified").count() >= 1
    with pytest.raises(ValueError):
        bin_contigs(spark, contigs, depths, BinConfig(select="markers"))
    assert [r["bin_num"] for r in out.table.orderBy("bin_num").collect()] == list(range(1, out.table.count() + 1))


def test_streamed_coverage_equals_batch(spark, tmp_path):
    schema = "sample string, qname string, flag int, contig string, pos int, mapq int, cigar string, mate_contig string, seq string, nm int"
    rows = [("s", f"r{i}", 1, "c1" if i % 2 else "c2", 100 + i, 60, "100M", "c2" if i % 2 else "c1", "*", 0) for i in range(20)]
    src = tmp_path / "in"
    for k in range(2):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).write.parquet(f"{src}/{k}")
    contigs = spark.createDataFrame([("c1", 1000), ("c2", 1000)], "contig string, length long")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = SC.start(SC.covered(stream, contigs), "memory", str(tmp_path / "cp"), "complete", "cov")
    q.processAllAvailable()
    q.stop()
    want = {r["contig"]: r["total"] for r in SC.covered(spark.createDataFrame(rows, schema), contigs).collect()}
    assert {r["contig"]: r["total"] for r in spark.table("cov").collect()} == want == {"c1": 1000, "c2": 1000}
    assert SC.linked(spark.createDataFrame(rows, schema), contigs).first()["cnt"] == 20


def test_late_rows_are_left_out(spark, tmp_path):
    src = tmp_path / "ev"
    for k, ts in enumerate(["2024-01-01 00:00:30", "2024-01-01 02:00:00", "2024-01-01 02:00:10", "2024-01-01 00:00:40"]):
        spark.sql(f"select timestamp '{ts}' as ts, 'a' as k").write.parquet(f"{src}/{k}")
    stream = spark.readStream.schema("ts timestamp, k string").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{src}/*")
    q = SC.start(SC.windowed(stream, "ts", ["k"], "1 minute", "10 minutes"), "memory", str(tmp_path / "cp2"), "append", "win")
    q.processAllAvailable()
    q.stop()
    assert [r["n"] for r in spark.table("win").collect()] == [1]


def test_recall_of_banded_pairs(spark):
    from strandloom.functions import sequences as S
    from strandloom.operators import pairs as P

    rng = np.random.default_rng(5)
    rows = []
    for g in range(12):
        base = rng.integers(0, 10**6, 500)
        for c in range(15):
            own = np.where(rng.random(500) < 0.04, rng.integers(0, 10**6, 500), base)
            rows.append((g * 100 + c, own.tolist()))
    sk = spark.createDataFrame(rows, "id long, sketch array<long>")
    want = {(r["i"], r["j"]): r["sim"] for r in P.all_pairs(sk, P.match_kernel, ["sketch"], 0.9).collect()}
    got = {(r["i"], r["j"]): r["sim"] for r in P.banded_pairs(sk, S.match_share).collect()}
    assert len(want) > 1000 and len(want.keys() & got.keys()) >= 0.95 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want.keys() & got.keys())
