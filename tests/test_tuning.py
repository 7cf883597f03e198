import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions.stats import chi2_even_sf_any
from strandloom.operators import cluster as C
from strandloom.operators import graph as G
from strandloom.operators import strains as T
from strandloom.operators import tuning as U


@pytest.fixture
def two_groups(spark):
    """Pairs within two groups of six, a few across; depths that tell the groups apart in six samples."""
    rng = np.random.default_rng(3)
    pairs, prof = [], []
    for c in (0, 10):
        pairs += [(a, b, 0.95) for a in range(c, c + 6) for b in range(a + 1, c + 6)]
    pairs += [(a, a + 10, 0.75) for a in range(3)]
    shape = {0: [1, 5, 2, 8, 3, 9], 10: [9, 2, 7, 1, 6, 3]}
    for c, s in shape.items():
        prof += [(i, (np.array(s) * rng.uniform(0.99, 1.01, 6)).tolist()) for i in range(c, c + 6)]
    p = G.profiles(spark.createDataFrame([(i, str(k), float(x)) for i, v in prof for k, x in enumerate(v)], "seq long, sample string, depth double"))
    return spark.createDataFrame(pairs, "i long, j long, sim double"), p


def test_a_sample_left_out_is_as_if_never_there(spark, two_groups):
    _, prof = two_groups
    got = {r["seq"]: r for r in G.without_sample(prof, 2).collect()}
    for r in prof.collect():
        keep = [x for k, x in enumerate(r["depth"]) if k != 2]
        ranks = np.argsort(np.argsort(keep)) + 1.0
        c = ranks - ranks.mean()
        assert got[r["seq"]]["depth"] == keep and np.allclose(got[r["seq"]]["unit"], c / np.linalg.norm(c))


def test_runs_keep_what_belongs_together(spark, work, two_groups):
    pairs, prof = two_groups
    base = U.Setting(0.5, 1.0, 0.7)
    runs = work.save(U.perturbed_runs(pairs, prof, 6, base, work, settings=U.perturbations(base)[4:6], most_dropped=1), "runs")
    rows = runs.collect()
    assert {r["run"] for r in rows} == set(range(3)) and len(rows) == 3 * 12
    for run in range(3):
        of = {r["seq"]: r["label"] for r in rows if r["run"] == run}
        assert len({of[i] for i in range(6)}) == 1 and of[0] != of[10]
    ref = spark.createDataFrame([(i, "a" if i < 10 else "b") for i in (*range(5), *range(10, 16), 5)], "seq long, bin string").withColumn("bin", F.when(F.col("seq") == 5, "b").otherwise(F.col("bin")))
    alt = {r["seq"]: (r["alternative"], r["alt_prob"]) for r in U.alternatives(ref, runs).collect()}
    assert alt == {5: ("a", 1.0)}


def test_sweep_by_modularity_and_by_markers(spark, work, two_groups):
    pairs, prof = two_groups
    terms = work.save(G.edge_terms(pairs, prof), "terms")
    got = U.sweep(terms, work, [(1.0, 1.0), (0.5, 1.0)])
    assert len(got.table) == 2 and got.labels.select("label").distinct().count() == 2
    markers = spark.createDataFrame([(c + m % 6, m) for c in (0, 10) for m in range(20)], "seq long, marker int")
    best = U.sweep(terms, work, [(0.5, 1.0)], markers=markers, set_size=20)
    assert best.table[0]["rank"] == (2, 200.0)
    y = prof.select("seq", F.lit(50_000).cast("long").alias("length"), F.transform("depth", lambda x: F.log(x + 1)).alias("y"))
    cut = U.sweep(terms, work, [(0.5, 1.0)], markers=markers, set_size=20, members=y)
    top = max(r["rank"] for r in cut.table)
    assert [r["silhouette"] for r in cut.table] == [0.6, 0.7, 0.8]
    assert cut.silhouette == next(r["silhouette"] for r in cut.table if r["rank"] == top)
    with pytest.raises(ValueError):
        U.sweep(terms, work, [])


def test_perturbations_stay_in_range():
    got = U.perturbations(U.Setting(0.0, 1.0, 0.02))
    assert len(got) == 10 == len(set(got))
    assert all(0 <= s.alpha <= 1 and s.min_score >= 0.01 and s.power in (1.0, 1.5) for s in got)


def test_texts_of_grids_and_resolutions():
    assert U.parse_grid("0.2:1.5;0.7;x:1") == [(0.2, 1.5), (0.7, 1.0)]
    assert U.parse_grid("1") == U.parse_grid("") == list(U.GRID)
    assert U.parse_resolutions("fine:1000:0.5,plain,usual:x,", 9, 0.7) == [("fine", 1000, 0.5), ("usual", 9, 0.7)]


def test_each_resolution_has_its_floor(spark):
    rows = [(1, i, 1000, [0.0, 0.01 * i] if i < 6 else [9.0, 9 + 0.01 * i]) for i in range(10)] + [(2, 50, 900, [1.0, 1.0])]
    m = spark.createDataFrame(rows, "bin long, seq long, length long, y array<double>")
    got = {}
    for r in U.at_resolutions(m, [("fine", 500, 0.7), ("usual", 5000, 0.7), ("whole", 1000, 2.0)]).collect():
        got.setdefault(r["resolution"], {}).setdefault((r["bin"], r["piece"]), set()).add(r["seq"])
    assert sorted(map(sorted, got["fine"].values())) == [[0, 1, 2, 3, 4, 5], [6, 7, 8, 9], [50]]
    assert list(got["usual"].values()) == [set(range(6))] and list(got["whole"].values()) == [set(range(10))]
    with pytest.raises(ValueError):
        U.at_resolutions(m, [])


def test_upper_tail_for_many_edges(spark):
    def plain(m, x):
        u = x / 2
        return sum(math.exp(i * math.log(u) - u - math.lgamma(i + 1)) for i in range(m))

    cases = [(1, 3.0), (5, 40.0), (256, 600.0), (257, 600.0), (1000, 1832.0), (1000, 2400.0), (4000, 8000.0)]
    df = spark.createDataFrame(cases, "m int, x double").withColumn("q", chi2_even_sf_any(F.col("m"), F.col("x")))
    for r in df.collect():
        assert r["q"] == pytest.approx(plain(r["m"], r["x"]), rel=0.02)


def test_labels_with_strong_links_unite(spark, work):
    inside = [(a, b, 0.95) for c in (0, 10, 20) for a in range(c, c + 4) for b in range(a + 1, c + 4)]
    strong = [(a, a + 10, 0.99999) for a in range(4)]
    weak = [(10, 20, 0.9), (11, 21, 0.9)]
    edges = spark.createDataFrame(inside + strong + weak, "i long, j long, score double")
    labels = spark.createDataFrame([(c + k, c) for c in (0, 10, 20) for k in range(4)], "node long, label long")
    got = {r["node"]: r["label"] for r in C.super_merge(edges, labels, work.save).collect()}
    assert got == {c + k: {0: 0, 10: 0, 20: 20}[c] for c in (0, 10, 20) for k in range(4)}
    # two strong edges are too few, whatever their weight
    few = spark.createDataFrame(inside + strong[:2], "i long, j long, score double")
    assert {r["label"] for r in C.super_merge(few, labels, lambda df, n: work.save(df, f"few-{n}")).collect()} == {0, 10, 20}


def test_a_pair_unites_and_fusion_keeps_cliques(spark, work):
    pair = spark.createDataFrame([(x, x + 1, 0.9) for x in range(0, 40, 2)], "i long, j long, score double")
    got = {r["node"]: r["label"] for r in C.propagate(pair, work.save, "tail").collect()}
    assert all(got[x] == got[x + 1] == x for x in range(0, 40, 2))
    e = spark.createDataFrame([(a, b, 0.9) for c in (0, 10) for a in range(c, c + 5) for b in range(a + 1, c + 5)], "i long, j long, score double")
    lab = {r["node"]: r["label"] for r in C.fused(e, lambda df, n: work.save(df, f"f-{n}")).collect()}
    assert len(set(lab.values())) == 2 and len({lab[x] for x in range(5)}) == 1


def test_trajectories_equal_a_plain_loop_and_cut_edges(spark):
    rng = np.random.default_rng(11)
    rows = [(c, p, s, "A", "CG"[int(rng.integers(2))], int(rng.integers(1, 20)), int(rng.integers(20, 60))) for c in range(4) for p in range(6) for s in range(5) if rng.random() < 0.8]
    rows.append((9, 0, 0, "A", "C", 3, 20))  # one sample says nothing
    sites = spark.createDataFrame(rows, "contig long, pos int, sample int, major string, alt string, alt_count int, total int")
    got = {r["contig"]: (np.array(r["v"]), r["sites"]) for r in T.contig_trajectories(sites, 5).collect()}
    want = {}
    for c in range(4):
        dirs = []
        for p in range(6):
            r = sorted(x for x in rows if x[0] == c and x[1] == p)
            if len(r) < 2:
                continue
            canon = max(r, key=lambda x: (x[6], -x[2]))[4]
            f = {x[2]: (x[5] / x[6] if x[4] == canon else 1 - x[5] / x[6] if x[3] == canon else 0.0) for x in r}
            v = np.array([f.get(k, np.mean(list(f.values()))) for k in range(5)])
            v = v - v.mean()
            if v @ v >= 1e-9:
                dirs.append(v / np.linalg.norm(v))
        s = sum(d if d @ dirs[0] >= 0 else -d for d in dirs)
        want[c] = (s / np.linalg.norm(s), len(dirs))
    assert got.keys() == want.keys()
    assert all(np.allclose(got[c][0], want[c][0]) and got[c][1] == want[c][1] for c in want)
    t = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.05])], "contig long, v array<double>")
    edges = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.9), (1, 4, 0.9)], "i long, j long, score double")
    assert {(r["i"], r["j"]) for r in G.trajectory_gate(edges, t).collect()} == {(1, 3), (1, 4)}


def test_runs_share_their_jobs(spark, work, two_groups):
    """The number of Spark jobs doesn't hang on the number of runs, and each run is as if alone."""
    pairs, prof = two_groups
    base = U.Setting(0.5, 1.0, 0.7)
    order = C.colours(pairs.select("i", "j"), work.save, 24)
    sc, jobs, got = spark.sparkContext, {}, {}
    for name, settings in {"one": [base], "many": [base] * 5, "mixed": U.perturbations(base)[:3]}.items():
        sc.setJobGroup(name, name)
        runs = U.perturbed_runs(pairs, prof, 0, base, work, settings=settings, order=order).collect()
        jobs[name] = len(sc.statusTracker().getJobIdsForGroup(name))
        got[name] = {(r["run"], r["seq"]): r["label"] for r in runs}
    sc.setJobGroup("", "")
    assert jobs["many"] <= 1.2 * jobs["one"]  # adaptive execution starts a job more or less
    assert all(got["many"][r, x] == label for (_, x), label in got["one"].items() for r in range(5))
    alone = U.perturbed_runs(pairs, prof, 0, base, work, settings=U.perturbations(base)[1:2], order=order).collect()
    assert {r["seq"]: r["label"] for r in alone} == {x: label for (run, x), label in got["mixed"].items() if run == 1}
