import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import cluster as C
from strandloom.operators import graph as G
from strandloom.operators import pairs as P
from strandloom.operators import refine as R
from strandloom.operators.components import connected


def test_tiles_give_every_pair_once_whatever_the_block(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(37, 5))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(37)], "id long, v array<double>")
    for block in (5, 1000):
        got = {(r["i"], r["j"]): r["sim"] for r in P.all_pairs(df, P.dot_kernel, ["v"], block=block).collect()}
        assert len(got) == 37 * 36 // 2
        assert all(abs(s - x[i] @ x[j]) < 1e-9 for (i, j), s in got.items())
    near = P.top_k(P.all_pairs(df, P.dot_kernel, ["v"], None, 3, 5), 3)
    for i in range(37):
        want = sorted((-(x[i] @ x[j]), j) for j in range(37) if j != i)[:3]
        assert [r["dst"] for r in near.filter(F.col("src") == i).orderBy("rank").collect()] == [j for _, j in want]


def test_one_sided_neighbours_make_no_edge(spark):
    near = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9), (1, 3, 0.8)], "src long, dst long, sim double")
    assert [(r["i"], r["j"]) for r in P.mutual(near).collect()] == [(1, 2)]


def test_postings_over_the_cap_are_left_out(spark):
    k = spark.createDataFrame([(i, "hot") for i in range(5)] + [(1, "x"), (2, "x")], "id long, key string")
    assert [(r["i"], r["j"]) for r in P.shared_keys(k, 1, 4).collect()] == [(1, 2)]


def test_upper_median_of_a_table(spark):
    for n in (1, 4, 7, 100):
        df = spark.createDataFrame([(float(i % 7),) for i in range(n)], "v double")
        assert G.upper_median(df, "v").first()["v"] == sorted(i % 7 for i in range(n))[n // 2]


@pytest.fixture
def cliques(spark):
    e = [(a, b, 0.9) for c in (0, 10) for a in range(c, c + 5) for b in range(a + 1, c + 5)]
    return spark.createDataFrame(e, "i long, j long, score double")


@pytest.mark.parametrize("kind", ["tail", "logsum", "fisher", "sum"])
def test_two_cliques_two_labels_and_a_fixed_point(spark, cliques, work, kind):
    lab = C.propagate(cliques, work.save, kind)
    by = {r["node"]: r["label"] for r in lab.collect()}
    assert len(set(by.values())) == 2 and len({by[x] for x in range(5)}) == 1
    again = C.propagate(cliques, lambda df, n: work.save(df, f"again-{n}"), kind, start=lab)
    assert {r["node"]: r["label"] for r in again.collect()} == by


def test_swapping_pairs_end(spark, work):
    e = spark.createDataFrame([(1, 2, 0.9)], "i long, j long, score double")
    assert C.propagate(e, work.save, "tail", 20).count() == 2


def test_modularity_moves_find_cliques(spark, cliques, work):
    bridged = cliques.unionByName(spark.createDataFrame([(0, 10, 0.1)], "i long, j long, score double"))
    by = {r["node"]: r["label"] for r in C.modularity_moves(bridged, work.save).collect()}
    assert len(set(by.values())) == 2


def test_confidence_is_full_without_a_rival(spark, cliques):
    lab = spark.createDataFrame([(x, 0 if x < 5 else 1) for x in (*range(5), *range(10, 15))], "node long, label long")
    assert all(r["second_label"] is None and r["confidence"] > 0.95 for r in C.node_confidence(cliques, lab).collect())


def test_components_by_brute_force(spark, work):
    rng = np.random.default_rng(3)
    e = {(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))}
    up = list(range(300))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in e:
        ra, rb = find(a), find(b)
        up[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(sorted(e), "a long, b long"), work).collect()}
    assert all(find(x) == r for x, r in got.items())
    assert {x for p in e if p[0] != p[1] for x in p if find(x) != x} == set(got)


def test_gfa_paths_skip_unknown_segments(spark):
    links = spark.createDataFrame([(1, 1), (1, 9)], "a long, b long")
    paths = spark.createDataFrame([("p", 0, 1), ("p", 1, 9), ("p", 2, 2), ("p", 3, 2)], "path string, pos int, seg long")
    known = spark.createDataFrame([(1,), (2,)], "seq long")
    assert [(r["i"], r["j"]) for r in G.gfa_links(links, paths, known).collect()] == [(1, 2)]


def test_mixture_cut_is_between_the_modes(spark):
    rng = np.random.default_rng(4)
    v = np.r_[rng.normal(0.2, 0.05, 500), rng.normal(0.8, 0.05, 500)].clip(0.01, 0.99)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    assert 0.35 < G.mixture_cut(df, "v") < 0.65
    assert 0.3 < G.otsu(df, "v").first()["cut"] < 0.7


def test_kmeans_split_by_abundance(spark):
    rng = np.random.default_rng(5)
    rows = [(1, i, 1000, (rng.normal(1 if i < 10 else 4, 0.05, 3)).tolist()) for i in range(20)] + [(2, 100 + i, 1000, rng.normal(2, 0.05, 3).tolist()) for i in range(4)]
    out = R.abundance_split(spark.createDataFrame(rows, "bin long, seq long, length long, y array<double>"), 2000)
    assert {(r["bin"], r["piece"]): r["n"] for r in out.groupBy("bin", "piece").agg(F.count("*").alias("n")).collect()} in ({(1, 0): 10, (1, 1): 10, (2, 0): 4},)


def test_ambiguous_contigs_are_not_recruited(spark):
    model = spark.createDataFrame([(0, 0.01, 0.0), (1, 0.01, 0.0)], "k int, a double, b double")
    bins = spark.createDataFrame([(b, k, 1000.0, 1000.0 * m) for b, m in ((1, 1.0), (2, 1.01), (3, 5.0)) for k in (0, 1)], "bin long, k int, w double, z double")
    cand = spark.createDataFrame([(1, 1000, [1.0, 1.0]), (2, 1000, [5.0, 5.0]), (3, 1000, [9.0, 9.0])], "seq long, length long, y array<double>")
    assert [(r["seq"], r["bin"]) for r in R.recruit_by_abundance(cand, bins, model, 2).collect()] == [(2, 3)]


def test_cores_never_meet(spark):
    sizes = spark.createDataFrame([(1, 500), (2, 500), (3, 10)], "bin long, total_length long")
    stats = spark.createDataFrame([(b, 0, 100.0, 100.0) for b in (1, 2, 3)], "bin long, k int, w double, z double")
    cand = spark.createDataFrame([(1, 3, 1, 0.0), (2, 3, 1, 0.0)], "a long, b long, links long, t2 double")
    out = {r["bin"]: r["root"] for r in R.merge_bins(cand, stats, sizes, 100, 3.8).collect()}
    assert out == {1: 1, 3: 1, 2: 2}


def test_youden_takes_the_highest_of_equals(spark):
    df = spark.createDataFrame([(3.0, True), (2.0, True), (2.0, False), (1.0, True), (0.0, False)], "value double, positive boolean")
    r = R.youden_boundary(df).first()
    assert r["boundary"] == 1.0 and r["tpr"] == 1.0 and r["fpr"] == 0.5


def test_sketch_similarity_queries_keep_pairs_from_a_half(spark, write_tables):
    from strandloom.operators import pairs
    from strandloom.plans import features

    base = [f"w{(k * k * 31 + k * 7) % 997:03d}".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(300)]
    other = str.maketrans("abcdefghijw", "aaaaaccccca")
    texts = [" ".join(base[9 * i :] + [x.translate(other) for x in base[: 9 * i]]) for i in range(30)]
    d = write_tables(documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for name, sketches in (("pmh_sketch_similarity", features._sketches(spark, d)), ("oph_sketch_similarity", features.S.bucket_sketch(features.dna(spark, d)))):
        every = {(r["i"], r["j"]): r["sim"] for r in pairs.all_pairs(sketches, pairs.match_kernel, ["sketch"]).collect()}
        assert any(0.5 <= x < 0.75 for x in every.values())
        assert {(r["i"], r["j"]) for r in features.QUERIES[name](spark, d).collect()} == {p for p, x in every.items() if x >= 0.5}


def test_sketch_candidates_are_all_pairs_that_share_half_the_registers(spark, write_tables):
    from strandloom.operators import pairs
    from strandloom.plans import features

    base = [f"w{(k * k * 31 + k * 7) % 997:03d}".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(300)]
    texts = [" ".join(base[: 300 - 25 * i] + [x[::-1] for x in base[: 25 * i]]) for i in (0, 1, 2, 4, 6, 8, 8, 8)]
    d = write_tables(documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    every = pairs.all_pairs(features._sketches(spark, d), pairs.match_kernel, ["sketch"]).collect()
    want = {(r["i"], r["j"], round(500 * r["sim"])) for r in every if r["sim"] >= 0.5}
    assert {(5, 6, 500), (6, 7, 500)} < want
    assert {tuple(r) for r in features.QUERIES["sketch_candidates"](spark, d).select("i", "j", "shared").collect()} == want


def test_postings_up_to_an_eighth_of_the_rows_are_searched(spark, write_tables):
    from strandloom.plans import features

    rows = [(1, s, p) for s in range(290) for p in (1, 2)] + [(1, s, 10 + s) for s in range(290, 2400)]
    d = write_tables(lineitem=spark.createDataFrame(rows, "l_linenumber int, l_suppkey long, l_partkey long"))
    assert features.QUERIES["invidx_candidates"](spark, d).count() == 290 * 289 // 2


def greedy_colours(spark, edges):
    """The plain loop: nodes in the order of the hash, each with the smallest colour that no neighbour has yet."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    h = {r["n"]: r["h"] for r in spark.createDataFrame([(n,) for n in near], "n long").withColumn("h", F.xxhash64("n")).collect()}
    got = {}
    for n in sorted(near, key=lambda n: (h[n], n)):
        got[n] = next(c for c in range(len(near)) if c not in {got.get(x) for x in near[n]})
    return near, got


def plain_propagation(near, colour, weight, start, max_rounds=60):
    """One node after another, colour by colour; a node counts the evidence -ln(1 - w) of its neighbours' labels as they are then."""
    label = dict(start)
    fewest, since = 10**9, 0
    for _ in range(max_rounds):
        moved = 0
        for n in sorted(near, key=lambda n: colour[n]):
            ev = {}
            for x in near[n]:
                w = weight.get((min(n, x), max(n, x)))
                if w is not None:
                    ev[label[x]] = ev.get(label[x], 0.0) - math.log(1 - w)
            if ev and ev.get(label[n], -1) < max(ev.values()) - 1e-12:
                label[n] = min(ev, key=lambda k: (-ev[k], k))
                moved += 1
        fewest, since = (moved, 0) if moved < fewest else (fewest, since + 1)
        if not moved or since == 3:
            break
    seen = {n for e in weight for n in e}
    name = {}
    for n in seen:
        name[label[n]] = min(n, name.get(label[n], n))
    return {n: name[label[n]] for n in seen}


def random_graph(seed, n=60, degree=3):
    rng = np.random.default_rng(seed)
    e = {(int(min(a, b)), int(max(a, b))): float(np.round(rng.uniform(0.3, 0.99), 6)) for a, b in rng.integers(0, n, (n * degree // 2, 2)) if a != b}
    return e


def test_colours_equal_a_greedy_loop(spark, work):
    e = random_graph(1)
    got, proper = C.colours(spark.createDataFrame(list(e), "i long, j long"), work.save, most=20)
    assert proper and {r["node"]: r["colour"] for r in got.collect()} == greedy_colours(spark, e)[1]
    clique = [(a, b) for a in range(12) for b in range(a + 1, 12)]
    got, proper = C.colours(spark.createDataFrame(clique, "i long, j long"), lambda df, n: work.save(df, f"clique-{n}"), most=4)
    assert not proper and {r["colour"] for r in got.collect()} <= set(range(4))


def test_propagation_equals_a_sequential_loop_and_runs_don_t_meddle(spark, work):
    """Several graphs at once, each as if alone, each as a plain loop in the order of the colours."""
    runs = {r: random_graph(r, degree=4) for r in range(4)}
    runs[4] = {k: w for k, w in list(runs[0].items())[::2]}
    edges = spark.createDataFrame([(r, *k, w) for r, e in runs.items() for k, w in e.items()], "run int, i long, j long, score double")
    near, colour = greedy_colours(spark, {k for e in runs.values() for k in e})
    order = C.colours(edges.select("i", "j").distinct(), work.save, 24)
    assert order[1] and {r["node"]: r["colour"] for r in order[0].collect()} == colour
    got = {}
    for r in C.propagate_runs(edges, work.save, "logsum", order=order).collect():
        got.setdefault(r["run"], {})[r["node"]] = r["label"]
    for r, e in runs.items():
        assert got[r] == plain_propagation(near, colour, e, {n: n for n in near})
    alone = C.propagate_runs(edges.filter("run = 2"), lambda df, n: work.save(df, f"alone-{n}"), "logsum", order=order)
    assert {r["node"]: r["label"] for r in alone.collect()} == got[2]


def test_folded_colours_still_end(spark, work):
    """Cliques of more nodes than colours: neighbours of a turn don't swap labels."""
    e = [(a, b, 0.9) for c in (0, 50) for a in range(c, c + 30) for b in range(a + 1, c + 30)] + [(3, 53, 0.5)]
    got = {r["node"]: r["label"] for r in C.propagate(spark.createDataFrame(e, "i long, j long, score double"), work.save, "tail", 40).collect()}
    assert {got[x] for x in range(30)} == {0} and {got[x] for x in range(50, 80)} == {50}
