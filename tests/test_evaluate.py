from pyspark.sql import functions as F

from strandloom.operators import evaluate as E


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def test_equal_shares_go_to_the_genome_seen_first(spark):
    gold = spark.createDataFrame([(1, "g1", 50), (2, "g2", 50)], "seq long, genome string, length long")
    pred = spark.createDataFrame([(1, "b"), (2, "b")], "seq long, bin string")
    r = E.amber_per_bin(gold, pred).first()
    assert (r["genome"], r["purity"], r["completeness"]) == ("g1", 0.5, 1.0)


def test_limits_are_strict_and_classes_cumulative(spark):
    per = spark.createDataFrame([(0.90, 0.96), (0.95, 0.96), (0.6, 0.95)], "completeness double, purity double").withColumn("tp_length", F.lit(1)).withColumn("total_length", F.lit(1))
    r = E.amber_tiers(per).first()
    assert (r["hq"], r["mq"], r["lq"]) == (1, 2, 3)


def test_first_of_repeated_sequences_counts_and_absent_ones_are_told(spark):
    gold = spark.createDataFrame([(1, "g", 10)], "seq long, genome string, length long")
    raw = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (9, "b", 2)], "seq long, bin string, ord long")
    pred = E.first_wins(raw, "seq", "ord", "bin")
    assert {(r["seq"], r["bin"]) for r in pred.collect()} == {(1, "a"), (9, "b")}
    assert [r["seq"] for r in E.unmatched(gold, pred).collect()] == [9]
    assert E.amber_per_bin(gold, pred).count() == 1


def test_completeness_counts_genomes_that_nothing_found(spark):
    gold = spark.createDataFrame([(1, "g", 10), (2, "h", 10)], "seq long, genome string, length long")
    pred = spark.createDataFrame([(1, "a")], "seq long, bin string")
    assert E.amber_completeness(gold, pred).first()["avg_completeness"] == 0.5


def test_markers_are_a_bag(spark):
    pred = spark.createDataFrame([(1, "b"), (2, "b"), (3, "c")], "seq long, bin string")
    hits = spark.createDataFrame([(1, "m1"), (1, "m1"), (2, "m2")], "seq long, marker string")
    r = rows(E.qc_per_bin(hits, pred, 4), "bin")
    assert (r[("b",)]["completeness"], r[("b",)]["contamination"], r[("b",)]["tier"]) == (50.0, 25.0, "LQ")
    assert r[("c",)]["tier"] == "-"


def test_tier_edges(spark):
    df = spark.createDataFrame([(50.0, 9.99), (90.0, 0.0), (90.1, 4.9), (49.9, 0.0)], "c double, x double")
    assert [r["t"] for r in df.select(E.tier(F.col("c"), F.col("x"), F.lit(True)).alias("t")).collect()] == ["MQ", "MQ", "HQ", "LQ"]


def test_upper_median(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)], "k string, v double")
    assert E.upper_median_by(df, ["k"], "v", "m").first()["m"] == 3.0
    assert df.groupBy("k").agg(E.upper_median("v").alias("m")).first()["m"] == 3.0


def test_refine_takes_the_best_first_and_ties_by_name(spark, work):
    m = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 4)], "cand string, seq long")
    hits = spark.createDataFrame([(1, "m1"), (2, "m2"), (3, "m1"), (4, "m1")], "seq long, marker string")
    out = {(r["cand"], r["seq"]) for r in E.refine_consensus(m, hits, 2, 50.0, 10.0, 5.0, work).collect()}
    # a and b tie at 100: a wins; b is left with contig 3, which is enough for half of the set
    assert out == {("a", 1), ("a", 2), ("b", 3), ("c", 4)}


def test_ensemble_needs_half_of_a_candidate_to_be_free(spark):
    m = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("c", 2), ("c", 4)], "cand string, seq long")
    hits = spark.createDataFrame([(1, "m1"), (2, "m2"), (4, "m1")], "seq long, marker string")
    out = {(r["cand"], r["seq"]) for r in E.ensemble_consensus(m, hits, 2).collect()}
    assert out == {("a", 1), ("a", 2), ("c", 4)}


def test_certify(spark):
    ref = spark.createDataFrame([(1, "b"), (2, "b"), (3, "b")], "seq long, bin string")
    runs = spark.createDataFrame([(r, s, "x" if s < 3 or r == 0 else "y") for r in range(4) for s in (1, 2, 3)], "run int, seq long, label string")
    contigs = spark.createDataFrame([(1, 100), (2, 100), (3, 10)], "seq long, length long")
    each, bins = E.certify(ref, runs, contigs)
    assert {r["seq"]: (r["prob"], r["state"]) for r in each.collect()} == {1: (1.0, "core"), 2: (1.0, "core"), 3: (0.25, "ambiguous")}
    assert bins.first()["certified"]


def greedy(members, hits, g, least, most, penalty):
    """The consensus by its words: best first, contigs gone everywhere, scores anew."""
    left, out = {}, set()
    for c, x in members:
        left.setdefault(c, set()).add(x)
    while True:
        best = None
        for c, seqs in left.items():
            ms = [m for s, m in hits if s in seqs]
            comp, cont = 100.0 * len(set(ms)) / g, 100.0 * (len(ms) - len(set(ms))) / g
            if comp >= least and cont <= most and (best is None or (-(comp - penalty * cont), c) < best):
                best = (-(comp - penalty * cont), c)
        if best is None:
            return out
        took = left.pop(best[1])
        out |= {(best[1], x) for x in took}
        for seqs in left.values():
            seqs -= took


def test_refine_scores_again_after_each_pick(spark, work):
    """Taking the best alone raises nothing above Y, which overlaps both; taking B and X together would lose it."""
    b = [("B", i) for i in range(1, 10)]
    y = [("Y", i) for i in (1, 2, 11, 12, 13, 14, 15, 16, 17, 18)]
    x = [("X", i) for i in range(11, 18)]
    hits = [(i, f"m{i}") for i in range(1, 10)] + [(10 + i, f"m{i}") for i in range(1, 9)]
    m = spark.createDataFrame(b + y + x, "cand string, seq long")
    h = spark.createDataFrame(hits, "seq long, marker string")
    for rows in (0, 10**6):
        got = {(r["cand"], r["seq"]) for r in E.refine_consensus(m, h, 10, 50.0, 30.0, 1.0, work, rows).collect()}
        assert got == greedy(b + y + x, hits, 10, 50.0, 30.0, 1.0) and {c for c, _ in got} == {"B", "Y"}


def test_refine_by_brute_force(spark):
    import random

    from strandloom.workspace import Workspace

    for seed in range(6):
        r = random.Random(seed)
        n = 60
        members = sorted({(f"c{r.randrange(12):02d}", r.randrange(n)) for _ in range(170)})
        hits = [(x, f"m{r.randrange(10)}") for x in range(n) for _ in range(r.randrange(3))]
        want = greedy(members, hits, 10, 30.0, 60.0, 0.7)
        m, h = spark.createDataFrame(members, "cand string, seq long"), spark.createDataFrame(hits, "seq long, marker string")
        for rows in (0, 40, 10**6)[seed % 3 :][:2]:
            got = E.refine_consensus(m, h, 10, 30.0, 60.0, 0.7, Workspace(spark, "refine"), rows)
            assert {(x["cand"], x["seq"]) for x in got.collect()} == want


def test_refine_ends_where_nothing_is_good_enough(spark, work):
    """A large component of contaminated candidates is done at once, and so is what a pick leaves of one."""
    m = [(c, i) for c in ("a", "b") for i in range(20)] + [("c", 19), ("c", 30), ("c", 31)]
    hits = [(i, f"m{i % 4}") for i in range(20)] + [(30, "m0"), (31, "m1")]
    for members in (m[:40], m):
        members_df, h = spark.createDataFrame(members, "cand string, seq long"), spark.createDataFrame(hits, "seq long, marker string")
        saved, save = [], work.save
        def bounded(df, name, *rest):
            saved.append(name)
            assert len(saved) < 60, "rounds without a pick"
            return save(df, name, *rest)
        work.save = bounded
        got = {(r["cand"], r["seq"]) for r in E.refine_consensus(members_df, h, 10, 20.0, 50.0, 1.0, work, 10).collect()}
        work.save = save
        assert got == greedy(members, hits, 10, 20.0, 50.0, 1.0) and len(got) == (0 if len(members) == 40 else 3)


def test_ensemble_by_brute_force(spark):
    import random

    for seed in range(3):
        r = random.Random(seed)
        members = sorted({(f"c{r.randrange(15):02d}", r.randrange(60)) for _ in range(150)})
        hits = [(x, f"m{r.randrange(10)}") for x in range(60) for _ in range(r.randrange(3))]
        of = {}
        for c, x in members:
            of.setdefault(c, set()).add(x)
        score = {}
        for c, seqs in of.items():
            ms = [m for s, m in hits if s in seqs]
            if len(seqs) >= 2 and 10 * len(set(ms)) >= 30:
                score[c] = 10.0 * len(set(ms)) - 0.5 * 10.0 * (len(ms) - len(set(ms)))
        taken, want = set(), set()
        for c in sorted(score, key=lambda c: (-score[c], c)):
            own = of[c] - taken
            if own and len(own) >= 0.5 * len(of[c]):
                taken |= own
                want |= {(c, x) for x in own}
        m, h = spark.createDataFrame(members, "cand string, seq long"), spark.createDataFrame(hits, "seq long, marker string")
        assert {(x["cand"], x["seq"]) for x in E.ensemble_consensus(m, h, 10, 30.0, 0.5, 0.5, task_rows=(10**6, 0, 10)[seed]).collect()} == want


def test_high_quality_and_the_size_of_the_marker_set(spark):
    per = spark.createDataFrame([("a", 90.0, 0.0), ("b", 90.1, 4.9), ("c", 99.0, 5.0)], "bin string, completeness double, contamination double")
    assert [r["bin"] for r in E.high_quality(per).collect()] == ["b"]
    hits = spark.createDataFrame([(1, "m1"), (2, "m1"), (2, "m2")], "seq long, marker string")
    assert (E.marker_set_size(hits, 7, 5), E.marker_set_size(hits, None, 5), E.marker_set_size(hits)) == (7, 5, 2)


def test_the_first_candidate_of_each_contig_is_found_in_tasks_of_bounded_size(spark, work):
    from pyspark.sql import functions as F

    rows = [(x * 13 % 70, f"c{x * 7 % 11}", float(x % 5)) for x in range(700)]
    best = {}
    for q, c, s in rows:
        best[q] = min(best.get(q, (1.0, "")), (-s, c))
    df = work.save(spark.createDataFrame(rows + [(None, "c0", 9.0)], "seq long, cand string, score double").coalesce(1), "rows")
    got = E.first_at_each(df, F.struct(-F.col("score"), "cand"), "best", deal=100)
    assert got.rdd.getNumPartitions() == 8
    assert sorted((r["seq"], *r["best"]) for r in got.collect()) == sorted((q, *best[q]) for q, _, _ in rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not {"Sort", "SortAggregate", "HashAggregate"} & set(plan[plan.rindex("Exchange") :].split())  # nothing is held where a whole file is read


def test_when_a_candidate_comes_first_is_told_row_by_row():
    """Rows come sorted, in batches of any size: a candidate that goes on in the next one is told once, by all of its rows."""
    import random

    import pyarrow as pa

    r = random.Random(5)
    firsts = {f"f{k}": -r.uniform(10, 60) for k in range(4)}
    rows = sorted([(f"c{r.randrange(12):02d}", [f"m{r.randrange(8)}" for _ in range(r.randrange(3))], r.choice([None, *firsts])) for _ in range(150)], key=lambda x: x[0])
    want = []
    for c in sorted({x[0] for x in rows}):
        left = [x for x in rows if x[0] == c]
        order = [None, *sorted((at, f) for f, at in firsts.items() if any(x[2] == f for x in left))]
        for i, last in enumerate(order):
            left = [x for x in left if last is None or x[2] != last[1]]
            ms = [m for x in left for m in x[1]]
            comp, cont = 10.0 * len(set(ms)), 10.0 * (len(ms) - len(set(ms)))
            then = max((-(comp - cont), c), last or (-1e9, ""))
            if comp >= 30 and cont <= 60 and (i + 1 == len(order) or then < order[i + 1]):
                want.append((7, *then))
                break
    assert len(want) > 6
    table = pa.table({"root": [7] * 150, "cand": [x[0] for x in rows], "markers": [x[1] for x in rows], "first": [x[2] for x in rows], "first_at": [firsts.get(x[2]) for x in rows]})
    for size in (150, 40, 1):
        got = [b.to_pylist() for b in E._overtaken(10, 30.0, 60.0, 1.0)(iter(table.to_batches(max_chunksize=size)))]
        assert [(x["root"], x["at"], x["name"]) for b in got for x in b] == want
