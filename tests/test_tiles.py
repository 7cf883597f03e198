import numpy as np
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.operators import graph as G
from strandloom.operators import pairs as P
from strandloom.operators import refine as R
from strandloom.plans import features


def test_nearest_of_copies_go_to_the_smaller_id_and_a_tile_sends_k_rows_each(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(40, 16)), 6, axis=0)[rng.permutation(240)].astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    want = {}
    for i in range(240):
        sims = [(sum(a * b for a, b in zip(x[i].tolist(), x[j].tolist())), j) for j in range(240) if j != i]
        want[i] = [j for s, j in sorted(((-s, j) for s, j in sims if s >= 0.2))[:7]]
    got = {}
    for r in sorted(P.nearest(df, P.dot_kernel, ["v"], 0.2, 7, block=90).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["src"], []).append(r["dst"])
    assert got == {i: js for i, js in want.items() if js}
    for block, tiles in ((90, 3), (1000, 1)):  # each row is in as many tiles as there are blocks
        assert P.tiles(df, ["v"], P._best(P.dot_kernel, None, 7), "src long, dst long, sim double", block).count() == 240 * 7 * tiles


def test_strips_of_a_tile_give_what_the_whole_gives(monkeypatch):
    rng = np.random.default_rng(4)
    a, b = rng.integers(-3, 4, size=(2, 150, 4)).astype(float)
    ia, ib = np.arange(150), np.arange(150) + 150

    def best():
        return [[d[c].tolist() for c in ("src", "dst", "sim")] for d in P._best(P.dot_kernel, None, 5)(ia, [a], ib, [b], False)]

    whole = best()
    monkeypatch.setattr(P, "STRIP", 200)
    assert best() == whole
    for i, s in enumerate(a @ b.T):
        assert whole[0][1][5 * i : 5 * i + 5] == [150 + j for j in np.lexsort((np.arange(150), -s))[:5]]


def test_the_median_of_pairs_needs_no_list_of_them(spark):
    rng = np.random.default_rng(5)
    for spread in (1.0, 1e-7, 0.0):  # wide, all in one bin of the first histogram, all equal
        x = 1 + spread * rng.random((61, 4))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
        sims = sorted(np.minimum(x[i], x[j]).sum() / np.maximum(x[i], x[j]).sum() for i in range(61) for j in range(i))
        counted, at = P.value_counts_at(df, P.min_max_kernel, ["v"], bins=64, enough=50, block=25)
        assert abs(G.value_at(counted, "sim", at).first()["sim"] - sims[len(sims) // 2]) < 1e-12
        assert counted.agg({"n": "sum"}).first()[0] <= (50 if spread else len(sims))


def test_scores_of_tiles_are_those_of_joined_profiles(spark):
    rng = np.random.default_rng(6)
    long = [(i, f"s{k}", float(v)) for i in range(40) for k, v in enumerate(rng.integers(0, 3, size=6) * (i % 4 > 0))]
    prof = G.profiles(spark.createDataFrame(long, "seq long, sample string, depth double")).withColumn("id", F.col("seq")).cache()
    geomean = lambda corr, a, b: np.sqrt(np.maximum(corr, 0.0) * np.clip(P.min_max_kernel(a, b), 0.0, 1.0))
    got = P.all_pairs(prof, P.depth_kernel(geomean), ["unit", "depth", "scaled"], 0.0, block=15)
    want = G.edge_scores(P.all_pairs(prof, P.dot_kernel, ["unit"]), prof, 6, 0.0, "geomean", 0.0)
    got, want = ({(r[0], r[1]): r[2] for r in df.collect()} for df in (got, want))
    assert len(want) > 100 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_scored_pairs_meet_their_profiles_in_the_tile(spark, write_tables):
    """No pair is shuffled to be joined with what its ends are."""
    rows = [(s, f, n, float(q)) for s in range(8) for f, n, q in (("A", "F", s + 1), ("N", "O", 3), ("R", "F", 9 - s))]
    d = write_tables(
        lineitem=spark.createDataFrame(rows, "l_suppkey long, l_returnflag string, l_linestatus string, l_quantity double"),
        embeddings=spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(8)], "vec_id long, embedding array<float>, label int"),
    )
    for query in (features._fuse, features._scored):
        plan = query(spark, d)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan[: plan.index("MapInArrow")]


def test_silhouette_by_sums_of_tiles(spark):
    rng = np.random.default_rng(7)
    x, label = rng.normal(size=(50, 3)), rng.integers(0, 4, size=50)
    rows = [(i, int(label[i]) if i % 10 else None, x[i].tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, label long, v array<double>")
    known = [i for i in range(50) if i % 10]
    each = []
    for i in known:
        mean = {c: np.mean([np.linalg.norm(x[i] - x[j]) for j in known if j != i and label[j] == c]) for c in {label[j] for j in known if j != i}}
        own = mean.pop(label[i])
        each.append((min(mean.values()) - own) / max(own, min(mean.values())))
    assert abs(R.silhouette_of_labels(df).first()[0] - np.mean(each)) < 1e-9
    for block, tiles in ((20, 3), (100, 1)):  # a tile sends at most a row per row and label
        assert P.tiles(df, ["v", "label"], R._distance_sums, "id long, lb long, total double, n long", block).count() <= 45 * 4 * tiles


def test_registers_are_compared_as_small_codes():
    rng = np.random.default_rng(8)
    for values, kind in ((np.arange(136), np.uint8), (rng.integers(0, 1 << 62, size=30), np.uint8), (np.arange(50_000), np.uint16)):
        a, b = (rng.choice(values, size=(n, 600)) for n in (70, 90))
        a[:40], a[3], b[5], b[7, :9] = b[:40], -1, -1, -1
        want = ((a[:, None, :] == b[None, :, :]) & (a[:, None, :] >= 0)).sum(axis=2) / 600
        assert {x.dtype for x in P._coded(a, b)} == {np.dtype(kind)}
        assert (P.match_kernel([a], [b]) == want).all()
        assert (np.concatenate([s for _, s in P.strips(P.match_kernel, [a], [b], 1000)]) == want).all()


def test_planes_of_many_words_are_counted_whole():
    rng = np.random.default_rng(9)
    for bits, registers in ((1, 64), (2, 500), (3, 1000)):
        words = -(-registers // 64)
        a, b = (rng.integers(-(1 << 62), 1 << 62, size=(n, bits * words)) for n in (12, 15))
        b[:5] = a[:5]
        b[6] = ~a[6]
        apart = a.reshape(12, 1, bits, words) ^ b.reshape(1, 15, bits, words)
        differ = np.bitwise_count(np.bitwise_or.reduce(apart, axis=2).view(np.uint64)).astype(int).sum(axis=2)
        want = np.maximum((1 - differ / registers - 2.0**-bits) / (1 - 2.0**-bits), 0.0)
        assert np.allclose(S.planes_kernel(registers, bits)([a], [b]), want, atol=1e-12)


def test_pairs_of_shared_keys_are_counted_in_tasks_of_bounded_size(spark):
    rng = np.random.default_rng(10)
    rows = sorted({(int(i), int(k)) for i, k in zip(rng.integers(0, 60, 700), rng.integers(0, 25, 700) ** 2 // 25)})
    keyed = spark.createDataFrame(rows, "id long, key long")
    of = {}
    for i, k in rows:
        of.setdefault(k, []).append(i)
    for cap in (None, 30):
        want, meetings = {}, 0
        for ids in of.values():
            if cap is None or len(ids) <= cap:
                meetings += len(ids) * (len(ids) - 1) // 2
                for x in ids:
                    for y in ids:
                        if x < y:
                            want[x, y] = want.get((x, y), 0) + 1
        got = P.shared_keys(keyed, 2, cap, task_pairs=100, chunk=7)
        assert {(r["i"], r["j"]): r["shared"] for r in got.collect()} == {p: n for p, n in want.items() if n >= 2}
        assert got.rdd.getNumPartitions() == -(-meetings // 100)


def test_bands_are_counted_in_tiles_as_their_keys_are(spark):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 4, size=(6, 100))
    x = base[rng.integers(0, 6, size=130)]
    x = np.where(rng.random(x.shape) < 0.1, 9, x)
    x[17] = -1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, sketch array<int>")
    for cap in (None, 15):
        want = {tuple(r) for r in P.shared_keys(P.band_keys(df, 5, 100), 2, cap).collect()}
        got = P.shared_bands(df, 2, 5, 100, cap, block=50)
        assert len(want) > 50 and {tuple(r) for r in got.collect()} == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert not {"Join", "Aggregate"} & set(plan[: plan.index("MapInArrow")].split())


def test_shared_registers_are_counted_in_tiles(spark, write_tables):
    """No register is a key that rows are joined by, and no pair is joined with the members of its ends."""
    d = write_tables(documents=spark.createDataFrame([(i, "some words about nothing " * (i + 1)) for i in range(6)], "doc_id long, text string"))
    plan = features.QUERIES["sketch_candidates"](spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")]


def test_registers_of_few_values_are_sent_in_few_bytes():
    rng = np.random.default_rng(12)
    hashes = rng.integers(0, 1 << 62, size=30_000)
    for values, each in ((np.arange(-1, 120), 1), (np.arange(-1, 136), 2), (np.arange(1 << 20), 4), (hashes, 3), (np.array([0.5, 0.25]), 4), (np.array([0.1, 0.2]), 8), (rng.integers(0, 1 << 62, size=1 << 18), 8)):
        x = rng.choice(values, size=300_000)
        data, kind = P._narrow(x)
        assert len(data) <= each * len(x) and (P._wide(data, kind, 1000) == x.reshape(1000, -1)).all()


def test_the_best_of_a_tile_are_exact_in_every_chunk_and_strip_and_few_are_held(monkeypatch):
    rng = np.random.default_rng(13)
    for scale, copies in ((1.0, 1), (1e-9, 1), (1e9, 1), (1.0, 30)):
        x = np.repeat(rng.normal(size=(600 // copies, 8)), copies, axis=0)[rng.permutation(600)].astype(np.float32) * scale
        x = x.astype(float)
        x[::50] *= 1e3  # a few long rows
        x[7, 2] = np.nan
        ids = rng.permutation(600)
        a, b, ia, ib = x[:280], x[280:], ids[:280], ids[280:]
        s = np.zeros((280, 320))
        for k in range(8):
            s += a[:, k, None] * b[None, :, k]
        s[7] = -np.inf
        held = []
        monkeypatch.setattr(P, "_dots", lambda *v, dots=P._dots: held.append(len(v[2])) or dots(*v))
        for chunk, strip, most in ((4096, 1 << 18, 1 << 21), (48, 40, 1 << 21), (100, 100, 900)):
            monkeypatch.setattr(P, "STRIP", strip)
            got = list(P._best(P.dot_kernel, None, 5, chunk, most)(ia, [a], ib, [b], False))
            for d, src, dst, sims in ((got[0], ia, ib, s), (got[1], ib, ia, s.T)):
                want = [(i, j, v) for row, i in zip(sims, src) for v, j in sorted(zip(-row, dst))[:5] if np.isfinite(v)]
                assert sorted(zip(d["src"], -d["sim"], d["dst"])) == sorted((i, v, j) for i, j, v in want)
        assert max(held[-20:]) <= 900 + 8 * 100  # the bound and a strip
        monkeypatch.undo()


def test_a_row_goes_to_no_more_tiles_as_the_table_grows():
    sent = [P.block_number(n, P.wide_block(64)) for n in (100_000, 600_000, 1_500_000)]
    assert sent == [24, 24, 24] and P.block_number(600_000) == 74
    assert P.wide_block(500) <= 8400 and P.wide_block(6) == P.WIDE_ROWS and P.wide_block(4096) == P.BLOCK


def test_all_pairs_of_copies_repeat_in_what_a_tile_gives_and_are_whole(spark, monkeypatch):
    rng = np.random.default_rng(14)
    x = np.repeat(rng.normal(size=(6, 4)), [1, 90, 1, 25, 12, 1], axis=0)[rng.permutation(130)]
    df = spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    for strip, block in ((1 << 18, 1000), (1 << 18, 30), (100, 50)):
        monkeypatch.setattr(P, "STRIP", strip)
        rows = P.all_pairs(df, P.dot_kernel, ["v"], block=block).collect()
        got = {(r["i"], r["j"]): r["sim"] for r in rows}
        assert len(rows) == len(got) == 130 * 129 // 2
        assert all(abs(got[7 * i, 7 * j] - x[i] @ x[j]) < 1e-12 for j in range(130) for i in range(j))
    # blocks of copies: similarities leave in runs, and a large group of copies is dealt to many blocks
    a, b = (np.repeat(rng.normal(size=(3, 4)), 20, axis=0) for _ in range(2))
    ia, ib = rng.permutation(120)[:60], np.arange(60) + 120
    for strip, runs in ((1 << 18, 9), (60 * 8, 27)):
        monkeypatch.setattr(P, "STRIP", strip)
        parts = list(P._whole(P.dot_kernel, None)(ia, [a], ib, [b], False))
        assert max(len(d["i"]) for d in parts) <= strip and sum(len(d["i"]) for d in parts) == 3600
        assert np.count_nonzero(np.diff(np.concatenate([d["sim"] for d in parts]))) == runs - 1
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4000)] + [(4000 + i, [2.0, float(i // 5)]) for i in range(4000)], "id long, v array<double>")
    dealt = P._dealt(same, ["v"], 8000, 8)
    sizes = dealt.groupBy("b").count().toPandas()
    assert len(sizes) == 8 and sizes["count"].max() < 2000
    assert dealt.filter("id >= 4000").groupBy("v").agg(F.count_distinct("b").alias("n")).filter("n > 1").count() == 0


def test_rounding_in_a_tile_is_that_of_the_queries(spark):
    rng = np.random.default_rng(15)
    x = np.concatenate([rng.normal(size=20_000), rng.integers(-(10**6), 10**6, 2000) / 1e6, [0.5e-6, -0.5e-6, -1e-9, 0.0, 2.5e-6, -1.5e-6, np.nan]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id int, x double")
    want = np.array([r["x"] for r in features.rounded(df, "x").orderBy("id").collect()])
    got = P._rounded(x, 6)
    assert np.array_equal(got, want, equal_nan=True) and not np.signbit(got[got == 0]).any()


def test_pairs_of_suppliers_are_rounded_in_the_tile(spark, write_tables):
    """Nothing is left to be done with each pair once it has left its tile."""
    rows = [(s, f, n, float(q)) for s in range(8) for f, n, q in (("A", "F", s + 1), ("N", "O", 3), ("R", "F", 9 - s))]
    d = write_tables(lineitem=spark.createDataFrame(rows, "l_suppkey long, l_returnflag string, l_linestatus string, l_quantity double"))
    for query in ("pearson_pairs", "weighted_jaccard_pairs", "spearman_pairs"):
        df = features.QUERIES[query](spark, d)
        assert "round" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert df.count() == 28


def test_no_row_of_a_small_block_is_its_own_neighbour():
    for n in (1, 2, 3, 6):
        ids, x = np.arange(n) + 10, np.arange(4.0 * n).reshape(n, 4) + 1
        (d,) = P._best(P.dot_kernel, None, 3)(ids, [x], ids, [x], True)
        assert (d["src"] != d["dst"]).all() and len(d["src"]) == n * min(3, n - 1)


def test_bands_that_many_rows_share_are_counted_whole(spark):
    """One more row than the cap of old."""
    df = spark.range(6001).select("id", F.array(F.lit(1), F.lit(2)).alias("sketch"))
    got = P.shared_bands(df, 1, rows=1, registers=2)
    assert tuple(got.agg(F.count(F.lit(1)), F.min("shared"), F.max("shared")).first()) == (6001 * 3000, 2, 2)


def test_pairs_are_counted_by_bins_and_none_is_made_a_row(spark, write_tables):
    rng = np.random.default_rng(16)
    x = np.repeat(rng.normal(size=(40, 4)), rng.integers(1, 9, size=40), axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    bin_of = lambda s: np.where(s > 0, np.minimum(np.floor(4 * s), 6), -1).astype(np.int64)
    i, j = np.triu_indices(len(x), 1)
    want = np.unique(bin_of((x[i] * x[j]).sum(axis=1)), return_counts=True)
    for block in (1000, 15):
        got = {r["bin"]: r["n"] for r in P.bin_counts(df, P.dot_kernel, ["v"], bin_of, 7, block).collect()}
        assert got == {int(b): int(n) for b, n in zip(*want) if b >= 0}
    rows = [(s, f, n, float(q)) for s in range(8) for f, n, q in (("A", "F", s // 2 + 1), ("N", "O", 3), ("R", "F", 9 - s // 2))]
    d = write_tables(lineitem=spark.createDataFrame(rows, "l_suppkey long, l_returnflag string, l_linestatus string, l_quantity double"))
    plan = features.QUERIES["otsu_cut"](spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert "bin#" in plan[plan.index("MapInArrow") :].split("\n")[0] and "sim#" not in plan


def test_pairs_above_a_bound_are_whole_and_copies_are_valued_once(spark, monkeypatch):
    rng = np.random.default_rng(17)
    x = np.repeat(rng.normal(size=(9, 4)), [1, 60, 1, 25, 12, 1, 1, 20, 9], axis=0)[rng.permutation(130)]
    df = spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    valued = lambda a, b: (a[0] + b[0]).sum(axis=1)
    want = {(7 * i, 7 * j): round((x[i] + x[j]).sum(), 6) for j in range(130) for i in range(j) if x[i] @ x[j] >= 0.5}
    for strip, block in ((1 << 18, 1000), (100, 50)):
        monkeypatch.setattr(P, "STRIP", strip)
        rows = P.all_pairs(df, P.dot_kernel, ["v"], 0.5, block=block, digits=6, value=valued).collect()
        assert len(rows) == len(want) and all(abs(want[r["i"], r["j"]] - r["sim"]) < 1e-9 for r in rows)
    # a block meets another in chunks of whole runs; each pair of runs that reaches the bound is valued once
    monkeypatch.undo()
    order = np.lexsort(x.T)
    ia, a, ib, b = order[:70], x[order[:70]], order[70:], x[order[70:]]
    for chunk in (8192, 16, 1):
        seen, out = [], []
        solve = P._whole(P.dot_kernel, None, 0.5, lambda u, v: seen.append(len(u[0])) or valued(u, v), chunk)
        for left, right, same in (((ia, [a]), (ib, [b]), False), ((ia, [a]), (ia, [a]), True), ((ib, [b]), (ib, [b]), True)):
            for d in solve(*left, *right, same):
                assert (d["i"] < d["j"]).all()
                out += zip(d["i"].tolist(), d["j"].tolist(), d["sim"].tolist())
        assert len(out) == len(want) and all(abs(want[7 * i, 7 * j] - v) < 1e-6 for i, j, v in out)
        assert sum(seen) <= 4 * 81


def test_nothing_is_left_to_do_with_pairs_of_suppliers_above_a_bound(spark, write_tables):
    rows = [(s, f, n, float(q)) for s in range(8) for f, n, q in (("A", "F", s // 3 + 1), ("N", "O", 3), ("R", "F", 9 - s // 3))]
    d = write_tables(lineitem=spark.createDataFrame(rows, "l_suppkey long, l_returnflag string, l_linestatus string, l_quantity double"))
    for query, column in (("prob_jaccard_exact", "jp"), ("depth_edge_term_fuse", "score")):
        df = features.QUERIES[query](spark, d)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "round" not in plan and "Join" not in plan[: plan.index("MapInArrow")]
        got = {(r["i"], r["j"]): r[column] for r in df.collect()}
        assert got[0, 1] == got[1, 2] == 1.0 and got[0, 3] == got[2, 5] < 1.0


def test_registers_that_a_sign_would_make_longer_are_sent_without_one():
    for top, each in ((127, 1), (254, 1), (32_895, 2), (65_534, 2), (65_535, 4)):
        x = np.array([-1, 0, top] * 1000)
        data, kind = P._narrow(x)
        assert len(data) == each * len(x) or top == 127
        assert (P._wide(data, kind, 1000) == x.reshape(1000, 3)).all() and (P._wide(data, kind, 1000, True) == x.reshape(1000, 3)).all()
    a, b = np.array([[1, -1, 7], [200, 3, 7]]), np.array([[1, -1, 8], [200, 200, 7]])
    want = P.match_kernel([a], [b])
    for kind in (np.int16, np.int32):
        assert (P.match_kernel([a.astype(kind)], [b.astype(kind)]) == want).all() and want.tolist() == [[1 / 3, 1 / 3], [0.0, 2 / 3]]


def test_pairs_that_agree_in_a_band_are_all_that_are_similar(spark, monkeypatch):
    rng = np.random.default_rng(18)
    base = rng.integers(0, 1 << 40, size=(40, 500))
    x = base[rng.integers(0, 40, size=260)]
    x = np.where(rng.random(x.shape) < rng.uniform(0, 0.12, size=260)[:, None], rng.integers(0, 1 << 40, size=x.shape), x)
    x[5:30] = x[5]  # copies
    for k in range(34, 41):  # at the bound: so many registers differ, one in each band first
        x[60 + k] = x[5]
        x[60 + k, np.linspace(0, 499, k).astype(int)] += 1
    planes = S._planes(x, 2)
    kernel, keys, value = S.planes_kernel(500, 2), S.planes_keys(500, 2, 0.9), S.planes_value(500, 2)
    ids = rng.permutation(260) * 3
    s = kernel([planes], [planes])
    assert (value([np.repeat(planes, 260, axis=0)], [np.tile(planes, (260, 1))]).reshape(260, 260) == s).all()
    want = {(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))): round(s[i, j], 6) for j in range(260) for i in range(j) if s[i, j] >= 0.9}
    assert len(want) > 300 and keys([planes]).shape == (260, 38)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, planes)], "id long, planes array<long>")
    for block in (1000, 90):
        rows = P.banded_tiles(df, kernel, ["planes"], keys, value, 0.9, 6, block).collect()
        assert len(rows) == len(want) and all(abs(want[r["i"], r["j"]] - r["sim"]) < 1e-9 for r in rows)
    # few pairs are held or compared at once, and most are not compared at all; where most agree somewhere, all are
    order = np.lexsort(planes.T)
    ids, planes = ids[order], planes[order]
    for strip, most, agree in ((1 << 18, 1 << 17, keys), (50, 40, keys), (50, 40, lambda c: np.zeros((len(c[0]), 3), dtype=np.int64))):
        monkeypatch.setattr(P, "STRIP", strip)
        seen, out = [], []
        solve = P._banded(kernel, agree, lambda u, v: seen.append(len(u[0])) or value(u, v), 0.9, 6, most)
        for left, right, same in ((slice(0, 120), slice(120, 260), False), (slice(0, 120),) * 2 + (True,), (slice(120, 260),) * 2 + (True,)):
            for d in solve(ids[left], [planes[left]], ids[right], [planes[right]], same):
                assert len(d["i"]) <= max(strip, 600)
                out += zip(d["i"].tolist(), d["j"].tolist(), d["sim"].tolist())
        assert len(out) == len(want) and {(i, j): v for i, j, v in out} == {k: float(P._rounded(np.array([v]), 6)[0]) for k, v in want.items()}
        assert max(seen, default=0) <= most and (agree is not keys) == (not seen)
