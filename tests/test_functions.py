import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions import arrays as A
from strandloom.functions import sequences as S
from strandloom.functions import stats as T


def one(spark, expr, **cols):
    df = spark.range(1)
    for k, v in cols.items():
        df = df.withColumn(k, F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v))
    return df.select(expr.alias("x")).first()["x"]


def test_ranks_and_profiles(spark):
    assert one(spark, A.average_ranks(F.col("v")), v=[10.0, 10.0, 5.0, 7.0]) == [3.5, 3.5, 1.0, 2.0]
    assert one(spark, A.centred_unit(F.col("v")), v=[2.0, 2.0]) == [0.0, 0.0]
    assert math.isclose(one(spark, A.weighted_jaccard(F.col("a"), F.col("b")), a=[1.0, 2.0, 3.0], b=[2.0, 2.0, 1.0]), 4 / 7)
    assert one(spark, A.weighted_jaccard(F.col("a"), F.col("b")), a=[0.0], b=[0.0]) == 0.0


def test_label_scores(spark):
    f = lambda m, ws: one(spark, T.label_score("fisher", F.lit(m), F.lit(sum(math.log(1 - w) for w in ws)), F.lit(sum(ws)), F.lit(max(ws))))
    assert math.isclose(f(1, [0.7]), 0.7)
    assert math.isclose(f(2, [0.7, 0.7]), 1 - 0.09 * (1 - 2 * math.log(0.3)))


def test_critical_values():
    assert math.isclose(T.chi2_critical(1), 3.841458820694124, rel_tol=1e-9)
    assert math.isclose(T.chi2_critical(6), 12.591587243743977, rel_tol=1e-9)
    assert T.chi2_critical(6, 0.05, 100) > T.chi2_critical(6)


def test_sequences(spark):
    assert one(spark, S.reverse_complement(F.lit("ACGTN"))) == "NACGT"
    assert one(spark, S.gc_percent(F.lit("GGAT"))) == 50
    unit = "ACGTTGCAAGCTTAGCTAGGCATTACGATC"
    assert one(spark, S.terminal_repeat(F.lit(unit + "T" * 60 + "G" + unit))) == 30
    assert one(spark, S.terminal_repeat(F.lit("ACGT"))) == 0
    assert one(spark, S.wrapped(F.lit("A" * 120))) == "A" * 60 + "\n" + "A" * 60
    assert one(spark, S.stretched(F.lit(0.88), F.lit(0.76))) == 0.5


def test_shreds_reach_the_end(spark):
    df = spark.createDataFrame([("c", "ACGT" * 6)], "name string, seq string")
    r = S.shreds(df, 10, 2).collect()
    assert {len(x["seq"]) for x in r} == {10} and max(x["start"] for x in r) == 14 and len(r) == 30


@settings(max_examples=40, deadline=None)
@given(st.text("ACGTNacgt", max_size=60))
def test_spectra_by_brute_force(seq):
    up = seq.upper()
    want: dict[str, int] = {}
    for i in range(len(up) - 3):
        k = up[i : i + 4]
        if set(k) <= set("ACGT"):
            rc = k[::-1].translate(str.maketrans("ACGT", "TGCA"))
            want[min(k, rc)] = want.get(min(k, rc), 0) + 1
    counts = S.canonical(np.bincount(S.kmer_codes(S.codes(seq), 4), minlength=256).astype(float))
    assert {S.kmer_name(int(i)): int(counts[i]) for i in np.flatnonzero(counts)} == want


def test_weighted_sketch_estimates_probability_jaccard(spark):
    rng = np.random.default_rng(1)
    x, y = rng.random(136), rng.random(136)
    y[:60] = x[:60]
    exact = sum(1 / np.maximum(x / x[v], y / y[v]).sum() for v in range(136))
    df = spark.createDataFrame([(1, x.tolist()), (2, y.tolist())], "id long, w array<double>")
    a, b = (np.array(r["sketch"]) for r in S.weighted_sketch(df, 2000).orderBy("id").collect())
    assert abs((a == b).mean() - exact) < 4 * math.sqrt(exact * (1 - exact) / 2000)


def test_bucket_sketches(spark):
    rng = np.random.default_rng(2)
    s = "".join(rng.choice(list("ACGT"), 3000))
    df = spark.createDataFrame([(1, s), (2, s), (3, None), (4, "".join(rng.choice(list("ACGT"), 3000)))], "id long, seq string")
    sk = {r["id"]: np.array(r["sketch"]) for r in S.bucket_sketch(df).collect()}
    assert (sk[1] == sk[2]).all() and (sk[3] == -1).all() and (sk[1] == sk[4]).mean() < 0.3


def test_low_bits_estimate_the_exact_similarity(spark):
    """Two bits a register: unbiased at all similarities, and about as precise as the registers allow."""

    rng = np.random.default_rng(2)
    m, bits, rows, want = 512, 2, [], []
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        for _ in range(12):
            a = rng.integers(0, 1 << 60, m)
            b = np.where(rng.random(m) < share, a, rng.integers(0, 1 << 60, m))
            rows += [(len(rows), a.tolist()), (len(rows) + 1, b.tolist())]
            want.append((a == b).mean())
    rows.append((len(rows), [-1] * m))
    got = S.low_bit_planes(spark.createDataFrame(rows, "id long, sketch array<long>"), bits).orderBy("id").collect()
    assert len(got) == len(rows) - 1 and all(len(r["planes"]) == bits * m // 64 for r in got)
    planes = np.array([r["planes"] for r in got])
    sim = np.diag(S.planes_kernel(m, bits)([planes[::2]], [planes[1::2]]))
    assert np.abs(sim - want).max() < 0.12 and abs(np.mean(sim - want)) < 0.02


def test_unit_words_are_counted_in_slices_and_rounded(spark):
    import pyarrow as pa

    r = np.random.default_rng(3)
    texts = ["".join(r.choice(list("ACGTNé"), p=[0.3, 0.2, 0.2, 0.2, 0.05, 0.05], size=n)) for n in (0, 3, 4, 50, 900)] + [None, "acgtACGT", "AAAA" * 20]
    want = {}
    for i, x in enumerate(texts):
        n = {}
        for p in range(len(x or "") - 3):
            if set(k := x[p : p + 4].upper()) <= set("ACGT"):
                n[k] = n.get(k, 0) + 1
        norm = sum(v * v for v in n.values()) ** 0.5
        want |= {(i, k): round(v / norm, 6) for k, v in n.items()}
    df = spark.createDataFrame(list(enumerate(texts)), "id int, seq string")
    got = {(x["id"], x["kmer"]): x["w"] for x in S.unit_words(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1.1e-6 for k, v in want.items())
    assert "aggregate" not in S.unit_words(df)._jdf.queryExecution().optimizedPlan().toString()
    # a batch that begins within its arrays; a long text is alone in its slice
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "seq": texts}).slice(2)
    rows = [tuple(x.values()) for b in S._unit_words(4, 6)(iter([batch])) for x in b.to_pylist()]
    assert {(i, k): w for i, k, w in rows} == {k: v for k, v in got.items() if k[0] >= 2}
    assert list(S._slices(np.array([0, 5, 30, 2, 2, 0]), 8, 2)) == [(0, 2), (2, 3), (3, 5), (5, 6)]


def test_sketches_straight_from_sequences_are_those_of_the_steps(spark):
    r = np.random.default_rng(4)
    texts = ["".join(r.choice(list("ACGTN"), p=[0.3, 0.2, 0.2, 0.29, 0.01], size=n)) for n in (0, 3, 40, 900, 3000)] + [None, "acgtACGTTTGACCA"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, seq string")
    read = lambda x, c: {y["id"]: list(y[c]) for y in x.collect()}
    for mode in ("gc", "markov"):
        assert read(S.sequence_sketch(df, mode, 64), "sketch") == read(S.weighted_sketch(S.kmer_weights(S.spectra(df), mode), 64), "sketch")
    for x in (S.sequence_sketch(df), S.bucket_planes(df)):
        assert x._jdf.queryExecution().optimizedPlan().toString().count("MapIn") == 1
    whole, ranks = read(S.bucket_sketch(df), "sketch"), read(S.bucket_sketch(df, ranked=True), "sketch")
    assert {i: x for i, x in whole.items()} == {i: S.one_permutation(t, 8, 500).tolist() for i, t in enumerate(texts)}
    a, b = (np.array([x[i] for i in sorted(x)]).ravel() for x in (whole, ranks))
    assert ((a < 0) == (b < 0)).all() and b.max() < 1 << 16 and (b[b < 0] == -1).all()
    assert len(set(zip(a, b))) == len(set(a)) == len(set(b))
    assert read(S.bucket_planes(df, 2), "planes") == read(S.low_bit_planes(S.bucket_sketch(df), 2), "planes")
