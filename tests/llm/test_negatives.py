"""Hard negatives against brute force."""

import numpy as np
import pytest

from strandloom.llm import negatives as neg

SCHEMA = "vec_id long, embedding array<float>, label int, w string, rank int"


def brute(rows, p=neg.NegativeParams(), step=50, flip=True):
    ok = [
        (i, (label + 1) % 10 if flip and i % 7 == 0 else label, [int(np.floor(float(np.float32(x)) * p.scale)) for x in v])
        for i, v, label, *_ in rows
        if None not in (i, v, label) and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for a in sorted({i for i, *_ in ok if i % step == 0}):
        _, own, q = min(r for r in ok if r[0] == a)
        score = sorted((-sum(x * y for x, y in zip(q, v)), i, label) for i, label, v in ok if i != a)
        for s, i, _ in [x for x in score if x[2] == own][: p.positives]:
            fit = [(t, j) for t, j, label in score if label != own and -50 * s <= -100 * t <= -95 * s][: p.negatives]
            out += [(a, i, r + 1, j, -s, -t) for r, (t, j) in enumerate(fit)]
    return sorted(out)


def found(df):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.select(*cols).collect())


def clustered(n, rng, labels=4, dims=6):
    at = rng.normal(size=(labels, dims))
    kind = rng.integers(0, labels, n)
    v = np.round((at[kind] + 0.4 * rng.normal(size=(n, dims))) * 4) / 16  # a coarse grid: many ties
    return [(int(i), v[i].tolist(), int(kind[i]), "x", 7) for i in range(n)]


def test_nulls_ties_repeats_and_blocks(spark, write_tables, work):
    rng = np.random.default_rng(3)
    rows = clustered(400, rng)
    rows += [(450, None, 1, "x", 7), (500, [float("nan")] + [0.0] * 5, 1, "x", 7), (550, [None] + [0.0] * 5, 1, "x", 7), (600, [0.5] * 6, None, "x", 7), (None, [0.5] * 6, 2, "x", 7)]
    rows += [(650, [], 1, "x", 7), (700, [0.0] * 6, 1, "x", 7), (750, [1.0, 2.0], 2, "x", 7), (800, [-1.0] * 9, 0, "x", 7)]
    rows += [(i, rows[3][1], rows[3][2], "x", 7) for i in range(1001, 1040)]  # one hot vector
    rows += [(50, rows[9][1], 3, "x", 7), (50, rows[9][1], 3, "x", 7), (1001, rows[8][1], 2, "x", 7)]
    d = write_tables(embeddings=spark.createDataFrame(rows, SCHEMA))
    want = brute(rows)
    assert want and found(neg.op11_hard_negatives(spark, d)) == want
    table = work.save(neg.labelled(spark.read.parquet(f"{d}/embeddings.parquet"), 256), "rows")
    small = neg.NegativeParams(anchor_block=3, candidate_block=50, leaf_rows=4)
    assert found(neg.mine(table, table.filter("vec_id % 50 = 0"), work, small)) == brute(rows, flip=False)


def test_whole_tables_of_one_label_and_empty(spark, write_tables):
    rows = [(i, [float(i % 5), 1.0], 1, "x", 7) for i in range(1, 60) if i % 7]
    assert neg.op11_hard_negatives(spark, write_tables(embeddings=spark.createDataFrame(rows, SCHEMA))).count() == 0
    assert neg.op11_hard_negatives(spark, write_tables(embeddings=spark.createDataFrame([], SCHEMA))).count() == 0


def test_scores_stay_at_the_limits_of_64_bits(spark, write_tables):
    rows = [(0, [1e30, 1e30], 1, "x", 7), (1, [1e30, 1e30], 2, "x", 7), (2, [1e30, 0.0], 2, "x", 7), (3, [-1e30, 0.0], 3, "x", 7), (4, [1.0, 0.0], 3, "x", 7)]
    got = found(neg.op11_hard_negatives(spark, write_tables(embeddings=spark.createDataFrame(rows, SCHEMA))))
    assert all(r[4] <= neg.MOST for r in got)  # 0 becomes label 2: its positives 1 and 2 have the greatest score
    assert neg.products(np.array([[neg.MOST, neg.MOST]]), np.array([[neg.MOST, neg.MOST], [neg.LEAST, neg.LEAST]])).tolist() == [[neg.MOST, neg.LEAST]]


@pytest.mark.parametrize("seed", range(20))
def test_search_by_brute_force(seed):
    """Windows, ties and all depths: the same rows as sorting every score; nodes out of reach are not scored."""
    rng = np.random.default_rng(seed)
    n, d, k = int(rng.integers(1, 300)), int(rng.integers(1, 6)), int(rng.integers(1, 5))
    labels, rows, ids = rng.integers(0, 3, n), rng.integers(-9, 10, (n, d)), rng.permutation(n)
    forest = neg.BallForest(ids.copy(), labels.copy(), rows.copy(), leaf=int(rng.integers(1, 20)))
    q = rng.integers(-9, 10, (7, d))
    lo = np.sort(rng.integers(-60, 200, (7, 2)), axis=1)
    hi = lo + rng.integers(0, 80, (7, 2))
    held = neg.Anchors(np.arange(7) + 3, q, lo, hi, k)
    forest.search(held, [r for of, r in forest.roots if of != 1], k)
    for a in range(7):
        for w in range(2):
            all_of = sorted((-int(q[a] @ rows[i]), int(ids[i])) for i in range(n) if labels[i] != 1 and ids[i] != a + 3)
            want = [(-s, i) for s, i in all_of if lo[a, w] <= -s <= hi[a, w]][:k]
            assert [(int(s), int(i)) for s, i, f in zip(held.score[a, w], held.id[a, w], held.full[a, w]) if f] == want


def test_far_nodes_are_not_scored(monkeypatch):
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.integers(-5, 6, (500, 4)) + c for c in ([500, 0, 0, 0], [0, 500, 0, 0], [-500, 0, 0, 0])])
    forest = neg.BallForest(np.arange(1500), np.zeros(1500, dtype=int), rows, leaf=50)
    scored = []
    monkeypatch.setattr(neg, "products", lambda a, b, f=neg.products: scored.append(len(b)) or f(a, b))
    held = neg.Anchors(np.array([-1]), np.array([[100, 0, 0, 0]]), np.array([[neg.LEAST]]), np.array([[neg.MOST]]), 3)
    forest.search(held, [r for _, r in forest.roots], 3)
    assert sum(scored) <= 550
