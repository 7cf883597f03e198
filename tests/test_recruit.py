"""Recruitment by cores against plain loops."""

import math

import numpy as np
import pytest

from strandloom.operators import refine as R


def plain(members, candidates):
    """Sums, cosines with the member really taken out, the boundary and the choice, one after another."""
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    fine = lambda m: any(m["unit"]) and any(m["tnf"])
    bins = sorted({m["bin"] for m in members})

    def score(m, b, leave):
        out = 1.0
        for c in ("unit", "tnf"):
            s = sum((unit(x[c]) * (x["length"] if c == "tnf" else 1) for x in members if x["bin"] == b and any(x[c]) and not (leave and x["seq"] == m["seq"])), np.zeros(len(m[c])))
            n = np.linalg.norm(s)
            out = min(out, float(np.clip(unit(m[c]) @ s / n, -1, 1)) if n > 1e-12 else -math.inf)
        return out

    ratio = lambda a, b: -math.inf if math.isinf(a) or math.isinf(b) else math.log((1 - b) / (1 - a))
    evidence = []
    for m in filter(fine, members):
        own = score(m, m["bin"], True)
        others = sorted((s for b in bins if b != m["bin"] and not math.isinf(s := score(m, b, False))), reverse=True)
        if len(others) > 1 and own != others[0]:
            evidence.append((ratio(own, others[0]), True) if own > others[0] else (ratio(others[0], max(own, others[1])), False))
    p, n = sum(x for _, x in evidence), sum(not x for _, x in evidence)
    if not p or not n:
        return {}, None
    rate = lambda v: sum(x for w, x in evidence if w >= v) / p - sum(not x for w, x in evidence if w >= v) / n
    cut = max({v for v, _ in evidence}, key=lambda v: (rate(v), v))
    got = {}
    for m in filter(fine, candidates):
        best = sorted(((-s, b) for b in bins if not math.isinf(s := score(m, b, False))))[:2]
        if len(best) == 2 and (r := ratio(-best[0][0], -best[1][0])) >= cut:
            got[m["seq"]] = (best[0][1], r)
    return got, cut


def made(seed):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(4, 5)), rng.uniform(0.2, 1, (4, 8))
    one = lambda seq, b, spread: {"seq": seq, "bin": b, "length": int(rng.integers(500, 9000)), "unit": (at[0][b] + spread * rng.normal(size=5)).tolist(), "tnf": np.abs(at[1][b] + spread * rng.normal(size=8)).tolist()}
    members = [one(i, int(rng.integers(3)), 0.9) for i in range(60)] + [one(60, 3, 0.1)]  # a core of one
    members.append({"seq": 61, "bin": 0, "length": 1000, "unit": [0.0] * 5, "tnf": members[0]["tnf"]})
    candidates = [one(100 + i, int(rng.integers(4)), 0.5) for i in range(40)] + [{"seq": 200, "bin": 0, "length": 1, "unit": [0.0] * 5, "tnf": [0.0] * 8}]
    return members, candidates


def frames(spark, members, candidates):
    schema = "bin long, seq long, length long, unit array<double>, tnf array<double>"
    m = spark.createDataFrame([[x[c] for c in ("bin", "seq", "length", "unit", "tnf")] for x in members], schema)
    return m, spark.createDataFrame([[x[c] for c in ("bin", "seq", "length", "unit", "tnf")] for x in candidates], schema).drop("bin")


@pytest.mark.parametrize("seed", [0, 1])
def test_calibrated_recruitment_equals_a_plain_loop(spark, work, seed):
    members, candidates = made(seed)
    want, cut = plain(members, candidates)
    got, boundary = R.calibrated_recruit(*frames(spark, members, candidates), work)
    assert boundary.first()["boundary"] == pytest.approx(cut)
    assert {r["seq"]: (r["bin"], pytest.approx(r["ratio"])) for r in got.collect()} == want and want


def test_blocks_don_t_matter(spark, work):
    members, candidates = made(3)
    m, c = frames(spark, members, candidates)
    cores = work.save(R.core_sums(m), "cores")
    whole, cut = ({(r["seq"], r["bin"], round(r["score"], 9), r["own"]) for r in R.joint_scores(m, cores, n).collect()} for n in (2048, 2))
    best = lambda rows: {s: sorted((x[1:] for x in rows if x[0] == s and not x[3]), key=lambda x: (-x[1], x[0]))[:2] for s in {x[0] for x in rows}}
    assert best(whole) == best(cut) and {x for x in whole if x[3]} == {x for x in cut if x[3]}


def test_one_kind_of_evidence_or_no_cores_recruit_nothing(spark, work):
    members = [{"seq": i, "bin": i % 3, "length": 1000, "unit": np.eye(3)[i % 3].tolist(), "tnf": np.eye(3)[i % 3].tolist()} for i in range(12)]
    m, c = frames(spark, members, members[:2])
    got, boundary = R.calibrated_recruit(m, c, work)
    assert got.count() == 0 and boundary.count() == 0
    got, boundary = R.calibrated_recruit(m.filter("bin > 9"), c, work)
    assert got.count() == 0 and boundary.count() == 0


def test_frozen_cores_take_what_reaches_one_bar(spark):
    rng = np.random.default_rng(5)
    cores = [(b, 0.5, rng.normal(size=4).tolist()) for b in range(9)]
    rows = [(i, rng.normal(size=4).tolist()) for i in range(50)]
    want = {}
    for i, v in rows:
        over = [b for b, tau, mean in cores if np.dot(v, mean) >= tau]
        if len(over) == 1:
            want[i] = over[0]
    got = R.recruit_to_frozen(spark.createDataFrame(rows, "seq long, unit array<double>"), spark.createDataFrame(cores, "bin long, tau double, mean array<double>"))
    assert want and {r["seq"]: r["bin"] for r in got.collect()} == want


def test_fragments_join_the_core_they_reach(spark):
    rng = np.random.default_rng(9)
    cores = [(b, float(rng.uniform(0, 1)), rng.normal(size=4).tolist()) for b in range(6)]
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    want = {}
    for i, v in rows:
        b, tau, mean = max(cores, key=lambda c: np.dot(v, c[2]))
        if np.dot(v, mean) >= tau + 0.1:
            want[i] = (b, pytest.approx(float(np.dot(v, mean))))
    got = R.consolidate_fragments(spark.createDataFrame(rows, "frag long, mean array<double>"), spark.createDataFrame(cores, "bin long, tau double, mean array<double>"), 0.1)
    assert want and {r["frag"]: (r["bin"], r["score"]) for r in got.collect()} == want


def test_repeated_markers_give_the_number_of_pieces(spark):
    """As many pieces as the most repeated marker has copies, along the depths; pieces under the floor go."""
    rows = [("a", i, 1000, [float(i // 4) * 9, 0.01 * i]) for i in range(12)] + [("b", 100 + i, 1000, [float(i // 4) * 9, 0.0]) for i in range(8)]
    rows += [("c", 200 + i, 1000 if i < 6 else 10, [0.0 if i < 6 else 9.0, 0.0]) for i in range(8)]
    hits = [(0, "m"), (5, "m"), (9, "m"), (1, "n"), (100, "m"), (101, "n"), (200, "m"), (207, "m")]
    m, h = spark.createDataFrame(rows, "bin string, seq long, length long, y array<double>"), spark.createDataFrame(hits, "seq long, marker string")
    got = {}
    for r in R.marker_split(m, h, floor=3000).collect():
        got.setdefault((r["bin"], r["piece"]), set()).add(r["seq"])
    assert sorted((b, sorted(x)) for (b, _), x in got.items()) == [("a", [0, 1, 2, 3]), ("a", [4, 5, 6, 7]), ("a", [8, 9, 10, 11]), ("b", list(range(100, 108))), ("c", list(range(200, 206)))]
