"""Exact search, sharding, SimHash groups and their components against brute force."""

import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm import sharding, simhash, topk
from strandloom.workspace import Workspace


def brute_topk(vectors, k=20):
    ok = [(i, np.floor(np.array(v, dtype=np.float32).astype(float) * 64).astype(int)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, w in ok:
        if q % 20 == 0:
            best = sorted((-int(w @ x), i) for i, x in ok if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_search_with_ties_nulls_and_blocks(spark, write_tables, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(130)]
    rows += [(200, [0.5] * 8), (201, [0.5] * 8), (220, None), (240, [float("nan")] + [0.0] * 7), (260, [None] + [0.0] * 7), (280, [float("inf")] * 8), (None, [1.0] * 8)]
    d = write_tables(embeddings=spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, w int"))
    want = brute_topk(rows)
    assert {tuple(r) for r in topk.op7_exact_topk(spark, d).collect()} == want
    v = topk.quantised(spark.read.parquet(f"{d}/embeddings.parquet"), 64)
    small = topk.TopKParams(query_block=3, candidate_block=17)
    assert {tuple(r) for r in topk.search(v.filter("vec_id % 20 = 0"), v, small).collect()} == want
    empty = write_tables(embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.op7_exact_topk(spark, empty).count() == 0


def test_fewer_rows_than_k(spark, write_tables):
    rows = [(0, [1.0]), (5, [2.0]), (20, [3.0])]
    d = write_tables(embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {tuple(r) for r in topk.op7_exact_topk(spark, d).collect()} == brute_topk(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), max_size=60), st.integers(1, 7))
def test_differencing_is_a_partition_at_least_as_good_as_greedy(sizes, k):
    slot = sharding.differencing(sizes, k)
    assert len(slot) == len(sizes) and all(0 <= s < k for s in slot)
    load = np.bincount(slot, weights=sizes, minlength=k)
    greedy = np.zeros(k)
    for s in sorted(sizes, reverse=True):
        greedy[greedy.argmin()] += s
    assert load.max() <= max(greedy.max() * 4 / 3 + 1, 1)


def plain_differencing(sizes, k):
    """The method word for word, with whole lists of members."""
    parts = [([0] * (k - 1) + [x], [[] for _ in range(k - 1)] + [[i]], i) for i, x in enumerate(sizes)]
    made = len(sizes)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[0][-1] - p[0][0]), p[2]))
        (la, ma, _), (lb, mb, _), *rest = parts
        both = sorted(((x + y, i, m + n) for i, (x, y, m, n) in enumerate(zip(la, lb[::-1], ma, mb[::-1]))), key=lambda t: (t[0], t[1]))
        low = both[0][0]
        parts = [*rest, ([x - low for x, _, _ in both], [m for _, _, m in both], made)]
        made += 1
    slot = [0] * len(sizes)
    for s, members in enumerate(parts[0][1] if parts else []):
        for i in members:
            slot[i] = s
    return slot


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), max_size=40), st.integers(1, 7))
def test_differencing_by_brute_force(sizes, k):
    assert sharding.differencing(sizes, k).tolist() == plain_differencing(sizes, k)


@pytest.mark.parametrize("items,bucket", [(40_000, 20_000), (600, 300), (150, 120)])
@pytest.mark.parametrize("hot", [0, 10**7])
def test_balance_with_and_without_buckets(spark, work, items, bucket, hot):
    rng = np.random.default_rng(4)
    sizes = np.minimum((rng.pareto(1.2, 3000) * 500).astype(int) + 16, 100_000).tolist() + ([hot] if hot else [])
    df = spark.createDataFrame([(f"g{i}", int(x)) for i, x in enumerate(sizes)], "item string, bytes long")
    out = sharding.assign(df, work, sharding.ShardParams(shards=8, final_items=items, bucket_groups=bucket)).collect()
    assert sorted(r["item"] for r in out) == sorted(f"g{i}" for i in range(len(sizes)))
    load = np.zeros(8)
    for r in out:
        load[r["shard"]] += sizes[int(r["item"][1:])]
    assert load.max() <= max(1.01 * load.mean(), max(sizes))


@pytest.mark.parametrize("items", [40_000, 50])
def test_shards(spark, work, items):
    rng = np.random.default_rng(1)
    texts = ["x" * int(n) for n in rng.integers(0, 3000, 400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, "copy " * 100) for i in range(200)] + [(None, None), (None, None), (7, texts[7]), (2000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard(df, work, sharding.ShardParams(shards=8, final_items=items, bucket_groups=40)).collect()
    assert len(out) == len(rows)
    at: dict = {}
    for r in out:
        at.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(v) == 1 for v in at.values())
    for s in range(8):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    by = {d: t for d, t in rows if d is not None}
    assert all(r["size"] == len((by[r["doc_id"]] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((by[r["doc_id"]] or "").encode()) for r in out if r["doc_id"] is not None)
    load = np.zeros(8)
    for r in out:
        load[r["shard"]] += r["size"]
    group = 200 * 516
    # five buckets of forty groups leave coarse composites
    assert load.max() <= max(group + 3000, load.sum() / 8 * (1.05 if items > 50 else 1.4))


def test_shards_of_nothing(spark, write_tables):
    d = write_tables(documents=spark.createDataFrame([], "doc_id long, text string"))
    assert sharding.op8_sharding(spark, d).count() == 0


def test_shards_with_clashing_names_and_a_very_long_text(spark, write_tables):
    rows = [(1, "a" * 3_000_000, "x", 1), (2, "b", "y", 2), (2, "b", "y", 2)]
    d = write_tables(documents=spark.createDataFrame(rows, "doc_id long, text string, item string, shard int"))
    out = sorted((r["doc_id"], r["size"], r["law"]) for r in sharding.op8_sharding(spark, d).collect())
    assert out == [(1, 3_000_016, "bytes"), (2, 17, "bytes"), (2, 17, "bytes")]


# -- near-duplicates


def brute_print(text, words=3):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(low)) if x]
    g = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] if len(w) >= words else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(codes, radius):
    up = list(range(len(codes)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One two", "a b c d", "É é ß", "x " * 3000])
def test_fingerprints(text):
    assert simhash.fingerprint(text) % (1 << 64) == brute_print(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3)), min_size=1, max_size=60), st.integers(0, 4), st.integers(2, 9))
def test_index_finds_every_link_in_a_group(rows, radius, fan):
    base = [g for _, g, _ in rows[:3]]
    codes = [(g, base[k % len(base)] ^ sum(1 << b for b in set(flips))) for k, (g, _, flips) in enumerate(rows)]
    codes = sorted(set(codes))
    group, code = np.array([g for g, _ in codes]), np.array([c for _, c in codes], dtype=np.uint64)
    a, b = simhash.forest(group, code, radius, fan)
    pos = {}
    for g in set(group.tolist()):
        own = [int(c) for gg, c in codes if gg == g]
        for c, r in zip(own, roots(own, radius)):
            pos[g, c] = own[r]
    # forests may root elsewhere, but the groups must be the same
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    linked = {(int(x), int(y)) for x, y in zip(a, b)}
    for g in set(group.tolist()):
        own = [int(c) for gg, c in codes if gg == g]
        up.clear()
        for x, y in linked:
            if x in own and y in own and (x ^ y).bit_count() >= 0:
                rx, ry = find(x), find(y)
                if rx != ry and pos[g, x] == pos[g, y]:
                    up[max(rx, ry)] = min(rx, ry)
        assert all((find(x) == find(y)) == (pos[g, x] == pos[g, y]) for x in own for y in own)


@pytest.mark.parametrize("node_rows", [8192, 4])
def test_groups_by_brute_force(spark, work, node_rows):
    rng = np.random.default_rng(2)
    centres = [int(x) for x in rng.integers(0, 2**63, 12)]
    codes = [0, 3]
    for c in centres:
        for _ in range(12):
            codes.append(c ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 5)).tolist())))
    ids = list(range(len(codes)))
    rng.shuffle(ids)
    want = {}
    r = roots(codes, 2)
    for k, x in enumerate(r):
        want.setdefault(x, []).append(ids[k])
    df = spark.createDataFrame([(int(i), c - (1 << 64) if c >> 63 else c) for i, c in zip(ids, codes)], "doc_id long, fp long")
    prints = work.save(df, "prints")
    of = simhash.group_near(prints, work, simhash.SimHashParams(node_rows=node_rows))
    got = {x["doc_id"]: x["component_id"] for x in prints.join(of, "fp").collect()}
    assert got == {i: min(want[r[k]]) for k, i in enumerate(ids)}


def test_near_query_with_odd_rows(spark, write_tables):
    rows = [(5, "a b c d e", "k"), (3, "A B c d E", "k"), (None, "a b c d e", "k"), (9, None, "k"), (8, " ", "k"), (8, " ", "k"), (4, "quite another text it is", None)]
    d = write_tables(documents=spark.createDataFrame(rows, "doc_id long, text string, fp string"))
    got = sorted(map(repr, map(tuple, simhash.op10_simhash_near_dedup(spark, d).collect())))
    comp = {5: 3, 3: 3, None: 3, 9: 8, 8: 8, 4: 4}
    assert got == sorted(repr((i, f"{brute_print(t):016x}", comp[i])) for i, t, _ in rows)
    d = write_tables(documents=spark.createDataFrame([], "doc_id long, text string"))
    assert simhash.op10_simhash_near_dedup(spark, d).count() == 0


def test_one_row_of_each_group_stays(spark, work):
    rows = [(5, "a b c d e f g", "x"), (3, "A B c d e F g", "y"), (3, "A B c d e F g", "y"), (None, None, None), (7, "some other words are here now", "z"), (8, "", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _rid string")
    out = simhash.keep_one(df, work)
    assert out.columns == ["doc_id", "text", "_rid"]
    assert sorted((r["doc_id"], r["_rid"]) for r in out.collect()) == [(3, "y"), (7, "z"), (8, "q")]
    assert simhash.keep_one(df.limit(0), work).count() == 0
