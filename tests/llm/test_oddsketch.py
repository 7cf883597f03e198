"""Near-duplicates by odd sketches against brute force; the estimate's error; both ways to a link."""

from pathlib import Path

import numpy as np
import pytest

from strandloom.llm import oddsketch as odd

SCHEMA = "doc_id long, text string, component_id string, node int, key long"


def brute(rows, percent=80, words=2):
    sets = [odd.shingles(t, words) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    out = [(r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))]
    return sorted(((*x, x[0] is not None and x[0] == x[2]) for x in out), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def edited(words, rng, share):
    w = list(words)
    for at in rng.choice(len(w), max(1, int(share * len(w))), replace=False):
        w[at] = f"z{rng.integers(1e6)}"
    return " ".join(w)


def corpus(seed=0, groups=12, copies=8, hot=60, share=0.04):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(groups):
        base = rng.choice(vocabulary, 120)
        texts += [edited(base, rng, s) for s in rng.choice([0.01, 0.03, 0.05, 0.08, 0.12], copies)]
    base = rng.choice(vocabulary, 150)
    texts += [edited(base, rng, share) for _ in range(hot)]  # one large group of near copies, not all pairs linked
    texts += [" ".join(rng.choice(vocabulary, 100)) for _ in range(40)]
    texts += ["one", "ONE", "one two", "One\tTwo", "two one", "É a", "é a", "x " * 5000, "x x", "y" * 100_000]
    rows = [(int(i), t, "c", 1, 2) for i, t in enumerate(rng.permutation(np.array(texts, dtype=object)))]
    rows += [(1000, None, "c", 1, 2), (1001, "", "c", 1, 2), (1002, " \n\t", "c", 1, 2), (None, rows[0][1], "c", 1, 2), (None, "only here of all", "c", 1, 2), (None, None, "c", 1, 2)]
    return rows + [rows[5], rows[5], (7, "another text of the same id", "c", 1, 2)]


@pytest.mark.parametrize("seed, params", [(0, odd.OddSketchParams()), (1, odd.OddSketchParams(block=8, chunk=2))])
def test_components(spark, work, seed, params):
    rows = corpus(seed)
    assert found(odd.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), work, params)) == brute(rows)


def test_links_that_only_tiles_find(spark, work, monkeypatch):
    """One large group whose smallest node is like few of the others: whole and cut tiles find the rest."""
    found_by = []
    monkeypatch.setattr(odd, "_tile_links", lambda *a, f=odd._tile_links: found_by.append(f(*a)) or found_by[-1])
    rows = corpus(2, groups=1, hot=120, share=0.034)
    for block in (8, 128):
        assert found(odd.near_duplicates(spark.createDataFrame(rows, SCHEMA), work, odd.OddSketchParams(block=block))) == brute(rows)
        assert found_by[-1].count() > 0


def test_a_chain(spark, work):
    """Each text is like the next, the ends are not alike; and a pair at exactly 80 in a hundred."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[10 * i : 10 * i + 101]), "c", 1, 2) for i in range(30)]
    rows += [(90, " ".join(f"v{i}" for i in range(91)), "c", 1, 2), (91, " ".join(f"v{i}" for i in range(10, 101)), "c", 1, 2)]  # 80 of 100
    rows += [(92, " ".join(f"u{i}" for i in range(91)), "c", 1, 2), (93, " ".join(f"u{i}" for i in range(11, 101)), "c", 1, 2)]  # 79 of 100
    got = found(odd.near_duplicates(spark.createDataFrame(rows, SCHEMA), work))
    assert got == brute(rows) and [r[2] for r in got if r[0] in (91, 93)] == [90, 93]


def test_empty(spark, write_tables):
    assert odd.op13_minhash_near_dedup(spark, write_tables(documents=spark.createDataFrame([], SCHEMA))).count() == 0
    rows = [(1, None, "c", 1, 2), (2, None, "c", 1, 2)]
    assert found(odd.op13_minhash_near_dedup(spark, write_tables(documents=spark.createDataFrame(rows, SCHEMA)))) == brute(rows)


@pytest.mark.parametrize("similarity", [0.6, 0.7, 0.8, 0.9, 0.97])
def test_estimates(similarity):
    """Against the exact similarity: no bias to speak of, more precise the more similar, and no pair from 0.8 is let go."""
    p, rng, errors, bits = odd.OddSketchParams(), np.random.default_rng(4), [], []
    hasher = odd.MinHasher(p)
    for _ in range(150):
        both, each = int(1000 * similarity), int(1000 * (1 - similarity)) // 2
        pool = np.unique(rng.integers(0, 1 << 64, both + 2 * each, dtype=np.uint64))
        rng.shuffle(pool)
        a, b = pool[: both + each], np.r_[pool[:both], pool[both + each :]]
        exact = both / (both + 2 * each)
        xor = hasher.odd_sketch(hasher.registers(a)) ^ hasher.odd_sketch(hasher.registers(b))
        bits.append(int(np.bitwise_count(xor.view(np.uint64)).sum()))
        errors.append(odd.estimate(bits[-1], p) - exact)
    sigma = np.sqrt(similarity * (1 - similarity) / p.registers)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 1.6 * sigma + 0.005
    assert similarity < 0.8 or max(bits) <= p.most_bits
    assert abs(odd.estimate(p.most_bits, p) - p.estimate_percent / 100) < 0.01


def test_bands_of_all_rows_go_once_the_nodes_are_written(spark, work):
    """Copies' bands and sketches, and the pairs that the stars are done with, take no disk beside the later tables."""
    rows = corpus(0)
    assert found(odd.near_duplicates(spark.createDataFrame(rows, SCHEMA), work)) == brute(rows)
    left = {p.name for p in Path(work.path.removeprefix("file://")).iterdir()}
    assert not left & {"prints", "pairs", "near", "chunks"} and {"nodes", "rows"} <= left
