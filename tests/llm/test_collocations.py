"""Phrases against brute force; the exact sums of a bucket; what the bitmap may and may not do."""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from strandloom.llm import collocations as col

SCHEMA = "doc_id long, text string, lang string, n long, w string, piece string"


def brute(rows, p):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, p.longest + 1) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= p.least}
    gone = {(lang, w[i:j]) for (lang, w), a in cand.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and a >= f[lang, w[i:j]]}
    out = {}
    for (lang, w), a in cand.items():
        if (lang, w) not in gone:
            s, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, b.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, b, l, r) in enumerate(sorted(x)[: p.first]))


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, docs=120):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "new", "york", "tax", "tax", "é", "É", "a b", "zu", "x" * 300] + [f"w{i}" for i in range(20)]
    rows = []
    for i in range(docs):
        w = rng.choice(words, int(rng.integers(0, 60)), p=np.r_[np.full(11, 0.06), np.full(20, 0.017)])
        text = "".join(str(x) + str(rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "  "])) for x in w) + str(rng.choice(["", "New York tax office opens. ", "new york"]))
        rows.append((i, text, [None, "und", "en", "de"][i % 4], 5, "q", "r"))
    return rows + rows[2:30:4] * 3 + [(900, None, "en", 5, "q", "r"), (901, "", None, 5, "q", "r"), (None, " ,;\t. ", "xx", 5, "q", "r"), (902, "tax " * 3000, "en", 5, "q", "r")]


@pytest.mark.parametrize("least", [3, 8])
def test_phrases(spark, work, least):
    rows = corpus(least)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    p = col.PhraseParams(least=least, first=15, chunk_words=200)
    want = brute(rows, p)
    assert want and found(col.phrases(docs, work, p)) == want


def test_a_full_bitmap_changes_nothing(spark, work):
    """With 64 bits nearly every n-gram passes on; the counts decide."""
    rows = corpus(5)
    p = col.PhraseParams(least=4, filter_bits=6)
    assert found(col.phrases(spark.createDataFrame(rows, SCHEMA), work, p)) == brute(rows, p)


def test_empty_tables_and_rare_words(spark, write_tables):
    for rows in ([], [(1, "one two three", "en", 5, "q", "r"), (2, None, None, 5, "q", "r")]):
        assert col.op12_phrase_collocations(spark, write_tables(documents=spark.createDataFrame(rows, SCHEMA))).count() == 0


def test_products_beyond_64_bits(spark, work):
    """A count of 4 * 10**9 makes products of 10**22."""
    n = 4_000_000_000
    pieces = spark.createDataFrame([("en", "a b", n), ("en", "a c", n + 1), ("en", "d b", 3)], col.PIECES)
    old = col.pieces
    try:
        col.pieces = lambda docs: pieces
        got = found(col.phrases(pieces, work, col.PhraseParams(least=2)))
    finally:
        col.pieces = old
    total = 2 * (2 * n + 4)
    want = sorted(((-(1000 * a * total // (l * r)), -a, p, l, r) for p, a, l, r in (("a b", n, 2 * n + 1, n + 3), ("a c", n + 1, 2 * n + 1, n + 1), ("d b", 3, 3, n + 3))))
    assert got == sorted(("en", i + 1, p, -a, l, r, total, -s) for i, (s, a, p, l, r) in enumerate(want))


def test_buckets_add_up_out_of_core():
    """More distinct n-grams than fit the memory given; each is added exactly."""
    n = 600_000
    batch = lambda k: pa.RecordBatch.from_pandas(pd.DataFrame({"lang": "en", "gram": [f"gram number {i} of many" for i in range(n)], "n": np.full(n, k)}))
    got = pa.Table.from_batches(col._add_up(6, "48MB")(iter([batch(2), batch(4)]))).to_pandas()
    assert len(got) == n and (got["n"] == 6).all()
    assert list(col._add_up(7, "48MB")(iter([batch(2), batch(4)]))) == [] or sum(b.num_rows for b in col._add_up(7, "48MB")(iter([batch(2), batch(4)]))) == 0
    assert list(col._add_up(1, "48MB")(iter([]))) == []
