"""The stages one by one and together."""

import corpus_pipeline as C

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(i, n=90):
    return " ".join(f"w{(i * 7919 + k * k * 31 + k) % 9973}" for k in range(n))


def rows():
    out = [(i, prose(i), "en", f"s{i % 2}", 0) for i in range(40)]
    out += [(100, prose(1), "en", "s0", 0), (101, prose(2) + " mail me@x.example.org now", "en", "s1", 0), (102, "tiny", "en", "s0", 0), (103, None, None, None, None), (104, prose(500) + " mail me@y.example.org now", "en", "s1", 0)]
    out += [(110 + k, prose(60 + k) + "\nthis passage is shared by many documents of the corpus", "en", "s0", 0) for k in range(5)]
    return out


def brute_near(texts, words=5, least=0.8):
    """The doc_ids that must go: all but the smallest of each group linked by Jaccard similarity of shingles."""
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()

    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i for i in texts if find(i) != i}


def test_stages(spark, write_tables):
    d = write_tables(documents=spark.createDataFrame(rows(), DOCS))
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (_, stage) in enumerate(C.STAGES):
        docs = stage(spark, docs, d)
        docs.write.mode("overwrite").parquet(f"{d}/out{k}")
        docs = spark.read.parquet(f"{d}/out{k}")
        seen.append(docs)
    good, lines, near, clean, pieces = seen
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    for df in seen[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert ids(good) == {*range(40), 100, 101, 104, *range(110, 115)}
    assert ids(lines) == ids(good)
    text = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert text[100] == "" and "shared by many" in text[110] and all("shared by many" not in text[k] for k in range(111, 115))
    # 100, a copy, is an empty document now, the only one; 101 is 2 with three words more
    assert ids(near) == ids(lines) - brute_near({r["doc_id"]: r["text"] for r in lines.collect()}) == ids(lines) - {101}
    assert "me@y.example.org" not in {r["doc_id"]: r["text"] for r in clean.collect()}[104]
    assert pieces.groupBy().sum("length").first()[0] == pieces.select("doc_id", "doc_tokens").distinct().groupBy().sum("doc_tokens").first()[0]
    assert sorted(map(tuple, C.run(spark, d).drop("sequence_id", "offset").collect())) == sorted(map(tuple, pieces.drop("sequence_id", "offset").collect()))


def test_copies_go_when_they_reach_the_stage(spark, write_tables):
    d = write_tables(documents=spark.createDataFrame([], DOCS))
    df = spark.createDataFrame([(3, prose(1), "en", "s", 0), (1, prose(1).upper(), "en", "s", 0), (2, prose(2), "en", "s", 0)], DOCS)
    assert {r["doc_id"] for r in C.drop_near_duplicates(spark, df, d).collect()} == {1, 2}
    assert C.run(spark, d).count() == 0


def edited(words, times):
    """``words`` with ``times`` words replaced, far from each other."""
    out, step = list(words), len(words) // times
    for k in range(times):
        out[k * step + step // 2] = f"edit{k}"
    return out


def test_edited_copies_go_from_four_fifths_alike(spark):
    """Shingles of five words: 8 edits of 400 words leave a Jaccard similarity of 0.82, 11 edits one of 0.76."""
    base = prose(3, 400).split()
    rows = [(1, " ".join(base)), (2, " ".join(edited(base, 8))), (3, " ".join(edited(base, 11)))]
    spam = "a b c d e " * 100  # fills the fingerprint, but not the set of shingles
    rows += [(4, spam + prose(4, 60)), (5, spam + prose(5, 60)), (6, None), (7, ""), (None, " ".join(base).upper())]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    assert {r["doc_id"] for r in C.drop_near_duplicates(spark, df, "").collect()} == {1, 3, 4, 5, 6}


def test_groups_of_any_size_are_cut_into_tiles(spark, work):
    from strandloom.llm import simhash

    rows = []
    for g in range(3):
        base = prose(50 + g, 300).split()
        rows += [(g * 100 + k, " ".join(base[:k * 7] + [f"own{g}x{k}"] + base[k * 7 + 1 :]), "en", "s", 0) for k in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    params = simhash.SimHashParams(words=5, block_rows=8)
    assert {r["doc_id"] for r in simhash.keep_one(df, work, params).collect()} == {0, 100, 200}
