"""Packing and BPE against the library."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import bpe, packing, pretoken

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
TEXTS = ["", "a", "it's  we'll 12 ½ x²\n\n end ", "Straße ÄÖÜ éà º ª µ", "<|endoftext|> in <|startoftext|>text", "日本語 и кириллица İstanbul ΟΔΟΣ ﬁ é", "tab\tnel\x85nbsp x\x1cy", "a" * 3000, "😀👍🏽", "don'T 'S", "   lead", "\n\n\n", "<|endoftext", "x<|endoftext|>"]


@pytest.fixture(scope="module")
def word():
    return tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def byte():
    return tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_word_ids_are_the_librarys(word):
    enc = packing.WordTokenizer("word_bpe_49k.json", 50)
    for t in TEXTS:
        assert np.frombuffer(enc(t), enc.width).tolist() == word.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_word_ids_of_random_texts(t):
    enc = packing._worker_tokenizer("word_bpe_49k.json", 1000)
    assert np.frombuffer(enc(t), enc.width).tolist() == enc.model.encode(t, add_special_tokens=False).ids


def lexicon(words):
    return bpe.Lexicon(bpe.compile_lexicon(words, "byte_bpe_50k.json"))


def test_transducer_is_exact_and_shares_suffixes():
    words = [" walking", " talking", " walked", " talked", "é", "a", " a", "ab", "abc", "b" * 50]
    data = bpe.compile_lexicon(words, "byte_bpe_50k.json")
    lex = bpe.Lexicon(data)
    for w in words:
        assert lex.get(w.encode()) == bpe.merges("byte_bpe_50k.json").ids(w)
    for w in ("", " walk", "walking", "abcd", "c", " walkingx"):
        assert lex.get(w.encode()) is None
    assert len(lex.first) - 1 < sum(len(w.encode()) for w in words)  # fewer states than letters


@settings(max_examples=40, deadline=None)
@given(st.sets(st.text(min_size=1, max_size=8), max_size=60), st.lists(st.text(max_size=8), max_size=20))
def test_random_lexicons(words, others):
    lex = lexicon(words)
    of = bpe.merges("byte_bpe_50k.json")
    for w in words:
        assert lex.get(w.encode("utf-8")) == of.ids(w)
    for w in set(others) - words:
        assert lex.get(w.encode("utf-8")) is None


def test_bytes_round_trip(byte):
    coder = bpe.Coder(lexicon(["a", " in", "it"]), "byte_bpe_50k.json", 3)
    for t in TEXTS:
        ids = coder.encode(t)
        assert ids == byte.encode(t, add_special_tokens=False).ids, t
        assert coder.decode(ids) == byte.decode(ids, skip_special_tokens=False) == t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_byte_ids_of_random_texts(t):
    byte = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    coder = bpe.Coder(lexicon(["a"]), "byte_bpe_50k.json", 1000)
    assert "".join(pretoken.byte_units(t, byte.pre_tokenizer)) == t
    assert coder.encode(t) == byte.encode(t, add_special_tokens=False).ids


def rows():
    return [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, TEXTS[3]), (99, None), (100, "word " * 6000)]


def test_pieces_are_gapless_and_whole(spark, work, word):
    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    p = packing.pack(df, work).toPandas().sort_values(["sequence_id", "offset"])
    at = 0
    for r in p.itertuples():
        assert r.sequence_id * 2048 + r.offset == at and r.offset + r.length <= 2048
        at += r.length
    want = {}
    for d, t in rows():
        ids = np.array(word.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want.setdefault(d, []).append(ids)
    assert at == sum(len(x) for v in want.values() for x in v)
    for r in p.itertuples():
        d = None if r.doc_id != r.doc_id else int(r.doc_id)
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in want[d])
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), work).count() == 0


def test_query_digests(spark, write_tables, byte):
    d = write_tables(documents=spark.createDataFrame([(i, t, "x") for i, t in rows()], "doc_id long, text string, n_tokens string"))
    got = sorted(map(repr, map(tuple, bpe.op5_bpe_round_trip(spark, d).collect())))
    want = []
    for i, t in rows():
        ids = byte.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(map(repr, want))
    d = write_tables(documents=spark.createDataFrame([], "doc_id long, text string"))
    assert bpe.op5_bpe_round_trip(spark, d).count() == 0
    enc = bpe.encode(spark.createDataFrame([(1, "it's")], "doc_id long, text string")).first()
    assert enc["ids"] == byte.encode("it's", add_special_tokens=False).ids


def test_short_cuts_hold_for_these_tokenizers_and_not_for_others(word, byte):
    assert pretoken.words_like(word.pre_tokenizer, word.normalizer.normalize_str) and pretoken.bytes_like(byte.pre_tokenizer)
    assert not pretoken.bytes_like(word.pre_tokenizer)


def test_packing_with_repeated_rows_and_clashing_names(spark, write_tables):
    rows = [(1, "one two three", 7, "x")] * 2 + [(None, None, None, None)]
    d = write_tables(documents=spark.createDataFrame(rows, "doc_id long, text string, part int, sequence_id string"))
    out = packing.op3_packing(spark, d).collect()
    assert sorted((r["doc_id"] or 0, r["start"], r["length"]) for r in out) == [(0, 0, 1), (1, 0, 4), (1, 0, 4)]
    assert sorted(r["offset"] for r in out)[0] == 0 and len({r["sequence_id"] for r in out}) == 1
