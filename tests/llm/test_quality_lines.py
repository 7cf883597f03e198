"""Quality rules and line dedup against brute force, and the odd rows that tables hold."""

import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm import line_dedup, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = " \t\n\x0b\x0c\r"


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    g = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {p for k in range(len(w) - 2) if g[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


ODD = [None, "", " \t\n", "a", "a b c", "a b c a b c", "x\nx\n\nx", "a a a a a", "ünï cödé 😀 #$", "\x1c |", " lead and trail \n", "w " * 20000]


def test_counts_of_odd_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r["doc_id"]: tuple(r[f"_q_{c}"] for c in cols) for r in quality.with_counts(df).collect()}
    assert got == {i: counts(t) for i, t in enumerate(ODD)}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é", max_size=40), min_size=1, max_size=20))
def test_counts_by_brute_force(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r["doc_id"]: tuple(r[f"_q_{c}"] for c in cols) for r in quality.with_counts(df).collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}


def prose(i, n=80):
    return " ".join(f"w{(i * 31 + k * k) % 997}" for k in range(n))


def test_cutoffs_follow_the_group_and_clean_rows_stay(spark, work):
    rows = [(i, prose(i), "en", "wiki", 0) for i in range(300)] + [(1000 + i, prose(i) + " # # #", "en", "code", 0) for i in range(300)]
    rows += [(2000, prose(1) + " #" * 60, "en", "wiki", 0), (2001, "short", "en", "wiki", 0), (2002, None, None, None, None), (2003, "a b c " * 60, "en", "wiki", 0)]
    df = spark.createDataFrame(rows, DOCS)
    kept = {r["doc_id"] for r in quality.keep_good(df, work).collect()}
    assert kept == {i for i in range(300)} | {1000 + i for i in range(300)}


def test_no_limit_is_fixed(spark, work):
    """What is ordinary in one source is odd in another, at any level; too few marks are odd as well."""
    def doc(i, marks, every=1):
        return " ".join(w + "#" * marks if k % every == 0 else w for k, w in enumerate(prose(i).split()))

    rows = [(i, doc(i, 1, 8), "en", "plain", 0) for i in range(300)] + [(1000 + i, doc(i, 3), "en", "tables", 0) for i in range(300)]
    rows += [(2000, doc(5, 3), "en", "plain", 0), (2001, doc(5, 1, 8), "en", "tables", 0), (2002, doc(6, 3), "en", "tables", 0)]
    rows += [(3000 + i, "".join("字" for _ in range(400 + i)) + " " + prose(i, 50), "zh", "plain", 0) for i in range(300)] + [(4000, "字" * 90_000 + " " + prose(7, 50), "zh", "plain", 0)]
    df = spark.createDataFrame(rows, DOCS)
    kept = {r["doc_id"] for r in quality.keep_good(df, work).collect()}
    assert kept == {*range(300), *range(1000, 1300), 2002, *range(3000, 3300)}


def test_bins_are_exact_below_2048_and_narrow_above(spark):
    values = [0, 1, 2047, 2048, 2049, 4095, 4096, 4097, 123_456_789, (1 << 40) + 12345]
    got = {r["v"]: r["b"] for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bin_of(F.col("v")).alias("b")).collect()}
    assert got == {v: v >> d << d for v in values for d in [max(v.bit_length() - 11, 0)]}


def test_text_of_many_megabytes(spark, work):
    text = prose(1, 600_000)
    df = spark.createDataFrame([(1, text, "en", "s", 0)], DOCS)
    r = quality.with_counts(df).first()
    assert (r["_q_n_words"], r["_q_n_repeat_words"]) == (600_000, counts(text)[4])


def test_quantiles_merge_to_those_of_all_rows(spark, work):
    rows = [(i, prose(i, 60 + i % 7) + " #" * (i % 5), "en", f"s{i % 3}", 0) for i in range(120)]
    df = quality.with_counts(spark.createDataFrame(rows, DOCS).withColumnsRenamed({"lang": "_q_lang", "source": "_q_source"}))
    df = df.select("*", *[c.alias(f"_q_{r}") for r, c in quality.ratios().items()])
    q = quality.quantiles(quality.sketch(df), []).filter("ratio = 'symbol_bp'").first()
    v = sorted(r["_q_symbol_bp"] for r in df.collect())
    assert (q["rows"], q["q1"], q["q3"]) == (120, v[29], v[89])


@pytest.mark.parametrize("stage", [quality.keep_good, line_dedup.dedup])
def test_empty_tables_repeated_rows_and_clashing_names(spark, work, stage):
    extra = "doc_id long, text string, lang string, source string, n_chars long, _lines int, _q_n_words string, h1 long, `a.b` int"
    assert stage(spark.createDataFrame([], extra), work).columns == ["doc_id", "text", "lang", "source", "n_chars", "_lines", "_q_n_words", "h1", "a.b"]
    rows = [(1, prose(1), "en", "s", 1, 7, "x", 9, 3)] * 2 + [(None, prose(2), None, None, None, None, None, None, None)]
    out = stage(spark.createDataFrame(rows, extra), work)
    assert out.count() == 3 and out.filter("_lines = 7 and h1 = 9 and `a.b` = 3 and _q_n_words = 'x'").count() == 2


def kept_lines(rows, least=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(SPACE).translate(low)
    order = lambda d: float("inf") if d is None else d
    owners: dict[str, set] = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            owners.setdefault(key(x), set()).add(order(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= least and len(owners[key(x)]) > 1 and order(d) > min(owners[key(x)]))]
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


LINES = [
    (5, "a line of words\nanother one here\nshort"),
    (3, "  A Line of WORDS \t\nshort\nown line here"),
    (9, "a line of words"),
    (9, "another one here\n\n"),
    (None, "own line here\nsomething else entirely"),
    (7, None),
    (8, ""),
    (2, "ÄÖÜ keeps its case\nx\nx"),
    (4, "äöü keeps its case\nmy my my my\nmy my my my"),
    (9, "a line of words"),
]


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (6, 3)])
def test_lines_by_brute_force(spark, work, batches, fanout):
    df = spark.createDataFrame(LINES, "doc_id long, text string")
    p = line_dedup.LineParams(batches=batches, fanout=fanout)
    out = line_dedup.drop_lines(df, work, p)
    n = F.size("_lines")
    got = out.select("doc_id", n.alias("n"), F.when(F.col("_kept").isNull(), 0).otherwise(n - F.size("_kept")).alias("g"), F.sha2(line_dedup.kept_text(F.coalesce("text", F.lit(""))), 256).alias("s")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, kept_lines(LINES)))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.lists(st.sampled_from(["common line one", "COMMON line ONE ", "second common line", "tiny", "", "öther line text"]), max_size=5).map("\n".join)), min_size=1, max_size=9))
def test_random_lines(spark, rows):
    from strandloom.workspace import Workspace

    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.drop_lines(df, Workspace(spark, "lines"), line_dedup.LineParams(batches=3, fanout=2))
    n = F.size("_lines")
    got = out.select("doc_id", n.alias("n"), F.when(F.col("_kept").isNull(), 0).otherwise(n - F.size("_kept")).alias("g"), F.sha2(line_dedup.kept_text(F.coalesce("text", F.lit(""))), 256).alias("s")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, kept_lines(rows)))


def test_runs_are_compacted_by_level(spark, work):
    runs = line_dedup.Runs(work, 2)
    for k in range(5):
        runs.add(spark.createDataFrame([(k, k, k)], "h1 long, h2 long, owner long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert sorted(r["owner"] for df in runs.all() for r in df.collect()) == list(range(5))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_are_read_as_they_lie(spark, work):
    """Above the scan of a run or of the batch's keys there is neither an exchange nor a sort."""
    runs = line_dedup.Runs(work, 4)
    for k in range(2):
        runs.add(spark.range(100 * k, 100 * k + 150).selectExpr("id AS h1", "id * 7 AS h2", "id AS owner"))
    keys = runs.write(spark.range(120, 400).selectExpr("id AS h1", "id * 7 AS h2", "id AS owner"))
    with line_dedup.sorted_scans(spark):
        new = runs.unseen(keys)
        plan = plan_of(new)
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan and "Sort [" not in plan
        assert {r["h1"] for r in new.collect()} == set(range(250, 400))


def test_a_later_batch_meets_the_runs(spark, work):
    rows = [r for r in LINES if r[0] is not None and r[0] != 9]
    first, later = [r for r in rows if r[0] <= 5], [r for r in rows if r[0] > 5]
    runs = line_dedup.Runs(work)
    got = []
    for part in (first, later, [(50, "own line here\nnew in this batch"), (51, "new in this BATCH\nshort")]):
        df = spark.createDataFrame([(*r, "x") for r in part], "doc_id long, text string, h1 string")
        got += [(r["doc_id"], r["text"]) for r in line_dedup.dedup_batch(df, runs).collect()]
    want = {d: "\n".join(x for x in (t or "").split("\n")) if t is not None else None for d, t in rows}
    texts = dict(got)
    assert texts[50] == "new in this batch" and texts[51] == "short" and set(texts) == set(want) | {50, 51}
    n = {d: (lines, lost) for d, lines, lost, _ in kept_lines(rows)}
    assert all(len((texts[d] or "").split("\n")) == max(n[d][0] - n[d][1], 1) for d in want)


def test_very_long_text_with_repeated_lines(spark, work):
    long = "\n".join(f"line number {i % 70_000} of a long text" for i in range(100_000))
    df = spark.createDataFrame([(1, long), (2, long + "\nits own last line")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup(df, work).collect()}
    assert out[1] == long and out[2] == "its own last line"
