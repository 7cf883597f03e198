"""Quality rules whose cut-offs follow the corpus.

Every document gets five ratios in integer units. For each ratio, a quantile sketch is kept per (language, source):
a histogram of the documents that pass the fixed base rules, in bins of one unit below 2048 and of at most a thousandth
of the value above, so that sketches merge by adding counts, in any order, and have a bounded number of bins whatever
the corpus. The upper limit of a group is ``q3 + spread * width`` of the rows above zero, as most documents have no symbols,
repeated lines or repeated words at all and quartiles of zeros say nothing. The ratios in ``TWO_SIDED`` have the lower limit
``q1 - spread * width`` of all rows too. The width is ``q3 - q1``, at least a twentieth of q3. No limit is fixed: a
group with fewer than ``min_group`` such rows uses the sketch of its language, and a language with fewer than
that the sketch of everything; both are sums of the sketches below them. A ratio that is zero everywhere has no
limit. The documents are then joined with the limits of their group and filtered. Everything on this path is
DataFrame functions.

Defined cases: null text counts as no words; null language or source is a group of its own; repeated rows are
judged one by one; an empty table gives an empty result; a group without any document that passes the base rules has
null limits; columns of the input that share a name with ours are not touched by :func:`keep_good`, which returns
the input's columns only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, table, text_or_empty, words_of

#: The ratios: symbols, and characters that are neither letters nor digits, per character of a word; repeated lines per
#: line; repeated words per word (all in basis points); characters per word (in hundredths).
RATIOS = ("symbol_bp", "mark_bp", "dup_line_bp", "repeat_bp", "word_len_pc")
#: Ratios that every text has some of, so that too little is odd as well.
TWO_SIDED = ("mark_bp", "word_len_pc")
#: Values below 2 ** this have bins of their own; above it, bins keep this many leading binary digits.
BIN_DIGITS = 11


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    spread: int = 6
    #: The quartiles are taken to be at least this part of the upper one apart.
    least_width: int = 20
    min_group: int = 200
    #: Groups up to which the table of cut-offs, some 100 bytes each, is broadcast; more of them are joined by a shuffle.
    broadcast_groups: int = 100_000


def with_counts(docs: DataFrame, prefix: str = "_q_") -> DataFrame:
    """Add the base counts of every whole text as columns ``<prefix>n_words`` and so on."""
    p = prefix
    text = text_or_empty()
    a = docs.select("*", words_of(text).alias(f"{p}w"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(f"{p}l"), F.size(F.regexp_extract_all(text, F.lit(r"[#*$%&|<>]"), 0)).cast("long").alias(f"{p}n_symbols"), F.length(F.regexp_replace(text, r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+", "")).cast("long").alias(f"{p}n_marks"))
    w = F.col(f"{p}w")
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))
    b = a.select(
        "*",
        F.size(w).cast("long").alias(f"{p}n_words"),
        F.length(F.array_join(w, "")).cast("long").alias(f"{p}word_chars"),
        F.size(f"{p}l").cast("long").alias(f"{p}n_lines"),
        (F.size(f"{p}l") - F.size(F.array_distinct(f"{p}l"))).cast("long").alias(f"{p}n_dup_lines"),
        F.when(F.size(w) >= 4, F.array_sort(grams)).alias(f"{p}s"),
    ).drop(f"{p}w", f"{p}l")
    s = F.col(f"{p}s")
    # in sorted order, equal windows are neighbours; the start of each window that has an equal one
    again = F.filter(s, lambda x, k: x["g"].eqNullSafe(F.get(s, k - 1)["g"]) | x["g"].eqNullSafe(F.get(s, k + 1)["g"]))
    c = b.select("*", F.array_sort(F.transform(again, lambda x: x["i"])).alias(f"{p}d")).drop(f"{p}s")
    d = F.col(f"{p}d")
    covered = F.aggregate(F.transform(d, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(d, k + 1) - x, F.lit(3)))), F.lit(0), lambda acc, x: acc + x)
    return c.select("*", F.coalesce(covered, F.lit(0)).cast("long").alias(f"{p}n_repeat_words")).drop(f"{p}d")


def ratios(prefix: str = "_q_") -> dict[str, Column]:
    """The ratios as whole numbers, rounded down."""
    n = lambda name: F.col(f"{prefix}{name}")
    over = lambda a, b, scale: F.when(b > 0, (scale * a - F.pmod(scale * a, b)) / b).otherwise(0).cast("long")
    return {
        "symbol_bp": over(n("n_symbols"), n("word_chars"), 10_000),
        "mark_bp": over(n("n_marks"), n("word_chars"), 10_000),
        "dup_line_bp": over(n("n_dup_lines"), n("n_lines"), 10_000),
        "repeat_bp": over(n("n_repeat_words"), n("n_words"), 10_000),
        "word_len_pc": over(n("word_chars"), n("n_words"), 100),
    }


def bin_of(value: Column) -> Column:
    """The least value of the bin that holds ``value``: its leading BIN_DIGITS binary digits."""
    drop = F.greatest(F.length(F.bin(value)) - BIN_DIGITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketch(scored: DataFrame, lang: str = "_q_lang", source: str = "_q_source") -> DataFrame:
    """Mergeable sketches: (lang, source, ratio, bin, n). Partial sums are made before the one small shuffle."""
    long = scored.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), bin_of(F.col(f"_q_{r}")).alias("bin")) for r in RATIOS])).alias("x"))
    return long.groupBy("lang", "source", "x.ratio", "x.bin").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """q1 and q3 of each (keys, ratio): the smallest bin that holds the quarter, or three quarters, of the rows."""
    merged = sketches.groupBy(*keys, "ratio", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "ratio")
    run = merged.select(*keys, "ratio", "bin", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("rows"))
    return run.groupBy(*keys, "ratio").agg(F.max("rows").alias("rows"), F.min(F.when(F.col("upto") * 4 >= F.col("rows"), F.col("bin"))).alias("q1"), F.min(F.when(F.col("upto") * 4 >= F.col("rows") * 3, F.col("bin"))).alias("q3"))


def fences(sketches: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """(lang, source, ratio, low, high): the fences around the quartiles of each group, or of what stands in for it."""
    named = lambda df, p: df.withColumnsRenamed({c: f"{p}_{c}" for c in df.columns})
    fine, by_lang, of_all = named(quantiles(sketches, ["lang", "source"]), "f"), named(quantiles(sketches, ["lang"]), "l"), named(quantiles(sketches, []), "a")
    groups = sketches.select("lang", "source").distinct().join(F.broadcast(sketches.sparkSession.createDataFrame([(r,) for r in RATIOS], "ratio string")))
    j = groups.join(fine, groups.lang.eqNullSafe(fine.f_lang) & groups.source.eqNullSafe(fine.f_source) & (groups.ratio == fine.f_ratio), "left")
    j = j.join(by_lang, j.lang.eqNullSafe(by_lang.l_lang) & (j.ratio == by_lang.l_ratio), "left").join(of_all, j.ratio == of_all.a_ratio, "left")
    pick = lambda q: F.when(F.col("f_rows") >= params.min_group, F.col(f"f_{q}")).when(F.col("l_rows") >= params.min_group, F.col(f"l_{q}")).otherwise(F.col(f"a_{q}"))
    q = j.select("lang", "source", "ratio", pick("q1").alias("q1"), pick("q3").alias("q3"))
    least = ((F.col("q3") - F.pmod(F.col("q3"), F.lit(params.least_width))) / params.least_width).cast("long")
    width = params.spread * F.greatest(F.col("q3") - F.col("q1"), least)
    return q.select("lang", "source", "ratio", (F.col("q1") - width).alias("low"), (F.col("q3") + width).alias("high"))


def thresholds(sketches: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """One row per (lang, source): max_<ratio>, and min_<ratio> of the two-sided ones."""
    both = fences(sketches.filter("bin > 0"), params).select("lang", "source", F.concat(F.lit("max_"), "ratio").alias("limit"), F.col("high").alias("value"))
    both = both.unionByName(fences(sketches, params).select("lang", "source", F.concat(F.lit("min_"), "ratio").alias("limit"), F.col("low").alias("value")))
    names = [f"max_{r}" for r in RATIOS] + [f"min_{r}" for r in TWO_SIDED]
    return both.groupBy("lang", "source").agg(*[F.max(F.when(F.col("limit") == n, F.col("value"))).alias(n) for n in names])


def judge(docs: DataFrame, work: Workspace, columns: list[str], params: QualityParams = QualityParams()) -> DataFrame:
    """``columns`` of ``docs`` with counts, ratios, limits, ``_q_base_failed`` and ``_q_kept``.

    ``docs`` needs text, lang and source. The counted table is written once and read twice.
    """
    rename = docs.select(*[F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(columns)], F.col("lang").alias("_q_lang"), F.col("source").alias("_q_source"), "text")
    scored = with_counts(rename).drop("text")
    failed = (F.col("_q_n_words") < params.min_words) | (100 * F.col("_q_n_repeat_words") > params.max_repeat_percent * F.col("_q_n_words"))
    scored = scored.select("*", *[c.alias(f"_q_{r}") for r, c in ratios().items()], failed.alias("_q_base_failed"))
    scored = work.save(scored, "scored")
    limits = work.save(thresholds(sketch(scored.filter("not _q_base_failed")), params), "limits")
    if limits.count() <= params.broadcast_groups:
        limits = F.broadcast(limits)
    joined = scored.join(limits, scored._q_lang.eqNullSafe(limits.lang) & scored._q_source.eqNullSafe(limits.source), "left").drop("lang", "source")
    within = F.lit(True)
    for r in RATIOS:
        within = within & F.coalesce(F.col(f"_q_{r}") <= F.col(f"max_{r}"), F.lit(True))
    for r in TWO_SIDED:
        within = within & F.coalesce(F.col(f"_q_{r}") >= F.col(f"min_{r}"), F.lit(True))
    return joined.select("*", (~F.col("_q_base_failed") & within).alias("_q_kept"))


def keep_good(docs: DataFrame, work: Workspace, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    out = judge(docs, work, docs.columns, params).filter("_q_kept")
    return out.select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(docs.columns)])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the contract, and the ratios and limits that decided."""
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), Workspace(spark, "op2"), ["doc_id"])
    return judged.select(F.col("_in_0").alias("doc_id"), *[F.col(f"_q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"), *[F.col(f"_q_{r}").alias(r) for r in RATIOS], *[F.col(f"max_{r}") for r in RATIOS], *[F.col(f"min_{r}") for r in TWO_SIDED])
