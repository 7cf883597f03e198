"""Phrases whose words keep company: exact counts of word n-grams, scored by their weakest cut.

Texts are cut into pieces at punctuation and line ends. Identical pieces become one row with a multiplicity, so copies
are counted, not read again. N-grams are counted level by level: a task adds up the weighted n-grams of its pieces, its
sums are shuffled to hash buckets, and in each bucket duckdb adds them out-of-core, under a memory limit, spilling to
the task's own folder, which goes with the task. Only phrases that reach ``least`` are of use, and all parts of such a
phrase reach it too; so between two levels the pieces shrink to the runs whose n-grams may still be frequent, told by a
bitmap of fixed size over the hashes of those that are. A bit set by another n-gram costs work, never a wrong result: what
counts is the exact sum of the strings.

A phrase's score needs the counts of both sides of each cut. They are looked up by requests, one row per side of a cut,
shuffled to where the counts of the parts are. As a part is at least as frequent as any phrase that holds it, a phrase
lies in a longer one with the same count only if it lies in one that is a word longer; so only those are compared.
Products are decimals of 38 digits, exact while ``1000 * a * n`` stays below 10**38; beyond that Spark raises an error.

Defined cases: a null text is empty; a null language is ``und``, together with a language of that name; texts without
words count nothing; repeated rows count each time; very long words, pieces and texts are ordinary keys; equal scores
go by count, then by the phrase's bytes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, ship, table, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COUNTS = "lang string, gram string, n long"
PIECES = "lang string, piece string, n long"


@dataclass(frozen=True)
class PhraseParams:
    longest: int = 5
    least: int = 100
    first: int = 2000
    #: Bits of the bitmap between levels, as a power of two; its size is the bound of what is sent to the tasks.
    filter_bits: int = 26
    #: Words that a task encodes at once, and the memory of a bucket's duckdb.
    chunk_words: int = 1_000_000
    bucket_memory: str = "192MB"


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, n): distinct pieces, words joined by one space, with their multiplicities."""
    low = F.translate(text_or_empty(), UPPER, LOWER)
    cut = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(low, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    bare = cut.select("lang", F.btrim(F.regexp_replace("piece", r"[\x20\x09]+", " ")).alias("piece")).filter("piece <> ''")
    return bare.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("n"))


class Encoded:
    """Words of a chunk of (lang, piece or gram, n) rows as codes, with the row that each belongs to."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches).combine_chunks()
        lang, piece, self.n = (rows.column(k).combine_chunks() for k in range(3))
        self.n = self.n.to_numpy()
        lang, words = lang.dictionary_encode(), pc.split_pattern(piece, " ")
        self.lang, self.langs = lang.indices.to_numpy(), lang.dictionary
        size = pc.list_value_length(words).to_numpy().astype(np.int64)
        words = words.flatten().dictionary_encode()
        self.code, self.unique = words.indices.to_numpy().astype(np.int64), words.dictionary
        self.row = np.repeat(np.arange(len(size)), size)
        self.end = np.repeat(np.cumsum(size), size)

    def starts(self, m: int) -> np.ndarray:
        """Where an n-gram of ``m`` words begins."""
        return np.flatnonzero(np.arange(len(self.code)) + m <= self.end)

    def phrases(self, first: np.ndarray, size: np.ndarray, n: np.ndarray, name: str) -> pa.RecordBatch:
        """(lang, name, n): the words from each place on, joined by spaces."""
        upto = np.cumsum(size)
        at = np.repeat(first - np.r_[0, upto[:-1]], size) + np.arange(upto[-1] if len(upto) else 0)
        words = pa.ListArray.from_arrays(pa.array(np.r_[0, upto], pa.int32()), self.unique.take(pa.array(self.code[at])))
        lang = self.langs.take(pa.array(self.lang[self.row[first]]))
        return pa.RecordBatch.from_arrays([lang, pc.binary_join(words, " "), pa.array(n, pa.int64())], ["lang", name, "n"])

    def sums(self, m: int) -> pa.RecordBatch:
        """Weighted counts of the chunk's n-grams of ``m`` words."""
        at = self.starts(m)
        key = self.lang[self.row[at]].astype(np.int64)
        for j in range(m):
            key = pd.factorize(key * len(self.unique) + self.code[at + j])[0]
        first = np.zeros(key.max(initial=-1) + 1, dtype=np.int64)
        first[key[::-1]] = at[::-1]
        total = np.zeros(len(first), dtype=np.int64)
        np.add.at(total, key, self.n[self.row[at]])
        return self.phrases(first, np.full(len(first), m), total, "gram")

    def hashes(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """(where, hash) of the n-grams of ``m`` words."""
        at = self.starts(m)
        word, lang = (np.array([xxhash.xxh64_intdigest(w, seed) for w in x.cast(pa.binary()).to_pylist()], dtype=np.uint64) for seed, x in enumerate((self.unique, self.langs)))
        h = lang[self.lang[self.row[at]]]
        for j in range(m):
            h = (h ^ word[self.code[at + j]]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return at, h

    def runs(self, m: int, bits: np.ndarray) -> pa.RecordBatch:
        """The longest stretches of at least ``m + 1`` words whose n-grams of ``m`` words are all in the bitmap."""
        at, h = self.hashes(m)
        at = at[seen(bits, h)]
        # consecutive places of one row belong together; a stretch of one n-gram holds none of ``m + 1`` words
        apart = (np.diff(at) > 1) | (np.diff(self.row[at]) > 0)
        s, e = np.flatnonzero(np.r_[True, apart]), np.flatnonzero(np.r_[apart, True])
        s, e = (at[s], at[e]) if len(at) else (at, at)
        s, e = s[e > s], e[e > s]
        return self.phrases(s, e - s + m, self.n[self.row[s]], "piece")


def seen(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(64 * len(bits) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _chunks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[Encoded]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
        if size >= 6 * words:  # about
            yield Encoded(held)
            held, size = [], 0
    if held:
        yield Encoded(held)


def _sums(m: int, words: int):
    return lambda batches: (c.sums(m) for c in _chunks(batches, words))


def _runs(m: int, words: int, bits):
    return lambda batches: (c.runs(m, np.frombuffer(bits.value, dtype=np.uint64)) for c in _chunks(batches, words))


def _bitmap_words(m: int, size: int, words: int):
    """(at, bits): the 64-bit words of the bitmap that a task's n-grams set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, words):
            _, h = c.hashes(m)
            at = np.unique(h & np.uint64(size - 1))
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else word
            yield pa.RecordBatch.from_pydict({"at": word[first], "bits": np.bitwise_or.reduceat(bit, first).view(np.int64) if len(word) else word})

    return run


def bitmap(grams: DataFrame, m: int, power: int, chunk_words: int) -> bytes:
    """Hashes of the (lang, gram, n) rows as a bitmap; its size doesn't depend on their number."""
    words = grams.mapInArrow(_bitmap_words(m, 1 << power, chunk_words), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << (power - 6), dtype=np.uint64)
    out[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out.tobytes()


def _add_up(least: int, memory: str):
    """Sums of a hash bucket's partial counts, by duckdb, of those that reach ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next(batches, None)
        if first is None:
            return
        with tempfile.TemporaryDirectory(prefix="bucket-") as spill, duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": spill}) as con:
            bucket = pa.RecordBatchReader.from_batches(first.schema, chain([first], batches))
            con.register("bucket", bucket)
            sums = con.sql(f"SELECT lang, gram, CAST(sum(n) AS BIGINT) AS n FROM bucket GROUP BY lang, gram HAVING sum(n) >= {int(least)}")
            yield from sums.to_arrow_reader(10_000)

    return run


def frequent(rows: DataFrame, m: int, params: PhraseParams) -> DataFrame:
    """(lang, gram, n) of the n-grams of ``m`` words in (lang, piece, n) rows, with n of at least ``least``."""
    partial = rows.mapInArrow(_sums(m, params.chunk_words), COUNTS)
    return partial.repartition("lang", "gram").mapInArrow(_add_up(params.least, params.bucket_memory), COUNTS)


def part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def phrases(docs: DataFrame, work: Workspace, params: PhraseParams = PhraseParams()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language of (lang, text) rows."""
    spark = docs.sparkSession
    ship(spark)
    rows = work.save(pieces(docs), "pieces", "zstd")
    words = F.length("piece") - F.length(F.replace("piece", F.lit(" "))) + 1
    total = work.save(rows.groupBy("lang").agg(F.sum(F.col("n") * words).alias("total")), "totals")
    levels = []
    for m in range(1, params.longest + 1):
        if m > 1:
            bits = spark.sparkContext.broadcast(bitmap(levels[-1], m - 1, params.filter_bits, params.chunk_words))
            rows = work.save(rows.mapInArrow(_runs(m - 1, params.chunk_words, bits), PIECES), f"runs{m}", "zstd")
            work.drop(f"runs{m - 1}" if m > 2 else "pieces")
        levels.append(work.save(frequent(rows, m, params), f"counts{m}"))
        if levels[-1].isEmpty():
            break
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    held = counts.withColumn("w", F.split("gram", " ")).filter(F.size("w") > 1).select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), "w")
    # requests for both sides of each cut go to where the counts of the parts are
    cuts = held.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    left, right = part(F.col("w"), F.lit(1), F.col("k")), part(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k"))
    asked = cuts.select("lang", "phrase", "a", "k", F.posexplode(F.array(left, right)).alias("side", "gram"))
    sides = asked.join(counts, ["lang", "gram"]).groupBy("lang", "phrase", "k").agg(F.max("a").alias("a"), *[F.max(F.when(F.col("side") == i, F.col("n"))).alias(c) for i, c in enumerate("lr")])
    sides = work.save(sides, "cuts").join(total, "lang")
    score = F.expr("(CAST(1000 AS DECIMAL(38, 0)) * CAST(a AS DECIMAL(38, 0)) * CAST(total AS DECIMAL(38, 0))) DIV (CAST(l AS DECIMAL(38, 0)) * CAST(r AS DECIMAL(38, 0)))")
    worst = sides.select("lang", "phrase", "a", "total", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("total").alias("total"), F.min("cut").alias("cut"))
    # phrases a word longer with the same count take the place of their parts
    n = F.size("w")
    inside = held.filter(n > 2).select("lang", F.col("a").alias("longer"), F.explode(F.array(part(F.col("w"), F.lit(1), n - 1), part(F.col("w"), F.lit(2), n - 1))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = worst.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    by = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= params.first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), F.col("cut.score").alias("score"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"), Workspace(spark, "op12"))
