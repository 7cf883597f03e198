"""Line dedup against levelled sorted runs.

The documents come in batches of ascending doc_id. A batch's line keys, each with the smallest doc_id of the batch
that holds it, are anti-joined by merging with every run written so far: keys found there belong to an earlier
document, the others are new and become a run of level 0. When a level holds ``fanout`` runs they are merged into one
run of the next level, so a batch meets few runs and a key is rewritten once per level. The runs hold each key once,
with its owner; they are tables bucketed and sorted by key, so that a join reads them as they lie: only the batch's own
keys are shuffled and sorted. A batch's lines are settled by the time it is over: a line goes if its key is in an older
run, or in the batch under a smaller doc_id. :func:`dedup_batch` adds a batch to runs that exist.

Keys are 128 bits (two independent 64-bit hashes of the stripped, lower-cased line); the lines never travel in the
key shuffles. Hot keys are reduced to one row per task before they are shuffled, and the lines that go are found by
a join that AQE may split where a key is hot.

Defined cases: null text is empty; a null doc_id is one document that comes after all others; rows that repeat a
doc_id count as that one document, each keeping its own text; an empty table gives an empty result; other columns
are carried along whatever their names are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, input_partitions, table, text_or_empty

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STRIP = " \t\n\u000b\f\r"
#: Stands for a null doc_id: after every other.
_LAST = (1 << 63) - 1
#: Lets a scan of a bucketed table report that its buckets, one file each, are sorted.
_SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@dataclass(frozen=True)
class LineParams:
    min_chars: int = 10
    #: The least number of batches, and the documents from which there are more.
    batches: int = 3
    batch_docs: int = 500_000_000
    fanout: int = 2


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_STRIP)), _UPPER, _LOWER)


def owner_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(_LAST))


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_SORTED_SCANS, None)
    spark.conf.set(_SORTED_SCANS, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SORTED_SCANS)
        else:
            spark.conf.set(_SORTED_SCANS, before)


@dataclass
class Runs:
    """Sorted runs by level; each is a bucketed table (h1, h2, owner) whose files lie in the workspace."""

    work: Workspace
    fanout: int = 2
    levels: list[list[DataFrame]] = field(default_factory=lambda: [[]])
    written: int = 0
    buckets: int = 0

    def __post_init__(self):
        self.buckets = self.buckets or input_partitions(self.work.spark)
        self.name = f"strandloom_runs_{uuid.uuid4().hex}"

    def all(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def write(self, rows: DataFrame) -> DataFrame:
        """``rows`` as a table of one sorted file a bucket."""
        self.written += 1
        name = f"{self.name}_{self.written}"
        placed = rows.repartition(self.buckets, "h1", "h2").sortWithinPartitions("h1", "h2")
        with sorted_scans(self.work.spark):
            placed.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.work.path}/{name}").option("compression", "snappy").saveAsTable(name)
        self.work.tables.append(name)
        return self.work.spark.table(name)

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows of the bucketed table ``keys`` whose key is in no run: an anti-join by merging per run."""
        for run in self.all():
            keys = keys.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, rows: DataFrame) -> DataFrame:
        """Write new keys as a run and merge full levels; the run as it was written stays readable until the next call."""
        fresh = self.write(rows.select("h1", "h2", "owner"))
        self.levels[0].append(fresh)
        at = 0
        while len(self.levels[at]) >= self.fanout:
            merged = self.levels[at][0]
            for other in self.levels[at][1:]:
                merged = merged.unionByName(other)
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(self.write(merged))
            self.levels[at] = []
            at += 1
        return fresh


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Upper doc_ids (inclusive) of all batches but the last, from a quantile sketch of the ids."""
    if batches < 2:
        return []
    found = docs.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000).alias("q")).first()["q"]
    return sorted(set(found or []))


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(d, t, pos, h1, h2) of every line whose key is long enough; ``t`` tells the texts of a repeated doc_id apart."""
    text = text_or_empty()
    lines = docs.select(owner_id().alias("d"), F.xxhash64(text).alias("t"), F.posexplode(F.transform(F.split(text, "\n", -1), line_key)).alias("pos", "key")).filter(F.length("key") >= min_chars)
    return lines.select("d", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"))


def settle(batch: DataFrame, runs: Runs, last: bool = False) -> DataFrame:
    """(d, t, pos) of the batch's lines (d, t, pos, h1, h2) that go; its new keys become a run, but for the last batch."""
    firsts = runs.write(batch.groupBy("h1", "h2").agg(F.min("d").alias("owner"), F.max("d").alias("last")))
    with sorted_scans(runs.work.spark):
        if not runs.all():
            losers = firsts.select("h1", "h2", "owner", "last")
            if not last:
                runs.add(firsts)
        else:
            new = runs.unseen(firsts)
            new = runs.write(new) if last else runs.add(new)
            was = new.select("h1", "h2", F.col("owner").alias("first"))
            # a key without a first in this batch is in an older run
            losers = firsts.join(was.hint("merge"), ["h1", "h2"], "left").select("h1", "h2", F.coalesce("first", F.lit(-_LAST - 1)).alias("owner"), "last")
        losers = runs.work.save(losers.filter(F.col("owner") < F.col("last")).select("h1", "h2", "owner"), f"losers{runs.written}")
    return batch.join(losers, ["h1", "h2"]).filter(F.col("d") > F.col("owner")).select("d", "t", "pos")


def gone_positions(gone: DataFrame) -> DataFrame:
    """(d, t, gone): for each (document, text) with lines to drop, their positions from 0."""
    return gone.groupBy("d", "t").agg(F.collect_set("pos").alias("gone"))


def dropped_positions(docs: DataFrame, work: Workspace, params: LineParams = LineParams()) -> DataFrame:
    """(d, t, gone) of a whole table, in batches of ascending doc_id."""
    bounds = batch_bounds(docs, max(params.batches, -(-docs.count() // params.batch_docs)))
    number = F.lit(0)
    for b in bounds:
        number = number + F.when(F.col("d") > b, 1).otherwise(0)
    work.save(line_rows(docs, params.min_chars).withColumn("batch", number), "lines", by="batch")
    occ = work.open("lines", "d long, t long, pos int, h1 long, h2 long, batch int")
    runs, gone = Runs(work, params.fanout), None
    for k in range(len(bounds) + 1):
        one = settle(occ.filter(F.col("batch") == k).drop("batch"), runs, k == len(bounds))
        gone = one if gone is None else gone.unionByName(one)
    return work.save(gone_positions(gone), "gone")


def dedup_batch(docs: DataFrame, runs: Runs, params: LineParams = LineParams()) -> DataFrame:
    """``docs``, a further batch, without the lines that earlier batches of ``runs`` or smaller doc_ids of its own hold.

    Its new keys are added to the runs, which belong to earlier documents whatever their doc_ids are.
    """
    lines = runs.work.save(line_rows(docs, params.min_chars), f"lines{runs.written}")
    gone = runs.work.save(gone_positions(settle(lines, runs)), f"gone{runs.written}")
    return _with_text(docs, gone)


def drop_lines(docs: DataFrame, work: Workspace, params: LineParams = LineParams(), gone: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``_lines`` (all lines) and ``_kept`` (positions kept, ascending, or null for all)."""
    gone = dropped_positions(docs, work, params) if gone is None else gone
    held = docs.select("*", owner_id().alias("_d"), F.xxhash64(text_or_empty()).alias("_t"))
    both = held.join(gone.withColumnsRenamed({"d": "_gd", "t": "_gt", "gone": "_gone"}), (F.col("_d") == F.col("_gd")) & (F.col("_t") == F.col("_gt")), "left")
    split = both.select(*docs.columns, "_gone", F.split(text_or_empty(), "\n", -1).alias("_lines"))
    return split.select(*docs.columns, "_lines", F.when(F.col("_gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))).alias("_kept"))


def kept_text(original: Column) -> Column:
    return F.when(F.col("_kept").isNull(), original).otherwise(F.array_join(F.transform("_kept", lambda p: F.get(F.col("_lines"), p)), "\n"))


def _with_text(docs: DataFrame, gone: DataFrame | None, work: Workspace | None = None, params: LineParams = LineParams()) -> DataFrame:
    names = [f"_in_{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], "doc_id", "text")
    out = drop_lines(plain, work, params, gone)
    text = F.when(F.col("_kept").isNull(), F.col("text")).otherwise(kept_text(F.col("text")))
    out = out.select(*[(text if c == "text" else F.col(n)).alias(c) for c, n in zip(docs.columns, names)])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def dedup(docs: DataFrame, work: Workspace, params: LineParams = LineParams()) -> DataFrame:
    """``docs`` with the text that is left, and ``n_chars``, if there is one, counted again; a document left empty stays."""
    return _with_text(docs, None, work, params)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), Workspace(spark, "op6"))
    n = F.size("_lines")
    return out.select("doc_id", n.cast("long").alias("n_lines"), F.when(F.col("_kept").isNull(), 0).otherwise(n - F.size("_kept")).cast("long").alias("n_dropped"), F.sha2(kept_text(text_or_empty()), 256).alias("kept_sha256"))
