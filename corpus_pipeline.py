"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; what it decides takes
effect in its result. All but the last return the columns of ``documents``. Null texts fail the quality rules; later
stages take them as empty, keep rows with a null doc_id and give an empty result for an empty table. Working tables of a
stage are dropped once its result is written.

No SQL is given for the whole: near-duplicates need XXH64 and components, packing needs a tokenizer. The stages are
tested against brute force instead, one by one and together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import line_dedup, packing, pii, quality, simhash
from strandloom.llm.common import Workspace, table
from strandloom.workspace import passing


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the fixed rules or their group's cut-offs go."""
    return quality.keep_good(docs, Workspace(spark, "stage-quality"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller doc_id has too go; a document that is left empty stays."""
    return line_dedup.dedup(docs, Workspace(spark, "stage-lines"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by shingles of five words at a Jaccard similarity of 0.8, the smallest doc_id stays."""
    return simhash.keep_one(docs, Workspace(spark, "stage-near"), simhash.SimHashParams(words=5))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind in brackets."""
    return pii.redact(docs, Workspace(spark, "stage-pii"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence."""
    return packing.pack(docs, Workspace(spark, "stage-pack"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with passing():
            docs = work.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            work.drop(f"stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
