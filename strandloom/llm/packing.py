"""Packing by concatenation and cuts.

First pass: each task tokenizes its documents, ends each with the end id, and writes for every document its ids and
its offset within the task; the tasks' totals, one number each, get a prefix sum, which turns these offsets into
global ones. Second pass: the one long sequence is cut at every multiple of the length. A document that lies across
a cut gives a record on either side of it. Only the very last sequence can be short.

Ids come from a table of the units met so far, kept by the worker process and cleared at a fixed size; a unit that
isn't in it goes through the tokenizer itself.

Defined cases: null and empty texts are a document of the end id alone; rows with a null doc_id and repeated rows
are packed like others; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, ship, table
from .pretoken import is_latin, words, words_like


@dataclass(frozen=True)
class PackParams:
    tokenizer: str = "word_bpe_49k.json"
    length: int = 2048
    end_id: int = 1
    memo: int = 600_000
    #: Tasks of the first pass up to which their offsets, 12 bytes each, are broadcast.
    broadcast_parts: int = 1_000_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


class WordTokenizer:
    """Ids of whole texts, as the library gives them, as little-endian bytes of ``width``."""

    def __init__(self, name: str, memo: int, width: str = "<u2"):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.model = Tokenizer.from_file(tokenizer_path(name))
        self.splitter = self.model.pre_tokenizer
        self.latin = words_like(self.splitter, self.model.normalizer.normalize_str)
        self.specials = [t.content for t in self.model.get_added_tokens_decoder().values()]
        if self.model.get_vocab_size() > np.iinfo(np.dtype(width)).max:
            width = "<u4"
        self.width, self.most = width, memo
        known = self
        model = self.model

        class Memo(dict):
            def __missing__(self, unit: str) -> bytes:
                out = np.array(model.encode(unit, add_special_tokens=False).ids, dtype=known.width).tobytes()
                if len(self) >= known.most:
                    self.clear()
                self[unit] = out
                return out

        self.memo = Memo()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype=self.width).tobytes()
        plain = text.lower() if self.latin and is_latin(text) else self.model.normalizer.normalize_str(text)
        return b"".join(map(self.memo.__getitem__, words(plain, self.splitter, self.latin)))


@cache
def _worker_tokenizer(name: str, memo: int) -> WordTokenizer:
    return WordTokenizer(name, memo)


def _tokenize(p: PackParams):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _worker_tokenizer(p.tokenizer, p.memo)
        end = np.array([p.end_id], dtype=encode.width).tobytes()
        part, at, size = TaskContext.get().partitionId(), 0, np.dtype(encode.width).itemsize
        for pdf in batches:
            ids = [encode(t or "") + end for t in pdf["text"]]
            n = np.array([len(x) // size for x in ids], dtype=np.int64)
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "part": np.full(len(n), part, dtype=np.int32), "before": before, "n": n, "width": size, "ids": ids})

    return run


def _cut(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for doc, at, n, width, ids in zip(pdf["doc_id"], pdf["at"].tolist(), pdf["n"].tolist(), pdf["width"].tolist(), pdf["ids"]):
                wide = np.frombuffer(ids, dtype=f"<u{width}").astype("<u4")
                s = 0
                while s < n:
                    seq, off = divmod(at + s, length)
                    e = min(n, s + length - off)
                    rows.append((doc, s, e - s, zlib.crc32(wide[s:e].tobytes()), n, seq, off))
                    s = e
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]).astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, work: Workspace, params: PackParams = PackParams()) -> DataFrame:
    """One row per piece of (doc_id, text) rows."""
    ship(docs.sparkSession)
    tokens = work.save(docs.select("doc_id", "text").mapInPandas(_tokenize(params), "doc_id long, part int, before long, n long, width int, ids binary"), "tokens")
    totals = work.save(tokens.groupBy("part").agg(F.sum("n").alias("total")), "totals")  # a row per task of the first pass
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    if totals.count() <= params.broadcast_parts:  # so the ids needn't be shuffled
        base = F.broadcast(base)
    placed = tokens.join(base, "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "n", "width", "ids")
    return placed.mapInPandas(_cut(params.length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), Workspace(spark, "op3"))
