"""Byte-level BPE with a minimal acyclic transducer as its lexicon.

The units of all documents are counted, and the ``lexicon_words`` most frequent ones, with the ids that the merges
give them, are compiled into an acyclic automaton that shares prefixes and suffixes. Its arcs carry how many words
come before those behind them, so that the sum along a word's path is the word's number, which points to its ids.
The compiled file is a few flat arrays; it is sent to the executors, whose size is bounded by the parameter, and
memory-mapped there. Units that it lacks are merged exactly. Each worker keeps a bounded table of recent answers.

Decoding is its own step: from ids to bytes to text.

Defined cases: null text is empty, which has no ids and decodes to an empty text; special tokens spelled out in a
text are the special ids, as in the library; rows with a null doc_id and repeated rows are treated like others; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import struct
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, ship, table
from .packing import tokenizer_path
from .pretoken import byte_letters, byte_units, bytes_like


@dataclass(frozen=True)
class BpeParams:
    tokenizer: str = "byte_bpe_50k.json"
    lexicon_words: int = 65_536
    memo: int = 400_000
    count_table: int = 300_000


class Merges:
    """The tokenizer's own merges, for one unit at a time, and its vocabulary for decoding."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        path = tokenizer_path(name)
        whole = Tokenizer.from_file(path)
        self.model, self.splitter = whole.model, whole.pre_tokenizer
        self.latin = bytes_like(self.splitter)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.letters = {b: ch for b, ch in enumerate(byte_letters())}
        back = {ch: b for b, ch in enumerate(byte_letters())}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(back[ch] for ch in token) if all(ch in back for ch in token) else token.encode() for token, i in spec["model"]["vocab"].items()}
        self.bytes_of |= {i: token.encode() for token, i in self.specials.items()}

    def ids(self, unit: str) -> tuple[int, ...]:
        return tuple(t.id for t in self.model.tokenize(unit.encode("utf-8").decode("latin-1").translate(self.letters)))


@cache
def merges(name: str) -> Merges:
    return Merges(name)


class _Builder:
    """Minimal acyclic automaton of words added in sorted order: finished suffixes are looked up and shared."""

    def __init__(self):
        self.arcs: list[dict[int, int]] = [{}]
        self.final = [False]
        self.known: dict[tuple, int] = {}
        self.open: list[tuple[int, int, int]] = []  # (state, letter, child) of the last word that may still change
        self.last = b""

    def _close(self, keep: int) -> None:
        while len(self.open) > keep:
            state, letter, child = self.open.pop()
            key = (self.final[child], tuple(self.arcs[child].items()))
            self.arcs[state][letter] = self.known.setdefault(key, child)

    def add(self, word: bytes) -> None:
        same = os.path.commonprefix([word, self.last])
        self._close(len(same))
        at = self.open[-1][2] if self.open else 0
        for letter in word[len(same) :]:
            self.arcs.append({})
            self.final.append(False)
            child = len(self.arcs) - 1
            self.arcs[at][letter] = child
            self.open.append((at, letter, child))
            at = child
        self.final[at] = True
        self.last = word

    def compiled(self, outputs: list[tuple[int, ...]]) -> bytes:
        self._close(0)
        order, seen = [], set()
        stack = [0]
        while stack:  # states that are still reachable
            s = stack.pop()
            if s not in seen:
                seen.add(s)
                order.append(s)
                stack.extend(self.arcs[s].values())
        number = {s: k for k, s in enumerate(order)}
        below: dict[int, int] = {}

        def count(s: int) -> int:
            todo = [s]
            while todo:
                x = todo[-1]
                missing = [c for c in self.arcs[x].values() if c not in below]
                if x in below or not missing:
                    below[x] = self.final[x] + sum(below[c] for c in self.arcs[x].values())
                    todo.pop()
                else:
                    todo.extend(missing)
            return below[s]

        first, labels, target, skip = [0], bytearray(), [], []
        for s in order:
            count(s)
            passed = int(self.final[s])
            for letter, child in sorted(self.arcs[s].items()):
                labels.append(letter)
                target.append(number[child])
                skip.append(passed)
                passed += count(child)
            first.append(len(labels))
        final = bytes(self.final[s] for s in order)
        pool = list(chain.from_iterable(outputs))
        ends = np.cumsum([0, *map(len, outputs)])
        parts = [np.array(x, dtype="<u4").tobytes() for x in (first, target, skip, ends, pool)] + [final, bytes(labels)]
        return struct.pack("<7I", *map(len, parts)) + b"".join(parts)


class Lexicon:
    """The compiled automaton over a memory map."""

    def __init__(self, data):
        sizes, at, parts = struct.unpack_from("<7I", data, 0), 28, []
        view = memoryview(data)
        for k, n in enumerate(sizes):
            parts.append(view[at : at + n].cast("I") if k < 5 else at)
            at += n
        self.first, self.target, self.skip, self.ends, self.pool, self.final_at, self.labels_at = parts
        self.data = data

    def get(self, word: bytes) -> tuple[int, ...] | None:
        state = number = 0
        first, at, find = self.first, self.labels_at, self.data.find
        for letter in word:
            arc = find(letter.to_bytes(), at + first[state], at + first[state + 1])
            if arc < 0:
                return None
            number += self.skip[arc - at]
            state = self.target[arc - at]
        if not self.data[self.final_at + state]:
            return None
        return tuple(self.pool[self.ends[number] : self.ends[number + 1]])


def compile_lexicon(words: Iterable[str], name: str) -> bytes:
    """The automaton file of distinct words."""
    of, build, outputs = merges(name), _Builder(), []
    for w in sorted({w.encode("utf-8") for w in words}):
        build.add(w)
        outputs.append(of.ids(w.decode("utf-8")))
    return build.compiled(outputs)


@lru_cache(maxsize=2)
def _mapped(digest: str, held) -> Lexicon:
    """Write the broadcast file once per worker and map it."""
    with tempfile.NamedTemporaryFile(prefix=f"lexicon-{digest[:8]}-", delete=False) as f:
        f.write(held.value)
    with open(f.name, "rb") as g:
        data = mmap.mmap(g.fileno(), 0, access=mmap.ACCESS_READ)
    os.unlink(f.name)  # the map stays
    return Lexicon(data)


class Coder:
    """Encoder and decoder of whole texts."""

    def __init__(self, lexicon: Lexicon, name: str, memo: int):
        self.of = merges(name)
        of = self.of

        class Memo(dict):
            def __missing__(self, unit: str) -> tuple[int, ...]:
                out = lexicon.get(unit.encode("utf-8"))
                if out is None:
                    out = of.ids(unit)
                if len(self) >= memo:
                    self.clear()
                self[unit] = out
                return out

        self.memo = Memo()
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.of.specials, key=len, reverse=True))) + ")") if self.of.specials else None

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.of.specials):
            out: list[int] = []
            for k, part in enumerate(self.split.split(text)):
                out.extend([self.of.specials[part]] if k % 2 else chain.from_iterable(map(self.memo.__getitem__, byte_units(part, self.of.splitter, self.of.latin))))
            return out
        return list(chain.from_iterable(map(self.memo.__getitem__, byte_units(text, self.of.splitter, self.of.latin))))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.of.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _count_units(name: str, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, of = Counter(), merges(name)
        for pdf in batches:
            for t in pdf["text"]:
                held.update(byte_units(t or "", of.splitter, of.latin))
                if len(held) > most:
                    yield pd.DataFrame({"unit": list(held.keys()), "n": list(held.values())})
                    held.clear()
        if held:
            yield pd.DataFrame({"unit": list(held.keys()), "n": list(held.values())})

    return run


def frequent_units(docs: DataFrame, work: Workspace, params: BpeParams = BpeParams()) -> list[str]:
    """The units that all documents use most: all with a count from some level on, at most ``lexicon_words``.

    The level comes from a histogram of the counts' logarithms, so no more than the lexicon reaches the driver.
    """
    counts = docs.select("text").mapInPandas(_count_units(params.tokenizer, params.count_table), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    counts = work.save(counts.filter("n > 1").select("unit", F.floor(F.log2("n") * 16).cast("int").alias("level")), "units")
    level, left = None, params.lexicon_words
    for r in sorted(counts.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["level"]):
        left -= r["n"]
        if left < 0:
            break
        level = r["level"]
    return [r["unit"] for r in counts.filter(F.col("level") >= level).select("unit").collect()] if level is not None else []


_CODERS: dict[str, Coder] = {}


def _encode(held, digest: str, p: BpeParams):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if digest not in _CODERS:
            _CODERS.clear()
            _CODERS[digest] = Coder(_mapped(digest, held), p.tokenizer, p.memo)
        coder = _CODERS[digest]
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [np.array(coder.encode(t or ""), dtype=np.int32) for t in pdf["text"]]})

    return run


def _digest(held, digest: str, p: BpeParams):
    def sha(x: bytes) -> str:
        return hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if digest not in _CODERS:
            _CODERS.clear()
            _CODERS[digest] = Coder(_mapped(digest, held), p.tokenizer, p.memo)
        coder = _CODERS[digest]
        decimal = {i: str(i) for i in coder.of.bytes_of}
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                ids = coder.encode(t or "")
                rows.append((len(ids), sha(",".join(map(decimal.__getitem__, ids)).encode()), sha(coder.decode(ids).encode("utf-8", "surrogatepass"))))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    return run


def _lexicon_for(docs: DataFrame, params: BpeParams):
    spark = docs.sparkSession
    ship(spark)
    blob = compile_lexicon(frequent_units(docs, Workspace(spark, "bpe"), params), params.tokenizer)
    return spark.sparkContext.broadcast(blob), hashlib.sha256(blob).hexdigest()


def encode(docs: DataFrame, params: BpeParams = BpeParams()) -> DataFrame:
    """(doc_id, ids array<int>) of (doc_id, text)."""
    held, digest = _lexicon_for(docs, params)
    return docs.select("doc_id", "text").mapInPandas(_encode(held, digest, params), "doc_id long, ids array<int>")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = BpeParams()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held, digest = _lexicon_for(docs, p)
    return docs.mapInPandas(_digest(held, digest, p), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
