"""MinHash near-duplicates, with candidates verified by odd sketches.

A text's set are its distinct shingles of words. Equal sets are one node, so copies are never compared. A node has
MinHash registers, cut into bands, and an odd sketch: every (register, value) toggles a bit of a bitmap, so that the
XOR of two sketches holds the registers in which the two differ, and its population count tells their number. For high
similarities few bits are set, few of them collide, and the estimate is precise; a candidate pair goes on only if it is
estimated near enough to the bound, and a link counts only if the full sets confirm it.

Candidates are nodes that share a band's bucket. First every node of a bucket meets the bucket's smallest node: pairs,
each kept once, are estimated and then confirmed next to the smaller node's set, in chunks. A bucket of two is done with
that, and what these links join needs no further comparison. Buckets whose other nodes are still in several components are
searched whole, in tiles of bounded size: the component with most nodes on one side, the others on both; a pair is
estimated in the tile of the first band that it shares only. Only nodes with a close partner get their sets, and a tile
links what isn't joined yet.

With 48 bands of 6 registers a pair at similarity 0.8 is missed by the bands with probability 5e-7, more similar ones
less; an estimate under 0.67 is 5 standard deviations away from 0.8.

Defined cases: null text is empty; text without words has an empty set, linked with nothing: it is its own component,
its doc_id; fewer words than a shingle's are one shingle; rows with a null doc_id keep their place, their component is
the smallest doc_id there is in it, null without any, and they aren't kept; repeated rows get equal results; an empty
table gives an empty result; other columns are not read. Sets hold 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.components import connected

from .collocations import seen
from .common import Workspace, ship, table


@dataclass(frozen=True)
class OddSketchParams:
    words: int = 2
    #: The least Jaccard similarity of a link, and the least estimate that is confirmed, in percent.
    similar_percent: int = 80
    estimate_percent: int = 67
    bands: int = 48
    band_rows: int = 6
    sketch_bits: int = 1024
    #: Partners that are confirmed together, and nodes of a tile's block.
    chunk: int = 16
    block: int = 128
    seed: int = 42
    #: Bits, as a power of two, of the bitmap that tells which texts are needed again: the bound of what is sent to the tasks.
    filter_bits: int = 26

    @property
    def registers(self) -> int:
        return self.bands * self.band_rows

    @property
    def most_bits(self) -> int:
        """The population count of an XOR at the least estimate."""
        differ = 2 * self.registers * (100 - self.estimate_percent) / 100
        return int(self.sketch_bits * (1 - (1 - 2 / self.sketch_bits) ** differ) / 2)


def shingles(text: str | None, words: int = 2) -> set[bytes]:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes, both act on ASCII only
    if len(w) < words:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*(w[k:] for k in range(words)))))


def hashed(grams: set[bytes], seed: int = 42) -> np.ndarray:
    """Distinct hashes in order."""
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(g, seed) for g in grams), dtype=np.uint64, count=len(grams)))


class MinHasher:
    def __init__(self, params: OddSketchParams):
        self.params = params
        rng = np.random.Generator(np.random.PCG64(params.seed))
        self.factor, self.shift = rng.integers(0, 1 << 32, size=(2, params.registers), dtype=np.uint32)
        self.factor |= np.uint32(1)
        self.salt = rng.integers(0, 1 << 64, size=params.registers, dtype=np.uint64)

    def registers(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(self.params.registers, ~np.uint32(0))
        high = (grams >> np.uint64(32)).astype(np.uint32)
        for s in range(0, len(high), 512):
            part = high[s : s + 512, None] * self.factor
            part += self.shift
            np.minimum(least, part.min(axis=0), out=least)
        return least

    def band_keys(self, registers: np.ndarray) -> np.ndarray:
        rows = registers.reshape(self.params.bands, self.params.band_rows)
        return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], dtype=np.uint64).view(np.int64)

    def odd_sketch(self, registers: np.ndarray) -> np.ndarray:
        """Bits that an odd number of (register, value) pairs fall on, as signed 64-bit words."""
        h = (registers ^ self.salt) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        odd = np.bincount((h >> np.uint64(40)).astype(np.int64) % self.params.sketch_bits, minlength=self.params.sketch_bits) & 1
        return np.packbits(odd.astype(bool)).view(np.int64)


def estimate(bits: int, params: OddSketchParams = OddSketchParams()) -> float:
    """Similarity by the population count of the XOR of two odd sketches."""
    share = 1 - 2 * bits / params.sketch_bits
    return 1 - log(max(share, 1e-9)) / log(1 - 2 / params.sketch_bits) / (2 * params.registers)


def _prints(params: OddSketchParams):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = MinHasher(params)
        for pdf in batches:
            n, digest, keys, sketch = [], [], [], []
            for text in pdf["text"]:
                grams = shingles(text, params.words)
                h = hashed(grams, params.seed)
                registers = hasher.registers(h)
                n.append(len(grams))
                digest.append(np.frombuffer(xxhash.xxh128_digest(h.tobytes()), dtype=np.int64))
                keys.append(hasher.band_keys(registers))
                sketch.append(hasher.odd_sketch(registers))
            digest = np.array(digest, dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame({"rid": pdf["rid"], "doc_id": pdf["doc_id"], "n": np.array(n, dtype=np.int64), "h1": digest[:, 0], "h2": digest[:, 1], "keys": keys, "sketch": sketch})

    return run


def _sets(params: OddSketchParams):
    """The text gives way to its set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="text").assign(grams=[hashed(shingles(t, params.words), params.seed).view(np.int64) for t in pdf["text"]])

    return run


def _bits_of(nodes: np.ndarray) -> np.ndarray:
    h = nodes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _node_words(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bits_of(batch.column(0).to_numpy()) & np.uint64(size - 1))
            yield pa.RecordBatch.from_pydict({"at": (at >> np.uint64(6)).astype(np.int64), "bits": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    return run


def _texts_of(nodes: DataFrame, texts: DataFrame, work: Workspace, params: OddSketchParams, name: str) -> DataFrame:
    """The rows (rid, text) of the nodes (node), and few others: so texts that nobody asks for aren't shuffled.

    The nodes are told by a bitmap of fixed size. The fuller it is, the more other rows pass; a join drops them."""
    words = nodes.select("node").mapInArrow(_node_words(1 << params.filter_bits), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(1 << (params.filter_bits - 6), dtype=np.uint64)
    bits[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    sent = texts.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(sent.value, dtype=np.uint64)
        for batch in batches:
            yield batch.filter(pa.array(seen(held, _bits_of(batch.column(0).to_numpy()))))

    return work.save(texts.mapInArrow(run, "rid long, text string"), name, "zstd")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def words_of(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64)


def close(sketch: np.ndarray, n: np.ndarray, root: np.ndarray, params: OddSketchParams) -> np.ndarray:
    """Which two rows of a tile are in different components and may be similar, by size and sketch."""
    bits = np.zeros((len(n), len(n)), dtype=np.int64)
    for w in np.ascontiguousarray(sketch.T).view(np.uint64):  # counts of signed numbers would be those of their absolute values
        bits += np.bitwise_count(w[:, None] ^ w[None, :])
    near = (bits <= params.most_bits) & (root[:, None] != root[None, :])
    return near & (100 * np.minimum(n[:, None], n[None, :]) >= params.similar_percent * np.maximum(n[:, None], n[None, :]))


def _estimated(params: OddSketchParams):
    """(tile, node, root, sketch, n) of a tile's rows that have a close partner of another component."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        near = close(words_of(pdf["sketch"]), pdf["n"].to_numpy(), pdf["root"].to_numpy(), params)
        keys, key = words_of(pdf["keys"]), pdf["key"].iloc[0]
        x, y = np.nonzero(np.triu(near))
        have = [np.zeros(0, np.int64)]
        for at in range(0, len(x), 8192):  # a slice of the pairs, so that their keys take little room
            i, j = x[at : at + 8192], y[at : at + 8192]
            first = keys[i, (keys[i] == keys[j]).argmax(axis=1)] == key
            have += [i[first], j[first]]
        have = np.unique(np.concatenate(have))
        return pdf.iloc[have][["tile", "node", "root", "sketch", "n"]]

    return run


def _link(params: OddSketchParams):
    """Links that span what a tile's sets join, beyond what is joined already."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        root, node, grams = pdf["root"].to_numpy(), pdf["node"].tolist(), pdf["grams"].tolist()
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for x, y in zip(*np.nonzero(np.triu(close(words_of(pdf["sketch"]), pdf["n"].to_numpy(), root, params)))):
            if find(int(root[x])) != find(int(root[y])) and similar(grams[x], grams[y], params.similar_percent):
                up[find(int(root[x]))] = find(int(root[y]))
                out.append((node[x], node[y]))
        return pd.DataFrame(np.array(out, dtype=np.int64).reshape(-1, 2), columns=["a", "b"])

    return run


def _xor_bits(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _star_links(nodes: DataFrame, shared: DataFrame, texts: DataFrame, work: Workspace, params: OddSketchParams) -> DataFrame:
    """(a, b): confirmed links between a bucket's smallest node and its others."""
    pairs = work.save(shared.filter("node <> a").select("a", F.col("node").alias("b")).distinct(), "pairs")
    side = lambda at: nodes.select(F.col("node").alias(at), F.col("n").alias(f"n_{at}"), F.col("sketch").alias(f"s_{at}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    fits = (100 * F.least("n_a", "n_b") >= params.similar_percent * F.greatest("n_a", "n_b")) & (_xor_bits("s_a", "s_b") <= params.most_bits)
    near = work.save(both.filter(fits).select("a", "b"), "near")
    chunks = near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / params.chunk).cast("int").alias("chunks"))
    near = work.save(near.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk")), "chunks")
    texts = _texts_of(near.select(F.explode(F.array("a", "b")).alias("node")), texts, work, params, "star_texts")
    one = near.select("a", "chunk").distinct().join(texts, F.col("a") == F.col("rid")).select("a", "chunk", "text")
    partners = near.join(texts, F.col("b") == F.col("rid")).select("a", "chunk", "b", "text")
    one = one.mapInPandas(_sets(params), "a long, chunk int, grams array<long>")
    partners = partners.mapInPandas(_sets(params), "a long, chunk int, b long, grams array<long>").withColumnRenamed("grams", "others")
    common = F.size(F.array_intersect("grams", "others"))
    alike = 100 * common >= params.similar_percent * (F.size("grams") + F.size("others") - common)
    links = work.save(partners.join(one, ["a", "chunk"]).filter(alike).select("a", "b"), "star")
    for name in ("star_texts", "pairs", "near", "chunks"):
        work.drop(name)
    return links


def _tile_links(nodes: DataFrame, shared: DataFrame, roots: DataFrame, texts: DataFrame, work: Workspace, params: OddSketchParams) -> DataFrame:
    """(a, b): confirmed links within the buckets whose nodes, the smallest aside, are in several components of (node, root)."""
    rooted = work.save(shared.filter("held > 2 and node <> a").select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "rooted")
    sizes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows"))
    mixed = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("all"), F.max(F.struct("rows", "root")).alias("most")).filter("parts > 1")
    blocks = lambda rows: F.ceil(rows / params.block).cast("int")
    mixed = mixed.select("key", F.col("most.root").alias("main"), (F.col("all") <= params.block).alias("small"), blocks(F.col("most.rows")).alias("mains"), blocks(F.col("all") - F.col("most.rows")).alias("others"))
    held = work.save(rooted.join(mixed, "key"), "mixed")
    # others meet others and the main component's nodes; those of the main component don't meet each other
    is_main = F.col("root") == F.col("main")
    at = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("i"), b.alias("j"))
    of_main = F.transform(up_to("others"), lambda i: cell("main", i, F.col("at")))
    of_other = F.concat(F.transform(up_to("others"), lambda i: cell("other", F.least(i, F.col("at")), F.greatest(i, F.col("at")))), F.transform(up_to("mains"), lambda j: cell("main", F.col("at"), j)))
    cells = F.when(F.col("small"), F.array(cell("all", F.lit(0), F.lit(0)))).when(is_main, of_main).otherwise(of_other)
    tiled = held.withColumn("at", at).select("key", "node", "root", F.explode(cells).alias("cell")).select(F.xxhash64("key", "cell.kind", "cell.i", "cell.j").alias("tile"), "key", "node", "root")
    tiled = tiled.join(nodes.select("node", "n", "keys", "sketch"), "node")
    near = tiled.groupBy("tile").applyInPandas(_estimated(params), "tile long, node long, root long, sketch array<long>, n long")
    near = work.save(near, "close")
    texts = _texts_of(near, texts, work, params, "tile_texts")
    full = near.join(texts, F.col("node") == F.col("rid")).select("tile", "node", "root", "sketch", "n", "text")
    full = full.mapInPandas(_sets(params), "tile long, node long, root long, sketch array<long>, n long, grams array<long>")
    return work.save(full.groupBy("tile").applyInPandas(_link(params), "a long, b long"), "tiles")


def near_duplicates(docs: DataFrame, work: Workspace, params: OddSketchParams = OddSketchParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of (doc_id, text)."""
    ship(docs.sparkSession)
    texts = work.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("rid")), "texts", "zstd")
    prints = texts.mapInPandas(_prints(params), "rid long, doc_id long, n long, h1 long, h2 long, keys array<long>, sketch array<long>")
    prints = work.save(prints, "prints")
    heads = prints.filter("n > 0").groupBy("h1", "h2").agg(F.min("rid").alias("node"), F.min("doc_id").alias("first"))
    nodes = work.save(heads.join(prints.select("rid", "n", "keys", "sketch"), F.col("node") == F.col("rid")).drop("rid"), "nodes")
    prints = work.save(prints.select("doc_id", "n", "h1", "h2"), "rows")
    work.drop("prints")  # bands and sketches are with the nodes, once for all copies
    dealt = nodes.select("node", F.explode("keys").alias("key"))
    least = dealt.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    shared = work.save(dealt.join(least, "key"), "shared")
    texts = texts.select("rid", "text")
    links = _star_links(nodes, shared, texts, work, params)
    roots = connected(links, work, "star")
    roots = work.save(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")
    more = _tile_links(nodes, shared, roots, texts, work, params)
    for name in ("texts", "tile_texts", "shared", "rooted", "mixed", "close"):
        work.drop(name)
    if not more.isEmpty():
        roots = connected(links.unionByName(more), work, "all")
        roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    rooted = work.save(nodes.select("node", "first", "h1", "h2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "whole")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = work.save(rooted.join(least, "root").select("h1", "h2", "component_id"), "components")
    full = prints.filter("n > 0").select("doc_id", "n", "h1", "h2").join(of, ["h1", "h2"]).select("doc_id", "n", "component_id")
    out = full.unionByName(prints.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark, "op13"))
