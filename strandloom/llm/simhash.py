"""SimHash near-duplicates through a Gray-order hierarchical index.

The distinct fingerprints are the nodes; only those are compared. Two fingerprints at most ``radius`` bits apart
agree on one of ``radius + 1`` bit blocks, so the top of the index are the shared patterns of a block: the
fingerprints are dealt to (block, pattern) nodes, patterns held by one fingerprint only are left out, and a node of
more than ``node_rows`` is factored again by the blocks of its free bits, up to three times; after that so few bits
are free that its size is bounded whatever the corpus. Below that, on the executors, a node's fingerprints are sorted
by Gray rank, which puts patterns with few differing bits side by side; consecutive runs make leaves and upper nodes,
each with the bits on which all its members agree, less those that its parent has factored out. A search adds up the
differences from node to node and leaves a whole group once they exceed the radius; it also takes a whole group at
once when even all its free bits couldn't exceed it. A task gives a spanning forest of the links it found, never all
pairs, and the forests' components are found by star contraction.

Defined cases: null text is empty; text without words has fingerprint zero, linked like any other; rows with a null
doc_id keep their place, and a component without any doc_id has a null component_id; repeated rows get equal
results; an empty table gives an empty result; other columns are not read.

:func:`keep_one` goes further, as close fingerprints neither find all similar texts nor only those: its candidates
are the index's groups and the texts that share a band of MinHash registers, and every link between two of them is
verified by the exact Jaccard similarity of their sets of shingles (as 64-bit hashes). Sixteen bands of four registers
miss a pair at similarity 0.8 with probability 0.0002, more similar ones less. Candidates that hang together meet in
tiles of bounded size, whatever the size of their group, and no candidate is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.components import connected

from .common import Workspace, ship, table


@dataclass(frozen=True)
class SimHashParams:
    words: int = 3
    radius: int = 2
    node_rows: int = 8192
    fan: int = 8
    seed: int = 42
    #: For :func:`keep_one`: the least Jaccard similarity, in percent, the MinHash bands, and the rows of a tile's block.
    similar_percent: int = 80
    bands: int = 16
    band_rows: int = 4
    block_rows: int = 512


def bits_of(hashes: list[int]) -> np.ndarray:
    """How many hashes have each of the 64 bits, highest bit first."""
    out = np.zeros(64, dtype=np.int64)
    for s in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[s : s + (1 << 16)], dtype=">u8")
        out += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return out


def shingle_hashes(text: str | None, words: int = 3, seed: int = 42) -> list[int]:
    """A hash per window of ``words`` words, or one of the whole where there are fewer."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes, both act on ASCII only
    if not w:
        return []
    h, join = xxhash.xxh64_intdigest, b" ".join
    return [h(join(w), seed)] if len(w) < words else [h(join(g), seed) for g in zip(*(w[k:] for k in range(words)))]


def simhash_of(hashes: list[int]) -> int:
    """As a signed 64-bit number; zero without hashes."""
    if not hashes:
        return 0
    set_bits = 2 * bits_of(hashes) > len(hashes)
    return int.from_bytes(np.packbits(set_bits).tobytes(), "big", signed=True)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """As a signed 64-bit number."""
    return simhash_of(shingle_hashes(text, words, seed))


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": np.array([fingerprint(t, words, seed) for t in pdf["text"]], dtype=np.int64)})

    return run


def shingle_set(hashes: list[int]) -> np.ndarray:
    """Distinct hashes in order."""
    return np.unique(np.array(hashes, dtype=np.uint64))


def band_keys(grams: np.ndarray, bands: int, rows: int, seed: int = 42) -> np.ndarray:
    """A key per band of MinHash registers of a set of hashes."""
    rng = np.random.Generator(np.random.PCG64(seed))
    factor, shift = rng.integers(0, 1 << 64, size=(2, bands * rows), dtype=np.uint64)
    factor |= np.uint64(1)
    least = np.full(bands * rows, ~np.uint64(0))
    for s in range(0, len(grams), 4096):
        least = np.minimum(least, (grams[s : s + 4096, None] * factor + shift).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(least[k * rows : (k + 1) * rows].tobytes(), k) for k in range(bands)], dtype=np.uint64).view(np.int64)


def _row_prints(params: SimHashParams):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp, h1, h2, keys = [], [], [], []
            for text in pdf["text"]:
                hashes = shingle_hashes(text, params.words, params.seed)
                grams = shingle_set(hashes)
                digest = np.frombuffer(xxhash.xxh128_digest(grams.tobytes()), dtype=np.int64)
                fp.append(simhash_of(hashes))
                h1.append(digest[0])
                h2.append(digest[1])
                keys.append(band_keys(grams, params.bands, params.band_rows))
            yield pd.DataFrame({"rid": pdf["rid"], "doc_id": pdf["_doc"], "fp": np.array(fp, dtype=np.int64), "h1": np.array(h1, dtype=np.int64), "h2": np.array(h2, dtype=np.int64), "keys": keys})

    return run


def _row_grams(params: SimHashParams):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            grams = [shingle_set(shingle_hashes(t, params.words, params.seed)).view(np.int64) for t in pdf["text"]]
            yield pdf.drop(columns="text").assign(grams=grams)

    return run


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Where a code stands in the reflected Gray sequence."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def cut_blocks(free: int, parts: int) -> list[int]:
    """Masks that cut the set bits of ``free`` into ``parts`` of nearly equal numbers, high bits first."""
    at = [b for b in range(63, -1, -1) if free >> b & 1]
    out, s = [], 0
    for p in range(parts):
        n = len(at) // parts + (p < len(at) % parts)
        out.append(sum(1 << b for b in at[s : s + n]))
        s += n
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class GrayIndex:
    """Hierarchical index over groups of fingerprints; a search stays in the query's own group."""

    def __init__(self, group: np.ndarray, codes: np.ndarray, fan: int = 8):
        order = np.lexsort((gray_rank(codes), group))
        self.codes, group = codes[order], group[order]
        # level 0: the codes themselves, which agree with themselves on all bits
        full = np.full(len(codes), ~np.uint64(0))
        self.pattern, self.mask, self.first, self.last = [self.codes], [full], [np.arange(len(codes))], [np.arange(len(codes)) + 1]
        self.span: list[tuple[np.ndarray, np.ndarray]] = [(np.arange(len(codes)), np.arange(len(codes)) + 1)]
        g = group
        while True:
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            sizes = np.diff(np.r_[starts, len(g)])
            if len(self.pattern) > 1 and sizes.max() == 1:
                break
            # runs of ``fan`` siblings within a group
            inside = np.arange(len(g)) - np.repeat(starts, sizes)
            head = np.flatnonzero(inside % fan == 0)
            ors, ands = np.bitwise_or.reduceat(self.pattern[-1], head), np.bitwise_and.reduceat(self.pattern[-1], head)
            mask = np.bitwise_and.reduceat(self.mask[-1], head) & ~(ors ^ ands)
            tail = np.r_[head[1:], len(g)]
            lo, hi = self.span[-1]
            self.span.append((lo[head], hi[tail - 1]))
            self.pattern.append(ands & mask)
            self.mask.append(mask)
            self.first.append(head)
            self.last.append(tail)
            g = g[head]
        self.roots, self.root_of = np.arange(len(g)), None
        lo, hi = self.span[-1]
        self.root_of = np.repeat(np.arange(len(g)), hi - lo)
        # what a node fixes beyond its parent
        self.own = [None] * len(self.mask)
        self.own[-1] = self.mask[-1]
        for k in range(len(self.mask) - 2, -1, -1):
            parent = np.repeat(np.arange(len(self.first[k + 1])), self.last[k + 1] - self.first[k + 1])
            self.own[k] = self.mask[k] & ~self.mask[k + 1][parent]

    def links(self, radius: int, batch: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, low, high): the query is within the radius of all codes from low to high, exclusive."""
        count = np.bitwise_count
        for s in range(0, len(self.codes), batch):
            q = np.arange(s, min(s + batch, len(self.codes)))
            node = self.root_of[q]
            acc = np.zeros(len(q), dtype=np.int64)
            for k in range(len(self.pattern) - 1, -1, -1):
                acc = acc + count((self.codes[q] ^ self.pattern[k][node]) & self.own[k][node])
                lo, hi = self.span[k][0][node], self.span[k][1][node]
                live = (acc <= radius) & (hi > q + 1)  # a link is found from its earlier end
                q, node, acc, lo, hi = q[live], node[live], acc[live], lo[live], hi[live]
                whole = acc + (64 - count(self.mask[k][node]).astype(np.int64)) <= radius
                if whole.any():
                    yield q[whole], lo[whole], hi[whole]
                    q, node, acc = q[~whole], node[~whole], acc[~whole]
                if k:
                    first, n = self.first[k][node], (self.last[k] - self.first[k])[node]
                    q, acc = np.repeat(q, n), np.repeat(acc, n)
                    node = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else node[:0]


def forest(group: np.ndarray, codes: np.ndarray, radius: int, fan: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Links (code, root) that span the components of each group."""
    index = GrayIndex(group, codes, fan)
    n = len(codes)
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for q, lo, hi in index.links(radius):
        for a, b, c in zip(q.tolist(), np.maximum(lo, q + 1).tolist(), hi.tolist()):
            ra = find(a)
            for x in range(b, c):
                rx = find(x)
                if rx != ra:
                    ra, other = (rx, ra) if rx < ra else (ra, rx)
                    up[other] = ra
    root = np.array([find(i) for i in range(n)], dtype=np.int64)
    linked = root != np.arange(n)
    return index.codes[linked], index.codes[root[linked]]


def _forests(radius: int, fan: int, chunk: int = 100_000):
    def solve(nodes: list[np.ndarray], codes: list[np.ndarray]) -> pd.DataFrame:
        a, b = forest(np.concatenate(nodes), np.concatenate(codes).view(np.uint64), radius, fan)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, codes, held = [], [], 0
        for pdf in batches:  # sorted by node: a node's rows are consecutive
            n, c = pdf["node"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64)
            if not len(n):
                continue
            if held >= chunk:
                cut = int(np.argmax(n != nodes[-1][-1])) if (n != nodes[-1][-1]).any() else len(n)
                nodes.append(n[:cut])
                codes.append(c[:cut])
                if cut < len(n):
                    yield solve(nodes, codes)
                    nodes, codes, held = [], [], 0
                n, c = n[cut:], c[cut:]
                if not len(n):
                    continue
            nodes.append(n)
            codes.append(c)
            held += len(n)
        if nodes:
            yield solve(nodes, codes)

    return run


def links(fps: DataFrame, work: Workspace, params: SimHashParams = SimHashParams()) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fps`` (fp) that keep every component whole."""
    parts = params.radius + 1
    masks = {(): cut_blocks((1 << 64) - 1, parts)}
    level = fps.select("fp", F.lit(0).alias("path"), F.lit(0).cast("long").alias("fixed"), F.lit(0).cast("long").alias("node"))
    ready = []
    paths: list[tuple[int, ...]] = [()]
    for depth in range(3):
        cut = [m for p in paths for m in cut_blocks(~sum(_mask_of(masks, p)) & ((1 << 64) - 1), parts)]
        for p, at in zip(paths, range(0, len(cut), parts)):
            masks[p] = cut[at : at + parts]
        table_of = F.array(*[F.lit(_signed(m)).cast("long") for m in cut])
        down = level.select("fp", "node", F.explode(F.array(*[(F.col("path") * parts + k).cast("int") for k in range(parts)])).alias("path"))
        down = down.select("fp", "path", F.xxhash64("node", "path", F.col("fp").bitwiseAND(F.get(table_of, F.col("path")))).alias("node"))
        sizes = down.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        met = work.save(down.join(sizes, "node").select("fp", "path", "node", "n"), f"index{depth}")
        small = met if depth == 2 else met.filter(F.col("n") <= params.node_rows)
        ready.append(small.select("node", "fp"))
        level = met.filter(F.col("n") > params.node_rows)
        paths = [(*p, k) for p in paths for k in range(parts)]
        if depth == 2 or level.isEmpty():
            break
    nodes = ready[0]
    for r in ready[1:]:
        nodes = nodes.unionByName(r)
    return nodes.repartition("node").sortWithinPartitions("node").mapInPandas(_forests(params.radius, params.fan), "a long, b long")


def _mask_of(masks: dict, path: tuple[int, ...]) -> list[int]:
    """The masks that a path has fixed."""
    return [masks[path[:k]][path[k]] for k in range(len(path))]


def fingerprints(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """(doc_id, fp) of every row of (doc_id, text)."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(_fingerprints(params.words, params.seed), "doc_id long, fp long")


def group_near(prints: DataFrame, work: Workspace, params: SimHashParams = SimHashParams(), component: str = "component_id") -> DataFrame:
    """(fp, component_id) of every distinct fingerprint of the written table (doc_id, fp).

    With ``component="root"``, (fp, root): the group's smallest fingerprint, which is there without any doc_id too.
    """
    nodes = work.save(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = connected(work.save(links(nodes.select("fp"), work, params), "links"), work)
    rooted = work.save(nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    if component == "root":
        return rooted.select("fp", "root")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "op10")
    prints = work.save(fingerprints(table(spark, sf_dir, "documents")), "prints")
    of = group_near(prints, work)
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def verified(node: list[int], block: list[int], keys: list[np.ndarray], grams: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that span the components of a tile, where a pair is linked that shares a key and is similar enough.

    If the tile has rows of two blocks, only pairs across them are tried; those within have tiles of their own.
    """
    n, across = len(node), len(set(block)) > 1
    up, tried, out = list(range(n)), set(), []

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def similar(x: int, y: int) -> bool:
        if (across and block[x] == block[y]) or (x, y) in tried:
            return False
        tried.update(((x, y), (y, x)))
        a, b = len(grams[x]), len(grams[y])
        if 100 * min(a, b) < percent * max(a, b):
            return False
        both = len(np.intersect1d(grams[x], grams[y], assume_unique=True))
        return 100 * both >= percent * (a + b - both)

    holders: dict[int, list[int]] = {}
    for x in range(n):
        for k in keys[x].tolist():
            holders.setdefault(k, []).append(x)
    for members in holders.values():
        parts: dict[int, list[int]] = {}
        for x in members if len(members) > 1 else ():
            for r, part in parts.items():
                if find(r) != find(x):
                    y = next((y for y in part if similar(x, y)), None)
                    if y is not None:
                        out.append((node[x], node[y]))
                        up[find(x)] = find(y)
            mine = [x]
            for r in [r for r in parts if find(r) == find(x)]:
                mine += parts.pop(r)
            parts[find(x)] = mine
    return out


def _verify(percent: int):
    def solve(held: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(held)
        got = verified(pdf["node"].tolist(), pdf["block"].tolist(), pdf["keys"].tolist(), pdf["grams"].tolist(), percent)
        return pd.DataFrame({"a": np.array([x for x, _ in got], dtype=np.int64), "b": np.array([y for _, y in got], dtype=np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:  # sorted by tile: a tile's rows are consecutive
            for tile, part in pdf.groupby("tile", sort=False):
                if held and held[-1]["tile"].iloc[-1] != tile:
                    yield solve(held)
                    held = []
                held.append(part)
        if held:
            yield solve(held)

    return run


def keep_one(docs: DataFrame, work: Workspace, params: SimHashParams = SimHashParams(words=5)) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the smallest doc_id, the first row if it is repeated."""
    ship(docs.sparkSession)
    names = [f"_in_{i}" for i in range(len(docs.columns))]
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], F.col("doc_id").cast("long").alias("_doc"), F.monotonically_increasing_id().alias("_rid"))
    held = work.save(held, "held", "zstd")
    text = F.col(names[docs.columns.index("text")]).alias("text")
    prints = work.save(held.select(F.col("_rid").alias("rid"), "_doc", text).mapInPandas(_row_prints(params), "rid long, doc_id long, fp long, h1 long, h2 long, keys array<long>"), "prints")
    # one row of all that have the same set
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("rid"))
    sets = prints.groupBy("h1", "h2").agg(F.min(order).alias("best"), F.min("fp").alias("fp"), F.first("keys").alias("keys"))
    sets = work.save(sets.select(F.col("best.rid").alias("node"), "best", "fp", "keys"), "sets")
    close = group_near(sets.select(F.col("node").alias("doc_id"), "fp"), work, params, component="root")
    keyed = work.save(sets.join(close, "fp").select("node", "best", F.concat("keys", F.array(F.xxhash64(F.lit("fingerprint"), "root"))).alias("keys")), "keyed")
    # candidates that hang together
    dealt = keyed.select("node", F.explode("keys").alias("key"))
    lead = dealt.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    of = connected(dealt.join(lead, "key").filter("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")), work, "met")
    of = of.unionByName(of.select(F.col("root").alias("node"), "root").distinct())
    sizes = of.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / params.block_rows).cast("int").alias("blocks"))
    tag = keyed.join(work.save(of.join(sizes, "root"), "groups"), "node", "left").select("node", "root", "blocks", F.when(F.col("root").isNotNull(), F.col("keys")).alias("keys"))
    tagged = work.save(held.join(tag, held._rid == tag.node), "tagged", "zstd")
    work.drop("held")
    # every two blocks of a group meet in a tile
    cand = tagged.filter(F.col("root").isNotNull())
    cand = cand.select("node", "root", "blocks", "keys", text).mapInPandas(_row_grams(params), "node long, root long, blocks int, keys array<long>, grams array<long>")
    cand = cand.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cand = cand.select("node", "root", "block", "keys", "grams", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cand = cand.select(F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), "node", "block", "keys", "grams")
    links = work.save(cand.repartition("tile").sortWithinPartitions("tile").mapInPandas(_verify(params.similar_percent), "a long, b long"), "verified")
    alike = connected(links, work, "alike")
    alike = work.save(alike.unionByName(alike.select(F.col("root").alias("node"), "root").distinct()).join(keyed.select("node", "best"), "node"), "alike")
    first = alike.groupBy("root").agg(F.min("best").alias("first"))
    losers = alike.join(first, "root").filter("best.rid <> first.rid").select("node")
    kept = tagged.filter(F.col("root").isNull()).unionByName(tagged.filter(F.col("root").isNotNull()).join(losers, "node", "left_anti"))
    return kept.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
