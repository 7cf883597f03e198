"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Documents of equal text form a group. Each group starts as a partial partition: its bytes in one of ``shards``
slots, the rest empty. The two partial partitions of the largest spread are combined again and again, the fullest
slot of one with the emptiest of the other, until one is left. While there are more than ``final_items`` groups, this
runs on executors over hashed buckets of them, and the filled slots of a bucket's last partition are items of the next
level; one bucket of each level is left as it is. The last differencing, on the driver, has at most ``final_items`` items
and a bucket per level. It places coarse items first and closes the gaps with the small ones that were left, whose
bytes are about one composite per shard, so the balance is as fine as without buckets. Groups of more than
``1 / (8 * shards)`` of all bytes are kept for the last level, where they count at most ``8 * shards``; so one huge
group doesn't spoil a bucket. The fullest shard has at most 1.01 times the mean, or the heaviest group (tested).

Slots within a shard are numbered by prefix sums of counts per (chunk of written rows, shard), so no group is numbered in one task.

Defined cases: null text counts as empty and is equal to it; repeated rows are rows of their own in one group;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, input_partitions, ship, table, text_or_empty


@dataclass(frozen=True)
class ShardParams:
    shards: int = 40
    overhead: int = 16
    bucket_groups: int = 20_000
    final_items: int = 40_000


def differencing(sizes: Iterable[int], k: int) -> np.ndarray:
    """The slot, from 0 to k - 1, of each item; slots come in ascending order of load. Ties go by position."""
    sizes = np.asarray(list(sizes), dtype=np.int64)
    n = len(sizes)
    if n == 0:
        return np.zeros(0, dtype=np.int32)
    # a partial partition: loads in ascending order; its node remembers where its parts' slots went
    load: dict[int, np.ndarray] = {}
    part: list[tuple[int, int, np.ndarray, np.ndarray] | None] = [None] * n
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)

    def loads(i: int) -> np.ndarray:
        if i < n:
            out = np.zeros(k, dtype=np.int64)
            out[k - 1] = sizes[i]
            return out
        return load.pop(i)

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = loads(a) + loads(b)[::-1]
        order = np.argsort(both, kind="stable")
        both = both[order]
        rank = np.empty(k, dtype=np.int16)
        rank[order] = np.arange(k, dtype=np.int16)
        part.append((a, b, rank, rank[::-1]))
        load[len(part) - 1] = both - both[0]
        heapq.heappush(heap, (-int(both[-1] - both[0]), len(part) - 1))
    slot = np.zeros(n, dtype=np.int32)
    stack: list[tuple[int, np.ndarray]] = [(heap[0][1], np.arange(k, dtype=np.int16))]
    while stack:
        at, to = stack.pop()
        if at < n:
            slot[at] = to[k - 1]
        else:
            a, b, ra, rb = part[at]
            part[at] = None
            stack.append((a, to[ra]))
            stack.append((b, to[rb]))
    return slot


def _bucket(k: int):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable")
        return pd.DataFrame({"item": pdf["item"], "bytes": pdf["bytes"], "composite": pdf["bucket"] + "." + pd.Series(differencing(pdf["bytes"], k), index=pdf.index).astype(str)})

    return solve


def assign(groups: DataFrame, work: Workspace, params: ShardParams = ShardParams()) -> DataFrame:
    """(item string, bytes long) -> (item, shard int). Items must not look like composites, ``<level>:<bucket>.<slot>``."""
    k = params.shards
    at = groups.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")).first()
    n, rest, last, maps = at["n"], groups, None, []
    if n > params.final_items:
        heavy = at["b"] / (8 * k)
        last, rest = groups.filter(F.col("bytes") > heavy), groups.filter(F.col("bytes") <= heavy)
    while n > params.final_items:
        buckets, level = max(2, -(-n // params.bucket_groups)), len(maps)
        hashed = work.save(rest.select("item", "bytes", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(buckets)).alias("b")), f"hashed{level}")
        last = last.unionByName(hashed.filter("b = 0").select("item", "bytes"))
        named = hashed.filter("b > 0").select("item", "bytes", F.concat(F.lit(f"{level}:"), "b").alias("bucket"))
        placed = work.save(named.groupBy("bucket").applyInPandas(_bucket(k), "item string, bytes long, composite string"), f"level{level}")
        maps.append(placed.select("item", "composite"))
        rest = placed.groupBy(F.col("composite").alias("item")).agg(F.sum("bytes").alias("bytes"))
        before, n = n, rest.count()
        if n >= before:
            break
    final = (rest if last is None else last.unionByName(rest)).orderBy("item").toPandas()  # final_items, 8 * shards and a bucket per level at most
    slots = differencing(final["bytes"], k)
    spark = groups.sparkSession
    out = spark.createDataFrame(pd.DataFrame({"item": final["item"].astype(str), "shard": slots.astype("int32")}), "item string, shard int") if len(final) else spark.createDataFrame([], "item string, shard int")
    for level in range(len(maps) - 1, -1, -1):
        made = F.startswith("item", F.lit(f"{level}:"))
        down = maps[level].join(out.filter(made).withColumnRenamed("item", "composite"), "composite").select("item", "shard")
        out = down.unionByName(out.filter(~made))
    return out


def shard(docs: DataFrame, work: Workspace, params: ShardParams = ShardParams()) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of (doc_id, text)."""
    ship(docs.sparkSession)
    text = text_or_empty()
    rows = work.save(docs.select("doc_id", (F.octet_length(text) + params.overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("item")), "rows")
    groups = work.save(rows.groupBy("item").agg(F.sum("size").alias("bytes")), "groups")
    placed = rows.join(assign(groups, work, params), "item").select("doc_id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("seq"))
    placed = work.save(placed.withColumn("part", F.shiftright("seq", 16)), "placed")
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("base"))
    numbered = placed.select("*", (F.row_number().over(Window.partitionBy("part", "shard").orderBy("seq")) - 1).cast("long").alias("within"))
    return numbered.join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("within")).alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"), Workspace(spark, "op8"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
