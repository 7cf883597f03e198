"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Candidates are cut into blocks of bounded size, and for each block its postings are built: for every term (vector
position) the rows with a weight and the weights. A block of sparse query rows scatters ``query weight * posting
weight`` into a dense array of scores, one term after another; a partition selection then keeps each query's k best
of the block, ties to the smaller vec_id, and the blocks' lists are merged. Queries and candidates meet in blocks:
each query block is sent to each candidate block once, so no table is broadcast and no task holds more than two
blocks and one row of scores.

Defined cases: vectors that are null, hold a null or a non-finite component, or have a null vec_id take no part;
vectors of differing lengths count missing components as zero; of rows that repeat a query's vec_id, the one with
the smallest vector is the query, and none of them is its candidate; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, ship, table


@dataclass(frozen=True)
class TopKParams:
    k: int = 20
    scale: int = 64
    query_step: int = 20
    query_block: int = 4096
    candidate_block: int = 8192


def quantised(vectors: DataFrame, scale: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, w): integer components of the rows that take part."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("w"))


def weight_type(*blocks: np.ndarray) -> type:
    """The narrowest integers that hold every sum of products of two blocks."""
    most = [int(np.abs(b).max(initial=0)) for b in blocks]
    return np.int32 if most[0] * most[1] * max(b.shape[1] for b in blocks) < 2**31 else np.int64


def dense(rows: list) -> np.ndarray:
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Postings:
    """Term -> (rows, weights) of a block of candidates in ascending order of id."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, kind: type):
        order = np.argsort(ids, kind="stable")
        self.ids, self.kind = ids[order], kind
        self.terms = []
        for column in weights[order].T:
            at = np.flatnonzero(column)
            self.terms.append((None if len(at) == len(column) else at, column[at].astype(kind)))

    def accumulate(self, query: np.ndarray, scores: np.ndarray, spare: np.ndarray) -> None:
        """Scatter the weighted postings of one query's terms into ``scores``."""
        scores.fill(0)
        for t in np.flatnonzero(query[: len(self.terms)]):
            rows, weights = self.terms[t]
            product = np.multiply(weights, query[t], out=spare[: len(weights)])
            if rows is None:
                scores += product
            else:
                scores[rows] += product


def best_of_block(qid: np.ndarray, queries: np.ndarray, block: Postings, k: int) -> pd.DataFrame:
    """Each query's k best of the block, ties to the smaller id."""
    n = len(block.ids)
    scores, spare = np.empty(n, dtype=block.kind), np.empty(n, dtype=block.kind)
    queries = queries.astype(block.kind)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for q, query in zip(qid, queries):
        block.accumulate(query, scores, spare)
        lo, hi = np.searchsorted(block.ids, q, "left"), np.searchsorted(block.ids, q, "right")
        left = n - (hi - lo)  # the query's own rows take no part
        if left <= k:
            at = np.r_[0:lo, hi:n]
        else:
            np.copyto(spare, scores)
            spare[lo:hi] = np.iinfo(block.kind).min
            bar = np.partition(spare, n - k)[n - k]
            above, equal = np.flatnonzero(spare > bar), np.flatnonzero(spare == bar)
            at = np.concatenate([above, equal[(equal < lo) | (equal >= hi)][: k - len(above)]])
        out.append((at, scores[at].astype(np.int64)))
    at = np.concatenate([a for a, _ in out])
    return pd.DataFrame({"query_id": np.repeat(qid, [len(a) for a, _ in out]), "vec_id": block.ids[at], "score": np.concatenate([s for _, s in out])})


def _meet(k: int):
    def meet(key, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        q, c = dense(queries["w"].tolist()), dense(candidates["w"].tolist())
        block = Postings(candidates["vec_id"].to_numpy(), c, weight_type(q, c))
        return best_of_block(queries["vec_id"].to_numpy(), q, block, k)

    return meet


def search(queries: DataFrame, candidates: DataFrame, params: TopKParams = TopKParams()) -> DataFrame:
    """(query_id, rank, vec_id, score) of (vec_id, w) queries against (vec_id, w) candidates."""
    ship(candidates.sparkSession)
    queries = queries.groupBy("vec_id").agg(F.min("w").alias("w"))
    nq, nc = (max(1, -(-df.count() // size)) for df, size in ((queries, params.query_block), (candidates, params.candidate_block)))
    block = lambda n, seed, *more: F.pmod(F.xxhash64(F.lit(seed), "vec_id", *more), F.lit(n)).cast("int")
    left = queries.select("vec_id", "w", block(nq, "q").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("cb"))
    # new names: queries may come from the same columns
    right = candidates.select(F.col("vec_id").alias("vec_id"), F.col("w").alias("w"), block(nc, "c", "w").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))
    met = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(_meet(params.k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.select("query_id", F.row_number().over(w).alias("rank"), "vec_id", "score").filter(F.col("rank") <= params.k)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = TopKParams()
    vectors = Workspace(spark, "op7").save(quantised(table(spark, sf_dir, "embeddings"), p.scale), "vectors")
    return search(vectors.filter(F.col("vec_id") % p.query_step == 0), vectors, p)
