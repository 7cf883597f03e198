"""Hard negatives by branch-and-bound in ball trees.

Candidates are cut into blocks of bounded size, and a block's rows of each label make a ball tree of their own: a node
holds a centre and a radius, so the inner product of an anchor with any of its rows lies within ``|anchor| * radius`` of
the product with the centre. A search goes down from the roots with the anchors that still need a node: an anchor leaves
a node whose upper bound is below the score window or strictly beneath the k-th best score found so far (a tie may still
win by its id), or whose lower bound is above the window. What is left at a leaf is scored exactly.

Anchors and candidates meet in blocks, twice: for each anchor's first rows of its own label (the positives), then,
within the window that each positive sets, for the first rows of other labels. Blocks' lists are merged by a window of
at most ``k`` rows a block. No table is broadcast, and no task holds more than two blocks.

Defined cases: rows with a null vec_id or label, a null vector or one with a null or non-finite component take no part;
vectors of differing lengths count missing components as zero; scores stay at the limits of 64 bits where they would
pass them; of rows that repeat an anchor's vec_id the one with the smallest label and vector is the anchor, and none of
them is its positive or negative; other rows that repeat a vec_id are rows of their own; an anchor without positives, or
a positive with a negative score, has no negatives, as its window is empty; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, ship, table
from .topk import dense

LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass(frozen=True)
class NegativeParams:
    scale: int = 256
    anchor_step: int = 50
    positives: int = 5
    negatives: int = 3
    #: The window of a negative's score, in percent of the positive's.
    least_percent: int = 50
    most_percent: int = 95
    anchor_block: int = 2048
    candidate_block: int = 8192
    leaf_rows: int = 64


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices, held at the limits of 64 bits."""
    most = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (a, b)]
    if most[0] * most[1] * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, MOST).astype(np.int64)


class BallForest:
    """A ball tree per label of a block of (id, label, integer vector) rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, leaf: int = 64):
        order = np.lexsort((ids, labels))
        self.ids, self.rows = ids[order], rows[order]
        self.at = self.rows.astype(np.float64)
        labels = labels[order]
        self.roots: list[tuple[int, int]] = []
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[tuple[int, ...]] = []
        starts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]]) if len(labels) else []
        for lo, hi in zip(starts, [*starts[1:], len(labels)]):
            self.roots.append((int(labels[lo]), self._grow(int(lo), int(hi), leaf)))
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def _grow(self, lo: int, hi: int, leaf: int) -> int:
        """A node over the rows from lo to hi, cut in halves along the widest component until a leaf is small enough."""
        first = len(self.span)
        todo = [(lo, hi, -1)]
        while todo:
            lo, hi, parent = todo.pop()
            me = len(self.span)
            if parent >= 0:
                self.children[parent] += (me,)
            points = self.at[lo:hi]
            centre = points.mean(axis=0)
            self.centre.append(centre)
            self.radius.append(float(np.sqrt(((points - centre) ** 2).sum(axis=1).max())))
            self.span.append((lo, hi))
            self.children.append(())
            if hi - lo > leaf and self.radius[-1] > 0:
                axis = int(np.ptp(points, axis=0).argmax()) if points.shape[1] else 0
                part = np.argsort(points[:, axis], kind="stable")
                for x in (self.ids, self.rows, self.at):
                    x[lo:hi] = x[lo:hi][part]
                mid = (lo + hi) // 2
                todo += [(mid, hi, me), (lo, mid, me)]
        return first

    def search(self, anchors: "Anchors", wanted: list[int], k: int) -> None:
        """Put into ``anchors`` their k best rows, within their windows, of the trees that ``wanted`` names."""
        reach = np.sqrt((anchors.at**2).sum(axis=1))
        todo = [(node, np.arange(len(reach))) for node in wanted]
        while todo:
            node, who = todo.pop()
            mid, spread = anchors.at[who] @ self.centre[node], reach[who] * self.radius[node]
            slack = 1e-9 * reach[who] * (np.sqrt((self.centre[node] ** 2).sum()) + self.radius[node])
            high, low = (np.clip(x, -(2.0**63), 2.0**63)[:, None] for x in (mid + spread + slack, mid - spread - slack))
            need = ((high >= anchors.lo[who]) & (low <= anchors.hi[who]) & (high >= anchors.kth[who])).any(axis=1)
            who, mid = who[need], mid[need]
            if not len(who):
                continue
            if self.children[node]:
                # the child nearer to the anchors is searched first, so that the k-th best rises early
                todo += sorted(((c, who) for c in self.children[node]), key=lambda x: float((anchors.at[who] @ self.centre[x[0]]).mean()))
            else:
                lo, hi = self.span[node]
                anchors.offer(who, self.ids[lo:hi], products(anchors.rows[who], self.rows[lo:hi]), k)


class Anchors:
    """Anchors with windows, and the best rows found for each window: scores descending, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int):
        self.ids, self.rows, self.at, self.lo, self.hi = ids, rows, rows.astype(np.float64), lo, hi
        self.kth = np.full(lo.shape, LEAST)
        self.score = np.full((*lo.shape, k), LEAST)
        self.id = np.full((*lo.shape, k), MOST)
        self.full = np.zeros((*lo.shape, k), dtype=bool)

    def offer(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
        other = ids[None, :] != self.ids[who][:, None]
        for w in range(self.lo.shape[1]):
            fits = other & (scores >= self.lo[who, w][:, None]) & (scores <= self.hi[who, w][:, None]) & (scores >= self.kth[who, w][:, None])
            for i in np.flatnonzero(fits.any(axis=1)):
                a, new = who[i], fits[i]
                s, d = np.r_[self.score[a, w][self.full[a, w]], scores[i][new]], np.r_[self.id[a, w][self.full[a, w]], ids[new]]
                top = np.lexsort((d, ~s))[:k]
                n = len(top)
                self.score[a, w, :n], self.id[a, w, :n], self.full[a, w, :n] = s[top], d[top], True
                if n == k:
                    self.kth[a, w] = s[top[-1]]


def _meet(params: NegativeParams, same: bool):
    """Best rows of a block for a block of anchors: of their own label, or of others within each anchor's windows."""
    k = params.positives if same else params.negatives

    def meet(key, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"anchor_id": [], "place": [], "vec_id": [], "score": []}
        if len(anchors) and len(rows):
            width = max(len(x) for w in (anchors["w"], rows["w"]) for x in w)
            q, c = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (dense(anchors["w"].tolist()), dense(rows["w"].tolist())))
            forest = BallForest(rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), c, params.leaf_rows)
            labels = anchors["label"].to_numpy(np.int64)
            for label in np.unique(labels):
                at = np.flatnonzero(labels == label)
                part = anchors.iloc[at]
                n = max(1, max(len(x) for x in part["lo"]))
                lo, hi = np.full((len(at), n), LEAST), np.full((len(at), n), LEAST)
                for i, (x, y) in enumerate(zip(part["lo"], part["hi"])):
                    lo[i, : len(x)], hi[i, : len(y)] = x, y
                    lo[i, len(x) :] = MOST  # no row fits where there are fewer windows
                none = lo > hi
                lo[none], hi[none] = MOST, LEAST
                held = Anchors(part["vec_id"].to_numpy(np.int64), q[at], lo, hi, k)
                forest.search(held, [root for of, root in forest.roots if (of == label) == same], k)
                a, w, r = np.nonzero(held.full)
                for name, x in (("anchor_id", held.ids[a]), ("place", w), ("vec_id", held.id[a, w, r]), ("score", held.score[a, w, r])):
                    out[name].append(x)
        return pd.DataFrame({name: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for name, x in out.items()})

    return meet


def _best(anchors: DataFrame, rows: DataFrame, params: NegativeParams, same: bool) -> DataFrame:
    """(anchor_id, place, rank, vec_id, score): the first rows of each anchor (vec_id, label, w, lo, hi) and window."""
    na, nr = (max(1, -(-df.count() // size)) for df, size in ((anchors, params.anchor_block), (rows, params.candidate_block)))
    block = lambda n, *by: F.pmod(F.xxhash64(F.lit("block"), *by), F.lit(n)).cast("int")
    left = anchors.select("vec_id", "label", "w", "lo", "hi", block(na, "vec_id").alias("ab"), F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("rb"))
    # new names: anchors may come from the same columns
    right = rows.select(*[F.col(c).alias(c) for c in ("vec_id", "label", "w")], block(nr, "vec_id", "w").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(na - 1))).alias("ab"))
    met = left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInPandas(_meet(params, same), "anchor_id long, place long, vec_id long, score long")
    w = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= (params.positives if same else params.negatives))


def labelled(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, w): label and integer components of the rows that take part."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("w"))


def mine(rows: DataFrame, anchors: DataFrame, work: Workspace, params: NegativeParams = NegativeParams()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of written (vec_id, label, w) tables."""
    ship(rows.sparkSession)
    anchors = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "w")).alias("first")).select("vec_id", "first.label", "first.w")
    bound = lambda x: F.array(F.lit(x).cast("long"))
    found = _best(anchors.withColumns({"lo": bound(LEAST), "hi": bound(MOST)}), rows, params, same=True)
    found = work.save(found.select("anchor_id", "rank", "vec_id", "score"), "positives")
    score = F.col("score").cast("decimal(38,0)")  # so that no product passes the limits
    window = found.withColumns({"lo": F.ceil(score * params.least_percent / 100), "hi": F.floor(score * params.most_percent / 100)})
    window = window.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "lo", "hi", "vec_id", "score"))).alias("p"))  # at most `positives` rows
    held = anchors.join(window, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "w", F.col("p.lo").cast("array<long>").alias("lo"), F.col("p.hi").cast("array<long>").alias("hi"))
    best = _best(held, rows, params, same=False)
    of = found.select("anchor_id", (F.col("rank") - 1).cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return best.join(of, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = NegativeParams()
    work = Workspace(spark, "op11")
    rows = labelled(table(spark, sf_dir, "embeddings"), p.scale)
    rows = work.save(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))), "rows")
    return mine(rows, rows.filter(F.col("vec_id") % p.anchor_step == 0), work, p)
