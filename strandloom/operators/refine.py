"""Refining bins: a length-aware model of abundance, recruitment, merging, splitting, rescue.

members(bin, seq, length, y[S]): y is the log depth per sample. Long forms are (bin, seq, length, k, y).
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions import arrays as A
from strandloom.functions.stats import chi2_critical
from strandloom.workspace import Workspace

from .alignments import ranked
from .components import connected


def log_depth(depth: Column) -> Column:
    return F.transform(depth, lambda x: F.log(x + 1.0))


def long_form(members: DataFrame) -> DataFrame:
    return members.select("bin", "seq", "length", F.posexplode("y").alias("k", "y"))


def fit_variance(long: DataFrame, least: int = 8) -> DataFrame:
    """(k, a, b): variance of y as a + b / length, per sample.

    Squared residuals against the bin's mean are regressed on 1 / length by five sums; then once more without those
    above three sigma of the first fit. All members count, where a sample would be taken on one machine.
    """
    g = long.groupBy("bin", "k").agg(F.avg("y").alias("mu"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    r = long.join(g, ["bin", "k"]).select("k", (1.0 / F.greatest(F.col("length"), F.lit(1))).alias("x"), (F.pow(F.col("y") - F.col("mu"), F.lit(2)) * F.col("n") / (F.col("n") - 1)).alias("d2"))

    def solve(rows: DataFrame) -> DataFrame:
        s = rows.groupBy("k").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum("d2").alias("sd"), F.sum(F.col("d2") * F.col("x")).alias("sdx"))
        det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
        a0 = F.when(F.abs(det) > 1e-30, (F.col("sd") * F.col("sxx") - F.col("sdx") * F.col("sx")) / det).otherwise(F.lit(0.0))
        b0 = F.when(F.abs(det) > 1e-30, (F.col("n") * F.col("sdx") - F.col("sx") * F.col("sd")) / det).otherwise(F.lit(0.0))
        a = F.when(F.col("n") < 4, F.lit(1e-4)).when(a0 > 0, a0).otherwise(F.col("sd") / F.col("n"))
        b = F.when((F.col("n") < 4) | (a0 <= 0), F.lit(0.0)).otherwise(F.greatest(b0, F.lit(0.0)))
        return s.select("k", F.greatest(a, F.lit(1e-6)).alias("a"), b.alias("b"))

    first = solve(r).withColumnsRenamed({"a": "a1", "b": "b1"})
    kept = r.join(first, "k").filter(F.col("d2") <= 9.0 * (F.col("a1") + F.col("b1") * F.col("x"))).select("k", "x", "d2")
    second = solve(kept)
    none = first.join(second, "k", "left_anti").select("k", F.lit(1e-4).alias("a"), F.lit(0.0).alias("b"))
    return second.unionByName(none)


def weighted(long: DataFrame, model: DataFrame) -> DataFrame:
    """Long rows with ``v``, the variance that the model gives them."""
    return long.join(F.broadcast(model), "k").withColumn("v", F.col("a") + F.col("b") / F.greatest(F.col("length"), F.lit(1))).drop("a", "b")  # a row per sample


def sufficient(long: DataFrame, model: DataFrame) -> DataFrame:
    """(bin, k, w, z): sums of 1 / variance and of y / variance; they add up when bins merge."""
    return weighted(long, model).filter("v > 1e-12").groupBy("bin", "k").agg(F.sum(1 / F.col("v")).alias("w"), F.sum(F.col("y") / F.col("v")).alias("z"))


def _unique_pass(best_t2: float, samples: int):
    """Arrow kernel: contigs against a block of bins; counts the bins that a contig is consistent with."""
    def run(key, contigs: pd.DataFrame, bins: pd.DataFrame) -> pd.DataFrame:
        if not len(contigs) or not len(bins):
            return pd.DataFrame({"seq": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "bin": pd.Series([], dtype=object)})
        y, v = np.stack(contigs["y"].tolist()), np.stack(contigs["v"].tolist())
        mu, iw = np.stack(bins["mu"].tolist()), np.stack(bins["iw"].tolist())
        t2 = np.zeros((len(y), len(mu)))
        for k in range(samples):
            d = y[:, k, None] - mu[None, :, k]
            t2 += d * d / (v[:, k, None] + iw[None, :, k])
        ok = t2 <= best_t2
        n = ok.sum(axis=1)
        return pd.DataFrame({"seq": contigs["seq"].to_numpy()[n > 0], "n": n[n > 0].astype(np.int64), "bin": bins["bin"].to_numpy()[ok.argmax(axis=1)[n > 0]]})

    return run


def recruit_by_abundance(candidates: DataFrame, bins: DataFrame, model: DataFrame, samples: int, alpha: float = 0.05, block: int = 4096) -> DataFrame:
    """(seq, bin): candidates (seq long, length, y[]) consistent with exactly one bin's (bin, k, w, z) profile.

    Candidates stay where they are dealt; bins, which are few next to contigs, are sent to every block of candidates.
    """
    crit = chi2_critical(samples, alpha)
    kind = dict(bins.dtypes)["bin"]
    profile = bins.groupBy("bin").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", (F.col("z") / F.col("w")).alias("mu"), (1 / F.col("w")).alias("iw")))), lambda s: s).alias("p")).filter(F.size("p") == samples)
    profile = profile.select("bin", F.col("p.mu").alias("mu"), F.col("p.iw").alias("iw"))
    vs = model.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "a", "b"))), lambda s: s).alias("m"))  # one row
    c = candidates.join(F.broadcast(vs)).select("seq", "y", F.transform("m", lambda s: s["a"] + s["b"] / F.greatest(F.col("length"), F.lit(1))).alias("v"))
    blocks = max(1, -(-c.count() // block))
    dealt = c.withColumn("b", F.pmod(F.xxhash64("seq"), F.lit(blocks)))
    sent = profile.select("bin", "mu", "iw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))
    hits = dealt.groupBy("b").cogroup(sent.groupBy("b")).applyInPandas(_unique_pass(crit, samples), f"seq long, n long, bin {kind}")
    return hits.filter("n = 1").select("seq", "bin")


def frozen_cores(members: DataFrame, least: int = 10) -> DataFrame:
    """(bin, tau, mean[]): mean unit vector and mean pairwise correlation of bins (bin, seq, unit[]) of ``least`` or more.

    The mean over pairs comes from vector sums, (|sum|^2 - sum of squares) / (n (n - 1)): no pair is made.
    """
    g = members.select("bin", "seq", F.posexplode("unit").alias("k", "u")).groupBy("bin", "k").agg(F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("q"), F.count(F.lit(1)).alias("n"))
    t = g.groupBy("bin").agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("q"), F.transform(F.array_sort(F.collect_list(F.struct("k", "s", "n"))), lambda x: x["s"] / x["n"]).alias("mean"))
    return t.filter(F.col("n") >= least).select("bin", F.col("n").alias("size"), ((F.col("ss") - F.col("q")) / (F.col("n") * (F.col("n") - 1))).alias("tau"), "mean")


def bin_coherence(members: DataFrame) -> DataFrame:
    return frozen_cores(members, 2).select("bin", "size", F.col("tau").alias("coherence"))


def coherence_bar(coherence: DataFrame, percent: float = 10.0) -> DataFrame:
    """One row, ``bar``, or none without bins: the element at round(percent of n - 1) of the sorted coherences.

    Ranks come from range partitions, so bins aren't gathered in one task.
    """
    work = Workspace(coherence.sparkSession, "bar")
    r = ranked(coherence.select("coherence"), [F.col("coherence")], work.save)
    n = coherence.agg(F.count(F.lit(1)).alias("n"))
    at = F.floor(percent / 100.0 * (F.col("n") - 1) + 0.5) + 1
    return r.join(F.broadcast(n)).filter(F.col("rank") == at).select(F.col("coherence").alias("bar"))  # n is one row


def _core_scores(columns: list[str], keep: int):
    def run(key, contigs: pd.DataFrame, cores: pd.DataFrame) -> pd.DataFrame:
        out = {"seq": np.zeros(0, np.int64), "bin": [], "score": np.zeros(0), "tau": np.zeros(0)}
        if not len(contigs) or not len(cores):
            return pd.DataFrame(out)
        s = None
        for c in columns:
            d = np.stack(contigs[c].tolist()) @ np.stack(cores[f"{c}_core"].tolist()).T
            s = d if s is None else np.minimum(s, d)
        bins, tau = cores["bin"].to_numpy(), cores["tau"].to_numpy()
        order = np.lexsort((np.broadcast_to(np.arange(len(bins)), s.shape), -s), axis=1)[:, :keep]
        r = np.repeat(np.arange(len(s)), order.shape[1])
        at = order.ravel()
        return pd.DataFrame({"seq": contigs["seq"].to_numpy()[r], "bin": bins[at], "score": s[r, at], "tau": tau[at]})

    return run


def against_cores(candidates: DataFrame, cores: DataFrame, columns: list[str], keep: int, block: int = 4096) -> DataFrame:
    """(seq, bin, score, tau): each candidate's ``keep`` best cores by the least of the dot products over ``columns``."""
    kind = dict(cores.dtypes)["bin"]
    blocks = max(1, -(-candidates.count() // block))
    dealt = candidates.withColumn("b", F.pmod(F.xxhash64("seq"), F.lit(blocks)))
    sent = cores.orderBy("bin").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return dealt.groupBy("b").cogroup(sent.groupBy("b")).applyInPandas(_core_scores(columns, keep), f"seq long, bin {kind}, score double, tau double")


def _frozen_hits(key, contigs: pd.DataFrame, cores: pd.DataFrame) -> pd.DataFrame:
    """Contigs of a block that reach the own bar of cores of a block: how many, and the first of them."""
    if not len(contigs) or not len(cores):
        return pd.DataFrame({"seq": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "bin": cores["bin"].iloc[:0]})
    cores = cores.sort_values("bin")
    ok = np.stack(contigs["unit"].tolist()) @ np.stack(cores["mean"].tolist()).T >= cores["tau"].to_numpy()
    n = ok.sum(axis=1)
    return pd.DataFrame({"seq": contigs["seq"].to_numpy()[n > 0], "n": n[n > 0].astype(np.int64), "bin": cores["bin"].to_numpy()[ok.argmax(axis=1)[n > 0]]})


def blocks_meet(contigs: DataFrame, cores: DataFrame, kernel, schema: str, block: int = 4096) -> DataFrame:
    """``kernel`` over each block of contigs (seq, ...) with each block of cores (bin, ...); none holds more than ``block`` of either."""
    nc, nk = (max(1, -(-x.count() // block)) for x in (contigs, cores))
    at = lambda n, c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = contigs.select("*", at(nc, "seq").alias("b"), each(nk).alias("k"))
    right = cores.select("*", at(nk, "bin").alias("k"), each(nc).alias("b"))
    return left.groupBy("b", "k").cogroup(right.groupBy("b", "k")).applyInPandas(kernel, schema)


def recruit_to_frozen(candidates: DataFrame, cores: DataFrame) -> DataFrame:
    """(seq, bin) of candidates (seq, unit[]) whose correlation reaches the own mean of exactly one core (bin, tau, mean[]).

    The bar is held against and the cores that it lets pass are counted where blocks meet: no score leaves a task."""
    kind = dict(cores.dtypes)["bin"]
    hits = blocks_meet(candidates.select("seq", "unit"), cores.select("bin", "tau", "mean"), _frozen_hits, f"seq long, n long, bin {kind}")
    return hits.groupBy("seq").agg(F.sum("n").alias("n"), F.min("bin").alias("bin")).filter("n = 1").select("seq", "bin")


def log_residual_ratio(best: Column, second: Column) -> Column:
    """ln of (1 - second) over (1 - best); infinite for a perfect best, zero where both are perfect."""
    win, run = F.greatest(1 - best, F.lit(0.0)), F.greatest(1 - second, F.lit(0.0))
    return F.when(second.isNull(), F.lit(float("-inf"))).when(win == 0, F.when(run > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))).when(run == 0, F.lit(0.0)).otherwise(F.log(run / win))


def top_two(scores: DataFrame) -> DataFrame:
    """(seq, bin, best, second, ratio) of (seq, bin, score)."""
    w = Window.partitionBy("seq").orderBy(F.desc("score"), "bin")
    r = scores.withColumn("r", F.row_number().over(w)).filter("r <= 2")
    t = r.groupBy("seq").agg(F.max(F.when(F.col("r") == 1, F.struct("bin", "score"))).alias("one"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("second"))
    return t.select("seq", F.col("one.bin").alias("bin"), F.col("one.score").alias("best"), "second", log_residual_ratio(F.col("one.score"), F.col("second")).alias("ratio"))


def youden_boundary(evidence: DataFrame) -> DataFrame:
    """One row, (boundary, tpr, fpr), of (value, positive): where true minus false positive rate is largest.

    Equal values count together; of equal differences the highest value wins. Values are counted first; the running sums
    go over range partitions of the distinct values, and a prefix sum over the partitions' totals.
    """
    work = Workspace(evidence.sparkSession, "youden")
    v = evidence.groupBy("value").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    v = work.save(v.repartitionByRange(F.desc("value")).withColumn("part", F.spark_partition_id()), "ranges")
    totals = v.groupBy("part").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("sp").over(w), F.lit(0)).alias("bp"), F.coalesce(F.sum("sn").over(w), F.lit(0)).alias("bn"), F.sum("sp").over(Window.partitionBy()).alias("ap"), F.sum("sn").over(Window.partitionBy()).alias("an"))  # a row per range
    inside = Window.partitionBy("part").orderBy(F.desc("value"))
    r = v.select("part", "value", F.sum("p").over(inside).alias("p"), F.sum("n").over(inside).alias("n")).join(before, "part")
    r = r.select("value", ((F.col("p") + F.col("bp")) / F.col("ap")).alias("tpr"), ((F.col("n") + F.col("bn")) / F.col("an")).alias("fpr"))
    one = r.agg(F.min_by(F.struct("value", "tpr", "fpr"), F.struct(-(F.col("tpr") - F.col("fpr")), -F.col("value"))).alias("b"))
    return one.select(F.col("b.value").alias("boundary"), F.col("b.tpr").alias("tpr"), F.col("b.fpr").alias("fpr"))


def leave_one_out(members: DataFrame, others: DataFrame) -> DataFrame:
    """(value, positive): confidence of every core member that finds its own core, or a wrong one.

    members(seq, bin, own): the score with the member left out; others(seq, bin, score): scores to the other cores.
    """
    t = top_two(others).select("seq", F.col("best").alias("o1"), F.col("second").alias("o2"))
    j = members.join(t, "seq").filter("o2 is not null and own <> o1")
    right = F.col("own") > F.col("o1")
    return j.select(F.when(right, log_residual_ratio(F.col("own"), F.col("o1"))).otherwise(log_residual_ratio(F.col("o1"), F.greatest("own", "o2"))).alias("value"), right.alias("positive"))


def core_sums(members: DataFrame) -> DataFrame:
    """(bin, unit[], tnf[]): sums of unit depth profiles, and of unit compositions weighted by length, of (bin, seq, length, unit[], tnf[])."""
    one = lambda c, w: members.select("bin", F.lit(c).alias("c"), w.cast("double").alias("w"), F.posexplode(A.unit(F.col(c))).alias("k", "x"))
    each = one("unit", F.lit(1.0)).unionByName(one("tnf", F.greatest(F.col("length"), F.lit(1))))
    s = each.groupBy("bin", "c", "k").agg(F.sum(F.col("w") * F.col("x")).alias("s"))
    inside = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("c") == c, F.struct("k", "s")))), lambda x: x["s"]).alias(c)
    return s.groupBy("bin").agg(inside("unit"), inside("tnf"))  # a bin has as many rows as its features have places


def _joint_scores(key, contigs: pd.DataFrame, cores: pd.DataFrame) -> pd.DataFrame:
    """(seq, bin, score, own) of a block: each contig's two best cores, and its own without itself.

    A score is the lesser of two cosines, to the core's depth and to its composition. A member is taken out of its own core's
    sum by a rank-one downdate of dot product and norm, without another pass."""
    kept = {"seq": [np.zeros(0, np.int64)], "bin": [cores["bin"].to_numpy()[:0]], "score": [np.zeros(0)], "own": [np.zeros(0, bool)]}
    if len(contigs) and len(cores):
        cores = cores.sort_values("bin")
        bins, seqs = cores["bin"].to_numpy(), contigs["seq"].to_numpy()
        place = {b: i for i, b in enumerate(bins)}
        at = np.array([place.get(b, -1) for b in contigs["bin"]])
        mine = np.flatnonzero(at >= 0)
        joint = None
        for c, w in (("unit", np.ones(len(contigs))), ("tnf", np.maximum(contigs["length"].to_numpy(float), 1.0))):
            x, s = np.stack(contigs[c].tolist()), np.stack(cores[c].tolist())
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            dot, ss = x @ s.T, np.broadcast_to((s * s).sum(axis=1), (len(x), len(s))).copy()
            d, v = dot[mine, at[mine]], w[mine]
            rest = ss[mine, at[mine]] + v * v - 2 * v * d
            ss[mine, at[mine]] = np.where(rest > 1e-9 * v * v, rest, 0.0)  # what rounding leaves of a core of one is nothing
            dot[mine, at[mine]] = d - v
            with np.errstate(divide="ignore", invalid="ignore"):
                cos = np.where(ss > 1e-30, np.clip(dot / np.sqrt(np.maximum(ss, 1e-300)), -1.0, 1.0), -np.inf)
            joint = cos if joint is None else np.minimum(joint, cos)
        kept["seq"].append(seqs[mine])
        kept["bin"].append(bins[at[mine]])
        kept["score"].append(joint[mine, at[mine]])
        kept["own"].append(np.ones(len(mine), bool))
        joint[mine, at[mine]] = -np.inf
        order = np.argsort(-joint, axis=1, kind="stable")[:, :2]  # of equals the smaller bin
        r, to = np.repeat(np.arange(len(joint)), order.shape[1]), order.ravel()
        fine = np.isfinite(joint[r, to])
        kept["seq"].append(seqs[r[fine]])
        kept["bin"].append(bins[to[fine]])
        kept["score"].append(joint[r, to][fine])
        kept["own"].append(np.zeros(fine.sum(), bool))
    return pd.DataFrame({c: np.concatenate(x) for c, x in kept.items()})


def joint_scores(contigs: DataFrame, cores: DataFrame, block: int = 2048) -> DataFrame:
    """(seq, bin, score, own) of contigs (seq, bin or null, length, unit[], tnf[]) against ``core_sums``. Contigs without a
    direction in one of the features have no scores."""
    seen = lambda c: F.exists(c, lambda x: x != 0)
    rows = contigs.select("seq", "bin", "length", "unit", "tnf").filter(seen("unit") & seen("tnf"))
    return blocks_meet(rows, cores, _joint_scores, f"seq long, bin {dict(cores.dtypes)['bin']}, score double, own boolean", block)


def calibrated_recruit(members: DataFrame, candidates: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(seq, bin, ratio) of the candidates that cores take, and (boundary, tpr, fpr), of which there may be no row.

    members(bin, seq, length, unit[], tnf[]) are the contigs of the cores, candidates(seq, length, unit[], tnf[]) the others.
    Every member is classified after it is left out of its core; how clearly it finds its own core, or a wrong one, is the
    evidence from which one boundary is learnt. A candidate goes to its best core if it is as clear as that. The cores don't
    change meanwhile. Without evidence of both kinds nothing is recruited.
    """
    cores = work.save(core_sums(members), "cores")
    kind = dict(cores.dtypes)["bin"]
    own = work.save(joint_scores(members, cores), "own_scores")
    evidence = work.save(leave_one_out(own.filter("own").select("seq", "bin", F.col("score").alias("own")), own.filter("not own").select("seq", "bin", "score")), "evidence")
    both = evidence.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n")).filter("p > 0 and n > 0")
    boundary = work.save(youden_boundary(evidence).join(F.broadcast(both)).drop("p", "n"), "boundary")  # a row each
    hits = work.save(joint_scores(candidates.withColumn("bin", F.lit(None).cast(kind)), cores).select("seq", "bin", "score"), "core_scores")
    best = top_two(hits).filter("second is not null")
    return best.join(F.broadcast(boundary.select("boundary"))).filter("ratio >= boundary").select("seq", "bin", "ratio"), boundary


# -- merging by read pairs


def linked_bins(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, links) with a < b: read pairs between different bins, of links (i, j, cnt)."""
    on = lambda side: members.select(F.col("seq").alias(side), F.col("bin").alias(f"bin_{side}"))
    x = links.join(on("i"), "i").join(on("j"), "j").filter("bin_i <> bin_j")
    return x.groupBy(F.least("bin_i", "bin_j").alias("a"), F.greatest("bin_i", "bin_j").alias("b")).agg(F.sum("cnt").alias("links"))


def merge_candidates(pairs: DataFrame, stats: DataFrame, sizes: DataFrame, floor: int, crit: float) -> DataFrame:
    """(a, b, links, t2): linked bins, one of them below the floor, whose profiles don't differ."""
    small = sizes.select("bin", (F.col("total_length") < floor).alias("frag"))
    x = pairs.join(small.select(F.col("bin").alias("a"), F.col("frag").alias("fa")), "a").join(small.select(F.col("bin").alias("b"), F.col("frag").alias("fb")), "b").filter("fa or fb")
    side = lambda s: stats.select(F.col("bin").alias(s), "k", F.col("w").alias(f"w{s}"), (F.col("z") / F.col("w")).alias(f"m{s}"))
    d = x.join(side("a"), "a").join(side("b"), ["b", "k"])
    part = F.pow(F.col("ma") - F.col("mb"), F.lit(2)) / (1 / F.col("wa") + 1 / F.col("wb"))
    return d.groupBy("a", "b").agg(F.max("links").alias("links"), F.sum(part).alias("t2")).filter(F.col("t2") <= crit)


def _merge_group(crit: float):
    """One component of linked bins: pairs in ascending distance, groups tested again as they grow."""
    def run(key, pairs: pd.DataFrame, stats: pd.DataFrame) -> pd.DataFrame:
        own: dict = {}
        for r in stats.itertuples():
            own.setdefault(r.bin, {})[r.k] = [r.w, r.z]
        core = dict(zip(stats["bin"], stats["core"]))
        up = {b: b for b in own}

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def distance(a, b):
            return sum((za / wa - zb / wb) ** 2 / (1 / wa + 1 / wb) for k in own[a].keys() & own[b].keys() for (wa, za), (wb, zb) in ((own[a][k], own[b][k]),))

        for r in pairs.sort_values(["t2", "a", "b"]).itertuples():
            ra, rb = find(r.a), find(r.b)
            if ra == rb or (core[ra] and core[rb]) or distance(ra, rb) > crit:
                continue
            root, other = min(ra, rb), max(ra, rb)
            for k, (w, z) in own[other].items():
                held = own[root].setdefault(k, [0.0, 0.0])
                held[0] += w
                held[1] += z
            up[other] = root
            core[root] = core[ra] or core[rb]
        return pd.DataFrame({"bin": list(up), "root": [find(b) for b in up]})

    return run


def merge_bins(candidates: DataFrame, stats: DataFrame, sizes: DataFrame, floor: int, crit: float) -> DataFrame:
    """(bin, root): bins joined in ascending distance; two cores never meet, and grown groups are tested again.

    Bins that candidates don't link, directly or through others, don't influence each other: every component of linked
    bins is one group of an executor, with a row per pair and per (bin, sample), none per contig.
    """
    work = Workspace(candidates.sparkSession, "merge-bins")
    kind = dict(sizes.dtypes)["bin"]
    pairs = work.save(candidates.select("a", "b", "t2"), "pairs")
    named = work.save(pairs.select(F.explode(F.array("a", "b")).alias("bin")).distinct().select("bin", F.monotonically_increasing_id().alias("node")), "nodes")
    on = lambda side: named.select(F.col("bin").alias(side), F.col("node").alias(f"n{side}"))
    edges = pairs.join(on("a"), "a").join(on("b"), "b")
    roots = connected(edges.select(F.col("na").alias("a"), F.col("nb").alias("b")), work)
    of = work.save(named.join(roots, "node", "left").select("bin", F.coalesce("root", "node").alias("group")), "groups")
    left = pairs.join(of.withColumnRenamed("bin", "a"), "a").select("group", "a", "b", "t2")
    right = stats.select("bin", "k", "w", "z").join(of.withColumnRenamed("group", "own"), "bin").join(sizes.select("bin", (F.col("total_length") >= floor).alias("core")), "bin").select("own", "bin", "k", "w", "z", "core")
    joined = left.groupBy("group").cogroup(right.groupBy("own")).applyInPandas(_merge_group(crit), f"bin {kind}, root {kind}")
    return sizes.select("bin").join(joined, "bin", "left").select("bin", F.coalesce("root", "bin").alias("root"))


# -- splitting


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, restarts: int = 10, rounds: int = 200) -> np.ndarray:
    """Labels of the best of several runs; spread-out starts; an empty cluster keeps its centre."""
    best, labels = np.inf, np.zeros(len(x), dtype=int)
    for _ in range(restarts):
        centres = [x[rng.integers(len(x))]]
        for _ in range(1, k):
            d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
            centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        c, lab = np.array(centres), np.zeros(len(x), dtype=int)
        for _ in range(rounds):
            d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
            new = d.argmin(axis=1)
            for j in range(k):
                if (new == j).any():
                    c[j] = x[new == j].mean(axis=0)
            if (new == lab).all():
                break
            lab = new
        inertia = ((x - c[lab]) ** 2).sum()
        if inertia < best:
            best, labels = inertia, lab
    return labels


def silhouette(x: np.ndarray, labels: np.ndarray, sample: int = 600) -> float:
    """Mean silhouette over evenly spaced rows, at most ``sample``; members of one-row clusters are left out."""
    at = np.arange(len(x)) if len(x) <= sample else (np.arange(sample) * len(x) / sample).astype(int)
    x, labels = x[at], labels[at]
    names = np.unique(labels)
    if len(names) < 2:
        return -1.0
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(axis=2))
    sums = np.stack([d[:, labels == c].sum(axis=1) for c in names], axis=1)
    n = np.array([(labels == c).sum() for c in names])
    own = np.searchsorted(names, labels)
    rows = np.arange(len(x))
    ok = n[own] > 1
    if not ok.any():
        return -1.0
    a = sums[rows, own] / np.maximum(n[own] - 1, 1)
    other = sums / n
    other[rows, own] = np.inf
    b = other.min(axis=1)
    return float(((b - a) / np.maximum(np.maximum(a, b), 1e-300))[ok].mean())


def best_split(x: np.ndarray, max_k: int, threshold: float, restarts: int, seed: int, sizes: np.ndarray | None = None, min_child: int = 0) -> np.ndarray | None:
    """Labels of the number of clusters with the best silhouette, if it reaches the threshold."""
    rng, best, out = np.random.default_rng(seed), -1.0, None
    for k in range(2, min(len(x) - 1, max_k) + 1):
        lab = kmeans(x, k, rng, restarts)
        if len(np.unique(lab)) < 2 or (min_child and np.bincount(lab, minlength=k).min() < min_child):
            continue
        s = silhouette(x, lab)
        if s > best:
            best, out = s, lab
    return out if best >= threshold else None


def _split(members_least: int, max_k: int, threshold: float, restarts: int, floor: int, min_child: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        piece = np.zeros(len(pdf), dtype=np.int64)
        if len(pdf) >= members_least:
            x = np.stack(pdf["y"].tolist())
            lab = best_split(x, max_k, threshold, restarts, int(pdf["seq"].iloc[0]) & 0x7FFFFFFF, min_child=min_child)
            if lab is not None:
                piece = lab.astype(np.int64)
        out = pd.DataFrame({"bin": pdf["bin"].to_numpy(), "piece": piece, "seq": pdf["seq"].to_numpy(), "length": pdf["length"].to_numpy()})
        if piece.any():
            out = out[out.groupby("piece")["length"].transform("sum") >= floor]
        return out

    return run


def abundance_split(members: DataFrame, floor: int = 200_000, least: int = 6, max_k: int = 6, threshold: float = 0.7, restarts: int = 10, min_child: int = 0) -> DataFrame:
    """(bin, piece, seq, length): bins of several abundance modes in pieces; pieces below the floor go.

    A bin, one genome's contigs, is one group; bins run in parallel and are bounded by the genome, not by the data.
    """
    kind = dict(members.dtypes)["bin"]
    return members.select("bin", "seq", "length", "y").groupBy("bin").applyInPandas(_split(least, max_k, threshold, restarts, floor, min_child), f"bin {kind}, piece long, seq long, length long")


def feedback_split(members: DataFrame, work: Workspace, floor: int = 200_000, percent: float = 10.0, **how) -> DataFrame:
    """(bin, piece, seq, length, again) of (bin, seq, length, y[], unit[]): bins from the floor on are split as ``abundance_split``
    does; the coherence of what they give sets a bar, its ``percent``-th percentile, and smaller bins are then split too,
    of which the pieces stay, as ``again``, that are at least as coherent. Pieces of one contig have no coherence and go, as do
    all small ones where there is no bar.
    """
    total = members.groupBy("bin").agg((F.sum("length") >= floor).alias("large"))
    both = work.save(members.join(total, "bin"), "feedback_members")
    first = work.save(abundance_split(both.filter("large"), floor, **how), "feedback_first")
    units = both.select("bin", "seq", "unit")
    named = lambda pieces: pieces.join(units, ["bin", "seq"]).select(F.struct("bin", "piece").alias("bin"), "seq", "unit")
    bar = coherence_bar(bin_coherence(named(first)), percent)
    second = work.save(abundance_split(both.filter(~F.col("large")), 0, **how), "feedback_second")
    clear = bin_coherence(named(second)).join(F.broadcast(bar)).filter("coherence >= bar").select("bin.*")  # bar is one row
    return first.withColumn("again", F.lit(False)).unionByName(second.join(clear, ["bin", "piece"], "left_semi").withColumn("again", F.lit(True)))


def _marker_split(least: int, max_k: int, restarts: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        n, copies = len(pdf), int(pdf["copies"].iloc[0])
        piece = np.zeros(n, dtype=np.int64)
        k = min(n, copies, max_k)
        if n >= least and copies > 1 and k > 1:
            piece = kmeans(np.stack(pdf["y"].tolist()), k, np.random.default_rng(int(pdf["seq"].iloc[0]) & 0x7FFFFFFF), restarts).astype(np.int64)
        return pd.DataFrame({"bin": pdf["bin"].to_numpy(), "piece": piece, "seq": pdf["seq"].to_numpy(), "length": pdf["length"].to_numpy()})

    return run


def marker_split(members: DataFrame, markers: DataFrame, floor: int = 200_000, least: int = 6, max_k: int = 6, restarts: int = 10) -> DataFrame:
    """As many pieces as the most repeated marker of a bin has copies; pieces below the floor go."""
    from .evaluate import marker_copies

    copies = marker_copies(markers, members.select("seq", "bin")).groupBy("bin").agg(F.max("copies").alias("copies"))
    kind = dict(members.dtypes)["bin"]
    out = members.join(copies, "bin", "left").na.fill(1, ["copies"]).groupBy("bin").applyInPandas(_marker_split(least, max_k, restarts), f"bin {kind}, piece long, seq long, length long")
    kept = out.groupBy("bin", "piece").agg(F.sum("length").alias("t")).filter(F.col("t") >= floor).select("bin", "piece")
    return out.join(kept, ["bin", "piece"], "left_semi")


def silhouette_of_labels(rows: DataFrame) -> DataFrame:
    """One row, ``silhouette``, of (id, label, v[]): a tile sends sums per (id, label), no distances; rows without a label take no part."""
    from .pairs import tiles

    known = rows.filter("label is not null")
    sums = tiles(known, ["v", "label"], _distance_sums, "id long, lb long, total double, n long")
    s = sums.groupBy("id", "lb").agg((F.sum("total") / F.sum("n")).alias("m")).join(known.select("id", "label"), "id")
    t = s.groupBy("id").agg(F.max(F.when(F.col("lb") == F.col("label"), F.col("m"))).alias("a"), F.min(F.when(F.col("lb") != F.col("label"), F.col("m"))).alias("b"))
    return t.filter("a is not null and b is not null").agg(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


def _distance_sums(ia, a, ib, b, same):
    """(id, lb, total, n): the sum of a row's distances to the other block's rows of each label, and their number, for either block."""
    from .pairs import strips

    (la, at_a), (lb, at_b) = (np.unique(x[1].ravel(), return_inverse=True) for x in (a, b))
    of_a, of_b = np.eye(len(la))[at_a], np.eye(len(lb))[at_b]
    to_a, to_b = np.zeros((len(ib), len(la))), np.zeros((len(ia), len(lb)))
    for lo, s in strips(_distance_kernel, a[:1], b[:1]):
        if same:
            s[np.arange(len(s)), lo + np.arange(len(s))] = 0.0
        to_b[lo : lo + len(s)] = s @ of_b
        to_a += s.T @ of_a[lo : lo + len(s)]
    for ids, labels, total, n, own in ((ia, lb, to_b, of_b.sum(axis=0), of_a), (ib, la, to_a, of_a.sum(axis=0), of_b))[: 1 if same else 2]:
        n = np.tile(n, (len(ids), 1)) - (own if same else 0)
        x, y = np.nonzero(n)
        yield {"id": ids[x], "lb": labels[y], "total": total[x, y], "n": n[x, y].astype(np.int64)}


def _distance_kernel(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    a, b = left[0], right[0]
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T, 0.0))


def singleton_rescue(contigs: DataFrame, membership: DataFrame, floor: int = 200_000) -> DataFrame:
    """(seq, length): contigs in no bin that are long enough to be one."""
    return contigs.filter(F.col("length") >= floor).join(membership, "seq", "left_anti").select("seq", "length")


def consolidate_fragments(fragments: DataFrame, cores: DataFrame, margin: float = 0.0) -> DataFrame:
    """(frag, bin): fragments whose mean correlation with a core reaches the core's own coherence plus a margin.

    fragments(frag, mean[]), cores(bin, tau, mean[]): mean cross correlations are dot products of mean vectors.
    """
    f = fragments.select(F.xxhash64("frag").alias("seq"), "frag", F.col("mean").alias("unit"))
    hits = against_cores(f.select("seq", "unit"), cores.select("bin", "tau", F.col("mean").alias("unit_core")), ["unit"], 1).filter(F.col("score") >= F.col("tau") + margin)
    return f.join(hits, "seq").select("frag", "bin", "score")
