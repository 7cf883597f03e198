"""Judging a binning: against a gold standard, by marker genes, by lineage, by stability.

Common shapes: gold(seq, genome, length), pred(seq, bin), markers(seq, marker) as a bag, contigs(seq, length).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.workspace import Workspace

from .components import connected


def first_wins(rows: DataFrame, key: str, order: str, *keep: str) -> DataFrame:
    """One row per ``key``: the one that comes first. A partial aggregate, not a window, so hot keys stay cheap."""
    return rows.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in keep])


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def confusion(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(bin, genome, bp, seqs) of the sequences that both sides know."""
    return pred.join(gold, "seq").groupBy("bin", "genome").agg(F.sum("length").alias("bp"), F.count(F.lit(1)).alias("seqs"))


def genome_sizes(gold: DataFrame) -> DataFrame:
    """(genome, size, seen): seen orders genomes by first appearance."""
    return gold.groupBy("genome").agg(F.sum("length").alias("size"), F.min("seq").alias("seen"))


def amber_per_bin(gold: DataFrame, pred: DataFrame, min_bin_size: int = 0) -> DataFrame:
    """Dominant genome, purity and completeness of every predicted bin; equal shares go to the genome seen first."""
    cells = confusion(gold, pred).join(genome_sizes(gold), "genome")
    per = cells.groupBy("bin").agg(F.sum("bp").alias("total_length"), F.sum("seqs").alias("seq_count"), F.max_by(F.struct("genome", "size", "bp"), F.struct("bp", -F.col("seen"))).alias("top"))
    per = per.filter(F.col("total_length") >= min_bin_size)
    return per.select(
        "bin",
        F.col("top.genome").alias("genome"),
        ratio(F.col("top.bp"), F.col("total_length")).alias("purity"),
        ratio(F.col("top.bp"), F.col("top.size")).alias("completeness"),
        "total_length",
        F.col("top.bp").alias("tp_length"),
        "seq_count",
    )


def amber_tiers(per_bin: DataFrame) -> DataFrame:
    """Recovered-bin counts; the classes are cumulative and the limits strict."""
    c, p = F.col("completeness"), F.col("purity")
    return per_bin.agg(F.count(F.lit(1)).alias("bins"), F.count_if((c > 0.9) & (p > 0.95)).alias("hq"), F.count_if((c > 0.7) & (p > 0.9)).alias("mq"), F.count_if((c > 0.5) & (p > 0.9)).alias("lq"), F.avg("purity").alias("avg_purity"), ratio(F.sum("tp_length"), F.sum("total_length")).alias("weighted_purity"))


def amber_completeness(gold: DataFrame, pred: DataFrame, min_bin_size: int = 0) -> DataFrame:
    """One row: the mean, over all gold genomes, of the best completeness any kept bin has."""
    cells = confusion(gold, pred)
    kept = cells.groupBy("bin").agg(F.sum("bp").alias("t")).filter(F.col("t") >= min_bin_size).select("bin")
    best = cells.join(kept, "bin", "left_semi").groupBy("genome").agg(F.max("bp").alias("bp"))
    return genome_sizes(gold).join(best, "genome", "left").agg(F.count(F.lit(1)).alias("genomes"), F.avg(ratio(F.coalesce("bp", F.lit(0)), F.col("size"))).alias("avg_completeness"))


def amber_summary(gold: DataFrame, pred: DataFrame, min_bin_size: int = 0) -> DataFrame:
    one = amber_tiers(amber_per_bin(gold, pred, min_bin_size))
    return one.join(amber_completeness(gold, pred, min_bin_size))  # one row each


def unmatched(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Predicted sequences that the gold standard lacks."""
    return pred.join(gold, "seq", "left_anti")


def marker_copies(markers: DataFrame, pred: DataFrame) -> DataFrame:
    """(bin, marker, copies): every hit counts."""
    return markers.join(pred, "seq").groupBy("bin", "marker").agg(F.count(F.lit(1)).alias("copies"))


def tier(completeness: Column, contamination: Column, has_markers: Column) -> Column:
    return F.when(~has_markers, "-").when((completeness > 90) & (contamination < 5), "HQ").when((completeness >= 50) & (contamination < 10), "MQ").otherwise("LQ")


def qc_per_bin(markers: DataFrame, pred: DataFrame, set_size: Column | int) -> DataFrame:
    """Completeness and contamination in percent of a marker set; exclusive tiers."""
    g = set_size if isinstance(set_size, Column) else F.lit(set_size)
    per = marker_copies(markers, pred).groupBy("bin").agg(F.count(F.lit(1)).alias("distinct_markers"), F.sum(F.col("copies") - 1).alias("extra_copies"))
    bins = pred.groupBy("bin").agg(F.count(F.lit(1)).alias("contigs")).join(per, "bin", "left")
    found = F.col("distinct_markers").isNotNull()
    comp, cont = 100.0 * F.coalesce("distinct_markers", F.lit(0)) / g, 100.0 * F.coalesce("extra_copies", F.lit(0)) / g
    return bins.select("bin", "contigs", F.coalesce("distinct_markers", F.lit(0)).alias("distinct_markers"), F.coalesce("extra_copies", F.lit(0)).alias("extra_copies"), comp.cast("double").alias("completeness"), cont.cast("double").alias("contamination"), tier(comp, cont, found).alias("tier"))


def marker_set_size(markers: DataFrame, chosen: int | None = None, stated: int | None = None) -> int:
    """The size that was asked for, or else the one that the marker file states, or else the number of markers seen."""
    return chosen or stated or markers.select("marker").distinct().count()


def high_quality(per_bin: DataFrame) -> DataFrame:
    """Bins of more than 90 % completeness and less than 5 % contamination."""
    return per_bin.filter("completeness > 90 and contamination < 5")


def qc_summary(per_bin: DataFrame) -> DataFrame:
    return per_bin.agg(F.count(F.lit(1)).alias("bins"), *[F.count_if(F.col("tier") == t).alias(n) for t, n in (("HQ", "hq"), ("MQ", "mq"), ("LQ", "lq"), ("-", "unscored"))], F.sum("completeness").alias("sum_completeness"), F.avg("contamination").alias("avg_contamination"))


def taxonomy_vote(contigs: DataFrame, pred: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(bin, lineage, weight, share): the lineage of most length; ties go to the one seen first."""
    seen = taxonomy.groupBy("lineage").agg(F.min("seq").alias("seen"))
    votes = pred.join(taxonomy, "seq").join(contigs, "seq").groupBy("bin", "lineage").agg(F.sum("length").alias("w")).join(seen, "lineage")
    won = votes.groupBy("bin").agg(F.max_by(F.struct("lineage", "w"), F.struct("w", -F.col("seen"))).alias("top"), F.sum("w").alias("all"))
    return won.select("bin", F.col("top.lineage").alias("lineage"), F.col("top.w").alias("weight"), ratio(F.col("top.w"), F.col("all")).alias("share"))


def bin_stats(members: DataFrame, min_bin_size: int = 0) -> DataFrame:
    """(bin, num_contigs, total_length, coverage) of (bin, seq, length, depth); small bins go."""
    out = members.groupBy("bin").agg(F.count(F.lit(1)).alias("num_contigs"), F.sum("length").alias("total_length"), (F.sum(F.col("length") * F.col("depth")) / F.sum("length")).alias("coverage"))
    return out.filter(F.col("total_length") >= min_bin_size)


def numbered(bins: DataFrame, size: str = "total_length", first: str = "first_contig") -> DataFrame:
    """Bin numbers by size, then by first contig; a table of bins, not of contigs."""
    return bins.withColumn("bin_num", F.row_number().over(Window.orderBy(F.desc(size), first)))


def bin_depth_stats(members: DataFrame) -> DataFrame:
    """Length-weighted mean and population deviation of depth, in one pass over (bin, length, depth)."""
    n, s, q = F.sum("length"), F.sum(F.col("length") * F.col("depth")), F.sum(F.col("length") * F.col("depth") * F.col("depth"))
    a = members.groupBy("bin").agg(n.cast("long").alias("total_length"), s.alias("s"), q.alias("q"))
    mean = F.col("s") / F.col("total_length")
    return a.select("bin", "total_length", mean.alias("mean_depth"), F.sqrt(F.greatest(F.col("q") / F.col("total_length") - mean * mean, F.lit(0.0))).alias("sd_depth"))


def upper_median(column: str) -> Column:
    """The element at n / 2 of the sorted values, not the mean of the middle two."""
    v = F.array_sort(F.collect_list(column))
    return F.get(v, F.floor(F.size(v) / 2).cast("int"))


def upper_median_by(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """The same for groups of any size: a rank that spills, no list per group."""
    w = Window.partitionBy(*keys)
    ranked = rows.select(*keys, column, F.row_number().over(w.orderBy(column)).alias("_k"), F.count(F.lit(1)).over(w).alias("_n"))
    return ranked.filter(F.col("_k") == F.floor(F.col("_n") / 2) + 1).select(*keys, F.col(column).alias(name))


def purify(members: DataFrame, markers: DataFrame, limit: float = 3.0) -> DataFrame:
    """Contigs to remove from bins of three or more: they carry a marker that the bin has twice, and are depth outliers.

    members(bin, seq, sample, depth): one row per contig and sample.
    """
    pairs = members.select("bin", "seq").distinct()
    sizes = pairs.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select("bin")
    hits = markers.join(pairs, "seq").join(sizes, "bin", "left_semi")
    twice = hits.groupBy("bin", "marker").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("bin", "marker")
    carriers = hits.join(twice, ["bin", "marker"], "left_semi").select("bin", "seq").distinct()
    touched = twice.select("bin").distinct()
    logs = members.join(touched, "bin", "left_semi").select("bin", "seq", "sample", F.log(F.col("depth") + 1.0).alias("y"))
    med = upper_median_by(logs, ["bin", "sample"], "y", "med")
    dev = logs.join(med, ["bin", "sample"]).select("bin", "seq", "sample", F.abs(F.col("y") - F.col("med")).alias("dev"))
    mad = upper_median_by(dev, ["bin", "sample"], "dev", "mad")
    z = dev.join(mad, ["bin", "sample"]).groupBy("bin", "seq").agg(F.max(F.col("dev") / (F.col("mad") * 1.4826 + 1e-9)).alias("zmax"))
    return z.filter(F.col("zmax") > limit).join(carriers, ["bin", "seq"], "left_semi")


def membership_matrix(contigs: DataFrame, labels: DataFrame) -> DataFrame:
    """(seq, cluster): label + 1, and 0 for contigs without a label."""
    return contigs.join(labels, "seq", "left").select("seq", F.coalesce(F.col("label") + 1, F.lit(0)).cast("long").alias("cluster"))


def partition_agreement(edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of edges on which two labellings agree about staying inside a cluster."""
    def inside(labels: DataFrame, name: str, rows: DataFrame) -> DataFrame:
        s, d = labels.select(F.col("node").alias("src"), F.col("label").alias("_s")), labels.select(F.col("node").alias("dst"), F.col("label").alias("_d"))
        return rows.join(s, "src").join(d, "dst").withColumn(name, F.col("_s") == F.col("_d")).drop("_s", "_d")

    both = inside(b, "in_b", inside(a, "in_a", edges))
    return both.agg(F.count(F.lit(1)).alias("edges"), F.avg((F.col("in_a") == F.col("in_b")).cast("double")).alias("agreement"))


# -- consensus of several binnings


def candidate_scores(members: DataFrame, markers: DataFrame, set_size: int) -> DataFrame:
    """(cand, completeness, contamination) of (cand, seq) by markers (seq, marker); a null marker is none."""
    c = markers.filter("marker is not null").join(members, "seq").groupBy("cand", "marker").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("cand").agg((100.0 * F.count(F.lit(1)) / set_size).alias("completeness"), (100.0 * F.sum(F.col("c") - 1) / set_size).alias("contamination"))


def _greedy(set_size: int, min_completeness: float, max_contamination: float, penalty: float):
    """One overlap component, by the plain loop: take the best, score those that lost contigs again."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        has = {s: m for s, m in zip(pdf["seq"], pdf["markers"])}
        cands = {c: set(x) for c, x in pdf.groupby("cand")["seq"]}
        holders: dict = {}
        for c, seqs in cands.items():
            for x in seqs:
                holders.setdefault(x, set()).add(c)

        def score(c) -> float | None:
            n: dict = {}
            for x in cands[c]:
                for m in has[x]:
                    n[m] = n.get(m, 0) + 1
            comp, cont = 100.0 * len(n) / set_size, 100.0 * (sum(n.values()) - len(n)) / set_size
            return comp - penalty * cont if comp >= min_completeness and cont <= max_contamination else None

        scores = {c: v for c in cands if (v := score(c)) is not None}
        out = []
        while scores:
            best = min(scores, key=lambda c: (-scores[c], c))
            took, at = cands.pop(best), scores.pop(best)
            out += [(best, x, at) for x in took]
            touched = set().union(*(holders[x] for x in took)) - {best}
            for c in touched & cands.keys():
                cands[c] -= took
                v = score(c) if cands[c] else None
                if v is None:
                    scores.pop(c, None)
                else:
                    scores[c] = v
        return pd.DataFrame(out, columns=["cand", "seq", "score"])

    return run


def overlap_groups(members: DataFrame, work: Workspace, label: str) -> DataFrame:
    """``members`` (cand, seq, ...) with ``root``: the component of candidates that share contigs, directly or through others."""
    nodes = work.save(members.select("cand").distinct().select("cand", F.monotonically_increasing_id().alias("node")), f"{label}nodes")
    at = members.select("cand", "seq").join(nodes, "cand")
    edges = at.join(at.groupBy("seq").agg(F.min("node").alias("first")), "seq").select(F.col("node").alias("a"), F.col("first").alias("b"))
    roots = connected(edges, work, label)
    of = nodes.join(roots, "node", "left").select("cand", F.coalesce("root", "node").alias("root"))
    return work.save(members.join(of, "cand"), f"{label}grouped")


def first_at_each(rows: DataFrame, key: Column, name: str, deal: int = 250_000, n: int | None = None) -> DataFrame:
    """``rows`` (seq, ...) with ``name``, the least key of their contig. Rows are dealt by contig to tasks of about ``deal``
    rows before anything is sorted: a saved table is small on disk, so one task may read all of it. ``n``: their number, where it is known."""
    dealt = rows.filter("seq is not null").repartition(max(1, -(-(rows.count() if n is None else n) // deal)), "seq")
    return dealt.withColumn(name, F.min(key).over(Window.partitionBy("seq")))


def _in_order(min_free: float):
    """One overlap component, in the order of the scores."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for (_, c), x in pdf.assign(at=-pdf["score"]).groupby(["at", "cand"]):
            own = set(x["seq"]) - taken
            if own and len(own) >= min_free * len(x):
                taken |= own
                out += [(c, q, x["score"].iloc[0]) for q in own]
        return pd.DataFrame(out, columns=["cand", "seq", "score"])

    return run


def _overtaken(set_size: int, min_completeness: float, max_contamination: float, penalty: float):
    """When one candidate comes first, if the contigs in ``firsts`` go in the order of their candidates: (root, at, name),
    the key of the last one that goes before it or its own key then, whichever is later; no row if it never does.

    Rows come sorted by candidate, and a candidate may go on in the next batch; only one is held."""
    def when(name, held: list[tuple]) -> tuple | None:
        n, steps = {}, {}
        for markers, at, owner in held:
            for m in markers:
                n[m] = n.get(m, 0) + 1
            if owner is not None:
                steps.setdefault((at, owner), []).append(markers)
        order, last, copies = sorted(steps), None, sum(n.values())
        for i in range(len(order) + 1):
            comp, cont = 100.0 * len(n) / set_size, 100.0 * (copies - len(n)) / set_size
            if comp >= min_completeness and cont <= max_contamination:
                own = (-(comp - penalty * cont), name)
                then = own if last is None else max(own, last)
                if i == len(order) or then < order[i]:
                    return then
            if i < len(order):
                last = order[i]
                for markers in steps[last]:
                    copies -= len(markers)
                    for m in markers:
                        n[m] -= 1
                        if not n[m]:
                            del n[m]
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, name, held, kind = None, None, [], None

        def told(out: list[tuple]) -> None:
            if held and (then := when(name, held)) is not None:
                out.append((root, *then))

        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], type=t) for k, t in enumerate((pa.int64(), pa.float64(), kind))], names=["root", "at", "name"])

        for batch in batches:
            kind, out = batch.schema.field("cand").type, []
            for r, c, markers, at, owner in zip(*(batch.column(x).to_pylist() for x in ("root", "cand", "markers", "first_at", "first"))):
                if c != name:
                    told(out)
                    root, name, held = r, c, []
                held.append((markers, at, owner))
            yield made(out)
        out = []
        told(out)
        if out:
            yield made(out)

    return run


def refine_consensus(members: DataFrame, markers: DataFrame, set_size: int, min_completeness: float = 50.0, max_contamination: float = 10.0, penalty: float = 5.0, work: Workspace | None = None, task_rows: int = 50_000, deal: int = 25_000) -> DataFrame:
    """(cand, seq, score): take the best candidate bin, remove its contigs everywhere, score again, until none is good enough.

    Of equals the smaller name comes first. Candidates that can't reach ``min_completeness``, which never grows, are
    left out. Candidates that share contigs, directly or through others, form components, which don't influence each other.

    A round takes many candidates of a component at once. Its firsts are those that come before all others at each of
    their contigs; no two share one, so none changes another's score. If they went in order, every other candidate would
    lose contigs to some of them, and may rise: each candidate's rows, dealt by candidate to tasks of about ``deal`` rows,
    tell when it would come before the next first. Up to the earliest such moment in the component the firsts are what the loop takes, and all of them go. The
    best candidate always does. Only candidates that lost contigs are scored again. A component with no more than
    ``task_rows`` rows left is settled by the plain loop, in one group; one without a candidate that is good enough is
    done, whatever its size, since nothing is taken from it that could make another one good enough.
    """
    work = work or Workspace(members.sparkSession, "consensus")
    kinds = dict(members.dtypes)
    schema = f"cand {kinds['cand']}, seq {kinds['seq']}, score double"

    def scored(rows: DataFrame) -> DataFrame:
        """(cand, at): at is the score with its sign turned, null for the contaminated; candidates that are too incomplete go."""
        c = rows.select("cand", F.explode("markers").alias("m")).groupBy("cand", "m").agg(F.count(F.lit(1)).alias("c"))
        c = c.groupBy("cand").agg((100.0 * F.count(F.lit(1)) / set_size).alias("comp"), (100.0 * F.sum(F.col("c") - 1) / set_size).alias("cont"))
        return c.filter(F.col("comp") >= min_completeness).select("cand", F.when(F.col("cont") <= max_contamination, -(F.col("comp") - penalty * F.col("cont"))).alias("at"))

    held = markers.filter("marker is not null").groupBy("seq").agg(F.collect_list("marker").alias("markers"))
    rows = members.select("cand", "seq").distinct().join(held, "seq", "left").withColumn("markers", F.coalesce("markers", F.array().cast(held.schema["markers"].dataType)))
    rows = work.save(rows.select("cand", "seq", "markers"), "members")
    scores = work.save(scored(rows), "scores")
    left = overlap_groups(rows.join(scores.select("cand"), "cand"), work, "overlap")
    out, k = None, 0
    while True:
        fit = left.select("root", "cand").distinct().join(scores.filter("at is not null"), "cand").select("root").distinct()
        sizes = work.save(left.join(fit, "root", "left_semi").groupBy("root").agg(F.count(F.lit(1)).alias("rows")), f"sizes{k}")
        small = sizes.filter(F.col("rows") <= task_rows)
        done = left.join(small, "root", "left_semi").select("root", "cand", "seq", "markers").groupBy("root").applyInPandas(_greedy(set_size, min_completeness, max_contamination, penalty), schema)
        done = work.save(done, f"done{k}")
        out = done if out is None else out.unionByName(done)
        n = sizes.filter(F.col("rows") > task_rows).agg(F.sum("rows")).first()[0]
        if n is None:
            return work.save(out, "picked")
        large = left.join(sizes.filter(F.col("rows") > task_rows), "root", "left_semi").join(scores, "cand")
        key = F.when(F.col("at").isNotNull(), F.struct("at", "cand"))
        marked = work.save(first_at_each(large, key, "top", n=n).withColumn("leads", F.coalesce(F.col("top.cand") == F.col("cand"), F.lit(False))), f"marked{k}")
        firsts = work.save(marked.groupBy("root", "cand").agg(F.bool_and("leads").alias("leads"), F.first("at").alias("at")).filter("leads").select("root", F.col("cand").alias("first"), F.col("at").alias("first_at")), f"firsts{k}")
        others = marked.join(firsts.select(F.col("first").alias("cand")), "cand", "left_anti").select("root", "cand", "markers", F.col("top.cand").alias("first"))
        others = others.join(firsts.drop("root"), "first", "left").select("root", "cand", "markers", F.when(F.col("first_at").isNotNull(), F.col("first")).alias("first"), "first_at")
        dealt = others.repartition(-(-n // deal), "cand").sortWithinPartitions("cand")
        when = dealt.mapInArrow(_overtaken(set_size, min_completeness, max_contamination, penalty), f"root long, at double, name {kinds['cand']}")
        cut = when.groupBy("root").agg(F.min(F.struct("at", "name")).alias("cut"))
        won = firsts.join(cut, "root", "left").filter(F.col("cut").isNull() | (F.struct(F.col("first_at").alias("at"), F.col("first").alias("name")) <= F.col("cut"))).select(F.col("first").alias("cand"))
        taken = work.save(marked.join(won, "cand", "left_semi").select("cand", "seq", (-F.col("at")).alias("score")), f"taken{k}")
        out = out.unionByName(taken)
        rest = marked.join(taken.select("cand").distinct(), "cand", "left_anti").join(taken.select("seq", F.lit(True).alias("gone")), "seq", "left")
        rest = work.save(rest.select("root", "cand", "seq", "markers", F.col("gone").isNotNull().alias("gone")), f"rest{k}")
        touched = rest.filter("gone").select("cand").distinct()
        again = scored(rest.filter("not gone").join(touched, "cand", "left_semi"))
        scores = work.save(scores.join(touched, "cand", "left_anti").unionByName(again), f"scores{k}")
        left = work.save(rest.filter("not gone").drop("gone").join(scores.select("cand"), "cand"), f"left{k}")
        k += 1


def ensemble_consensus(members: DataFrame, markers: DataFrame, set_size: int, min_completeness: float = 30.0, min_free: float = 0.5, penalty: float = 5.0, work: Workspace | None = None, task_rows: int = 50_000) -> DataFrame:
    """(cand, seq, score): candidates in descending score, each taken with its free contigs if half of them are free.

    Components of candidates that share contigs are settled in a task each, up to ``task_rows`` rows. In larger ones a
    candidate is settled as soon as all better ones that share a contig with it are, as the scores are fixed: a round
    settles all that come first at every contig they still hold. Nothing is gathered.
    """
    work = work or Workspace(members.sparkSession, "ensemble")
    kinds = dict(members.dtypes)
    members = members.select("cand", "seq").distinct()
    pooled = members.groupBy("cand").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    s = candidate_scores(members, markers, set_size).filter(F.col("completeness") >= min_completeness)
    s = s.join(pooled, "cand").select("cand", "n", (F.col("completeness") - penalty * F.col("contamination")).alias("score"))
    live = overlap_groups(work.save(members.join(s, "cand"), "live"), work, "overlap")
    small = live.groupBy("root").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") <= task_rows)
    out = live.join(small, "root", "left_semi").groupBy("root").applyInPandas(_in_order(min_free), f"cand {kinds['cand']}, seq {kinds['seq']}, score double")
    left, order, k = work.save(live.join(small, "root", "left_anti").drop("root"), "left0"), F.struct(-F.col("score"), "cand"), 0
    while not left.isEmpty():
        ready = first_at_each(left, order, "best").groupBy("cand", "score", "n").agg(F.count_if(order != F.col("best")).alias("behind"), F.count(F.lit(1)).alias("free")).filter("behind = 0")
        ready = work.save(ready.select("cand", (F.col("free") >= min_free * F.col("n")).alias("taken")), f"ready{k}")
        won = work.save(left.join(ready.filter("taken"), "cand", "left_semi").select("cand", "seq", "score"), f"won{k}")
        out, k = out.unionByName(won), k + 1
        left = work.save(left.join(ready, "cand", "left_anti").join(won.select("seq"), "seq", "left_anti"), f"left{k}")
    return work.save(out, "picked")


def certify(reference: DataFrame, runs: DataFrame, contigs: DataFrame, core: float = 0.8, ambiguous: float = 0.5, fraction: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Stability of a binning under perturbation.

    reference(seq, bin), runs(run, seq, label): a contig agrees with a run if it is in the label that most of its bin
    has there. Gives contigs (seq, bin, prob, state) and bins (bin, core_fraction, mean_prob, certified).
    """
    votes = reference.join(runs, "seq").groupBy("bin", "run", "label").agg(F.count(F.lit(1)).alias("c"))
    plural = votes.groupBy("bin", "run").agg(F.min_by("label", F.struct(-F.col("c"), "label")).alias("plural"))
    seen = reference.join(runs, "seq").join(plural, ["bin", "run"])
    prob = seen.groupBy("bin", "seq").agg(F.avg((F.col("label") == F.col("plural")).cast("double")).alias("prob"))
    each = reference.join(prob, ["bin", "seq"], "left").join(contigs, "seq").select("seq", "bin", "length", "prob", F.when(F.col("prob") >= core, "core").when(F.col("prob") < ambiguous, "ambiguous").otherwise("member").alias("state"))
    bins = each.groupBy("bin").agg((F.sum(F.when(F.col("state") == "core", F.col("length")).otherwise(0)) / F.sum("length")).alias("core_fraction"), (F.sum(F.coalesce("prob", F.lit(0.0)) * F.col("length")) / F.sum("length")).alias("mean_prob"))
    return each, bins.withColumn("certified", (F.col("core_fraction") >= fraction) & (F.col("mean_prob") >= fraction))
