"""Clustering of a weighted graph: label propagation, modularity moves, confidence, ensembles.

Edges are (i, j, score) with i < j and 0 < score < 1; labels are (node, label). Every round is joins and partial
aggregates, and is written out by ``save``, so lineage stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.stats import chi2_even_cdf, chi2_even_sf_any, label_score

Save = Callable[[DataFrame, str], DataFrame]
EPS = 1e-12
TOP = 1 - 1e-6


def arcs(edges: DataFrame) -> DataFrame:
    """(src, dst, w) both ways, with weights below one."""
    w = F.least("score", F.lit(TOP))
    return edges.select(F.col("i").alias("src"), F.col("j").alias("dst"), w.alias("w")).unionByName(edges.select(F.col("j").alias("src"), F.col("i").alias("dst"), w.alias("w")))


def singletons(a: DataFrame) -> DataFrame:
    return a.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("label"))


def label_evidence(a: DataFrame, labels: DataFrame, kind: str) -> DataFrame:
    """(node, label, score): what each node's neighbours say for each of their labels."""
    g = a.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src", "label")
    g = g.agg(F.count(F.lit(1)).alias("m"), F.sum(F.log(1 - F.col("w"))).alias("sl"), F.sum("w").alias("sw"), F.max("w").alias("mw"))
    return g.select(F.col("src").alias("node"), "label", label_score(kind, F.col("m"), F.col("sl"), F.col("sw"), F.col("mw")).alias("score"))


def propagate_once(a: DataFrame, labels: DataFrame, kind: str = "logsum") -> DataFrame:
    """(node, label, prev): one synchronous round. The own label is kept if it is within rounding of the best; else the
    best wins, and of equals the smallest."""
    seen = label_evidence(a, labels, kind).join(labels.withColumnRenamed("label", "prev"), "node")
    best = seen.groupBy("node", "prev").agg(F.max("score").alias("top"), F.max(F.when(F.col("label") == F.col("prev"), F.col("score"))).alias("own"), F.min_by("label", F.struct(-F.col("score"), "label")).alias("best"))
    return best.select("node", F.when(F.col("own") >= F.col("top") - EPS, F.col("prev")).otherwise(F.col("best")).alias("label"), "prev")


def colours(edges: DataFrame, save: Save, most: int = 8, max_rounds: int = 24) -> tuple[DataFrame, bool]:
    """(node, colour) of a graph (i, j), and whether the ends of every edge differ in colour.

    Nodes are ordered by a hash. A node is coloured as soon as all its neighbours before it are, with the smallest colour
    that none of them has: what a loop over the nodes in that order does, in as many rounds as the longest path down the order.
    Once a colour reaches ``most``, or after ``max_rounds``, colours are folded to ``most`` and nodes not coloured yet take
    one by their hash; then neighbours may have equal colours.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
    e = edges.filter("i <> j")
    both = e.select(F.col("i").alias("src"), F.col("j").alias("dst")).unionByName(e.select(F.col("j").alias("src"), F.col("i").alias("dst"))).distinct()
    before = save(both.filter(order("dst") < order("src")), "before")
    nodes = both.select(F.col("src").alias("node")).distinct()
    waits = before.select(F.col("src").alias("node"), F.lit(True).alias("waits")).distinct()
    state = save(nodes.join(waits, "node", "left").select("node", F.when(F.col("waits").isNull(), 0).alias("colour")), "colour0")
    at = F.least("colour", F.lit(62))
    for k in range(1, max_rounds + 1):
        got = state.agg(F.count_if(F.col("colour").isNull()).alias("left"), F.max("colour").alias("top")).first()
        if not got["left"] or got["top"] >= most:
            break
        todo = before.join(state.filter("colour is null").select(F.col("node").alias("src")), "src", "left_semi")
        seen = todo.join(state.select(F.col("node").alias("dst"), "colour"), "dst").groupBy(F.col("src").alias("node"))
        seen = seen.agg(F.count_if(F.col("colour").isNull()).alias("waits"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at)).alias("used")).filter("waits = 0")
        free = F.bit_count(F.bitwise_not("used").bitwiseAND(F.col("used") + 1) - 1)  # the lowest bit not set
        state = save(state.join(seen.select("node", free.alias("free")), "node", "left").select("node", F.coalesce("colour", "free").alias("colour")), f"colour{k % 2 + 1}")
    got = state.agg(F.count_if(F.col("colour").isNull()).alias("left"), F.max("colour").alias("top")).first()
    proper = not got["left"] and (got["top"] is None or got["top"] < most)
    return state.select("node", F.pmod(F.coalesce(F.col("colour").cast("long"), F.xxhash64("node")), F.lit(most)).cast("int").alias("colour")), proper


def propagate_runs(edges: DataFrame, save: Save, kind: str = "tail", max_rounds: int = 60, start: DataFrame | None = None, order: tuple[DataFrame, bool] | None = None, patience: int = 3) -> DataFrame:
    """(run, node, label) of graphs (run, i, j, score), all runs together, when no node of a run changes any more.

    A round lets the colours of the united graph (or of ``order``) have their turn. Nodes of one colour aren't neighbours, so
    moving them together is what a loop over them does: each takes the label of most evidence, keeps its own if that is as
    good, and of others that are equal takes the smallest. Once fewer than a quarter of the nodes move in a round, a node is
    looked at only if a neighbour has changed since its last turn, and a run only as long as it changes. A turn reads its
    colour's arcs and writes the nodes that moved in this round so far, whatever the number of runs; a round ends with one write of the labels.

    Not every kind of evidence grows from move to move, so labels may go round for ever: a run ends as well when for
    ``patience`` rounds its moves haven't become fewer than ever before.

    Where colours had to be folded (``colours``), neighbours of one turn that both want to move do so to smaller
    labels only in odd rounds, to larger ones only in even rounds, so they never swap; then two rounds without a move end a run.
    """
    of, proper = order or colours(edges.select("i", "j").distinct(), save)
    w = F.least("score", F.lit(TOP))
    both = edges.select("run", F.col("i").alias("src"), F.col("j").alias("dst"), w.alias("w")).unionByName(edges.select("run", F.col("j").alias("src"), F.col("i").alias("dst"), w.alias("w")))
    a = save(both.join(of.select(F.col("node").alias("src"), "colour"), "src").sortWithinPartitions("colour"), "arcs")
    turns = [r[0] for r in a.select("colour").distinct().orderBy("colour").collect()]
    if start is None:
        start = a.select("run", F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    held = save(start.select("run", "node", "label", F.lit(0).alias("changed")), "labels0")
    now, quiet, fewest = 0, {}, {}
    size = {r["run"]: r["count"] for r in held.groupBy("run").count().collect()}  # a row per run
    live, few = list(size), False
    for t in range(1, max_rounds + 1):
        moved = None
        for colour in turns:
            now += 1
            lab = held
            if moved is not None:
                lab = held.join(moved.select("run", "node", F.col("label").alias("to"), F.col("changed").alias("at")), ["run", "node"], "left").select("run", "node", F.coalesce("to", "label").alias("label"), F.coalesce("at", "changed").alias("changed"))
            own = a.filter((F.col("colour") == colour) & F.col("run").isin(live))
            if proper and few:
                recent = lab.filter(F.col("changed") > now - len(turns)).select("run", F.col("node").alias("dst"))
                own = own.join(own.join(recent, ["run", "dst"]).select("run", "src").distinct(), ["run", "src"], "left_semi")
            g = own.join(lab.select("run", F.col("node").alias("dst"), "label"), ["run", "dst"]).groupBy("run", "src", "label")
            g = g.agg(F.count(F.lit(1)).alias("m"), F.sum(F.log(1 - F.col("w"))).alias("sl"), F.sum("w").alias("sw"), F.max("w").alias("mw"))
            score = label_score(kind, F.col("m"), F.col("sl"), F.col("sw"), F.col("mw"))
            seen = g.select("run", F.col("src").alias("node"), "label", score.alias("score")).join(lab.select("run", "node", F.col("label").alias("prev")), ["run", "node"])
            best = seen.groupBy("run", "node", "prev").agg(F.max("score").alias("top"), F.max(F.when(F.col("label") == F.col("prev"), F.col("score"))).alias("own"), F.min_by("label", F.struct(-F.col("score"), "label")).alias("label"))
            want = best.filter(F.col("own").isNull() | (F.col("own") < F.col("top") - EPS)).select("run", "node", "label", "prev")
            if not proper:
                want = save(want, "want")
                ends = own.join(want.select("run", F.col("node").alias("src")), ["run", "src"], "left_semi").join(want.select("run", F.col("node").alias("dst")), ["run", "dst"], "left_semi")
                clash = ends.select("run", F.col("src").alias("node"), F.lit(True).alias("clash")).distinct()
                turn = F.col("label") < F.col("prev") if t % 2 else F.col("label") > F.col("prev")
                want = want.join(clash, ["run", "node"], "left").filter(F.col("clash").isNull() | turn)
            one = want.select("run", "node", "label", F.lit(now).alias("changed"))
            moved = save(one if moved is None else moved.unionByName(one), f"moved{now % 2}")  # all of this round so far
        if moved is None:
            break
        to = moved.select("run", "node", F.col("label").alias("to"), F.col("changed").alias("at"))
        held = save(held.join(to, ["run", "node"], "left").select("run", "node", F.coalesce("to", "label").alias("label"), F.coalesce("at", "changed").alias("changed")), f"labels{t % 2 + 1}")
        moves = {r["run"]: r["count"] for r in moved.groupBy("run").count().collect()}  # a row per run
        for run in live:
            n = moves.get(run, 0)
            quiet[run] = 0 if n else quiet.get(run, 0) + 1
            fewest[run] = (n, t) if n < fewest.get(run, (n + 1, 0))[0] else fewest[run]
        live = [run for run in live if quiet[run] < (1 if proper else 2) and t - fewest[run][1] < (patience if proper else 2 * patience)]
        if not live:
            break
        few = 4 * sum(moves.get(run, 0) for run in live) < sum(size[run] for run in live)
    names = held.groupBy("run", "label").agg(F.min("node").alias("name"))
    return save(held.join(names, ["run", "label"]).select("run", "node", F.col("name").alias("label")), "named")


def propagate(edges: DataFrame, save: Save, kind: str = "tail", max_rounds: int = 60, start: DataFrame | None = None) -> DataFrame:
    """(node, label) of one graph (i, j, score), by ``propagate_runs``; ``start`` is (node, label)."""
    start = start if start is None else start.select(F.lit(0).alias("run"), "node", "label")
    return propagate_runs(edges.select(F.lit(0).alias("run"), "i", "j", "score"), save, kind, max_rounds, start).select("node", "label")


def node_confidence(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label, confidence, second_label, second_score): the margin between the own and the best other label."""
    a = arcs(edges)
    g = a.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("m"), F.sum(F.log(1 - F.col("w"))).alias("sl"))
    ev = g.select(F.col("src").alias("node"), F.col("label").alias("k"), chi2_even_cdf(F.col("m"), -2 * F.col("sl")).alias("s")).join(labels, "node")
    out = ev.groupBy("node", "label").agg(F.coalesce(F.max(F.when(F.col("k") == F.col("label"), F.col("s"))), F.lit(0.0)).alias("own"), F.min(F.when(F.col("k") != F.col("label"), F.struct((-F.col("s")).alias("n"), "k"))).alias("other"))
    second = F.coalesce(-F.col("other.n"), F.lit(0.0))
    return out.select("node", "label", F.least(F.greatest(F.col("own") - second, F.lit(0.0)), F.lit(1.0)).alias("confidence"), F.col("other.k").alias("second_label"), second.alias("second_score"))


def binned_nodes(edges: DataFrame) -> DataFrame:
    """Nodes with at least one positive edge."""
    e = edges.filter("score > 0")
    return e.select(F.col("i").alias("node")).unionByName(e.select(F.col("j").alias("node"))).distinct()


def modularity_moves(edges: DataFrame, save: Save, gamma: float = 1.0, rounds: int = 12, levels: int = 4) -> DataFrame:
    """(node, label) by greedy modularity moves over ever coarser graphs.

    In a round, half of the nodes, picked by a hash of node and round, move to the neighbouring community of the
    largest gain; then communities become nodes. Weights are the evidence -ln(1 - score).
    """
    a = save(edges.select("i", "j", (-F.log(1 - F.least("score", F.lit(TOP)))).alias("w")), "level0")
    of = save(binned_nodes(edges).select("node", F.col("node").alias("label")), "of0")
    for lv in range(levels):
        both = a.filter("i <> j").select(F.col("i").alias("src"), F.col("j").alias("dst"), "w").unionByName(a.filter("i <> j").select(F.col("j").alias("src"), F.col("i").alias("dst"), "w"))
        loops = a.filter("i = j").select(F.col("i").alias("node"), (2 * F.col("w")).alias("k"))
        deg = save(both.select(F.col("src").alias("node"), F.col("w").alias("k")).unionByName(loops).groupBy("node").agg(F.sum("k").alias("k")), f"deg{lv}")
        m2 = deg.agg(F.sum("k")).first()[0] or 0.0
        if m2 == 0:
            break
        comm = save(deg.select("node", F.col("node").alias("c"), "k"), f"comm{lv}")
        still = 0
        for r in range(rounds):
            tot = comm.groupBy("c").agg(F.sum("k").alias("t"))
            into = both.join(comm.select(F.col("node").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("node"), "c").agg(F.sum("w").alias("w"))
            cand = into.join(tot, "c").join(comm.select("node", F.col("c").alias("own"), "k"), "node")
            gain = F.col("w") - gamma * F.col("k") * (F.col("t") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / m2
            # without an edge into its own community, a node only loses there
            alone = -gamma * F.col("k") * (F.col("own_t") - F.col("k")) / m2
            best = cand.join(tot.select(F.col("c").alias("own"), F.col("t").alias("own_t")), "own").select("node", "own", "k", "c", gain.alias("g"), alone.alias("alone")).groupBy("node", "own").agg(F.min_by("c", F.struct(-F.col("g"), "c")).alias("to"), F.max("g").alias("g"), F.coalesce(F.max(F.when(F.col("c") == F.col("own"), F.col("g"))), F.max("alone")).alias("stay"))
            turn = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0
            moved = best.filter(turn & (F.col("g") > F.col("stay") + 1e-9) & (F.col("to") != F.col("own")))
            comm = save(comm.join(moved.select("node", "to"), "node", "left").select("node", F.coalesce("to", "c").alias("c"), "k", F.col("to").isNotNull().alias("moved")), f"comm{lv}-{r}")
            still = still + 1 if comm.filter("moved").isEmpty() else 0
            comm = comm.drop("moved")
            if still == 2:
                break
        names = comm.groupBy("c").agg(F.min("node").alias("name"))
        to = save(comm.join(names, "c").select("node", "name"), f"to{lv}")
        of = save(of.join(to.select(F.col("node").alias("label"), "name"), "label").select("node", F.col("name").alias("label")), f"of{lv + 1}")
        x = a.join(to.select(F.col("node").alias("i"), F.col("name").alias("a")), "i").join(to.select(F.col("node").alias("j"), F.col("name").alias("b")), "j")
        coarser = save(x.groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.sum("w").alias("w")), f"level{lv + 1}")
        if to.filter("node <> name").isEmpty():
            break
        a = coarser
    return of


def fused(edges: DataFrame, save: Save, gamma: float = 8.0, kind: str = "tail", max_rounds: int = 60) -> DataFrame:
    """(node, label): propagation that starts from the communities of modularity moves instead of single nodes."""
    start = modularity_moves(edges, lambda df, n: save(df, f"moves-{n}"), gamma)
    return propagate(edges, lambda df, n: save(df, f"refine-{n}"), kind, max_rounds, start)


def super_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, m, sl), both ways: number and summed ln(1 - score) of the edges between two labels."""
    lab = labels.select(F.col("node").alias("i"), F.col("label").alias("a")), labels.select(F.col("node").alias("j"), F.col("label").alias("b"))
    w = F.log(1 - F.least("score", F.lit(TOP)))
    e = edges.filter("score > 0").join(lab[0], "i").join(lab[1], "j").filter("a <> b")
    one = e.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("m"), F.sum(w).alias("sl"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "m", "sl"))


def super_merge(edges: DataFrame, labels: DataFrame, save: Save, doubt: float = 1e-9, least: int = 3, max_rounds: int = 60) -> DataFrame:
    """(node, label): labels whose edges to another label are together too strong for chance join it.

    A label moves to the neighbour of the smallest upper tail if that is at most ``doubt`` and comes from ``least`` edges or
    more; of equals to the smallest. Moves take turns downwards and upwards as in ``propagate``, over the graph of labels,
    which is summed up once.
    """
    s = save(super_edges(edges, labels), "super")
    state = save(s.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("label"), F.array("node").alias("past"), F.lit(False).alias("frozen")), "super0")
    quiet = 0
    for k in range(1, max_rounds + 1):
        of = state.select(F.col("node").alias("b"), F.col("label").alias("to"))
        ev = s.join(of, "b").groupBy("a", "to").agg(F.sum("m").alias("m"), F.sum("sl").alias("sl")).join(state.select(F.col("node").alias("a"), F.col("label").alias("own")), "a").filter("to <> own")
        ev = ev.select("a", "to", "m", chi2_even_sf_any(F.col("m"), -2 * F.col("sl")).alias("tail")).filter((F.col("tail") <= doubt) & (F.col("m") >= least))
        best = ev.groupBy(F.col("a").alias("node")).agg(F.min_by("to", F.struct("tail", "to")).alias("to"))
        turn = F.col("to") < F.col("label") if k % 2 else F.col("to") > F.col("label")
        change = F.coalesce(turn, F.lit(False)) & ~F.col("frozen")
        again = change & F.array_contains("past", F.col("to"))
        state = save(state.join(best, "node", "left").select("node", F.when(change, F.col("to")).otherwise(F.col("label")).alias("label"), F.when(change & ~again, F.concat("past", F.array("to"))).otherwise(F.col("past")).alias("past"), (F.col("frozen") | again).alias("frozen"), change.alias("changed")), f"super{k % 2 + 1}")
        quiet = quiet + 1 if state.filter("changed").isEmpty() else 0
        if quiet == 2:
            break
        state = state.drop("changed")
    return labels.join(state.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def jittered(edges: DataFrame, seed, spread: float = 0.05) -> DataFrame:
    """Scores changed by up to ``spread`` of themselves, from a hash of the edge and the seed, a number or a column."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    u = (F.pmod(F.xxhash64("i", "j", seed), F.lit(1_000_003)) / 1_000_003.0 - 0.5) * 2
    return edges.withColumn("score", F.least(F.col("score") * (1 + spread * u), F.lit(TOP)))


def seed_ensemble(edges: DataFrame, save: Save, runs: int = 5, kind: str = "tail", max_rounds: int = 30) -> DataFrame:
    """(node, label): propagation over edges weighted by how many perturbed runs kept both ends together.

    The runs are propagated together; the last propagation takes its turns in the same order."""
    keep = lambda label: lambda df, n: save(df, f"{label}-{n}")
    order = colours(edges.select("i", "j"), keep("order"))
    many = jittered(edges.select("i", "j", "score", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")), F.col("run"))
    lab = save(propagate_runs(many, keep("runs"), kind, max_rounds, order=order), "runs")
    votes = edges.join(lab.select("run", F.col("node").alias("i"), F.col("label").alias("a")), "i").join(lab.select("run", F.col("node").alias("j"), F.col("label").alias("b")), ["run", "j"])
    share = votes.groupBy("i", "j").agg(F.max("score").alias("score"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("share")).filter("share > 0")
    agreed = save(share.select(F.lit(0).alias("run"), "i", "j", (F.col("score") * F.col("share")).alias("score")), "agreed")
    return propagate_runs(agreed, keep("final"), kind, max_rounds, order=order).select("node", "label")
