"""Choosing and doubting a binning: settings swept over one graph, runs under perturbation, several resolutions.

The pairs of the graph are scored once (``graph.edge_terms``); each setting mixes the stored terms anew and propagates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.workspace import Workspace

from . import cluster as C
from . import evaluate as E
from . import graph as G
from .refine import abundance_split

#: (weight of composition, power of the score) where no grid is given.
GRID = ((0.3, 1.0), (0.4, 1.0), (0.5, 1.0), (0.5, 1.5), (0.6, 1.0))
SILHOUETTES = (0.6, 0.7, 0.8)


@dataclass(frozen=True)
class Setting:
    alpha: float
    power: float = 1.0
    min_score: float = 0.7
    seed: int = 0


def parse_grid(text: str) -> list[tuple[float, float]]:
    """"a:p;a:p" -> [(a, p)]; an absent power is 1; an empty text or "1" is the usual grid; what isn't a number is left out."""
    if text.strip() in ("", "1"):
        return list(GRID)
    out = []
    for part in text.split(";"):
        a, _, p = part.partition(":")
        try:
            out.append((float(a), float(p or 1)))
        except ValueError:
            continue
    return out or list(GRID)


def clustered_runs(edges: DataFrame, save, kind: str, seeds: list[int], max_rounds: int = 60, order: tuple[DataFrame, bool] | None = None) -> DataFrame:
    """(run, node, label) of graphs (run, i, j, score), propagated together. Run r starts with labels named in an order that
    hangs on ``seeds[r]``; at the end labels are the smallest nodes that carry them."""
    nodes = edges.select("run", F.col("i").alias("node")).union(edges.select("run", "j")).distinct()
    seed = F.get(F.array(*[F.lit(int(x)) for x in seeds]), F.col("run"))
    start = nodes.select("run", "node", F.when(seed == 0, F.col("node")).otherwise(F.xxhash64("node", seed)).alias("label"))
    return C.propagate_runs(edges, save, kind, max_rounds, start, order)


def near_complete(labels: DataFrame, markers: DataFrame, set_size: int) -> tuple[int, float]:
    """(bins above 90 % completeness and under 5 % contamination, their summed completeness)."""
    good = E.qc_per_bin(markers, labels.select(F.col("node").alias("seq"), F.col("label").alias("bin")), set_size).filter("completeness > 90 and contamination < 5")
    r = good.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("completeness"), F.lit(0.0)).alias("s")).first()
    return r["n"], r["s"]


@dataclass
class Choice:
    alpha: float
    power: float
    silhouette: float | None
    labels: DataFrame
    table: list[dict]


def sweep(terms: DataFrame, work: Workspace, grid=GRID, min_score: float = 0.7, kind: str = "tail", markers: DataFrame | None = None, set_size: int = 0, members: DataFrame | None = None, floor: int = 200_000) -> Choice:
    """The best setting of a grid over edge terms (i, j, sim, term), and its labels.

    Without markers the weighted modularity on the composition graph decides; with markers the number of near-complete
    bins, then their completeness. With ``members`` (seq, length, y[]) as well, bins are split at each silhouette
    before they are judged, and the silhouette is chosen too. Of equals the first wins.
    """
    if not len(grid):
        raise ValueError("the grid is empty")
    plain = terms.filter("sim > 0").select("i", "j", F.col("sim").alias("score"))
    edges = work.save(G.mixed_runs(terms, [(n, alpha, min_score, power) for n, (alpha, power) in enumerate(grid)]), "sweep-edges")
    labels = clustered_runs(edges, lambda df, x: work.save(df, f"sweep-{x}"), kind, [0] * len(grid))
    each = plain.select(F.col("i").alias("node")).union(plain.select("j")).distinct().withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))
    every = work.save(each.join(labels, ["run", "node"], "left").select("run", "node", F.coalesce("label", "node").alias("label")), "sweep-every")
    quality = {r["run"]: r["q"] or 0.0 for r in G.modularity_runs(plain, every).collect()}  # a row per setting
    best, rows = None, []
    for n, (alpha, power) in enumerate(grid):
        lab = labels.filter(F.col("run") == n).select("node", "label")
        q = quality.get(n, 0.0)
        options = [(None, lab)]
        if markers is not None and members is not None:
            bins = members.join(lab.select(F.col("node").alias("seq"), F.col("label").alias("bin")), "seq")
            options = []
            for s in SILHOUETTES:
                cut = abundance_split(bins, floor, threshold=s)
                names = cut.groupBy("bin", "piece").agg(F.min("seq").alias("name"))
                options.append((s, work.save(cut.join(names, ["bin", "piece"]).select(F.col("seq").alias("node"), F.col("name").alias("label")), f"split{n}-{int(s * 100)}")))
        for s, got in options:
            rank = near_complete(got, markers, set_size) if markers is not None else (q, 0.0)
            rows.append({"alpha": alpha, "power": power, "silhouette": s, "modularity": q, "rank": rank})
            if best is None or rank > best[0]:
                best = (rank, Choice(alpha, power, s, lab, rows))
    return best[1]


def perturbations(base: Setting) -> list[Setting]:
    """Ten settings around ``base``: the weight of composition, the least score, the power and the order of labels."""
    def at(alpha: float = 0.0, score: float = 0.0, power: float | None = None, seed: int = 0) -> Setting:
        return Setting(round(min(max(base.alpha + alpha, 0.0), 1.0), 12), base.power if power is None else power, max(0.01, base.min_score + score), seed or base.seed)

    other = 1.5 if base.power == 1.0 else 1.0
    return [at(-0.1), at(0.1), at(score=-0.03), at(score=0.03), at(power=other), at(seed=1), at(seed=2), at(-0.1, seed=3), at(0.1, seed=4), at(score=-0.03, seed=5)]


def perturbed_runs(pairs: DataFrame, prof: DataFrame, samples: int, base: Setting, work: Workspace, kind: str = "tail", mode: str = "corr", most_dropped: int = 6, max_rounds: int = 60, settings: list[Setting] | None = None, min_coverage: float = 1.0, neg_corr: float = -0.3, order: tuple[DataFrame, bool] | None = None) -> DataFrame:
    """(run, seq, label): the pairs (i, j, sim) clustered under each of ``settings`` (``perturbations`` if None) and, from four samples on, with each of up to
    ``most_dropped`` samples left out.

    A contig without an edge in a run is alone there. The pairs are scored once for all settings and once for all samples left
    out, and all runs are propagated together: the number of Spark jobs doesn't hang on the number of runs.
    """
    settings = perturbations(base) if settings is None else settings
    dropped = min(samples, most_dropped) if samples >= 4 else 0
    runs = [(n, s.alpha, s.min_score, s.power) for n, s in enumerate(settings)]
    terms = work.save(G.edge_terms(pairs, prof, mode, min_coverage, neg_corr), "run-terms")
    edges = G.mixed_runs(terms, runs)
    if dropped:
        first = len(runs)
        each = F.explode(F.sequence(F.lit(0), F.lit(dropped - 1))).alias("k")
        less = G.without_sample(prof.select("seq", "depth", "scaled", each), F.col("k"), ("k",))
        less = G.edge_terms(pairs.select("i", "j", "sim", each), less, mode, min_coverage, neg_corr, ("k",)).withColumn("run", F.col("k") + first).drop("k")
        edges = edges.unionByName(G.mixed_runs(less, [(first + k, base.alpha, base.min_score, base.power) for k in range(dropped)]))
    edges = work.save(edges, "run-edges")
    seeds = [s.seed for s in settings] + [base.seed] * dropped
    lab = clustered_runs(edges, lambda df, x: work.save(df, f"runs-{x}"), kind, seeds, max_rounds, order)
    nodes = pairs.select(F.col("i").alias("seq")).union(pairs.select("j")).distinct().withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(len(seeds) - 1))))
    whole = nodes.join(lab.select("run", F.col("node").alias("seq"), "label"), ["run", "seq"], "left")
    return work.save(whole.select("run", "seq", F.coalesce("label", "seq").alias("label")), "perturbed")


def alternatives(reference: DataFrame, runs: DataFrame) -> DataFrame:
    """(bin, seq, alternative, alt_prob): the bin that a contig most often goes to where it leaves its own.

    In a run, a bin stands for the label that most of its members have; of bins with the same label, the largest
    owns it. Of equally frequent ones the smallest bin is named.
    """
    votes = reference.join(runs, "seq").groupBy("bin", "run", "label").agg(F.count(F.lit(1)).alias("c"))
    plural = votes.groupBy("bin", "run").agg(F.min_by("label", F.struct(-F.col("c"), "label")).alias("plural"))
    sizes = reference.groupBy("bin").agg(F.count(F.lit(1)).alias("size"))
    owner = plural.join(sizes, "bin").groupBy("run", F.col("plural").alias("label")).agg(F.min_by("bin", F.struct(-F.col("size"), "bin")).alias("owner"))
    seen = reference.join(runs, "seq").join(plural, ["bin", "run"]).join(owner, ["run", "label"], "left")
    n = seen.groupBy("bin", "seq").agg(F.count(F.lit(1)).alias("seen"))
    left = seen.filter((F.col("label") != F.col("plural")) & (F.col("owner") != F.col("bin"))).groupBy("bin", "seq", "owner").agg(F.count(F.lit(1)).alias("c"))
    best = left.groupBy("bin", "seq").agg(F.min_by("owner", F.struct(-F.col("c"), "owner")).alias("alternative"), F.max("c").alias("c"))
    return best.join(n, ["bin", "seq"]).select("bin", "seq", "alternative", (F.col("c") / F.col("seen")).alias("alt_prob"))


def parse_resolutions(text: str, floor: int, silhouette: float) -> list[tuple[str, int, float]]:
    """"name:floor:silhouette,..." -> [(name, floor, silhouette)]; a part without a colon is left out, and one with a single
    colon takes both values from the defaults."""
    out = []
    for part in text.split(","):
        bits = part.split(":", 2)
        if len(bits) == 2:
            out.append((bits[0], floor, silhouette))
        elif len(bits) == 3:
            out.append((bits[0], int(bits[1] or 0), float(bits[2] or 0)))
    return out


def at_resolutions(members: DataFrame, resolutions: list[tuple[str, int, float]], least: int = 6, max_k: int = 6, restarts: int = 10) -> DataFrame:
    """(resolution, bin, piece, seq, length): the same bins split with each resolution's floor and silhouette."""
    out = None
    for name, floor, silhouette in resolutions:
        cut = abundance_split(members, floor, least, max_k, silhouette, restarts)
        kept = cut.groupBy("bin", "piece").agg(F.sum("length").alias("t")).filter(F.col("t") >= floor).select("bin", "piece")
        one = cut.join(kept, ["bin", "piece"], "left_semi").select(F.lit(name).alias("resolution"), "bin", "piece", "seq", "length")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no resolution given")
    return out
