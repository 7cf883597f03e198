"""The whole way from contigs and depths to bins, as one plan of stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.config import BinConfig
from strandloom.functions import arrays as A
from strandloom.functions import sequences as S
from strandloom.functions.stats import chi2_critical
from strandloom.operators import cluster as C
from strandloom.operators import evaluate as E
from strandloom.operators import graph as G
from strandloom.operators import pairs as P
from strandloom.operators import refine as R
from strandloom.operators import tuning as U
from strandloom.workspace import Workspace


@dataclass
class Binning:
    edges: DataFrame
    labels: DataFrame
    bins: DataFrame
    table: DataFrame
    #: (seq, bin, length, prob, state, alternative, alt_prob) and (bin, core_fraction, mean_prob, certified) of the labels, if asked for.
    stable: DataFrame | None = None
    stable_bins: DataFrame | None = None


def features(contigs: DataFrame, depths: DataFrame, work: Workspace, cfg: BinConfig) -> DataFrame:
    """(id, length, depth, scaled, unit, y, w, tnf): one row a contig that has both a sequence and depths."""
    both = contigs.join(depths.select(F.col("name"), "depth"), "name")
    both = work.save(both.select("id", "name", F.length("seq").cast("long").alias("length"), "seq", "depth"), "contigs")
    spec = work.save(S.spectra(both.select("id", "seq")), "spectra")
    w = S.kmer_weights(spec, "gc")
    depth = G.normalised(both.select(F.col("id").alias("seq"), "depth")).select("*", A.centred_unit(A.average_ranks(F.col("depth"))).alias("unit")).withColumnRenamed("seq", "id")
    out = both.drop("seq", "depth").join(depth, "id").join(w, "id").join(spec.select("id", A.unit(F.col("k4")).alias("tnf")), "id")
    return work.save(out.withColumn("y", R.log_depth(F.col("depth"))), "features")


def similarity_pairs(feat: DataFrame, work: Workspace, cfg: BinConfig) -> DataFrame:
    """(i, j, sim): mutual nearest neighbours by composition sketches."""
    large = feat.filter(F.col("length") >= cfg.min_contig)
    sk = work.save(S.weighted_sketch(large.select("id", "w"), cfg.sketch_m, cfg.seed), "sketches")
    if sk.count() < cfg.index_from:
        raw = P.all_pairs(sk, P.match_kernel, ["sketch"], None, cfg.max_edges)
    else:
        raw = P.banded_pairs(sk, S.match_share, cfg.band_registers, cfg.sketch_m, cfg.posting_cap)
    raw = work.save(raw, "raw_pairs")
    chance = work.save(P.random_pairs(sk, "sketch", S.match_share), "chance_pairs")
    base = G.upper_median(chance, "sim").first()
    b0 = min(base["sim"], 0.95) if base else 0.0
    pairs = work.save(raw.select("i", "j", S.stretched(F.col("sim"), F.lit(b0)).alias("sim")), "pairs")
    near = P.top_k(pairs, cfg.max_edges)
    if cfg.sim_cutoff:
        cut = cfg.sim_cutoff
    else:
        best = P.directed(pairs).groupBy(F.col("src").alias("id")).agg(F.max("sim").alias("sim"))
        row = G.similarity_cutoff(best, cfg.max_posterior, 0.05).first()
        cut = row["cutoff"] if row and row["cutoff"] is not None else 0.05
    near = near.filter(F.col("sim") >= cut)
    return work.save(P.mutual(near).select("i", "j", "sim"), "mutual")


def weighed(pairs: DataFrame, feat: DataFrame, samples: int, work: Workspace, cfg: BinConfig, gfa: DataFrame | None = None, alpha: float | None = None, power: float = 1.0) -> DataFrame:
    """(i, j, score): pairs weighed with depth; links of an assembly graph are edges of a fixed score."""
    large = feat.filter(F.col("length") >= cfg.min_contig).withColumnRenamed("id", "seq")
    edges = G.edge_scores(pairs, large, samples, alpha, "corr", cfg.min_edge_score, cfg.min_coverage, cfg.neg_corr, power)
    if gfa is not None:
        links = gfa.select("i", "j", F.lit(cfg.gfa_weight).alias("score"))
        edges = edges.unionByName(links).groupBy("i", "j").agg(F.max("score").alias("score"))
    return work.save(edges, "edges")


def clustered(edges: DataFrame, work: Workspace, cfg: BinConfig) -> DataFrame:
    """(node, label) by the configured way of clustering."""
    if cfg.clustering == "louvain":
        return C.modularity_moves(edges, work.save, cfg.gamma)
    if cfg.clustering == "fuse":
        return C.fused(edges, work.save, cfg.gamma, cfg.lpa_score, cfg.lpa_max_rounds)
    labels = C.propagate(edges, work.save, cfg.lpa_score, cfg.lpa_max_rounds)
    if cfg.clustering == "mlpa":
        return work.save(C.super_merge(edges, labels, work.save, cfg.merge_doubt, cfg.merge_edges, cfg.lpa_max_rounds), "united")
    if cfg.clustering != "lpa":
        raise ValueError(f"unknown clustering {cfg.clustering!r}")
    return labels


def chosen(pairs: DataFrame, feat: DataFrame, work: Workspace, cfg: BinConfig, markers: DataFrame | None, set_size: int | None) -> U.Choice:
    """The setting that ``cfg.select`` asks for, out of its grid."""
    if cfg.select not in ("modularity", "markers", "markers+split"):
        raise ValueError(f"unknown selection {cfg.select!r}")
    by_markers = cfg.select != "modularity"
    if by_markers and (markers is None or not set_size):
        raise ValueError("selection by markers needs markers and the size of their set")
    large = feat.filter(F.col("length") >= cfg.min_contig).withColumnRenamed("id", "seq")
    terms = work.save(G.edge_terms(pairs, large, "corr", cfg.min_coverage, cfg.neg_corr), "terms")
    split = large.select("seq", "length", "y") if cfg.select == "markers+split" else None
    return U.sweep(terms, work, U.parse_grid(cfg.grid), cfg.min_edge_score, cfg.lpa_score, markers if by_markers else None, set_size or 0, split, cfg.min_bin_size)


def certified(labels: DataFrame, pairs: DataFrame, feat: DataFrame, samples: int, work: Workspace, cfg: BinConfig, alpha: float, power: float) -> tuple[DataFrame, DataFrame]:
    """How far labels hold under perturbation: contigs with their alternatives, and bins."""
    large = work.save(feat.filter(F.col("length") >= cfg.min_contig).select(F.col("id").alias("seq"), "length", "depth", "scaled", "unit"), "profiles")
    runs = U.perturbed_runs(pairs, large, samples, U.Setting(alpha, power, cfg.min_edge_score), work, cfg.lpa_score, most_dropped=cfg.cert_dropped, max_rounds=cfg.lpa_max_rounds, min_coverage=cfg.min_coverage, neg_corr=cfg.neg_corr)
    ref = work.save(labels.select(F.col("node").alias("seq"), F.col("label").alias("bin")), "reference")
    each, bins = E.certify(ref, runs, large.select("seq", "length"), cfg.cert_core, cfg.cert_ambiguous, cfg.cert_fraction)
    return work.save(each.join(U.alternatives(ref, runs), ["bin", "seq"], "left"), "stable"), work.save(bins, "stable_bins")


def similarity_graph(feat: DataFrame, samples: int, work: Workspace, cfg: BinConfig, gfa: DataFrame | None = None) -> DataFrame:
    """(i, j, score): mutual nearest neighbours by composition sketches, weighed with depth."""
    return weighed(similarity_pairs(feat, work, cfg), feat, samples, work, cfg, gfa)


def bin_contigs(spark: SparkSession, contigs: DataFrame, depths: DataFrame, cfg: BinConfig = BinConfig(), gfa: DataFrame | None = None, links: DataFrame | None = None, markers: DataFrame | None = None, marker_set: int | None = None, trajectories: DataFrame | None = None) -> Binning:
    """contigs(id long, name, seq), depths(name, depth[]): graph, propagation, recruitment, splitting, merging, rescue, bins.

    Optional: gfa (i, j), links (i, j, cnt) of read pairs, markers (seq = id, marker) with the set's size,
    trajectories (contig = id, v[]) of variants, which cut edges that they contradict.
    """
    work = Workspace(spark, "binning")
    feat = features(contigs, depths, work, cfg)
    one = feat.select(F.size("depth").alias("s")).first()
    samples = one["s"] if one else 0
    pairs = similarity_pairs(feat, work, cfg)
    if trajectories is not None:
        pairs = work.save(G.trajectory_gate(pairs, trajectories, cfg.variant_cosine), "gated")
    alpha, power, silhouette = G.composition_weight(samples), 1.0, cfg.split_silhouette
    if cfg.select:
        best = chosen(pairs, feat, work, cfg, markers, marker_set)
        alpha, power, silhouette = best.alpha, best.power, best.silhouette or silhouette
    edges = weighed(pairs, feat, samples, work, cfg, gfa, alpha, power)
    labels = clustered(edges, work, cfg)
    stable = certified(labels, pairs, feat, samples, work, cfg, alpha, power) if cfg.certify else (None, None)
    cols = ["seq", "length", "y", "unit", "tnf", "depth"]
    nodes = feat.withColumnRenamed("id", "seq").select(*cols)
    members = work.save(nodes.join(labels.select(F.col("node").alias("seq"), F.col("label").alias("bin")), "seq"), "members0")
    model = bins = None
    if samples > 1:
        long = R.long_form(members)
        model = work.save(R.fit_variance(long), "model")
        big = members.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= cfg.min_recruit_cluster).select("bin")
        bins = work.save(R.sufficient(long.join(big, "bin", "left_semi"), model), "stats")
        left = nodes.join(members.select("seq"), "seq", "left_anti").filter(F.col("length") >= cfg.min_small_contig)
        got = R.recruit_by_abundance(work.save(left.select("seq", "length", "y"), "left"), bins, model, samples, cfg.alpha)
        members = work.save(members.unionByName(nodes.join(got, "seq").select(*members.columns)), "members1")
    how = {"least": cfg.split_min_members, "max_k": cfg.split_max_k, "threshold": silhouette, "restarts": cfg.split_restarts}
    if cfg.split_feedback and samples > 1:
        split = work.save(R.feedback_split(members, work, cfg.min_bin_size, cfg.split_coherence_percent, **how).drop("again"), "pieces")
    else:
        split = R.abundance_split(members, cfg.min_bin_size, **how)
    # a piece is named by its smallest contig, so names stay unique
    named = split.groupBy("bin", "piece").agg(F.min("seq").alias("name"))
    where = work.save(split.join(named, ["bin", "piece"]).select("seq", F.col("name").alias("bin")), "split")
    if links is not None and model is not None:
        m = nodes.join(where, "seq")
        stats = work.save(R.sufficient(R.long_form(m.select("bin", "seq", "length", "y")), model), "merge_stats")
        sizes = work.save(m.groupBy("bin").agg(F.sum("length").alias("total_length")), "merge_sizes")
        linked = work.save(R.linked_bins(links, where), "merge_pairs")
        crit = chi2_critical(samples, cfg.alpha, linked.count())
        joined = R.merge_bins(R.merge_candidates(linked, stats, sizes, cfg.min_bin_size, crit), stats, sizes, cfg.min_bin_size, crit)
        where = work.save(where.join(joined, "bin").select("seq", F.col("root").alias("bin")), "merged")
    if cfg.core_recruit and samples > 1:
        m = nodes.join(where, "seq")
        cores = m.groupBy("bin").agg(F.sum("length").alias("t")).filter(F.col("t") >= cfg.min_bin_size).select("bin")
        rest = nodes.join(where.select("seq"), "seq", "left_anti").filter(F.col("length") >= cfg.min_contig)
        took, _ = R.calibrated_recruit(work.save(m.join(cores, "bin", "left_semi").select("bin", "seq", "length", "unit", "tnf"), "core_members"), work.save(rest.select("seq", "length", "unit", "tnf"), "leftover"), work)
        where = work.save(where.unionByName(took.select("seq", "bin")), "recruited")
    if markers is not None and samples >= 1:
        m = nodes.join(where, "seq").select("bin", "seq", F.posexplode("depth").alias("sample", "depth"))
        where = work.save(where.join(E.purify(m, markers).select("seq"), "seq", "left_anti"), "purified")
    rescued = R.singleton_rescue(nodes.select("seq", "length"), where, cfg.min_bin_size).select("seq", F.col("seq").alias("bin"))
    where = work.save(where.unionByName(rescued), "rescued")
    full = nodes.join(where, "seq").select("bin", "seq", "length", A.total(F.col("depth")).alias("depth"))
    sizes = E.bin_stats(full, cfg.min_bin_size).join(where.groupBy("bin").agg(F.min("seq").alias("first_contig")), "bin")
    table = E.numbered(sizes)
    if markers is not None and marker_set:
        table = table.join(E.qc_per_bin(markers, where, marker_set).select("bin", "completeness", "contamination", "tier"), "bin", "left")
    table = work.save(table, "table")
    return Binning(edges, labels, work.save(full.join(table.select("bin", "bin_num"), "bin").select("bin_num", "bin", "seq", "length", "depth"), "bins"), table, *stable)

