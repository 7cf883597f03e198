"""Every default of the engine in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BinConfig:
    # contigs
    min_contig: int = 2500
    min_small_contig: int = 1000
    full_header: bool = False
    # graph
    max_edges: int = 200
    sim_cutoff: float = 0.0
    max_posterior: float = 95.0
    min_edge_score: float = 0.70
    edge_floor: float = 0.05
    min_coverage: float = 1.0
    neg_corr: float = -0.3
    gfa_weight: float = 0.90
    sketch_k: int = 4
    sketch_m: int = 500
    seed: int = 42
    #: Contigs from which the graph's pairs come from bands of registers instead of tiles, a band's registers, its longest posting.
    index_from: int = 200_000
    band_registers: int = 20
    posting_cap: int = 6000
    snn_power: float = 0.5
    # clustering
    lpa_score: str = "tail"
    lpa_max_rounds: int = 60
    #: "lpa", "louvain" (modularity moves), "fuse" (propagation from them) or "mlpa" (propagation, then labels unite).
    clustering: str = "lpa"
    gamma: float = 8.0
    merge_doubt: float = 1e-9
    merge_edges: int = 3
    #: How mixing weight and power are chosen: "" (fixed), "modularity", "markers" or "markers+split" (with the silhouette).
    select: str = ""
    #: Settings to sweep, "weight:power;..."; empty for the usual ones.
    grid: str = ""
    #: Least absolute cosine of two variant trajectories; edges below it are cut.
    variant_cosine: float = 0.10
    # bins
    min_bin_size: int = 200_000
    min_recruit_cluster: int = 10
    alpha: float = 0.05
    #: Contigs left over go to bins of ``min_bin_size`` by depth and composition, by a boundary that the bins' own contigs teach.
    core_recruit: bool = True
    # splitting
    split_max_k: int = 6
    split_min_members: int = 6
    split_restarts: int = 10
    split_silhouette: float = 0.70
    split_sample: int = 600
    #: Bins under ``min_bin_size`` are split too, and keep the pieces whose coherence reaches this percentile of the others'.
    split_feedback: bool = True
    split_coherence_percent: float = 10.0
    # alignments
    percent_identity: int = 97
    min_mapq: int = 0
    max_edge_bases: int = 75
    first_reads: int = 4000
    # variants and strains
    snv_min_depth: int = 5
    snv_min_af: float = 0.05
    strain_max_sites: int = 96
    strain_min_sites: int = 12
    strain_max_k: int = 4
    # certification
    certify: bool = False
    cert_dropped: int = 6
    cert_core: float = 0.80
    cert_ambiguous: float = 0.50
    cert_fraction: float = 0.80
