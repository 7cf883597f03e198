"""How many strains a bin holds, from variant frequencies over samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import arrays as A


def site_direction(rows: pd.DataFrame, samples: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Unit direction and frequencies of one site over the samples, or None if it says nothing.

    Frequencies are those of the alternative allele of the deepest sample; missing samples get the mean.
    """
    if len(rows) < max(2, (samples + 1) // 2):
        return None
    canon = rows["alt"].iloc[int(rows["total"].to_numpy().argmax())]
    share = rows["alt_count"].to_numpy() / np.maximum(rows["total"].to_numpy(), 1)
    value = np.where(rows["alt"] == canon, share, np.where(rows["major"] == canon, 1 - share, 0.0))
    f = np.full(samples, value.mean())
    f[rows["sample"].to_numpy(int)] = value
    d = f - f.mean()
    norm = np.sqrt((d * d).sum())
    return (d / norm, f) if norm * norm >= 1e-9 else None


def direction_clusters(dirs: np.ndarray, least: float = 0.75) -> list[list[tuple[int, int]]]:
    """Groups of (site, sign): sites join the nearest direction, up to sign; directions that drift together unite."""
    centres: list[np.ndarray] = []
    groups: list[list[tuple[int, int]]] = []
    for i, d in enumerate(dirs):
        dots = np.array([c @ d for c in centres])
        if len(dots) and np.abs(dots).max() >= least:
            at = len(dots) - 1 - int(np.abs(dots)[::-1].argmax())
            sign = -1 if dots[at] < 0 else 1
            groups[at].append((i, sign))
            c = centres[at] + sign * d
            n = np.sqrt((c * c).sum())
            centres[at] = c / n if n > 1e-6 else c
        else:
            centres.append(d.copy())
            groups.append([(i, 1)])
    for a in range(len(groups)):
        for b in range(a + 1, len(groups)):
            if groups[a] and groups[b] and abs(dot := centres[a] @ centres[b]) >= least:
                groups[a] += [(i, s if dot > 0 else -s) for i, s in groups[b]]
                groups[b] = []
    return [g for g in groups if g]


def _estimate(samples: int, min_sites: int, max_strains: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [x for _, rows in pdf.sort_values(["contig", "pos", "sample"]).groupby(["contig", "pos"], sort=True) if (x := site_direction(rows, samples)) is not None]
        strains, minor = 1, None
        if len(found) >= min_sites:
            groups = [g for g in direction_clusters(np.array([d for d, _ in found])) if len(g) >= max(min_sites, round(0.25 * len(found)))]
            if groups:
                top = max(groups, key=len)
                share = np.mean([found[i][1] if s > 0 else 1 - found[i][1] for i, s in top], axis=0)
                minor = share if share.mean() <= 0.5 else 1 - share
                strains = min(1 + len(groups), max_strains)
        return pd.DataFrame({"bin": [pdf["bin"].iloc[0]], "sites": [len(found)], "strains": [strains], "minor": [minor]})

    return run


def estimate_strains(sites: DataFrame, samples: int, min_sites: int = 12, max_strains: int = 4) -> DataFrame:
    """(bin, sites, strains, minor[]) of (bin, contig, pos, sample int, major, alt, alt_count, total).

    A bin's sites are at most ``max_sites`` per contig and sample, so a group is bounded.
    """
    kind = dict(sites.dtypes)["bin"]
    return sites.groupBy("bin").applyInPandas(_estimate(samples, min_sites, max_strains), f"bin {kind}, sites long, strains int, minor array<double>")


def site_frequencies(sites: DataFrame, samples: int, least: int = 2) -> DataFrame:
    """(contig, pos, f[]): each site's frequencies over the samples, of the alternative allele where it is deepest.

    sites(contig, pos, sample int from 0, major, alt, alt_count, total). Sites seen in fewer than ``least`` samples go;
    samples without the site get the mean. Of equal depths the first sample names the allele.
    """
    row = F.struct("sample", "major", "alt", "alt_count", "total")
    s = sites.groupBy("contig", "pos").agg(F.array_sort(F.collect_list(row)).alias("r"), F.max_by("alt", F.struct("total", -F.col("sample"))).alias("canon")).filter(F.size("r") >= least)
    share = s.select("contig", "pos", F.transform("r", lambda x: F.struct(x["sample"].alias("k"), F.when(x["alt"] == F.col("canon"), F.when(x["total"] > 0, x["alt_count"] / x["total"]).otherwise(0.0)).when(x["major"] == F.col("canon"), 1 - F.when(x["total"] > 0, x["alt_count"] / x["total"]).otherwise(0.0)).otherwise(0.0).alias("x"))).alias("r"))
    mean = share.withColumn("mean", A.total(F.transform("r", lambda x: x["x"])) / F.size("r"))
    own = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.coalesce(F.get(F.transform(F.filter("r", lambda x: x["k"] == k), lambda x: x["x"]), F.lit(0)), F.col("mean")))
    return mean.select("contig", "pos", own.alias("f"))


def contig_trajectories(sites: DataFrame, samples: int, least: int = 2) -> DataFrame:
    """(contig, v[], sites): a unit vector of how variant frequencies move over the samples.

    Each site gives the direction of its centred frequencies; those that point away from the contig's first site (a
    cosine under -1e-9) are turned round; the sum is scaled to one. A join with one row a contig and sums per sample: no contig is one group of
    rows. Contigs whose sites say nothing are left out.
    """
    d = site_frequencies(sites, samples, least).select("contig", "pos", "f", (A.total(F.col("f")) / samples).alias("m"))
    d = d.select("contig", "pos", F.transform("f", lambda x: x - F.col("m")).alias("c")).filter(A.dot(F.col("c"), F.col("c")) >= 1e-9)
    d = d.select("contig", "pos", A.unit(F.col("c")).alias("d"))
    first = d.groupBy("contig").agg(F.min_by("d", "pos").alias("ref"))
    turned = d.join(first, "contig").select("contig", F.when(A.dot(F.col("d"), F.col("ref")) < -1e-9, F.transform("d", lambda x: -x)).otherwise(F.col("d")).alias("d"))
    sums = turned.groupBy("contig").agg(F.array(*[F.sum(F.col("d")[k]) for k in range(samples)]).alias("s"), F.count(F.lit(1)).alias("sites"))
    return sums.filter(A.dot(F.col("s"), F.col("s")) >= 1e-12).select("contig", A.unit(F.col("s")).alias("v"), "sites")
