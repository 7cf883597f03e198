"""From features to a weighted graph: depth profiles, edge scores, cut-offs, shared neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions import arrays as A


def samples_of(long: DataFrame) -> list[str]:
    """The samples' names in order; there are as many as sequencing runs, not as contigs."""
    return [r[0] for r in long.select("sample").distinct().orderBy("sample").collect()]


def depth_matrix(long: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """(seq, depth[S]) of (seq, sample, depth); absent samples are 0. One shuffle, whatever S is."""
    samples = samples_of(long) if samples is None else samples
    return long.groupBy("seq").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("sample") == s, F.col("depth"))), F.lit(0.0)).cast("double") for s in samples]).alias("depth"))


def normalised(matrix: DataFrame) -> DataFrame:
    """Depths over the mean of their sample; the means are one small row."""
    size = F.size("depth")
    long = matrix.select(F.posexplode("depth").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m"))
    means = long.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("means"))
    return matrix.join(F.broadcast(means)).select("seq", "depth", F.when(size >= 0, F.zip_with("depth", "means", lambda x, m: F.when(m > 0, x / m).otherwise(F.lit(0.0)))).alias("scaled"))


def profiles(long: DataFrame) -> DataFrame:
    """(seq, depth, scaled, ranks, unit): everything that pair scores need."""
    m = normalised(depth_matrix(long)).select("*", A.average_ranks(F.col("depth")).alias("ranks"))
    return m.select("*", A.centred_unit(F.col("ranks")).alias("unit"))


def incremental_depth(old: DataFrame, new: DataFrame, extra: int) -> DataFrame:
    """Append ``extra`` samples of (seq, depth) to (seq, depth); contigs that the new file lacks get zeros."""
    zero = F.array(*[F.lit(0.0)] * extra)
    return old.join(new.withColumnRenamed("depth", "_more"), "seq", "left").select("seq", F.concat("depth", F.coalesce("_more", zero)).alias("depth"))


def any_covered(a: Column, b: Column, least: float = 1.0) -> Column:
    return F.exists(a, lambda x: x > least) | F.exists(b, lambda x: x > least)


def with_ends(edges: DataFrame, nodes: DataFrame, key: str, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Edges (i, j, ...) with the columns of both ends as <c>_i and <c>_j; ``by`` are keys that both sides have besides."""
    for end in ("i", "j"):
        edges = edges.join(nodes.select(*by, F.col(key).alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), [*by, end])
    return edges


def edge_terms(edges: DataFrame, prof: DataFrame, mode: str = "corr", min_coverage: float = 1.0, neg_corr: float = -0.3, by: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, sim, term): composition and depth of each edge, not yet mixed; opposed and uncovered edges go."""
    both = with_ends(edges, prof, "seq", ["depth", "scaled", "unit"], by).filter(any_covered(F.col("depth_i"), F.col("depth_j"), min_coverage))
    term = A.depth_term(A.dot(F.col("unit_i"), F.col("unit_j")), A.weighted_jaccard(F.col("scaled_i"), F.col("scaled_j")), mode, neg_corr)
    return both.select(*by, "i", "j", "sim", term.alias("term")).filter("term is not null")


def mixed(terms: DataFrame, alpha: float, min_score: float = 0.7, power: float = 1.0) -> DataFrame:
    """(i, j, score) of edge terms: alpha of the composition, the rest depth; those below ``min_score`` go, then the power is taken."""
    score = alpha * F.col("sim") + (1 - alpha) * F.col("term")
    kept = terms.select("i", "j", score.alias("score")).filter(F.col("score") >= min_score)
    return kept.withColumn("score", F.pow("score", F.lit(power))) if power != 1.0 else kept


def mixed_runs(terms: DataFrame, settings: list[tuple[int, float, float, float]]) -> DataFrame:
    """(run, i, j, score) of edge terms under each of (run, alpha, min_score, power), as ``mixed`` gives them, in one scan.

    A column ``run`` of the terms restricts a row to the settings of that run."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.lit(float(a)).alias("alpha"), F.lit(float(m)).alias("least"), F.lit(float(p)).alias("power")) for r, a, m, p in settings]))
    rows = terms.withColumn("s", each)
    rows = rows.filter(F.col("run") == F.col("s.run")) if "run" in terms.columns else rows
    score = F.col("s.alpha") * F.col("sim") + (1 - F.col("s.alpha")) * F.col("term")
    kept = rows.select(F.col("s.run").alias("run"), "i", "j", score.alias("score"), "s.least", "s.power").filter("score >= least")
    return kept.select("run", "i", "j", F.when(F.col("power") == 1.0, F.col("score")).otherwise(F.pow("score", "power")).alias("score"))


def edge_scores(edges: DataFrame, prof: DataFrame, samples: int, alpha: float | None = None, mode: str = "corr", min_score: float = 0.7, min_coverage: float = 1.0, neg_corr: float = -0.3, power: float = 1.0) -> DataFrame:
    """(i, j, score): composition and depth mixed; weak, opposed and uncovered edges go. alpha: 1 up to two samples, else 0."""
    return mixed(edge_terms(edges, prof, mode, min_coverage, neg_corr), composition_weight(samples) if alpha is None else alpha, min_score, power)


def composition_weight(samples: int) -> float:
    """The weight of composition where none is given: with few samples, depth says too little."""
    return 1.0 if samples <= 2 else 0.0


def without_sample(prof: DataFrame, k: int | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Profiles (seq, depth, scaled, unit) as they would be without sample ``k`` (from 0), a number or a column."""
    def rest(column: str):
        return F.filter(column, lambda x, at: at != k)

    return prof.select(*by, "seq", rest("depth").alias("depth"), rest("scaled").alias("scaled")).withColumn("unit", A.centred_unit(A.average_ranks(F.col("depth"))))


def trajectory_gate(edges: DataFrame, trajectories: DataFrame, least: float = 0.10) -> DataFrame:
    """Edges whose ends don't disagree in their variants: two trajectories (contig, v[]) with an absolute cosine under
    ``least`` cut the edge. Contigs without one cut nothing."""
    out = edges
    for end in ("i", "j"):
        out = out.join(trajectories.select(F.col("contig").alias(end), F.col("v").alias(f"_v{end}")), end, "left")
    agree = F.col("_vi").isNull() | F.col("_vj").isNull() | (F.abs(A.dot(F.col("_vi"), F.col("_vj"))) >= least)
    return out.filter(agree).select(*edges.columns)


def otsu(values: DataFrame, column: str, bins: int = 256) -> DataFrame:
    """One row, ``cut``: the upper edge of the bin that maximises the variance between classes. Only bin counts move."""
    return otsu_of_bins(values.filter(F.col(column) > 0).groupBy(F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")), bins)


def otsu_of_bins(counts: DataFrame, bins: int = 256) -> DataFrame:
    """The same from the number of values in each bin (bin, n)."""
    h = counts.select(F.col("bin").cast("int").alias("bin"), F.col("n").cast("double").alias("n"))
    up, whole = Window.orderBy("bin"), Window.partitionBy()  # at most ``bins`` rows
    mid = F.col("n") * (F.col("bin") + 0.5)
    run = h.select("bin", F.sum("n").over(up).alias("w"), F.sum(mid).over(up).alias("s"), F.sum("n").over(whole).alias("wt"), F.sum(mid).over(whole).alias("st"))
    rest = F.col("wt") - F.col("w")
    between = F.col("w") * rest * F.pow(F.col("s") / F.col("w") - (F.col("st") - F.col("s")) / rest, F.lit(2))
    return run.filter(rest > 0).agg(F.min_by("bin", F.struct(-between, "bin")).alias("b")).select(F.when(F.col("b").isNotNull(), (F.col("b") + 1) / F.lit(float(bins))).otherwise(F.lit(0.0)).alias("cut"))


def mixture_cut(values: DataFrame, column: str, bins: int = 4096, rounds: int = 100) -> float:
    """Where a low and a high normal component cross. Spark makes one fixed histogram; the fit runs on its bins."""
    rows = values.filter((F.col(column) > 0) & (F.col(column) <= 1)).groupBy(F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("x")).orderBy("bin").collect()
    n = sum(r["n"] for r in rows)
    if n < 8:
        return 0.0
    pts = [(r["x"], r["n"]) for r in rows]

    def at(share: float) -> float:
        seen = 0
        for x, c in pts:
            seen += c
            if seen > share * n:
                return x
        return pts[-1][0]

    comp = [[at(0.25), 0.01, 0.5], [at(0.75), 0.01, 0.5]]  # mean, variance, weight
    if comp[1][0] <= comp[0][0]:
        comp[1][0] = comp[0][0] + 1e-3

    def density(x: float, c: list[float]) -> float:
        return c[2] * math.exp(-0.5 * (x - c[0]) ** 2 / c[1]) / math.sqrt(2 * math.pi * c[1])

    for _ in range(rounds):
        resp = []
        for x, c in pts:
            p = [density(x, k) for k in comp]
            t = sum(p)
            resp.append((x, c * p[0] / t, c * p[1] / t) if t > 1e-300 else (x, 0.0, 0.0))
        mass = [sum(r[k + 1] for r in resp) for k in (0, 1)]
        if min(mass) < 1e-9:
            break
        for k in (0, 1):
            mean = sum(r[0] * r[k + 1] for r in resp) / mass[k]
            comp[k] = [mean, max(sum((r[0] - mean) ** 2 * r[k + 1] for r in resp) / mass[k], 1e-6), mass[k] / sum(mass)]
    low, high = sorted(comp)
    a, b = low[0], high[0]
    for _ in range(100):
        mid = (a + b) / 2
        a, b = (mid, b) if density(mid, low) > density(mid, high) else (a, mid)
    return (a + b) / 2


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, near[]): sorted neighbours; degrees are bounded by the k of the nearest-neighbour graph."""
    both = edges.select(F.col("i").alias("node"), F.col("j").alias("n")).unionByName(edges.select(F.col("j").alias("node"), F.col("i").alias("n")))
    return both.groupBy("node").agg(F.array_sort(F.collect_set("n")).alias("near"))


def snn_reweight(edges: DataFrame, power: float = 0.5) -> DataFrame:
    """(i, j, score): each score times a power of the Jaccard overlap of its ends' neighbourhoods."""
    both = with_ends(edges, neighbours(edges), "node", ["near"])
    common = F.size(F.array_intersect("near_i", "near_j"))
    jac = common / (F.size("near_i") + F.size("near_j") - common)
    return both.select("i", "j", (F.col("score") * F.pow(jac, F.lit(power))).alias("score"))


def similarity_cutoff(best: DataFrame, percent: float = 95.0, floor: float = 0.05) -> DataFrame:
    """One row, ``cutoff``: the highest thousandth that ``percent`` of the nodes of (id, sim) reach with their best neighbour."""
    step = F.floor(F.round(F.col("sim"), 9) * 1000).cast("int")
    h = best.groupBy(F.least(F.greatest(step, F.lit(0)), F.lit(999)).alias("p")).agg(F.count(F.lit(1)).alias("n"))  # at most 1000 rows
    run = h.select("p", F.sum("n").over(Window.orderBy(F.desc("p"))).alias("reach"), F.sum("n").over(Window.partitionBy()).alias("all"))
    return run.filter(F.col("reach") * 100 >= F.lit(percent) * F.col("all")).agg(F.greatest(F.max("p") / F.lit(1000.0), F.lit(floor)).alias("cutoff"))


def upper_median(values: DataFrame, column: str) -> DataFrame:
    """One row: the value at n / 2 in sorted order. Distinct values are counted and ranked; no list of all values is made."""
    return value_at(values.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, values.count() // 2)


def value_at(counted: DataFrame, column: str, at: int) -> DataFrame:
    """One row: the value at ``at``, from 0, in sorted order of the distinct values (column, n)."""
    ranked = counted.repartitionByRange(column).sortWithinPartitions(column)
    ranked = ranked.select(column, "n", F.spark_partition_id().alias("part"))
    before = ranked.groupBy("part").agg(F.sum("n").alias("t")).select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("base"))  # a row per partition
    upto = F.col("base") + F.sum("n").over(Window.partitionBy("part").orderBy(column))
    placed = ranked.join(before, "part").select(column, "n", upto.alias("upto"))
    return placed.filter((F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)).select(column)


def gfa_links(links: DataFrame, paths: DataFrame, known: DataFrame) -> DataFrame:
    """(i, j) with i < j from links (a, b) and paths (path, pos, seg); path steps skip segments that aren't known."""
    on = paths.join(known.select(F.col("seq").alias("seg")), "seg", "left_semi")
    steps = on.select("seg", F.lag("seg").over(Window.partitionBy("path").orderBy("pos")).alias("prev")).filter("prev is not null")
    ends = links.join(known.select(F.col("seq").alias("a")), "a", "left_semi").join(known.select(F.col("seq").alias("b")), "b", "left_semi")
    both = steps.select(F.least("seg", "prev").alias("i"), F.greatest("seg", "prev").alias("j")).unionByName(ends.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")))
    return both.filter("i <> j").distinct()


def modularity_runs(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(run, q): weighted modularity of (i, j, score) under each of the labellings (run, node, label)."""
    a, b = (labels.select("run", F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ij")
    e = edges.join(a, "i").join(b, ["run", "j"])
    w = e.groupBy("run").agg(F.sum("score").alias("w"), F.sum(F.when(F.col("label_i") == F.col("label_j"), F.col("score")).otherwise(0.0)).alias("inside"))
    vol = e.select("run", F.col("label_i").alias("label"), "score").unionByName(e.select("run", F.col("label_j").alias("label"), "score")).groupBy("run", "label").agg(F.sum("score").alias("v"))
    sq = vol.groupBy("run").agg(F.sum(F.col("v") * F.col("v")).alias("vv"))
    return w.join(sq, "run").select("run", F.when(F.col("w") > 0, F.col("inside") / F.col("w") - F.col("vv") / (4 * F.col("w") * F.col("w"))).otherwise(F.lit(0.0)).alias("q"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, ``q``: weighted modularity of (i, j, score) under (node, label)."""
    e = with_ends(edges, labels, "node", ["label"])
    w = e.agg(F.sum("score").alias("w"), F.sum(F.when(F.col("label_i") == F.col("label_j"), F.col("score")).otherwise(0.0)).alias("inside"))
    vol = e.select(F.col("label_i").alias("label"), "score").unionByName(e.select(F.col("label_j").alias("label"), "score")).groupBy("label").agg(F.sum("score").alias("v"))
    sq = vol.agg(F.sum(F.col("v") * F.col("v")).alias("vv"))
    return w.join(sq).select(F.when(F.col("w") > 0, F.col("inside") / F.col("w") - F.col("vv") / (4 * F.col("w") * F.col("w"))).otherwise(F.lit(0.0)).alias("q"))
