"""Queries that cluster graphs and refine bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import arrays as A
from strandloom.functions.stats import chi2_critical
from strandloom.operators import cluster as C
from strandloom.operators import evaluate as E
from strandloom.operators import graph as G
from strandloom.operators import pairs as P
from strandloom.operators import refine as R
from strandloom.operators import tuning as U
from strandloom.workspace import Workspace

from . import bindings as B
from .features import _DEPTH, _DOTS, _KNN, rounded

CRIT6 = chi2_critical(6)


def knn_edges(s, d, work=None):
    e = P.mutual(P.nearest(B.vectors(s, d), P.dot_kernel, ["v"], 0.2, 5)).select("i", "j", F.col("sim").alias("score"))
    return (work or Workspace(s, "edges")).save(e, "edges")


def _rounds(s, d, n):
    work = Workspace(s, "rounds")
    a = work.save(C.arcs(knn_edges(s, d, work)), "arcs")
    lab = C.singletons(a)
    for k in range(n):
        lab = work.save(C.propagate_once(a, lab, "logsum").select("node", "label"), f"r{k}")
    return lab


def _labels(s, d):
    return B.vectors(s, d).select(F.col("id").alias("node"), "label")


def _supplier_members(s, d):
    """Suppliers in nations, with log depths of six samples and a length."""
    dm = G.depth_matrix(B.supplier_depth(s, d))
    sup = B.table(s, d, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_nationkey").cast("long").alias("bin"), (1000 + F.floor(F.abs("s_acctbal"))).cast("long").alias("length"))
    return dm.join(sup, "seq").select("bin", "seq", "length", R.log_depth(F.col("depth")).alias("y"), "depth")


def _region_members(s, d):
    n = B.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("bin"), F.col("n_regionkey").cast("long").alias("region"))
    return _supplier_members(s, d).join(F.broadcast(n), "bin").select(F.col("region").alias("bin"), "seq", "length", "y", "depth")


def _fit(s, d):
    return R.fit_variance(R.long_form(_region_members(s, d)))


def _suff(s, d):
    long = R.long_form(_region_members(s, d))
    return R.sufficient(long, R.fit_variance(long))


def _parts(s, d):
    """Parts as leftovers: six log depths and a length."""
    dm = G.depth_matrix(B.part_depth(s, d))
    return dm.join(B.part_contigs(s, d), "seq").select("seq", "length", R.log_depth(F.col("depth")).alias("y"), A.centred_unit(A.average_ranks(F.col("depth"))).alias("unit"))


def _stat_recruit(s, d):
    work = Workspace(s, "recruit")
    long = work.save(R.long_form(_region_members(s, d)), "long")
    model = work.save(R.fit_variance(long), "model")
    # suppliers' depths are some twenty times a part's; the offset puts both on one scale
    parts = _parts(s, d).withColumn("y", F.transform("y", lambda x: x + F.log(F.lit(20.0))))
    return R.recruit_by_abundance(parts, work.save(R.sufficient(long, model), "bins"), model, 6)


def _cores(s, d):
    m = _region_members(s, d).withColumn("unit", A.centred_unit(A.average_ranks(F.col("depth"))))
    return R.frozen_cores(m, 2)


def _frozen(s, d):
    work = Workspace(s, "frozen")
    cores = work.save(_cores(s, d).withColumn("tau", F.lit(0.95) * F.sqrt(A.dot(F.col("mean"), F.col("mean")))), "cores")
    return R.recruit_to_frozen(work.save(_parts(s, d).select("seq", "unit"), "parts"), cores)


def _core_top2(s, d):
    work = Workspace(s, "cores")
    cores = work.save(_cores(s, d).select("bin", "tau", A.unit(F.col("mean")).alias("unit_core")), "cores")
    hits = R.against_cores(work.save(_parts(s, d).select("seq", "unit"), "parts"), cores, ["unit"], 2)
    return rounded(R.top_two(hits.select("seq", "bin", F.round("score", 9).alias("score"))), "best", "second", "ratio")


def _calibrated(s, d):
    """Parts taken by regions of suppliers: depth by rank profile, the depths themselves in place of a composition."""
    work = Workspace(s, "calibrated")
    with_tnf = lambda df: df.withColumns({"unit": A.centred_unit(A.average_ranks(F.col("depth"))), "tnf": F.col("depth")})
    members = work.save(with_tnf(_region_members(s, d)).select("bin", "seq", "length", "unit", "tnf"), "members")
    parts = with_tnf(G.depth_matrix(B.part_depth(s, d)).join(B.part_contigs(s, d), "seq")).select("seq", "length", "unit", "tnf")
    return rounded(R.calibrated_recruit(members, work.save(parts, "parts"), work)[0], "ratio")


def _youden(s, d):
    v = B.table(s, d, "customer").select(F.round("c_acctbal", 0).alias("value"), (F.col("c_mktsegment") == "BUILDING").alias("positive"))
    return rounded(R.youden_boundary(v), "tpr", "fpr")


def _links(s, d):
    l = B.table(s, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a, b = l.withColumnRenamed("l_partkey", "i"), l.withColumnRenamed("l_partkey", "j")
    return a.join(b, "l_orderkey").filter("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("cnt"))


def _part_members(s, d):
    dm = G.depth_matrix(B.part_depth(s, d))
    p = B.table(s, d, "part").select(F.col("p_partkey").alias("seq"), F.concat("p_brand", F.lit("/"), "p_type").alias("bin"), (1000 + F.col("p_size") * 100).cast("long").alias("length"))
    return dm.join(p, "seq").select("bin", "seq", "length", R.log_depth(F.col("depth")).alias("y"))


def _merge_inputs(s, d):
    work = Workspace(s, "merge")
    m = work.save(_part_members(s, d), "members")
    long = work.save(R.long_form(m), "long")
    stats = work.save(R.sufficient(long, R.fit_variance(long)), "stats")
    sizes = work.save(m.groupBy("bin").agg(F.sum("length").alias("total_length")), "sizes")
    pairs = work.save(R.linked_bins(_links(s, d), m.select("seq", "bin")), "pairs")
    crit = chi2_critical(6, 0.05, pairs.count())
    return R.merge_candidates(pairs, stats, sizes, FLOOR, crit), stats, sizes, crit


FLOOR = 40_000


def _merge_candidates(s, d):
    work = Workspace(s, "merge-q")
    m = work.save(_part_members(s, d), "members")
    sizes = m.groupBy("bin").agg(F.sum("length").alias("total_length"))
    flat = R.long_form(m).groupBy("bin", "k").agg(F.sum(F.col("length")).cast("double").alias("w"), F.sum(F.col("length") * F.col("y")).alias("z"))
    return rounded(R.merge_candidates(R.linked_bins(_links(s, d), m.select("seq", "bin")), flat, sizes, FLOOR, 3000.0), "t2", n=4)


def _merge(s, d):
    cand, stats, sizes, crit = _merge_inputs(s, d)
    return R.merge_bins(cand, stats, sizes, FLOOR, crit)


def _split(s, d):
    return R.abundance_split(_region_members(s, d), floor=10_000, threshold=0.3)


def _rescue(s, d):
    contigs = B.part_contigs(s, d)
    binned = B.table(s, d, "lineitem").filter("l_discount = 0").select(F.col("l_partkey").alias("seq")).distinct()
    return R.singleton_rescue(contigs, binned, 4000)


def _silhouette(s, d):
    return rounded(R.silhouette_of_labels(B.vectors(s, d)), "silhouette")


def _modularity(s, d):
    return rounded(G.modularity(knn_edges(s, d), _labels(s, d)), "q")


def _ensemble(s, d):
    work = Workspace(s, "ensemble")
    return C.seed_ensemble(knn_edges(s, d, work), work.save, 3, "tail", 12)


def run_inputs(s, d, work):
    """Suppliers' pairs, the five nearest by rank profile, and their depths in six samples."""
    prof = work.save(G.profiles(B.supplier_depth(s, d)).withColumn("id", F.col("seq").cast("long")), "profiles")
    pairs = P.mutual(P.nearest(prof, P.dot_kernel, ["unit"], 0.2, 5))
    return work.save(pairs.select("i", "j", "sim"), "pairs"), prof.select(F.col("id").alias("seq"), "depth", "scaled", "unit")


BASE = U.Setting(0.5, 1.0, 0.6)


def _perturbed(s, d):
    work = Workspace(s, "perturbed")
    pairs, prof = run_inputs(s, d, work)
    return U.perturbed_runs(pairs, prof, 6, BASE, work, max_rounds=30)


def _converged(s, d):
    work = Workspace(s, "lpa")
    return C.propagate(knn_edges(s, d, work), work.save, "tail", 40)


def _louvain(s, d):
    work = Workspace(s, "louvain")
    return C.modularity_moves(knn_edges(s, d, work), work.save)


def _super_edges(s, d):
    return rounded(C.super_edges(knn_edges(s, d), _labels(s, d)), "sl")


def _super_merge(s, d):
    work = Workspace(s, "super")
    edges = knn_edges(s, d, work)
    return C.super_merge(edges, C.propagate(edges, work.save, "tail", 40), work.save)


def _fused(s, d):
    work = Workspace(s, "fused")
    return C.fused(knn_edges(s, d, work), work.save)


def _moments(s, d):
    o = B.table(s, d, "lineitem").groupBy("l_suppkey")
    return rounded(o.agg(F.avg("l_quantity").alias("mean"), F.var_samp("l_quantity").alias("var"), F.skewness("l_quantity").alias("skew"), F.kurtosis("l_quantity").alias("kurt")), "mean", "var", "skew", "kurt")


QUERIES = {
    "lpa_round1": lambda s, d: _rounds(s, d, 1),
    "lpa_round2": lambda s, d: _rounds(s, d, 2),
    "lpa_converged": _converged,
    "louvain_converged": _louvain,
    "seed_ensemble": _ensemble,
    "perturbed_runs": _perturbed,
    "super_edges": _super_edges,
    "super_merge": _super_merge,
    "fused_labels": _fused,
    "node_confidence": lambda s, d: rounded(C.node_confidence(knn_edges(s, d), _labels(s, d)), "confidence", "second_score").na.fill(-1, ["second_label"]),
    "binned_nodes": lambda s, d: C.binned_nodes(knn_edges(s, d)),
    "modularity": _modularity,
    "abd_variance_fit": lambda s, d: rounded(_fit(s, d), "a", n=7).withColumn("b", F.round("b", 4) + 0.0),
    "suff_stats": lambda s, d: rounded(_suff(s, d), "w", "z", n=2),
    "stat_recruit_unique": _stat_recruit,
    "bin_coherence": lambda s, d: rounded(R.bin_coherence(_region_members(s, d).withColumn("unit", A.centred_unit(A.average_ranks(F.col("depth"))))), "coherence"),
    "coherence_bar": lambda s, d: rounded(R.coherence_bar(R.bin_coherence(_supplier_members(s, d).withColumn("unit", A.centred_unit(A.average_ranks(F.col("depth"))))), 25.0), "bar"),
    "frozen_core_recruit": _frozen,
    "core_recruit_top2": _core_top2,
    "core_recruit_calibrated": _calibrated,
    "youden_boundary": _youden,
    "pe_links": _links,
    "pe_merge_candidates": _merge_candidates,
    "pe_merge_components": _merge,
    "abundance_split": _split,
    "feedback_split": lambda s, d: R.feedback_split(_supplier_members(s, d).withColumn("unit", A.centred_unit(A.average_ranks(F.col("depth")))), Workspace(s, "feedback"), 60_000, 50.0, threshold=0.3),
    "silhouette_given_labels": _silhouette,
    "singleton_rescue": _rescue,
    "moments": _moments,
}


def _lpa_sql(rounds: int) -> str:
    out = f"WITH {_KNN}, arcs AS (SELECT i AS src, j AS dst, least(sim, 1 - 1e-6) AS w FROM mut UNION ALL SELECT j, i, least(sim, 1 - 1e-6) FROM mut), l0 AS (SELECT DISTINCT src AS node, src AS label FROM arcs)"
    for k in range(rounds):
        out += f""", e{k} AS (SELECT a.src AS node, l.label, -sum(ln(1 - a.w)) AS s FROM arcs a JOIN l{k} l ON a.dst = l.node GROUP BY ALL),
b{k} AS (SELECT e.node, p.label AS prev, max(e.s) AS top, max(CASE WHEN e.label = p.label THEN e.s END) AS own FROM e{k} e JOIN l{k} p ON e.node = p.node GROUP BY ALL),
w{k} AS (SELECT node, label FROM e{k} QUALIFY row_number() OVER (PARTITION BY node ORDER BY s DESC, label) = 1),
l{k + 1} AS (SELECT b.node, CASE WHEN b.own >= b.top - 1e-12 THEN b.prev ELSE w.label END AS label FROM b{k} b JOIN w{k} w ON b.node = w.node)"""
    return out + f" SELECT node, label FROM l{rounds}"


_REG = f"""{_DEPTH}, sup AS (SELECT s_suppkey AS seq, CAST(s_nationkey AS BIGINT) AS nation, CAST(n_regionkey AS BIGINT) AS bin, 1000 + CAST(floor(abs(s_acctbal)) AS BIGINT) AS length FROM supplier JOIN nation ON s_nationkey = n_nationkey),
reg AS (SELECT s.bin, s.nation, s.seq, s.length, f.k, ln(f.x + 1.0) AS y FROM sup s JOIN full_ f ON s.seq = f.seq)"""
_FIT = f"""{_REG},
mu AS (SELECT bin, k, avg(y) AS mu, count(*) AS n FROM reg GROUP BY ALL HAVING count(*) >= 8),
res AS (SELECT r.k, 1.0::DOUBLE / r.length AS x, (r.y - m.mu) ** 2 * m.n / (m.n - 1) AS d2 FROM reg r JOIN mu m ON r.bin = m.bin AND r.k = m.k),
s1 AS (SELECT k, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(d2) AS sd, sum(d2 * x) AS sdx FROM res GROUP BY k),
f1 AS (SELECT k, (sd * sxx - sdx * sx) / (n * sxx - sx * sx) AS a0, (n * sdx - sx * sd) / (n * sxx - sx * sx) AS b0, sd / n AS flat FROM s1),
g1 AS (SELECT k, greatest(CASE WHEN a0 > 0 THEN a0 ELSE flat END, 1e-6) AS a, CASE WHEN a0 > 0 THEN greatest(b0, 0) ELSE 0 END AS b FROM f1),
s2 AS (SELECT r.k, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(d2) AS sd, sum(d2 * x) AS sdx FROM res r JOIN g1 g ON r.k = g.k WHERE d2 <= 9.0 * (g.a + g.b * r.x) GROUP BY r.k),
f2 AS (SELECT k, (sd * sxx - sdx * sx) / (n * sxx - sx * sx) AS a0, (n * sdx - sx * sd) / (n * sxx - sx * sx) AS b0, sd / n AS flat FROM s2),
fit AS (SELECT k, greatest(CASE WHEN a0 > 0 THEN a0 ELSE flat END, 1e-6) AS a, CASE WHEN a0 > 0 THEN greatest(b0, 0.0) ELSE 0.0 END AS b FROM f2)"""
_SUFF = f"""{_FIT}, suff AS (SELECT r.bin, r.k, sum(1 / (f.a + f.b / r.length)) AS w, sum(r.y / (f.a + f.b / r.length)) AS z FROM reg r JOIN fit f ON r.k = f.k GROUP BY ALL)"""
_PART = """plong AS (SELECT l_partkey AS seq, l_returnflag || l_linestatus AS sample, sum(l_quantity) AS x FROM lineitem GROUP BY ALL),
pfull AS (SELECT s.seq, n.k, coalesce(l.x, 0.0) AS x FROM (SELECT DISTINCT seq FROM plong) s CROSS JOIN names n LEFT JOIN plong l ON l.seq = s.seq AND l.sample = n.sample),
prank AS (SELECT seq, k, x, rank() OVER (PARTITION BY seq ORDER BY x) + (count(*) OVER (PARTITION BY seq, x) - 1) / 2.0 AS r FROM pfull),
pcen AS (SELECT *, r - avg(r) OVER (PARTITION BY seq) AS c FROM prank),
punit AS (SELECT *, coalesce(c / nullif(sqrt(sum(c * c) OVER (PARTITION BY seq)), 0), 0.0) AS u FROM pcen)"""


def _core_sql(key: str) -> str:
    return f"""core AS (SELECT s.{key} AS bin, u.k, sum(u.u) AS sm, sum(u.u * u.u) AS q, count(*) AS n FROM sup s JOIN units u ON s.seq = u.seq GROUP BY ALL),
coh AS (SELECT bin, max(n) AS size, (sum(sm * sm) - sum(q)) / (max(n) * (max(n) - 1)) AS coherence FROM core GROUP BY bin HAVING max(n) >= 2)"""


_PLINKS = "l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), links AS (SELECT a.l_partkey AS i, b.l_partkey AS j, count(*) AS cnt FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL)"

ORACLES = {
    "lpa_round1": _lpa_sql(1),
    "lpa_round2": _lpa_sql(2),
    "node_confidence": f"""WITH {_KNN}, arcs AS (SELECT i AS src, j AS dst, least(sim, 1 - 1e-6) AS w FROM mut UNION ALL SELECT j, i, least(sim, 1 - 1e-6) FROM mut),
lab AS (SELECT vec_id AS node, CAST(label AS BIGINT) AS label FROM embeddings),
g AS (SELECT a.src AS node, l.label AS k, count(*) AS m, -sum(ln(1 - a.w)) AS u FROM arcs a JOIN lab l ON a.dst = l.node GROUP BY ALL),
ev AS (SELECT g.node, p.label, g.k, greatest(0, 1 - exp(-u) * list_sum(list_transform(range(0, CAST(m AS BIGINT)), lambda i: u ** i / CAST(factorial(CAST(i AS INT)) AS DOUBLE)))) AS s FROM g JOIN lab p ON g.node = p.node),
o AS (SELECT node, label, coalesce(max(s) FILTER (k = label), 0) AS own, coalesce(max(s) FILTER (k <> label), 0) AS oth, arg_min(k, struct_pack(n := -s, k := k)) FILTER (k <> label) AS second_label FROM ev GROUP BY ALL)
SELECT node, label, round(least(greatest(own - oth, 0.0), 1.0), 6) + 0.0 AS confidence, coalesce(second_label, -1) AS second_label, round(oth, 6) + 0.0 AS second_score FROM o""",
    "super_edges": f"""WITH {_KNN}, e AS (SELECT CAST(a.label AS BIGINT) AS a, CAST(b.label AS BIGINT) AS b, ln(1 - least(m.sim, 1 - 1e-6)) AS w FROM mut m JOIN embeddings a ON m.i = a.vec_id JOIN embeddings b ON m.j = b.vec_id WHERE a.label <> b.label),
d AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e)
SELECT a, b, count(*) AS m, round(sum(w), 6) + 0.0 AS sl FROM d GROUP BY a, b""",
    "binned_nodes": f"WITH {_KNN} SELECT DISTINCT node FROM (SELECT i AS node FROM mut UNION ALL SELECT j FROM mut)",
    "modularity": f"""WITH {_KNN}, e AS (SELECT m.sim AS w, a.label AS la, b.label AS lb FROM mut m JOIN embeddings a ON m.i = a.vec_id JOIN embeddings b ON m.j = b.vec_id),
v AS (SELECT label, sum(w) AS v FROM (SELECT la AS label, w FROM e UNION ALL SELECT lb, w FROM e) GROUP BY label)
SELECT round((SELECT sum(w) FILTER (la = lb) / sum(w) FROM e) - (SELECT sum(v * v) FROM v) / (4 * (SELECT sum(w) FROM e) ** 2), 6) + 0.0 AS q""",
    "abd_variance_fit": f"WITH {_FIT} SELECT CAST(k AS INT) AS k, round(a, 7) + 0.0 AS a, round(b, 4) + 0.0 AS b FROM fit",
    "suff_stats": f"WITH {_SUFF} SELECT bin, CAST(k AS INT) AS k, round(w, 2) + 0.0 AS w, round(z, 2) + 0.0 AS z FROM suff",
    "stat_recruit_unique": f"""WITH {_SUFF}, {_PART}, prof AS (SELECT bin, k, z / w AS mu, 1 / w AS iw FROM suff),
t AS (SELECT p.seq, b.bin, sum((ln(p.x + 1.0) + ln(20.0::DOUBLE) - b.mu) ** 2 / (f.a + f.b / (1000 + q.p_size * 100) + b.iw)) AS t2
  FROM pfull p JOIN part q ON p.seq = q.p_partkey JOIN fit f ON p.k = f.k JOIN prof b ON p.k = b.k GROUP BY ALL)
SELECT seq, min(bin) AS bin FROM t WHERE t2 <= {CRIT6!r} GROUP BY seq HAVING count(*) = 1""",
    "bin_coherence": f"WITH {_REG}, {_core_sql('bin')} SELECT bin, size, round(coherence, 6) + 0.0 AS coherence FROM coh",
    "coherence_bar": f"WITH {_REG}, {_core_sql('nation')}, o AS (SELECT coherence, row_number() OVER (ORDER BY coherence) - 1 AS r, count(*) OVER () AS n FROM coh) SELECT round(coherence, 6) + 0.0 AS bar FROM o WHERE r = CAST(floor(0.25 * (n - 1) + 0.5) AS BIGINT)",
    "frozen_core_recruit": f"""WITH {_REG}, {_core_sql('bin')}, {_PART}, m AS (SELECT bin, k, sm / n AS mean FROM core WHERE n >= 2), t AS (SELECT bin, 0.95 * sqrt(sum(mean * mean)) AS tau FROM m GROUP BY bin),
d AS (SELECT p.seq, m.bin, sum(p.u * m.mean) AS score FROM punit p JOIN m ON p.k = m.k GROUP BY ALL)
SELECT d.seq, min(d.bin) AS bin FROM d JOIN t ON d.bin = t.bin WHERE d.score >= t.tau GROUP BY d.seq HAVING count(*) = 1""",
    "core_recruit_top2": f"""WITH {_REG}, {_core_sql('bin')}, {_PART}, m AS (SELECT bin, k, sm / n / sqrt(sum((sm / n) ** 2) OVER (PARTITION BY bin)) AS mean FROM core WHERE n >= 2),
d AS (SELECT p.seq, m.bin, round(sum(p.u * m.mean), 9) AS score FROM punit p JOIN m ON p.k = m.k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, bin) AS r FROM d),
t AS (SELECT seq, max(bin) FILTER (r = 1) AS bin, max(score) FILTER (r = 1) AS best, max(score) FILTER (r = 2) AS second FROM r WHERE r <= 2 GROUP BY seq)
SELECT seq, bin, round(best, 6) + 0.0 AS best, round(second, 6) + 0.0 AS second,
  CASE WHEN greatest(1 - best, 0) = 0 THEN CASE WHEN greatest(1 - second, 0) > 0 THEN 'inf'::DOUBLE ELSE 0.0 END WHEN greatest(1 - second, 0) = 0 THEN 0.0 ELSE round(ln(greatest(1 - second, 0) / greatest(1 - best, 0)), 6) + 0.0 END AS ratio FROM t""",
    "core_recruit_calibrated": f"""WITH {_REG}, {_PART},
mem AS (SELECT DISTINCT bin, seq, length FROM reg),
mv AS (SELECT m.bin, m.seq, m.length, u.k, u.u, coalesce(u.x / nullif(sqrt(sum(u.x * u.x) OVER (PARTITION BY u.seq)), 0), 0) AS t, sum(u.u * u.u) OVER (PARTITION BY u.seq) > 0 AND sum(u.x * u.x) OVER (PARTITION BY u.seq) > 0 AS ok FROM mem m JOIN units u ON m.seq = u.seq),
cs AS (SELECT bin, k, sum(u) AS su, sum(length * t) AS st FROM mv GROUP BY ALL),
cn AS (SELECT bin, sum(su * su) AS nu, sum(st * st) AS nt FROM cs GROUP BY bin),
dm AS (SELECT m.seq, m.bin AS own, m.length, c.bin, sum(m.u * c.su) AS du, sum(m.t * c.st) AS dt FROM mv m JOIN cs c ON m.k = c.k WHERE m.ok GROUP BY ALL),
sc AS (SELECT seq, own, dm.bin, greatest(-1, least(1, CASE WHEN own = dm.bin THEN least((du - 1) / sqrt(nu - 2 * du + 1), (dt - length) / sqrt(nt - 2 * length * dt + length * length)) ELSE least(du / sqrt(nu), dt / sqrt(nt)) END)) AS score FROM dm JOIN cn ON dm.bin = cn.bin),
rk AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, bin) AS r FROM sc WHERE own <> bin),
ot AS (SELECT seq, max(score) FILTER (r = 1) AS o1, max(score) FILTER (r = 2) AS o2 FROM rk GROUP BY seq),
ev AS (SELECT CASE WHEN s.score > o1 THEN ln((1 - o1) / (1 - s.score)) ELSE ln((1 - greatest(s.score, o2)) / (1 - o1)) END AS value, s.score > o1 AS positive FROM sc s JOIN ot ON s.seq = ot.seq WHERE s.own = s.bin AND s.score <> o1),
vc AS (SELECT value, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM ev GROUP BY value),
roc AS (SELECT value, sum(p) OVER (ORDER BY value DESC) / sum(p) OVER () - sum(n) OVER (ORDER BY value DESC) / sum(n) OVER () AS j FROM vc),
cut AS (SELECT value AS boundary FROM roc ORDER BY j DESC, value DESC LIMIT 1),
pv AS (SELECT seq, k, u, x / nullif(sqrt(sum(x * x) OVER (PARTITION BY seq)), 0) AS t, sum(u * u) OVER (PARTITION BY seq) > 0 AS ok FROM punit),
ps AS (SELECT p.seq, c.bin, greatest(-1, least(1, least(sum(p.u * c.su) / sqrt(any_value(n.nu)), sum(p.t * c.st) / sqrt(any_value(n.nt))))) AS score FROM pv p JOIN cs c ON p.k = c.k JOIN cn n ON n.bin = c.bin WHERE p.ok GROUP BY ALL),
pr AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY score DESC, bin) AS r FROM ps),
pt AS (SELECT seq, max(bin) FILTER (r = 1) AS bin, ln((1 - max(score) FILTER (r = 2)) / (1 - max(score) FILTER (r = 1))) AS ratio FROM pr GROUP BY seq)
SELECT seq, bin, round(ratio, 6) + 0.0 AS ratio FROM pt, cut WHERE ratio >= boundary""",
    "youden_boundary": """WITH v AS (SELECT round(c_acctbal, 0) AS value, count(*) FILTER (c_mktsegment = 'BUILDING') AS p, count(*) FILTER (c_mktsegment <> 'BUILDING') AS n FROM customer GROUP BY 1),
r AS (SELECT value, sum(p) OVER (ORDER BY value DESC) / sum(p) OVER () AS tpr, sum(n) OVER (ORDER BY value DESC) / sum(n) OVER () AS fpr FROM v)
SELECT value AS boundary, round(tpr, 6) + 0.0 AS tpr, round(fpr, 6) + 0.0 AS fpr FROM r ORDER BY tpr - fpr DESC, value DESC LIMIT 1""",
    "pe_links": f"WITH {_PLINKS} SELECT * FROM links",
    "pe_merge_candidates": f"""WITH {_DEPTH}, {_PART}, {_PLINKS}, m AS (SELECT p_partkey AS seq, p_brand || '/' || p_type AS bin, 1000 + p_size * 100 AS length FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)),
pr AS (SELECT least(a.bin, b.bin) AS a, greatest(a.bin, b.bin) AS b, CAST(sum(cnt) AS BIGINT) AS links FROM links JOIN m a ON i = a.seq JOIN m b ON j = b.seq WHERE a.bin <> b.bin GROUP BY ALL),
sz AS (SELECT bin, sum(length) < {FLOOR} AS frag FROM m GROUP BY bin),
st AS (SELECT m.bin, p.k, sum(m.length) AS w, sum(m.length * ln(p.x + 1.0)) / sum(m.length) AS mu FROM m JOIN pfull p ON m.seq = p.seq GROUP BY ALL)
SELECT pr.a, pr.b, pr.links, round(sum((x.mu - y.mu) ** 2 / (1.0 / x.w + 1.0 / y.w)), 4) + 0.0 AS t2 FROM pr JOIN sz fa ON pr.a = fa.bin JOIN sz fb ON pr.b = fb.bin JOIN st x ON x.bin = pr.a JOIN st y ON y.bin = pr.b AND x.k = y.k
WHERE fa.frag OR fb.frag GROUP BY ALL HAVING sum((x.mu - y.mu) ** 2 / (1.0 / x.w + 1.0 / y.w)) <= 3000.0""",
    "silhouette_given_labels": f"""WITH {_DOTS}, dd AS (SELECT i, j, sqrt(greatest(list_sum(list_transform(a.v, lambda x: x * x)) + list_sum(list_transform(b.v, lambda x: x * x)) - 2 * sim, 0)) AS dist FROM dots JOIN vec a ON i = a.id JOIN vec b ON j = b.id),
dir AS (SELECT i AS src, j AS dst, dist FROM dd UNION ALL SELECT j, i, dist FROM dd),
s AS (SELECT src, e.label AS lb, avg(dist) AS m FROM dir JOIN embeddings e ON dst = e.vec_id GROUP BY ALL),
t AS (SELECT s.src, max(m) FILTER (s.lb = e.label) AS a, min(m) FILTER (s.lb <> e.label) AS b FROM s JOIN embeddings e ON s.src = e.vec_id GROUP BY s.src)
SELECT round(avg((b - a) / greatest(a, b)), 6) + 0.0 AS silhouette FROM t WHERE a IS NOT NULL AND b IS NOT NULL""",
    "singleton_rescue": "SELECT p_partkey AS seq, CAST(1000 + p_size * 100 AS BIGINT) AS length FROM part WHERE 1000 + p_size * 100 >= 4000 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0)",
    "moments": """WITH c AS (SELECT l_suppkey, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS c, l_quantity AS q FROM lineitem),
m AS (SELECT l_suppkey, count(*) AS n, avg(q) AS mean, sum(c ** 2) AS m2, sum(c ** 3) AS m3, sum(c ** 4) AS m4 FROM c GROUP BY 1)
SELECT l_suppkey, round(mean, 6) + 0.0 AS mean, round(m2 / (n - 1), 6) + 0.0 AS var, round(sqrt(n) * m3 / m2 ** 1.5, 6) + 0.0 AS skew, round(n * m4 / (m2 * m2) - 3, 6) + 0.0 AS kurt FROM m""",
}
