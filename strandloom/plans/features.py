"""Queries from sequences and depths to graphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandloom.functions import arrays as A
from strandloom.functions import sequences as S
from strandloom.operators import graph as G
from strandloom.operators import pairs as P
from strandloom.workspace import Workspace

from . import bindings as B

LETTERS = "abcdefghijklmnopqrstuvwxyz"
AS_BASES = "ACGTACGTACGTACGTACGTACGTAC"


def dna(s, d):
    """Documents as contigs: letters become bases, everything else goes."""
    text = F.regexp_replace(F.translate(F.lower("text"), LETTERS, AS_BASES), "[^ACGT]", "")
    return B.table(s, d, "documents").select(F.col("doc_id").alias("id"), text.alias("seq"))


def rounded(df, *cols, n=6):
    return df.withColumns({c: F.round(c, n) + 0.0 for c in cols})


def _profiles(s, d):
    return Workspace(s, "profiles").save(G.profiles(B.supplier_depth(s, d)), "profiles").withColumn("id", F.col("seq").cast("long"))


def _spearman(s, d, digits=None):
    return P.all_pairs(_profiles(s, d), P.dot_kernel, ["unit"], digits=digits)


def _pearson(s, d, digits=None):
    prof = _profiles(s, d).withColumn("centred", A.centred_unit(F.col("depth")))
    return P.all_pairs(prof, P.dot_kernel, ["centred"], digits=digits)


def _wjac(s, d, digits=None):
    return P.all_pairs(_profiles(s, d), P.min_max_kernel, ["scaled"], digits=digits)


def _otsu(s, d, bins=256):
    def bin_of(sim):
        v = P._rounded(sim, 9)
        return np.where(v > 0, np.minimum(np.floor(v * bins), bins - 1), -1).astype(np.int64)

    return G.otsu_of_bins(P.bin_counts(_profiles(s, d), P.dot_kernel, ["unit"], bin_of, bins), bins)


def _fuse(s, d):
    geomean = lambda corr, a, b: np.sqrt(np.maximum(corr, 0.0) * np.clip(P.min_max_kernel(a, b), 0.0, 1.0))
    return P.all_pairs(_profiles(s, d), P.depth_kernel(geomean), ["unit", "depth", "scaled"], 0.0, digits=6).withColumnRenamed("sim", "score")


def _vectors(s, d):
    return B.vectors(s, d).withColumn("u", F.col("v"))


def _nearest(s, d, k=5, least=0.2):
    return P.nearest(_vectors(s, d), P.dot_kernel, ["u"], least, k)


def _scored(s, d):
    """Edges between suppliers: composition from the vector of the same number, depth from shipments."""
    prof = _profiles(s, d)
    mix = lambda corr, a, b: 0.3 * P.dot_kernel(a, b) + (1 - 0.3) * np.maximum(corr, 0.0)
    both = prof.join(_vectors(s, d).select("id", "u"), "id")
    return P.all_pairs(both, P.depth_kernel(mix), ["unit", "depth", "u"], 0.3, digits=6).withColumnRenamed("sim", "score")


def _sketches(s, d):
    return Workspace(s, "sketches").save(S.sequence_sketch(dna(s, d), "gc"), "sketches")


def _canonical(s, d):
    spec = S.spectra(dna(s, d)).select(F.posexplode("k4").alias("code", "c")).groupBy("code").agg(F.sum("c").alias("c"))
    kmer = F.concat(*[F.substr(F.lit(S.BASES), (F.shiftright("code", 2 * (3 - i)).bitwiseAND(3) + 1).cast("int"), F.lit(1)) for i in range(4)])
    named = spec.select(kmer.alias("k"), "c")
    return named.groupBy(F.least("k", S.reverse_complement(F.col("k"))).alias("kmer")).agg(F.sum("c").cast("long").alias("cnt")).filter("cnt > 0")


def _named_weights(weighted):
    names = F.array(*[F.lit(S.kmer_name(int(x))) for x in S.CANONICAL4])
    return weighted.select("id", F.inline(F.arrays_zip(names.alias("kmer"), F.col("w"))))


def _tnf(s, d):
    return S.unit_words(dna(s, d))


def _gc_weight(s, d):
    return _named_weights(S.kmer_weights(S.spectra(dna(s, d)), "gc")).filter("w > 0").select("id", "kmer", F.round("w", 6).alias("w"))


def _idf(s, d):
    spec = S.spectra(dna(s, d))
    n = spec.count()
    df = _named_weights(S.kmer_weights(spec, "raw")).filter("w > 0").groupBy("kmer").agg(F.count(F.lit(1)).alias("df"))
    return df.select("kmer", "df", F.round(F.log2((n + 1) / (F.col("df") + 0.5)), 6).alias("idf"))


def prob_jaccard(a, b):
    """Probability Jaccard similarity of the weights of two rows each: the sum over elements of 1 / sum of the larger relative weights."""
    out = np.zeros(len(a))
    with np.errstate(divide="ignore", invalid="ignore"):
        for v in range(a.shape[1]):
            larger = np.zeros(len(a))
            for u in range(a.shape[1]):
                larger += np.maximum(a[:, u] / a[:, v], b[:, u] / b[:, v])
            out += np.where((a[:, v] > 0) & (b[:, v] > 0), 1 / larger, 0.0)
    return out


def _prob_jaccard(s, d):
    return P.all_pairs(_profiles(s, d), P.dot_kernel, ["unit", "depth"], 0.8, digits=6, value=lambda a, b: prob_jaccard(a[1], b[1])).withColumnRenamed("sim", "jp")


def _pmh(s, d):
    return P.all_pairs(_sketches(s, d), P.match_kernel, ["sketch"], 0.5)


def _oph(s, d):
    return P.all_pairs(Workspace(s, "sketches").save(S.bucket_sketch(dna(s, d), ranked=True), "sketches"), P.match_kernel, ["sketch"], 0.5)


def _low_bits(s, d):
    planes = Workspace(s, "planes").save(S.bucket_planes(dna(s, d), 2), "planes")
    return P.banded_tiles(planes, S.planes_kernel(500, 2), ["planes"], S.planes_keys(500, 2, 0.9), S.planes_value(500, 2), 0.9, 6)


def _baseline(s, d):
    counted, at = P.value_counts_at(_profiles(s, d), P.min_max_kernel, ["scaled"])
    # rounding keeps the order
    return G.value_at(Workspace(s, "baseline").save(counted, "values"), "sim", at).select(F.round(F.round("sim", 9), 6).alias("baseline"))


def _cutoff(s, d):
    best = P.nearest(_profiles(s, d), P.dot_kernel, ["unit"], None, 1)
    return G.similarity_cutoff(best.select(F.col("src").alias("id"), "sim"))


def _gfa(s, d):
    l = B.table(s, d, "lineitem")
    paths = l.select(F.col("l_orderkey").alias("path"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.col("l_partkey").alias("seg"))
    known = B.part_contigs(s, d).filter("length >= 2500")
    links = B.table(s, d, "supplier").select((F.col("s_suppkey")).alias("a"), (F.col("s_nationkey") + 1).cast("long").alias("b"))
    return G.gfa_links(links, paths, known)


def _invidx(s, d):
    keyed = B.table(s, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("key")).distinct()
    return P.shared_keys(keyed, 2, max(256, keyed.select("id").distinct().count() // 8))


def _sketch_candidates(s, d, least=250):
    """Pairs that share at least half of the 500 registers."""
    return P.shared_registers(_sketches(s, d).filter(F.get("sketch", F.lit(0)) >= 0), least)


def _snn(s, d):
    edges = P.mutual(_nearest(s, d)).select("i", "j", F.col("sim").alias("score"))
    return rounded(G.snn_reweight(edges), "score")


def _incremental(s, d):
    l = B.table(s, d, "lineitem")
    old = G.depth_matrix(l.filter("l_linestatus = 'F'").groupBy(F.col("l_partkey").alias("seq"), F.col("l_returnflag").alias("sample")).agg(F.sum("l_quantity").alias("depth")), ["A", "N", "R"])
    new = G.depth_matrix(l.filter("l_linestatus = 'O' and l_discount > 0.05").groupBy(F.col("l_partkey").alias("seq"), F.col("l_returnflag").alias("sample")).agg(F.sum("l_quantity").alias("depth")), ["A", "N", "R"])
    out = G.incremental_depth(old, new, 3)
    return out.select("seq", *[F.get("depth", F.lit(k)).alias(f"s{k}") for k in range(6)])


QUERIES = {
    "depth_matrix": lambda s, d: G.normalised(G.depth_matrix(B.supplier_depth(s, d))).select("seq", F.posexplode("scaled").alias("sample_no", "x")).select("seq", "sample_no", F.round("x", 6).alias("x")),
    "depth_avg_rank": lambda s, d: _profiles(s, d).select("seq", F.posexplode("ranks").alias("sample_no", "r")),
    "depth_unit_vectors": lambda s, d: _profiles(s, d).select("seq", F.posexplode("unit").alias("sample_no", "u")).select("seq", "sample_no", F.round("u", 6).alias("u")),
    "spearman_pairs": lambda s, d: _spearman(s, d, 6),
    "pearson_pairs": lambda s, d: _pearson(s, d, 6),
    "weighted_jaccard_pairs": lambda s, d: _wjac(s, d, 6),
    "depth_edge_term_fuse": _fuse,
    "edge_score": _scored,
    "otsu_cut": _otsu,
    "gmm_cut": lambda s, d: s.createDataFrame([(G.mixture_cut(_spearman(s, d), "sim"),)], "cut double"),
    "snn_reweight": _snn,
    "knn_topk": lambda s, d: rounded(_nearest(s, d), "sim"),
    "mutual_knn_edges": lambda s, d: rounded(P.mutual(_nearest(s, d)), "sim"),
    "lsh_candidates": lambda s, d: P.shared_bands(_sketches(s, d), 1),
    "invidx_candidates": _invidx,
    "sketch_candidates": _sketch_candidates,
    "kmer_canonical_counts": _canonical,
    "kmer_tnf_l2": _tnf,
    "kmer_gc_weight": _gc_weight,
    "kmer_idf": _idf,
    "prob_jaccard_exact": _prob_jaccard,
    "pmh_sketch_similarity": _pmh,
    "oph_sketch_similarity": _oph,
    "low_bit_similarity": _low_bits,
    "baseline_upper_median": _baseline,
    "sim_cutoff_calibration": _cutoff,
    "gfa_style_links": _gfa,
    "incremental_depth": _incremental,
}

_DEPTH = """long AS (SELECT l_suppkey AS seq, l_returnflag || l_linestatus AS sample, sum(l_quantity) AS x FROM lineitem GROUP BY ALL),
names AS (SELECT sample, row_number() OVER (ORDER BY sample) - 1 AS k FROM (SELECT DISTINCT sample FROM long)),
full_ AS (SELECT s.seq, n.k, coalesce(l.x, 0.0) AS x FROM (SELECT DISTINCT seq FROM long) s CROSS JOIN names n LEFT JOIN long l ON l.seq = s.seq AND l.sample = n.sample),
scaled AS (SELECT seq, k, x, x / avg(x) OVER (PARTITION BY k) AS y FROM full_),
ranks AS (SELECT seq, k, x, y, rank() OVER (PARTITION BY seq ORDER BY x) + (count(*) OVER (PARTITION BY seq, x) - 1) / 2.0 AS r FROM scaled),
cen AS (SELECT *, r - avg(r) OVER (PARTITION BY seq) AS c, x - avg(x) OVER (PARTITION BY seq) AS cx FROM ranks),
units AS (SELECT *, coalesce(c / nullif(sqrt(sum(c * c) OVER (PARTITION BY seq)), 0), 0.0) AS u, coalesce(cx / nullif(sqrt(sum(cx * cx) OVER (PARTITION BY seq)), 0), 0.0) AS ux FROM cen),
prs AS (SELECT a.seq AS i, b.seq AS j, sum(a.u * b.u) AS sp, sum(a.ux * b.ux) AS pe, sum(least(a.y, b.y)) / sum(greatest(a.y, b.y)) AS wj, bool_or(a.x > 1 OR b.x > 1) AS covered
  FROM units a JOIN units b ON a.k = b.k AND a.seq < b.seq GROUP BY a.seq, b.seq)"""
_DNA = f"""dna AS (SELECT doc_id AS id, regexp_replace(translate(lower(text), '{LETTERS}', '{AS_BASES}'), '[^ACGT]', '', 'g') AS seq FROM documents),
kmers AS (SELECT id, seq[p:p + 3] AS k FROM (SELECT id, seq, unnest(range(1, length(seq) - 2)) AS p FROM dna)),
canon AS (SELECT id, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer, count(*) AS c FROM kmers GROUP BY ALL)"""
_DOTS = """vec AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
dots AS (SELECT a.id AS i, b.id AS j, list_sum(list_transform(range(1, 65), lambda p: a.v[p] * b.v[p])) AS sim FROM vec a JOIN vec b ON a.id < b.id)"""
_KNN = f"""{_DOTS},
dir AS (SELECT i AS src, j AS dst, sim FROM dots WHERE sim >= 0.2 UNION ALL SELECT j, i, sim FROM dots WHERE sim >= 0.2),
knn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM dir QUALIFY rank <= 5),
mut AS (SELECT a.src AS i, a.dst AS j, a.sim FROM knn a JOIN knn b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst)"""

ORACLES = {
    "depth_matrix": f"WITH {_DEPTH} SELECT seq, CAST(k AS INT) AS sample_no, round(y, 6) AS x FROM scaled",
    "depth_avg_rank": f"WITH {_DEPTH} SELECT seq, CAST(k AS INT) AS sample_no, CAST(r AS DOUBLE) AS r FROM ranks",
    "depth_unit_vectors": f"WITH {_DEPTH} SELECT seq, CAST(k AS INT) AS sample_no, round(u, 6) AS u FROM units",
    "spearman_pairs": f"WITH {_DEPTH} SELECT i, j, round(sp, 6) + 0.0 AS sim FROM prs",
    "pearson_pairs": f"WITH {_DEPTH} SELECT i, j, round(pe, 6) + 0.0 AS sim FROM prs",
    "weighted_jaccard_pairs": f"WITH {_DEPTH} SELECT i, j, round(wj, 6) AS sim FROM prs",
    "depth_edge_term_fuse": f"WITH {_DEPTH} SELECT i, j, round(sqrt(greatest(sp, 0) * wj), 6) AS score FROM prs WHERE sp >= -0.3 AND covered",
    "edge_score": f"WITH {_DEPTH}, {_DOTS}, s AS (SELECT p.i, p.j, 0.3 * d.sim + 0.7 * greatest(p.sp, 0) AS score FROM prs p JOIN dots d ON p.i = d.i AND p.j = d.j WHERE p.sp >= -0.3 AND p.covered) SELECT i, j, round(score, 6) AS score FROM s WHERE score >= 0.3",
    "otsu_cut": f"""WITH {_DEPTH}, h AS (SELECT least(CAST(floor(round(sp, 9) * 256) AS INT), 255) AS bin, CAST(count(*) AS DOUBLE) AS n FROM prs WHERE round(sp, 9) > 0 GROUP BY 1),
r AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS w, sum(n * (bin + 0.5)) OVER (ORDER BY bin) AS s, sum(n) OVER () AS wt, sum(n * (bin + 0.5)) OVER () AS st FROM h)
SELECT (bin + 1) / 256.0::DOUBLE AS cut FROM r WHERE wt > w ORDER BY w * (wt - w) * (s / w - (st - s) / (wt - w)) ** 2 DESC, bin LIMIT 1""",
    "snn_reweight": f"""WITH {_KNN}, nb AS (SELECT i AS node, j AS n FROM mut UNION ALL SELECT j, i FROM mut), deg AS (SELECT node, count(*) AS c FROM nb GROUP BY 1),
com AS (SELECT m.i, m.j, m.sim, count(y.n) AS common FROM mut m JOIN nb x ON x.node = m.i LEFT JOIN nb y ON y.node = m.j AND y.n = x.n GROUP BY ALL)
SELECT c.i, c.j, round(c.sim * sqrt(common / (a.c + b.c - common)), 6) AS score FROM com c JOIN deg a ON c.i = a.node JOIN deg b ON c.j = b.node""",
    "knn_topk": f"WITH {_KNN} SELECT src, dst, round(sim, 6) AS sim, CAST(rank AS INT) AS rank FROM knn",
    "mutual_knn_edges": f"WITH {_KNN} SELECT i, j, round(sim, 6) AS sim FROM mut",
    "invidx_candidates": """WITH k AS (SELECT DISTINCT l_suppkey AS id, l_partkey AS key FROM lineitem),
ok AS (SELECT * FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING count(*) <= greatest(256, (SELECT count(DISTINCT id) FROM k) // 8)))
SELECT a.id AS i, b.id AS j, count(*) AS shared FROM ok a JOIN ok b ON a.key = b.key AND a.id < b.id GROUP BY ALL HAVING count(*) >= 2""",
    "kmer_canonical_counts": f"WITH {_DNA} SELECT kmer, CAST(sum(c) AS BIGINT) AS cnt FROM canon GROUP BY kmer",
    "kmer_tnf_l2": f"WITH {_DNA}, t AS (SELECT id, k, count(*) AS c FROM kmers GROUP BY ALL) SELECT id, k AS kmer, round(c / sqrt(sum(c * c) OVER (PARTITION BY id)), 6) AS w FROM t",
    "kmer_gc_weight": f"""WITH {_DNA}, b AS (SELECT id, length(seq) AS n, length(replace(seq, 'A', '')) AS na, length(replace(seq, 'C', '')) AS nc, length(replace(seq, 'G', '')) AS ng, length(replace(seq, 'T', '')) AS nt FROM dna WHERE length(seq) > 0),
p AS (SELECT id, (n - na) / n AS a, (n - nc) / n AS c, (n - ng) / n AS g, (n - nt) / n AS t FROM b),
w AS (SELECT x.id, x.kmer, x.c / sum(x.c) OVER (PARTITION BY x.id) AS obs, x.kmer AS k, reverse(translate(x.kmer, 'ACGT', 'TGCA')) AS rk FROM canon x),
e AS (SELECT w.id, w.kmer, w.obs, list_product(list_transform([1, 2, 3, 4], lambda i: CASE w.k[i] WHEN 'A' THEN p.a WHEN 'C' THEN p.c WHEN 'G' THEN p.g ELSE p.t END))
  + list_product(list_transform([1, 2, 3, 4], lambda i: CASE w.rk[i] WHEN 'A' THEN p.a WHEN 'C' THEN p.c WHEN 'G' THEN p.g ELSE p.t END)) AS ex FROM w JOIN p ON w.id = p.id)
SELECT id, kmer, round(least(obs / ex, 20.0), 6) AS w FROM e""",
    "kmer_idf": f"WITH {_DNA} SELECT kmer, count(DISTINCT id) AS df, round(log2(((SELECT count(*) FROM documents) + 1) / (count(DISTINCT id) + 0.5)), 6) AS idf FROM canon GROUP BY kmer",
    "prob_jaccard_exact": f"""WITH {_DEPTH}, w AS (SELECT seq, list(x ORDER BY k) AS d FROM full_ GROUP BY seq)
SELECT p.i, p.j, round(coalesce(list_sum(list_transform(range(1, 7), lambda v: CASE WHEN a.d[v] > 0 AND b.d[v] > 0 THEN 1 / list_sum(list_transform(range(1, 7), lambda u: greatest(a.d[u] / a.d[v], b.d[u] / b.d[v]))) ELSE 0 END)), 0), 6) AS jp
FROM prs p JOIN w a ON p.i = a.seq JOIN w b ON p.j = b.seq WHERE p.sp >= 0.8""",
    "baseline_upper_median": f"WITH {_DEPTH}, o AS (SELECT round(wj, 9) AS s, row_number() OVER (ORDER BY round(wj, 9)) AS r, count(*) OVER () AS n FROM prs) SELECT round(s, 6) AS baseline FROM o WHERE r = n // 2 + 1",
    "sim_cutoff_calibration": f"""WITH {_DEPTH}, best AS (SELECT id, max(sp) AS sim FROM (SELECT i AS id, sp FROM prs UNION ALL SELECT j, sp FROM prs) GROUP BY id),
h AS (SELECT least(greatest(CAST(floor(round(sim, 9) * 1000) AS INT), 0), 999) AS p FROM best)
SELECT greatest(max(p) / 1000.0::DOUBLE, 0.05) AS cutoff FROM h a WHERE (SELECT count(*) FROM h b WHERE b.p >= a.p) * 100 >= 95.0 * (SELECT count(*) FROM h)""",
    "gfa_style_links": """WITH known AS (SELECT p_partkey AS seq FROM part WHERE 1000 + p_size * 100 >= 2500),
st AS (SELECT l_partkey AS seg, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS prev FROM lineitem WHERE l_partkey IN (SELECT seq FROM known)),
a AS (SELECT seg AS a, prev AS b FROM st WHERE prev IS NOT NULL UNION ALL SELECT s_suppkey, CAST(s_nationkey + 1 AS BIGINT) FROM supplier WHERE s_suppkey IN (SELECT seq FROM known) AND s_nationkey + 1 IN (SELECT seq FROM known))
SELECT DISTINCT least(a, b) AS i, greatest(a, b) AS j FROM a WHERE a <> b""",
    "incremental_depth": """WITH o AS (SELECT l_partkey AS seq, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0.0) AS s0, coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0.0) AS s1, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0.0) AS s2 FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
n AS (SELECT l_partkey AS seq, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0.0) AS s3, coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0.0) AS s4, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0.0) AS s5 FROM lineitem WHERE l_linestatus = 'O' AND l_discount > 0.05 GROUP BY 1)
SELECT o.seq, s0, s1, s2, coalesce(s3, 0.0) AS s3, coalesce(s4, 0.0) AS s4, coalesce(s5, 0.0) AS s5 FROM o LEFT JOIN n ON o.seq = n.seq""",
}
