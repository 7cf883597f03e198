"""Queries about the quality of binnings."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import evaluate as E
from strandloom.operators import tuning as U
from strandloom.workspace import Workspace

from . import bindings as B

MIN_LENGTH = 1500
MIN_BIN = 1_200_000
SET_SIZE = 100


def rounded(df, *cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


def _long_gold(s, d):
    return B.gold(s, d).filter(F.col("length") >= MIN_LENGTH)


def _members(s, d):
    """(bin, seq, length, depth) of parts; depth is the total over samples."""
    total = B.part_depth(s, d).groupBy("seq").agg(F.sum("depth").alias("depth"))
    return B.part_bins(s, d).join(B.part_contigs(s, d), "seq").join(total, "seq", "left").na.fill(0.0, ["depth"])


def _purify(s, d):
    supplier = B.table(s, d, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_nationkey").alias("bin"))
    # a supplier's markers are the months of its largest shipments, one a return flag, over all rows of lineitem: sparse by meaning
    shipped = B.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("seq"), "l_returnflag", F.month("l_shipdate").alias("month")).agg(F.sum("l_quantity").alias("q"))
    markers = shipped.groupBy("seq", "l_returnflag").agg(F.min_by("month", F.struct(-F.col("q"), "month")).alias("marker")).select("seq", "marker")
    return rounded(E.purify(B.supplier_depth(s, d).join(supplier, "seq"), markers, 2.0), "zmax")


def _candidates(s, d):
    """Three binnings of events: by user, by type and hour, by type and day; candidates are numbered across them."""
    e = B.table(s, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("user:"), F.col("user_id")).alias("a"), F.concat(F.lit("hour:"), "event_type", F.date_format("ts", ":MMddHH")).alias("b"), F.concat(F.lit("day:"), "event_type", F.date_format("ts", ":MMdd")).alias("c"))
    return e.select("seq", F.explode(F.array("a", "b", "c")).alias("cand"))


def _refine(s, d):
    return rounded(E.refine_consensus(_candidates(s, d), B.event_markers(s, d), SET_SIZE, 10.0, 30.0, 1.0, Workspace(s, "refine")), "score")


def _runs(s, d):
    runs = B.table(s, d, "orders").select(F.year("o_orderdate").alias("run"), F.col("o_custkey").alias("seq"), F.col("o_orderpriority").alias("label"), "o_orderkey")
    return runs.groupBy("run", "seq").agg(F.min_by("label", "o_orderkey").alias("label"))


def _certify(s, d):
    contigs = B.table(s, d, "customer").select(F.col("c_custkey").alias("seq"), (1000 + F.floor(F.abs("c_acctbal"))).cast("long").alias("length"))
    each, _ = E.certify(B.segments(s, d), _runs(s, d), contigs)
    return each


def _certify_bins(s, d):
    each = _certify(s, d)
    out = each.groupBy("bin").agg((F.sum(F.when(F.col("state") == "core", F.col("length")).otherwise(0)) / F.sum("length")).alias("core_fraction"), (F.sum(F.coalesce("prob", F.lit(0.0)) * F.col("length")) / F.sum("length")).alias("mean_prob"))
    return rounded(out, "core_fraction", "mean_prob")


def _agreement(s, d):
    v = B.table(s, d, "lineitem")
    edges = v.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    part = B.table(s, d, "part").select(F.col("p_partkey").alias("node"), F.pmod("p_size", F.lit(5)).alias("label"))
    other = B.table(s, d, "part").select(F.col("p_partkey").alias("node"), F.pmod(F.length("p_name"), F.lit(3)).alias("label"))
    return rounded(E.partition_agreement(edges, part, other), "agreement")


QUERIES = {
    "amber_per_bin": lambda s, d: rounded(E.amber_per_bin(B.gold(s, d), B.predicted(s, d)), "purity", "completeness"),
    "amber_summary": lambda s, d: rounded(E.amber_summary(B.gold(s, d), B.predicted(s, d)), "avg_purity", "weighted_purity", "avg_completeness"),
    "amber_unmatched": lambda s, d: E.unmatched(_long_gold(s, d), B.predicted(s, d)).select("seq", "bin"),
    "amber_min_bin_size": lambda s, d: rounded(E.amber_summary(_long_gold(s, d), B.predicted(s, d), MIN_BIN), "avg_purity", "weighted_purity", "avg_completeness"),
    "qc_per_bin": lambda s, d: E.qc_per_bin(B.event_markers(s, d), B.event_bins(s, d), SET_SIZE),
    "qc_summary": lambda s, d: rounded(E.qc_summary(E.qc_per_bin(B.event_markers(s, d), B.event_bins(s, d), SET_SIZE)), "avg_contamination", "sum_completeness"),
    "taxonomy_vote": lambda s, d: rounded(E.taxonomy_vote(B.part_contigs(s, d), B.part_bins(s, d), B.table(s, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("lineage"))), "share"),
    "bin_stats": lambda s, d: rounded(E.bin_stats(_members(s, d), 1_000_000), "coverage"),
    "bin_depth_stats": lambda s, d: rounded(E.bin_depth_stats(_members(s, d)), "mean_depth", "sd_depth", n=4),
    "purify_outliers": _purify,
    "membership_matrix": lambda s, d: E.membership_matrix(B.part_contigs(s, d), B.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("seq")).agg(F.min("l_suppkey").alias("label"))),
    "partition_agreement": _agreement,
    "refine_consensus": _refine,
    "ensemble_consensus": lambda s, d: rounded(E.ensemble_consensus(_candidates(s, d), B.event_markers(s, d), SET_SIZE, 10.0, 0.5, 1.0), "score"),
    "certify_stability": lambda s, d: rounded(_certify(s, d), "prob"),
    "certify_bins": _certify_bins,
    "certify_alternatives": lambda s, d: rounded(U.alternatives(B.segments(s, d), _runs(s, d)), "alt_prob"),
}

_GOLD = "gold AS (SELECT c_custkey AS seq, c_nationkey AS genome, 1000 + CAST(floor(abs(c_acctbal)) AS BIGINT) AS length FROM customer)"
_PRED = "pred AS (SELECT o_custkey AS seq, arg_min(o_orderpriority, o_orderkey) AS bin FROM orders GROUP BY o_custkey)"


def _amber(gold: str, floor: int = 0) -> str:
    return f"""
{_GOLD}, {_PRED}, g AS (SELECT * FROM gold WHERE length >= {gold}),
gs AS (SELECT genome, sum(length) AS size, min(seq) AS seen FROM g GROUP BY genome),
cells AS (SELECT p.bin, g.genome, sum(g.length) AS bp, count(*) AS seqs FROM pred p JOIN g ON p.seq = g.seq GROUP BY ALL),
tot AS (SELECT bin, sum(bp) AS total, sum(seqs) AS n FROM cells GROUP BY bin HAVING sum(bp) >= {floor}),
top AS (SELECT c.*, s.size, row_number() OVER (PARTITION BY c.bin ORDER BY c.bp DESC, s.seen) AS r FROM cells c JOIN gs s ON c.genome = s.genome),
per AS (SELECT t.bin, p.genome, p.bp / t.total AS purity, p.bp / p.size AS completeness, CAST(t.total AS BIGINT) AS total_length,
  CAST(p.bp AS BIGINT) AS tp_length, CAST(t.n AS BIGINT) AS seq_count FROM tot t JOIN top p ON t.bin = p.bin AND p.r = 1)"""


def _amber_summary(gold: str, floor: int) -> str:
    return f"""WITH {_amber(gold, floor)},
a AS (SELECT count(*) AS bins, count(*) FILTER (completeness > 0.9 AND purity > 0.95) AS hq, count(*) FILTER (completeness > 0.7 AND purity > 0.9) AS mq,
  count(*) FILTER (completeness > 0.5 AND purity > 0.9) AS lq, round(avg(purity), 6) AS avg_purity,
  coalesce(round(sum(tp_length) / sum(total_length), 6), 0.0) AS weighted_purity FROM per),
b AS (SELECT count(*) AS genomes, round(avg(coalesce(m.bp, 0) / gs.size), 6) AS avg_completeness
  FROM gs LEFT JOIN (SELECT genome, max(bp) AS bp FROM cells WHERE bin IN (SELECT bin FROM tot) GROUP BY genome) m ON gs.genome = m.genome)
SELECT * FROM a, b"""


_MEMBERS = """members AS (SELECT p.p_type AS bin, p.p_partkey AS seq, 1000 + p.p_size * 100 AS length, coalesce(l.depth, 0) AS depth
  FROM part p LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS depth FROM lineitem GROUP BY 1) l ON p.p_partkey = l.l_partkey)"""
_QC = f"""hits AS (SELECT user_id AS bin, json_extract_string(props, '$.k') AS marker, count(*) AS c FROM events GROUP BY ALL),
qc AS (SELECT b.bin, b.contigs, h.d AS distinct_markers, CAST(h.x AS BIGINT) AS extra_copies, 100.0::DOUBLE * h.d / {SET_SIZE} AS completeness, 100.0::DOUBLE * h.x / {SET_SIZE} AS contamination
  FROM (SELECT user_id AS bin, count(*) AS contigs FROM events GROUP BY 1) b JOIN (SELECT bin, count(*) AS d, sum(c - 1) AS x FROM hits GROUP BY bin) h ON b.bin = h.bin)"""
_TIER = "CASE WHEN completeness > 90 AND contamination < 5 THEN 'HQ' WHEN completeness >= 50 AND contamination < 10 THEN 'MQ' ELSE 'LQ' END"
_CANDS = """ev AS (SELECT event_id AS seq, json_extract_string(props, '$.k') AS marker, unnest(['user:' || user_id, 'hour:' || event_type || strftime(ts, ':%m%d%H'), 'day:' || event_type || strftime(ts, ':%m%d')]) AS cand FROM events),
cands AS (SELECT cand, list(struct_pack(seq := seq, m := marker) ORDER BY seq) AS items FROM ev GROUP BY cand),
size_ AS (SELECT max(event_id) + 1 AS n FROM events)"""
#: The greedy loop: one row a pick, with the contigs that are gone by then.
_REFINE_SQL = f"""WITH RECURSIVE {_CANDS}, step AS (
  SELECT 0 AS k, CAST(NULL AS VARCHAR) AS cand, CAST(NULL AS DOUBLE) AS score, CAST([] AS BIGINT[]) AS seqs, list_transform(range(0, n), lambda i: false) AS gone FROM size_
  UNION ALL
  SELECT k + 1, cand, score, list_transform(f, lambda x: x.seq), list_transform(gone, lambda g, i: g OR list_contains(list_transform(f, lambda x: x.seq), i - 1)) FROM (
    SELECT * FROM (
      SELECT k, gone, cand, f, 100.0::DOUBLE * len(list_distinct(list_transform(f, lambda x: x.m))) / {SET_SIZE} AS comp,
        100.0::DOUBLE * (len(f) - len(list_distinct(list_transform(f, lambda x: x.m)))) / {SET_SIZE} AS cont, comp - 1.0 * cont AS score
      FROM (SELECT s.k, s.gone, c.cand, list_filter(c.items, lambda x: NOT s.gone[x.seq + 1]) AS f FROM step s CROSS JOIN cands c))
    WHERE comp >= 10 AND cont <= 30 QUALIFY row_number() OVER (ORDER BY score DESC, cand) = 1))
SELECT cand, unnest(seqs) AS seq, round(score, 6) + 0.0 AS score FROM step WHERE k > 0"""
_ENSEMBLE_SQL = f"""WITH RECURSIVE {_CANDS}, q AS (SELECT cand, list_transform(items, lambda x: x.seq) AS seqs, 100.0::DOUBLE * len(list_distinct(list_transform(items, lambda x: x.m))) / {SET_SIZE} AS comp,
    100.0::DOUBLE * (len(items) - len(list_distinct(list_transform(items, lambda x: x.m)))) / {SET_SIZE} AS cont FROM cands),
o AS (SELECT cand, seqs, comp - 1.0 * cont AS score, row_number() OVER (ORDER BY comp - 1.0 * cont DESC, cand) AS r FROM q WHERE comp >= 10 AND len(seqs) >= 2),
step AS (
  SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS VARCHAR) AS cand, CAST(NULL AS DOUBLE) AS score, CAST([] AS BIGINT[]) AS own, list_transform(range(0, n), lambda i: false) AS gone FROM size_
  UNION ALL
  SELECT r, cand, score, own, list_transform(gone, lambda g, i: g OR list_contains(own, i - 1)) FROM (
    SELECT r, cand, score, gone, CASE WHEN len(free) >= 0.5 * n THEN free ELSE CAST([] AS BIGINT[]) END AS own FROM (
      SELECT o.r, o.cand, o.score, s.gone, len(o.seqs) AS n, list_filter(o.seqs, lambda x: NOT s.gone[x + 1]) AS free FROM step s JOIN o ON o.r = s.r + 1)))
SELECT cand, unnest(own) AS seq, round(score, 6) + 0.0 AS score FROM step WHERE r > 0"""
_CERTIFY = """ref AS (SELECT c_custkey AS seq, c_mktsegment AS bin, 1000 + CAST(floor(abs(c_acctbal)) AS BIGINT) AS length FROM customer),
runs AS (SELECT year(o_orderdate) AS run, o_custkey AS seq, arg_min(o_orderpriority, o_orderkey) AS label FROM orders GROUP BY 1, 2),
votes AS (SELECT bin, run, label, count(*) AS c FROM ref JOIN runs USING (seq) GROUP BY ALL),
plural AS (SELECT bin, run, label FROM votes QUALIFY row_number() OVER (PARTITION BY bin, run ORDER BY c DESC, label) = 1),
prob AS (SELECT r.bin, r.seq, avg(CASE WHEN u.label = p.label THEN 1.0 ELSE 0.0 END) AS prob FROM ref r JOIN runs u USING (seq) JOIN plural p ON p.bin = r.bin AND p.run = u.run GROUP BY ALL),
each_ AS (SELECT r.seq, r.bin, r.length, p.prob, CASE WHEN p.prob >= 0.8 THEN 'core' WHEN p.prob < 0.5 THEN 'ambiguous' ELSE 'member' END AS state FROM ref r LEFT JOIN prob p ON r.seq = p.seq)"""

ORACLES = {
    "amber_per_bin": f"WITH {_amber('0')} SELECT bin, genome, round(purity, 6) AS purity, round(completeness, 6) AS completeness, total_length, tp_length, seq_count FROM per",
    "amber_summary": _amber_summary("0", 0),
    "amber_unmatched": f"WITH {_GOLD}, {_PRED} SELECT seq, bin FROM pred WHERE seq NOT IN (SELECT seq FROM gold WHERE length >= {MIN_LENGTH})",
    "amber_min_bin_size": _amber_summary(str(MIN_LENGTH), MIN_BIN),
    "qc_per_bin": f"WITH {_QC} SELECT *, {_TIER} AS tier FROM qc",
    "qc_summary": f"WITH {_QC}, t AS (SELECT *, {_TIER} AS tier FROM qc) SELECT count(*) AS bins, count(*) FILTER (tier = 'HQ') AS hq, count(*) FILTER (tier = 'MQ') AS mq, count(*) FILTER (tier = 'LQ') AS lq, count(*) FILTER (tier = '-') AS unscored, round(sum(completeness), 6) AS sum_completeness, round(avg(contamination), 6) AS avg_contamination FROM t",
    "taxonomy_vote": """WITH v AS (SELECT p_type AS bin, p_brand AS lineage, CAST(sum(1000 + p_size * 100) AS BIGINT) AS w FROM part GROUP BY ALL),
s AS (SELECT p_brand AS lineage, min(p_partkey) AS seen FROM part GROUP BY 1),
t AS (SELECT v.*, sum(w) OVER (PARTITION BY bin) AS all_w, row_number() OVER (PARTITION BY bin ORDER BY w DESC, seen) AS r FROM v JOIN s ON v.lineage = s.lineage)
SELECT bin, lineage, w AS weight, round(w / all_w, 6) AS share FROM t WHERE r = 1""",
    "bin_stats": f"WITH {_MEMBERS} SELECT bin, count(*) AS num_contigs, CAST(sum(length) AS BIGINT) AS total_length, round(sum(length * depth) / sum(length), 6) AS coverage FROM members GROUP BY bin HAVING sum(length) >= 1000000",
    "bin_depth_stats": f"WITH {_MEMBERS}, m AS (SELECT bin, sum(length) AS n, sum(length * depth) / sum(length) AS mean FROM members GROUP BY bin) SELECT m.bin, CAST(m.n AS BIGINT) AS total_length, round(m.mean, 4) AS mean_depth, round(sqrt(sum(x.length * (x.depth - m.mean) * (x.depth - m.mean)) / m.n), 4) AS sd_depth FROM m JOIN members x ON m.bin = x.bin GROUP BY m.bin, m.n, m.mean",
    "purify_outliers": """WITH members AS (SELECT s_nationkey AS bin, s_suppkey AS seq FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)),
big AS (SELECT bin FROM members GROUP BY bin HAVING count(*) >= 3),
peaks AS (SELECT l_suppkey AS seq, arg_min(month, struct_pack(a := -q, b := month)) AS marker FROM (SELECT l_suppkey, l_returnflag, month(l_shipdate) AS month, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY l_suppkey, l_returnflag),
hits AS (SELECT m.bin, m.seq, p.marker FROM peaks p JOIN members m ON p.seq = m.seq WHERE m.bin IN (SELECT bin FROM big)),
twice AS (SELECT bin, marker FROM hits GROUP BY ALL HAVING count(*) > 1),
carriers AS (SELECT DISTINCT h.bin, h.seq FROM hits h JOIN twice t ON h.bin = t.bin AND h.marker = t.marker),
logs AS (SELECT m.bin, m.seq, l_returnflag || l_linestatus AS sample, ln(sum(l_quantity) + 1.0) AS y FROM lineitem JOIN members m ON l_suppkey = m.seq WHERE m.bin IN (SELECT bin FROM twice) GROUP BY ALL),
med AS (SELECT bin, sample, list_sort(list(y))[count(*) // 2 + 1] AS med FROM logs GROUP BY ALL),
dev AS (SELECT l.*, abs(l.y - m.med) AS dev FROM logs l JOIN med m ON l.bin = m.bin AND l.sample = m.sample),
mad AS (SELECT bin, sample, list_sort(list(dev))[count(*) // 2 + 1] AS mad FROM dev GROUP BY ALL),
z AS (SELECT d.bin, d.seq, max(d.dev / (m.mad * 1.4826 + 1e-9)) AS zmax FROM dev d JOIN mad m ON d.bin = m.bin AND d.sample = m.sample GROUP BY ALL)
SELECT z.bin, z.seq, round(z.zmax, 6) AS zmax FROM z JOIN carriers c ON z.bin = c.bin AND z.seq = c.seq WHERE z.zmax > 2""",
    "membership_matrix": "SELECT p_partkey AS seq, CAST(coalesce(l.label + 1, 0) AS BIGINT) AS cluster FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS label FROM lineitem GROUP BY 1) l ON p_partkey = l.l_partkey",
    "partition_agreement": """WITH n AS (SELECT p_partkey AS node, p_size % 5 AS a, length(p_name) % 3 AS b FROM part)
SELECT count(*) AS edges, round(avg(CASE WHEN (s.a = t.a) = (s.b = t.b) THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM lineitem JOIN n s ON l_partkey = s.node JOIN n t ON l_suppkey = t.node""",
    "refine_consensus": _REFINE_SQL,
    "ensemble_consensus": _ENSEMBLE_SQL,
    "certify_stability": f"WITH {_CERTIFY} SELECT seq, bin, length, round(prob, 6) AS prob, state FROM each_",
    "certify_alternatives": f"""WITH {_CERTIFY}, sizes AS (SELECT bin, count(*) AS n FROM ref GROUP BY bin),
owner AS (SELECT run, label, p.bin AS owner FROM plural p JOIN sizes s ON p.bin = s.bin QUALIFY row_number() OVER (PARTITION BY run, label ORDER BY s.n DESC, p.bin) = 1),
seen AS (SELECT r.bin, r.seq, u.label <> p.label AS away, o.owner FROM ref r JOIN runs u ON r.seq = u.seq JOIN plural p ON p.bin = r.bin AND p.run = u.run LEFT JOIN owner o ON o.run = u.run AND o.label = u.label),
n AS (SELECT bin, seq, count(*) AS n FROM seen GROUP BY ALL),
l AS (SELECT bin, seq, owner, count(*) AS c FROM seen WHERE away AND owner <> bin GROUP BY bin, seq, owner QUALIFY row_number() OVER (PARTITION BY bin, seq ORDER BY c DESC, owner) = 1)
SELECT l.bin, l.seq, l.owner AS alternative, round(l.c / n.n, 6) AS alt_prob FROM l JOIN n ON l.bin = n.bin AND l.seq = n.seq""",
    "certify_bins": f"WITH {_CERTIFY} SELECT bin, round(sum(CASE WHEN state = 'core' THEN length ELSE 0 END) / sum(length), 6) AS core_fraction, round(sum(coalesce(prob, 0) * length) / sum(length), 6) AS mean_prob FROM each_ GROUP BY bin",
}
