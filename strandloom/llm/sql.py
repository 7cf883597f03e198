"""The same results in DuckDB's SQL."""

from __future__ import annotations

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Counts, ratios, histograms, limits and verdicts; ``docs`` is (doc_id, text, lang, source).
QUALITY_CTES = f"""
q_words AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         CASE WHEN trim(coalesce(text, ''), {_SPACES}) = '' THEN CAST([] AS VARCHAR[])
              ELSE regexp_split_to_array(trim(coalesce(text, ''), {_SPACES}), '[\\x20\\x09-\\x0D]+') END AS w
  FROM docs),
q_lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM q_words)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
q_grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM q_words WHERE len(w) >= 3)),
q_again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM q_grams) WHERE c > 1),
q_covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM q_again) GROUP BY doc_id),
q_counts AS (
  SELECT a.doc_id, a.lang, a.source, CAST(len(a.w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(a.w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(a.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(a.text, '[\\p{{L}}\\p{{M}}\\p{{N}}\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS n_marks,
         CAST(coalesce(l.n_lines, 0) AS BIGINT) AS n_lines,
         CAST(coalesce(l.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM q_words a LEFT JOIN q_lines l ON a.doc_id = l.doc_id LEFT JOIN q_covered c ON a.doc_id = c.doc_id),
q_scored AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CAST(CASE WHEN word_chars > 0 THEN 10000 * n_symbols // word_chars ELSE 0 END AS BIGINT) AS symbol_bp,
    CAST(CASE WHEN word_chars > 0 THEN 10000 * n_marks // word_chars ELSE 0 END AS BIGINT) AS mark_bp,
    CAST(CASE WHEN n_lines > 0 THEN 10000 * n_dup_lines // n_lines ELSE 0 END AS BIGINT) AS dup_line_bp,
    CAST(CASE WHEN n_words > 0 THEN 10000 * n_repeat_words // n_words ELSE 0 END AS BIGINT) AS repeat_bp,
    CAST(CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS BIGINT) AS word_len_pc
  FROM q_counts),
q_long AS (
  SELECT lang, source, ratio, v - v % (1::BIGINT << CAST(greatest(length(bin(v)) - 11, 0) AS INT)) AS bin
  FROM (SELECT lang, source, unnest(['symbol_bp', 'mark_bp', 'dup_line_bp', 'repeat_bp', 'word_len_pc']) AS ratio,
               unnest([symbol_bp, mark_bp, dup_line_bp, repeat_bp, word_len_pc]) AS v FROM q_scored WHERE NOT base_failed)),
q_sides AS (SELECT *, true AS upper FROM q_long WHERE bin > 0 UNION ALL SELECT *, false FROM q_long),
q_fine AS (
  SELECT lang, source, ratio, upper, count(*) AS n, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3 FROM q_sides GROUP BY ALL),
q_lang AS (
  SELECT lang, ratio, upper, count(*) AS n, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3 FROM q_sides GROUP BY ALL),
q_all AS (
  SELECT ratio, upper, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3 FROM q_sides GROUP BY ALL),
q_groups AS (SELECT DISTINCT s.lang, s.source, s.upper, r.ratio FROM q_sides s, (SELECT DISTINCT ratio FROM q_long) r),
q_picked AS (
  SELECT g.lang, g.source, g.ratio, g.upper,
    CASE WHEN f.n >= 200 THEN f.q1 WHEN l.n >= 200 THEN l.q1 ELSE a.q1 END AS q1,
    CASE WHEN f.n >= 200 THEN f.q3 WHEN l.n >= 200 THEN l.q3 ELSE a.q3 END AS q3
  FROM q_groups g LEFT JOIN q_fine f ON g.lang IS NOT DISTINCT FROM f.lang AND g.source IS NOT DISTINCT FROM f.source AND g.ratio = f.ratio AND g.upper = f.upper
  LEFT JOIN q_lang l ON g.lang IS NOT DISTINCT FROM l.lang AND g.ratio = l.ratio AND g.upper = l.upper LEFT JOIN q_all a ON g.ratio = a.ratio AND g.upper = a.upper),
q_cuts AS (
  SELECT lang, source, ratio, CASE WHEN upper THEN CAST(q3 + 6 * greatest(q3 - q1, q3 // 20) AS BIGINT) END AS hi,
    CASE WHEN NOT upper THEN CAST(q1 - 6 * greatest(q3 - q1, q3 // 20) AS BIGINT) END AS lo FROM q_picked),
q_limits AS (
  SELECT lang, source, max(hi) FILTER (ratio = 'symbol_bp') AS max_symbol_bp, max(hi) FILTER (ratio = 'mark_bp') AS max_mark_bp,
    max(hi) FILTER (ratio = 'dup_line_bp') AS max_dup_line_bp, max(hi) FILTER (ratio = 'repeat_bp') AS max_repeat_bp,
    max(hi) FILTER (ratio = 'word_len_pc') AS max_word_len_pc,
    max(lo) FILTER (ratio = 'mark_bp') AS min_mark_bp, max(lo) FILTER (ratio = 'word_len_pc') AS min_word_len_pc
  FROM q_cuts GROUP BY lang, source),
q_judged AS (
  SELECT s.*, m.* EXCLUDE (lang, source),
    NOT base_failed AND coalesce(symbol_bp <= max_symbol_bp, true) AND coalesce(mark_bp BETWEEN min_mark_bp AND max_mark_bp, true)
      AND coalesce(dup_line_bp <= max_dup_line_bp, true) AND coalesce(repeat_bp <= max_repeat_bp, true)
      AND coalesce(word_len_pc BETWEEN min_word_len_pc AND max_word_len_pc, true) AS kept
  FROM q_scored s LEFT JOIN q_limits m ON s.lang IS NOT DISTINCT FROM m.lang AND s.source IS NOT DISTINCT FROM m.source)
"""

_LINES = f"""
l_lines AS (
  SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
l_owner AS (
  SELECT key, min(doc_id) AS owner FROM l_lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
"""

ORACLES: dict[str, str] = {
    "op2_quality_rules": f"""
WITH docs AS (SELECT doc_id, text, lang, source FROM documents), {QUALITY_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, symbol_bp, mark_bp, dup_line_bp, repeat_bp,
  word_len_pc, max_symbol_bp, max_mark_bp, max_dup_line_bp, max_repeat_bp, max_word_len_pc, min_mark_bp, min_word_len_pc
FROM q_judged""",
    "op6_line_dedup": f"""
WITH {_LINES}
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT l.doc_id, l.i, l.line, o.owner IS NOT NULL AND o.owner < l.doc_id AS gone FROM l_lines l LEFT JOIN l_owner o ON l.key = o.key)
GROUP BY doc_id""",
    "op7_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE embedding IS NOT NULL),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id AS vec_id, q.label = c.label AS same,
    CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score
FROM (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
WHERE rank <= 3""",
    "op12_phrase_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS g
      FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, g, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(g, ' ') AS w FROM f WHERE m > 1),
x AS (SELECT lang, g, a, m, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:m], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT x.lang, x.g, x.a, x.k, l.a AS l, r.a AS r, t.n,
        (1000::HUGEINT * x.a::HUGEINT * t.n::HUGEINT) // (l.a::HUGEINT * r.a::HUGEINT) AS score
      FROM x JOIN f l ON l.lang = x.lang AND l.g = x.lp JOIN f r ON r.lang = x.lang AND r.g = x.rp JOIN t ON t.lang = x.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
o AS (SELECT DISTINCT lang, sub, a FROM (
        SELECT lang, a, array_to_string(w[i:i + z - 1], ' ') AS sub FROM (SELECT lang, a, w, z, unnest(range(1, m - z + 2)) AS i FROM c, (SELECT unnest(range(2, 5)) AS z) WHERE z < m)))
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank, g AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
  FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.sub = b.g AND 100 * o.a >= 100 * b.a))
WHERE rank <= 2000""",
    "op13_minhash_near_dedup": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN t = '' THEN CAST([] AS VARCHAR[]) ELSE regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+') END AS w
  FROM (SELECT doc_id, translate(trim(coalesce(text, ''), {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
g AS MATERIALIZED (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.n >= 80 * (x.n + y.n - i.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id""",
}
