"""DuckDB SQL that says what the operators' queries return, where SQL can."""

SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

EXACT = rf"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACE_RUN}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""

MIXING = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * CAST(sum(size) AS DOUBLE) AS cap,
             [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
             [0.5::DOUBLE, 0.0, -0.5][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS ramp
      FROM d GROUP BY source),
fill(share, round) AS (
  SELECT 0.0::DOUBLE, 0
  UNION ALL
  SELECT CASE WHEN n.share > f.share THEN n.share ELSE f.share END, f.round + 1
  FROM fill f, LATERAL (
    SELECT coalesce((CAST(sum(source_size) AS DOUBLE) * 150 / 100
             - coalesce(sum(cap) FILTER (cap <= f.share * weight), 0.0))
           / sum(weight) FILTER (cap > f.share * weight), f.share) AS share FROM s) n
  WHERE f.round < 40),
p AS (SELECT s.*, least(cap, (SELECT max(share) FROM fill) * weight) AS target FROM s),
r AS (SELECT d.doc_id, d.size, p.source_size, p.target, CAST(round(p.target) AS BIGINT) AS words, p.ramp,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
-- Every reading a row may have: words it gives, and where the integrated schedule w(t) = 1 + ramp (1 - 2 t) has reached its start.
readings AS (
  SELECT *, CASE WHEN ramp = 0 THEN done ELSE 2 * done / (1 + ramp + sqrt(greatest(0.0, (1 + ramp) * (1 + ramp) - 4 * ramp * done))) END AS position
  FROM (SELECT doc_id, k, ramp, greatest(0, least(size, words - k * source_size - begun)) AS gives,
               CASE WHEN words > 0 THEN least(1.0::DOUBLE, CAST(begun + k * source_size AS DOUBLE) / words) ELSE 1.0::DOUBLE END AS done
        FROM r, (VALUES (0), (1)) AS t(k))),
ranked AS (SELECT doc_id, k, row_number() OVER (ORDER BY position, doc_id, k) - 1 AS rank FROM readings WHERE gives > 0)
SELECT r.doc_id, r.size, r.source_size, r.target, CAST(g.taken AS BIGINT) AS taken, round(g.position, 9) AS position,
       coalesce(k.ranks, '') AS train_ranks
FROM r JOIN (SELECT doc_id, sum(gives) AS taken, min(position) FILTER (k = 0) AS position FROM readings GROUP BY doc_id) g USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY k) AS ranks FROM ranked GROUP BY doc_id) k USING (doc_id)
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(t, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents)),
words AS (
  SELECT lang, w, lead(w, 1) OVER s AS w2, lead(w, 2) OVER s AS w3
  FROM (SELECT lang, piece, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM pieces) WINDOW s AS (PARTITION BY piece ORDER BY i)),
f AS (
  SELECT lang, 1 AS k, w AS g, count(*)::HUGEINT AS f FROM words GROUP BY ALL
  UNION ALL SELECT lang, 2, w || ' ' || w2, count(*) FROM words WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3, count(*) FROM words WHERE w3 IS NOT NULL GROUP BY ALL),
sizes AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT *, string_split(g, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT o.lang, o.g, o.k, o.f AS a, c AS cut, l.f AS l, r.f AS r, (1000000::HUGEINT * o.f * o.f) // (l.f * r.f) AS score
  FROM often o JOIN (VALUES (1), (2)) AS t(c) ON c < o.k
  JOIN f l ON l.lang = o.lang AND l.g = array_to_string(o.w[1:c], ' ')
  JOIN f r ON r.lang = o.lang AND r.g = array_to_string(o.w[c + 1:o.k], ' ')),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, g, max(f) AS most
  FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS g FROM often WHERE k = 3)
  GROUP BY ALL),
kept AS (
  SELECT w.* FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.g = w.g AND w.k = 2
  WHERE i.most IS NULL OR 100 * i.most < 50 * w.a)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS BIGINT) AS rank, g AS phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN sizes USING (lang)
QUALIFY rank <= 2000
"""
