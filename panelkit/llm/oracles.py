"""DuckDB SQL for those corpus queries that SQL can express.

The similarity queries are stated as plain joins on tokens that count what two sets share,
without sketches, prefixes or bounds, so they are meant for the small tables.
"""

from __future__ import annotations

#: Maximal runs without white space.
WORD = r"'[^\x20\x09-\x0D]+'"

MIXING = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORD})) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST([3, 1, 2][nth % 3 + 1] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 2 AS most
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM s)),
l AS (
  SELECT *, ((SELECT CAST(sum(source_size) AS DOUBLE) * CAST(1.5 AS DOUBLE) FROM s)
      - coalesce(sum(most) OVER (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
o AS (SELECT first(level ORDER BY most / weight, nth) FILTER (level * weight <= most) AS level FROM l),
t AS (SELECT source, source_size, least(most, coalesce(o.level * weight, most)) AS target FROM l, o),
b AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS budget,
    CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
k AS (
  SELECT *, coalesce(sum(tied) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT source, key, sum(size) AS tied FROM d GROUP BY source, key))
SELECT d.doc_id, d.size, b.source_size, b.target,
  CAST(d.size * b.epochs + CASE
    WHEN k.before + k.tied <= b.budget - b.epochs * b.source_size THEN d.size
    WHEN k.before > b.budget - b.epochs * b.source_size THEN 0
    ELSE (d.size * (b.budget - b.epochs * b.source_size - k.before)) // k.tied END AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.key = k.key
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s
  FROM d),
classes AS (SELECT s, len(s) AS n, min(doc_id) AS c FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT c, n, unnest(s) AS t FROM classes),
links AS (
  SELECT x.c AS a, y.c AS b FROM tokens x JOIN tokens y ON x.t = y.t AND x.c <> y.c AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY x.c, y.c HAVING 100 * count(*) >= 85 * (min(x.n) + min(y.n) - count(*))),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a AS c, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN least_of USING (c)
"""

LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ts FROM documents),
raw AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS line FROM d WHERE text IS NOT NULL),
l AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, line) AS place
  FROM (SELECT doc_id, line, regexp_extract_all(lower(t), {WORD}) AS w FROM raw) WHERE len(w) > 0),
sets AS (
  SELECT doc_id, line, place, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS s
  FROM l),
classes AS (SELECT s, len(s) AS n, min(place) AS c FROM sets GROUP BY s),
tokens AS (SELECT c, n, unnest(s) AS t FROM classes),
links AS (
  SELECT x.c AS a, y.c AS b FROM tokens x JOIN tokens y ON x.t = y.t AND x.c <> y.c AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
  GROUP BY x.c, y.c HAVING 5 * count(*) >= 4 * (min(x.n) + min(y.n) - count(*))),
linked AS (SELECT a AS c, min(b) AS other, count(*) AS links FROM links GROUP BY a),
told AS (
  SELECT doc_id, line, place > least(c, coalesce(other, c)) AS gone, coalesce(links, 0) AS links
  FROM sets JOIN classes ON sets.s = classes.s LEFT JOIN linked USING (c)),
by_doc AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(list(line ORDER BY line) FILTER (gone), []) AS removed, CAST(sum(links) AS BIGINT) AS n_links
  FROM told GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN coalesce(n_removed, 0) = 0 THEN text
    ELSE array_to_string(list_filter(ts, lambda t, i: NOT list_contains(removed, i - 1)), chr(10)) END AS text,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(array_to_string(removed, ','), '') AS removed_lines, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN by_doc ON d.doc_id = by_doc.doc_id
"""

NEGATIVES = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.vector, b.vector) AS BIGINT) AS score
  FROM v a JOIN v b ON a.row <> b.row WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) AS nth FROM s WHERE same QUALIFY nth <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor, p.nth ORDER BY s.score DESC, s.vec_id NULLS LAST) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= 5
"""

ORACLES: dict[str, str] = {"op3_source_mixing": MIXING, "op9_near_duplicates": NEAR_DUPLICATES, "op10_line_dedup": LINE_DEDUP, "op12_hard_negatives": NEGATIVES}
