"""DuckDB SQL for the operators' queries that SQL can express, by plain joins and counts over the same tables.

Not among them: language models, tokenizers, hash permutations, fingerprints, page markup, searches over edits.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op1_line_dedup"] = r"""
WITH raw AS (
  SELECT doc_id, coalesce('=' || source, 'null') AS site, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM raw),
wide AS (
  SELECT line FROM lines WHERE line <> '' GROUP BY line
  HAVING count(DISTINCT site) >= CASE WHEN len(regexp_extract_all(line,
    '[\p{Han}\p{Hiragana}\p{Katakana}]{1,2}|[^\s\p{Han}\p{Hiragana}\p{Katakana}]+')) >= 20 THEN 2 ELSE 10 END),
marked AS (
  SELECT l.*, w.line IS NOT NULL AND row_number() OVER (PARTITION BY l.line ORDER BY l.doc_id NULLS LAST, l.pos) > 1 AS gone
  FROM lines l LEFT JOIN wide w ON l.line = w.line),
kept AS (
  SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
         CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS lines_removed
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, k.text, coalesce(k.lines_removed, 0) AS lines_removed FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def _whole(scale: int, condition: str = "true") -> str:
    """Vectors that take part, with whole components as doubles (exact below 2^53)."""
    return f"""
  SELECT *, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor({scale} * x)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND {condition}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


ORACLE["op6_maxscore"] = f"""
WITH vectors AS ({_whole(1024)}),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""

ORACLE["op11_hard_negatives"] = f"""
WITH vectors AS (
  SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM ({_whole(256, "label IS NOT NULL")})),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM scored WHERE same)
  WHERE place <= 5),
hard AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
   AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM hard WHERE rank <= 3
"""
