"""DuckDB counterparts of the corpus queries that SQL can express in time."""

ORACLES: dict[str, str] = {}

ORACLES["op1_cover_tree_top_k"] = """
WITH t AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM t q JOIN t c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLES["op6_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS spot FROM documents
), full_lines AS (
  SELECT doc_id, line, spot, row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS pos
  FROM l WHERE length(trim(line, ' ' || chr(9) || chr(13))) > 0
), pairs AS (
  SELECT doc_id, pos, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM full_lines
), later AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth FROM pairs WHERE k IS NOT NULL) WHERE nth > 1
), long_lines AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth FROM full_lines
  WHERE length(line) > 100 AND len(list_filter(string_split_regex(line, '[\t\x0B\f\r ]+'), lambda w: w <> '')) > 50
), gone AS (
  SELECT doc_id, pos FROM later UNION SELECT doc_id, pos + 1 FROM later UNION SELECT doc_id, pos FROM long_lines WHERE nth > 1
), runs AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before < pos - 1) AS n_runs
  FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM gone) GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.spot) AS kept
  FROM l LEFT JOIN full_lines f USING (doc_id, spot) LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = f.pos
  WHERE g.doc_id IS NULL GROUP BY l.doc_id
), n AS (SELECT doc_id, count(*) AS n_lines FROM full_lines GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_runs, 0) AS n_runs,
  CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(k.kept, '')) END AS kept_md5
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN runs r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
