"""SQL counterparts of the data-preparation queries, for DuckDB."""

_STATE = """
WITH raw AS (
  SELECT board, snapshot_id, ts, lower(trim(key, E' \\t\\r\\n')) AS k, ingested_at, rank,
         CASE WHEN isnan(score) THEN NULL ELSE score END AS score,
         CASE WHEN isnan(price_completion) THEN NULL ELSE price_completion END AS price
  FROM snapshots WHERE snapshot_id IS NOT NULL AND trim(key, E' \\t\\r\\n') <> ''
),
series AS (
  SELECT *, row_number() OVER w AS place, lag(s) OVER w AS before, lead(s) OVER w AS after
  FROM (SELECT snapshot_id AS s, min(board) AS board, min(ts) AS o FROM raw GROUP BY snapshot_id)
  WINDOW w AS (PARTITION BY board ORDER BY o NULLS FIRST, s)
),
state AS (
  SELECT s, k, place, before, after, series.board, rank, score, price
  FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, k ORDER BY ingested_at DESC NULLS LAST,
               rank DESC NULLS LAST, score DESC NULLS LAST, price DESC NULLS LAST) AS n FROM raw) r
  JOIN series ON series.s = r.snapshot_id WHERE n = 1
),
pairs AS (
  SELECT coalesce(c.s, o.after) AS s, coalesce(c.k, o.k) AS k, c.s IS NULL AS gone, o.s IS NULL AS fresh, c.before AS before, c.s AS cs,
         c.rank IS DISTINCT FROM o.rank
         OR (c.score IS NULL) <> (o.score IS NULL) OR coalesce(abs(c.score - o.score) >= 0.01, false)
         OR (c.price IS NULL) <> (o.price IS NULL) OR coalesce(abs(c.price - o.price) >= 1e-10, false) AS differs
  FROM state c FULL OUTER JOIN (SELECT * FROM state WHERE after IS NOT NULL) o ON c.s = o.after AND c.k = o.k
)
"""

P2_FOUND = (
    _STATE
    + """
SELECT CAST(s AS BIGINT) AS snapshot_id, k AS key, CASE WHEN fresh THEN 'added' WHEN gone THEN 'removed' ELSE 'changed' END AS change_kind
FROM pairs WHERE (gone OR fresh OR differs) AND (gone OR before IS NOT NULL)
"""
)

P3_FOUND = (
    _STATE
    + """
, marks AS (
  SELECT series.board, k, pairs.s, gone, lead(pairs.s) OVER (PARTITION BY series.board, k ORDER BY place) AS ends
  FROM pairs JOIN series ON series.s = pairs.s WHERE gone OR fresh OR differs
)
SELECT board, k AS key, CAST(s AS BIGINT) AS from_id, CAST(coalesce(ends, -1) AS BIGINT) AS to_id FROM marks WHERE NOT gone
"""
)

P3_VERSIONS = (
    _STATE
    + """
, marks AS (
  SELECT series.board, k, pairs.s, gone, lead(pairs.s) OVER (PARTITION BY series.board, k ORDER BY place) AS ends
  FROM pairs JOIN series ON series.s = pairs.s WHERE gone OR fresh OR differs
), versions AS (SELECT board, k, ends, row_number() OVER (PARTITION BY board, k ORDER BY s) AS n FROM marks WHERE NOT gone)
SELECT board, CAST(count(DISTINCT k) AS BIGINT) AS keys, CAST(count(*) AS BIGINT) AS versions,
       CAST(count(*) FILTER (WHERE ends IS NULL) AS BIGINT) AS holding, CAST(max(n) AS BIGINT) AS most_versions
FROM versions GROUP BY board
"""
)

P1_PROFILE = r"""
WITH raw AS (
  SELECT load_id, 'price_prompt' AS column_name, price_prompt IS NULL AS missing, price_prompt AS t,
         CASE WHEN regexp_full_match(price_prompt, '[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?') THEN TRY_CAST(price_prompt AS DOUBLE) END AS x, 0.0 AS low, 1.0 AS high FROM usage_loads
  UNION ALL SELECT load_id, 'context_length', context_length IS NULL, NULL, CAST(context_length AS DOUBLE), 1.0, 1e8 FROM usage_loads
  UNION ALL SELECT load_id, 'coding_index', coding_index IS NULL OR isnan(coding_index), NULL, CASE WHEN isnan(coding_index) THEN NULL ELSE coding_index END, 0.0, 100.0 FROM usage_loads
)
SELECT load_id, column_name, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE missing) AS BIGINT) AS missing,
       CAST(count(*) FILTER (WHERE NOT missing AND x IS NULL) AS BIGINT) AS malformed,
       CAST(count(*) FILTER (WHERE x NOT BETWEEN low AND high) AS BIGINT) AS impossible,
       CAST(count(DISTINCT x) + count(DISTINCT CASE WHEN x IS NULL THEN t END) AS BIGINT) AS distinct_values,
       min(x) FILTER (WHERE x BETWEEN low AND high) AS lowest, max(x) FILTER (WHERE x BETWEEN low AND high) AS highest
FROM raw GROUP BY load_id, column_name
"""
