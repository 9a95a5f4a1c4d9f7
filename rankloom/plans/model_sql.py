"""SQL counterparts of the queries on the model index, for DuckDB."""

from __future__ import annotations

from rankloom.functions.text import SIDELINED
from rankloom.operators.fit import BYTES, NOTES, Machine, preset
from rankloom.operators.score import MODEL_SIGNALS, MODEL_WEIGHTS, WITHOUT_QUALITY


def _r1(x: str) -> str:
    return f"CAST(printf('%.1f', {x}) AS DOUBLE)"


def _nan(t: str, *cols: str) -> str:
    return ", ".join(f"CASE WHEN isnan({t}{c}) THEN NULL ELSE {t}{c} END AS {c}" for c in cols)


SIZES = r"list_transform(regexp_extract_all({t}, '(?i)(?:^|[^\d.])(\d+(?:\.\d+)?)\s*b\b', 1), lambda x: CAST(x AS DOUBLE))"
PRODUCT = r"(?i)(\d+)\s*x\s*(\d+(?:\.\d+)?)\s*b\b"


def _billions(t: str) -> str:
    a, b = (f"regexp_extract({t}, '{PRODUCT}', {i})" for i in (1, 2))
    return f"list_max(list_concat({SIZES.format(t=t)}, CASE WHEN {a} <> '' THEN [CAST({a} AS DOUBLE) * CAST({b} AS DOUBLE)] ELSE [] END))"


def _number(c: str) -> str:
    return rf"(CASE WHEN regexp_full_match({c}, '\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*') THEN CASE WHEN isnan(TRY_CAST(trim({c}) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim({c}) AS DOUBLE) END END)"


def _squash(c: str) -> str:
    return f"regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]', '', 'g')"


NUMS = ("price_prompt", "price_completion", "intelligence_index", "coding_index", "agentic_index", "arena_elo")
USAGE = f"usage_ AS (SELECT rec_id, or_id, name, hf_id, usage_rank, context_length, {_nan('', *NUMS)} FROM usage_models)"
RATINGS = f"""lines_ AS (SELECT line_id, name, {_number('elo')} AS elo FROM arena_lines),
ratings AS (SELECT {_squash('name')} AS norm, arg_max(elo, line_id) AS elo FROM lines_ WHERE name <> '' AND elo <> 0 GROUP BY 1)"""
UNIFIED = f"""WITH {USAGE}, {RATINGS},
p AS (SELECT *, min(rec_id) OVER (PARTITION BY key) AS seq FROM (SELECT *, coalesce(nullif(hf_id, ''), or_id) AS key FROM usage_) WHERE key <> ''
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY rec_id DESC) = 1),
last_ AS (SELECT * FROM hub_models WHERE hf_id <> '' QUALIFY row_number() OVER (PARTITION BY hf_id ORDER BY rec_id DESC) = 1),
first_ AS (SELECT * FROM hub_models WHERE hf_id <> '' QUALIFY row_number() OVER (PARTITION BY hf_id ORDER BY rec_id) = 1),
both_ AS (
  SELECT p.key, coalesce(nullif(p.name, ''), p.or_id) AS name, p.name AS said, p.hf_id, p.or_id, h.downloads, h.likes, p.usage_rank, p.context_length, p.price_prompt, p.price_completion,
         p.intelligence_index, p.coding_index, p.agentic_index, p.arena_elo, CASE WHEN h.hf_id IS NULL THEN 'usage' ELSE 'usage,hub' END AS sources, 0 AS side, p.seq, {_squash('p.name')} AS norm
  FROM p LEFT JOIN last_ h ON nullif(p.hf_id, '') = h.hf_id
  UNION ALL
  SELECT hf_id, hf_id, hf_id, hf_id, NULL, downloads, likes, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'hub', 1, rec_id, {_squash("split_part(hf_id, '/', -1)")}
  FROM first_ WHERE hf_id NOT IN (SELECT key FROM p)
),
unified AS (
  SELECT key, both_.name, hf_id, or_id, downloads, likes, usage_rank, context_length, price_prompt, price_completion, intelligence_index, coding_index, agentic_index,
         coalesce(nullif(arena_elo, 0), r.elo) AS arena_elo, sources, side, seq, regexp_matches(words, '(?i){SIDELINED.replace("'", "''")}') AS noise, {_billions('words')} AS params_b, coalesce(hf_id, '') <> '' AS local
  FROM (SELECT *, coalesce(said, '') || ' ' || coalesce(hf_id, '') AS words FROM both_) both_ LEFT JOIN ratings r USING (norm)
)"""


def board(weights: dict[str, float] | None = None) -> str:
    w = {**MODEL_WEIGHTS, **(weights or {})}
    raw = {s.name: (f"log10({s.column} + 1.0)" if s.logarithmic else f"CAST({s.column} AS DOUBLE)") for s in MODEL_SIGNALS}
    ends = ", ".join(f"min({x}) AS lo_{n}, max({x}) AS hi_{n}" for n, x in raw.items())
    scaled = {n: f"({x} - lo_{n}) / (CASE WHEN hi_{n} = lo_{n} THEN 1.0 ELSE hi_{n} - lo_{n} END) * 100.0" for n, x in raw.items()}
    norms = ", ".join(f"{scaled[s.name] if s.higher_is_better else '100.0 - (' + scaled[s.name] + ')'} AS n_{s.name}" for s in MODEL_SIGNALS)
    used = [(n, x) for n, x in w.items() if n in raw and x > 0]
    total = " + ".join(f"(CASE WHEN n_{n} IS NULL THEN 0.0 ELSE n_{n} * CAST({x} AS DOUBLE) END)" for n, x in used)
    weight = " + ".join(f"(CASE WHEN n_{n} IS NULL THEN 0.0 ELSE CAST({x} AS DOUBLE) END)" for n, x in used)
    quality = " OR ".join(f"n_{s.name} IS NOT NULL" for s in MODEL_SIGNALS if s.quality and w[s.name] > 0) or "false"
    return f"""{UNIFIED},
ends AS (SELECT {ends} FROM unified),
normed AS (SELECT unified.*, {norms} FROM unified CROSS JOIN ends),
blended AS (SELECT *, {_r1(f"s * (CASE WHEN {quality} THEN 1.0 ELSE CAST({WITHOUT_QUALITY} AS DOUBLE) END)")} AS score FROM (SELECT *, (0.0 + {total}) / nullif(0.0 + {weight}, 0.0) AS s FROM normed)),
board AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, side, seq) AS INT) AS rank FROM blended)
"""


def _dollars(x: str) -> str:
    return f"'$' || printf('%.2f', {x} * 1e6)"


def _short(x: str) -> str:
    x = f"CAST({x} AS DOUBLE)"
    sizes = " ".join(f"WHEN {x} >= {s} THEN printf('%.1f', {x} / {s}) || '{m}'" for s, m in (("1e9", "B"), ("1e6", "M"), ("1e3", "K")))
    return f"CASE WHEN {x} IS NULL THEN '—' {sizes} WHEN {x} = floor({x}) THEN printf('%.0f', {x}) ELSE regexp_replace(printf('%.3f', {x}), '\\.?0+$', '') END"


def _fitted(m: Machine) -> str:
    size = f"params_b * CAST({BYTES[m.quant]} AS DOUBLE)"
    notes = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NOTES.items())
    b = f"CAST({m.budget} AS DOUBLE)"
    return f"""fitted AS (SELECT *, CASE fit {notes} END AS note FROM (SELECT *, CASE WHEN need_ <= {b} THEN 'fits' WHEN need_ <= {b} * CAST(1.12 AS DOUBLE) THEN 'tight' WHEN {size} <= CAST({m.ram} AS DOUBLE) THEN 'offload' ELSE 'toobig' END AS fit
  FROM (SELECT *, {size} * CAST(1.2 AS DOUBLE) AS need_ FROM board WHERE local AND params_b <> 0 AND NOT noise)))"""


EVENTS = r"""
told AS (
  SELECT c.board, c.s, coalesce(c.rank, 2147483647) AS place, c.key, c.name, c.rank, c.score, c.ts, o.key IS NULL AS fresh, o.rank AS orank, o.price AS oprice, c.price, c.noise,
         c.intelligence_index IS NOT NULL OR (c.usage_rank IS NOT NULL AND c.usage_rank <> 0) AS known, coalesce(c.score, 0.0) - coalesce(o.score, 0.0) AS gain
  FROM states c LEFT JOIN states o ON o.s = c.before AND o.key = c.key WHERE c.before IS NOT NULL
),
tops AS (SELECT s, min(key) AS was FROM states WHERE rank = 1 GROUP BY s),
every AS (
  SELECT c.board, c.s, 0 AS place, 0 AS pos, 'new_leader' AS type, c.key, c.name, c.rank, c.score, c.ts, '🔭 New #1 — ' || coalesce(c.name, 'None') || ' takes the top spot (score ' || coalesce(CAST(c.score AS VARCHAR), 'None') || ').' AS headline,
         NULL::INT AS rank_delta, NULL::DOUBLE AS score_delta, NULL::DOUBLE AS old_price, NULL::DOUBLE AS new_price
  FROM states c LEFT JOIN tops ON tops.s = c.before WHERE c.before IS NOT NULL AND c.rank = 1 AND tops.was IS DISTINCT FROM c.key
  UNION ALL
  SELECT board, s, place, 1, 'new_model', key, name, rank, score, ts, '🔭 New intelligence detected — ' || coalesce(name, 'None') || ' enters the index at #' || rank || ' (score ' || coalesce(CAST(score AS VARCHAR), 'None') || ').', NULL, NULL, NULL, NULL
  FROM told WHERE NOT coalesce(noise, false) AND fresh AND known AND rank <> 0 AND rank <= 150
  UNION ALL
  SELECT board, s, place, 2, 'big_climber', key, name, rank, score, ts, '📈 ' || coalesce(name, 'None') || ' is climbing — up ' || (orank - rank) || ' to #' || rank || ' (score ' || coalesce(CAST(score AS VARCHAR), 'None') || ').', orank - rank, CAST(printf('%.1f', gain) AS DOUBLE), NULL, NULL
  FROM told WHERE NOT coalesce(noise, false) AND NOT fresh AND rank <> 0 AND orank <> 0 AND (orank - rank >= 15 OR gain >= 2.5)
  UNION ALL
  SELECT board, s, place, 3, 'price_drop', key, name, rank, score, ts, '💸 ' || coalesce(name, 'None') || ' got cheaper — $' || printf('%.2f', oprice * 1e6) || ' → $' || printf('%.2f', price * 1e6) || ' /Mtok.', NULL, NULL, oprice, price
  FROM told WHERE NOT coalesce(noise, false) AND NOT fresh AND oprice <> 0 AND price <> 0 AND price < oprice * CAST(0.75 AS DOUBLE)
),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY board, s ORDER BY place, key, pos) AS INT) AS ord FROM every)
"""
BOARD_STATES = f"""WITH raw AS (SELECT row_id, snapshot_id AS s, board, ts, lower(trim(key, E' \\t\\r\\n')) AS key, name, rank, noise, usage_rank, ingested_at, coding_index AS coding, arena_elo AS arena, sources,
  {_nan('', 'score', 'intelligence_index')}, CASE WHEN isnan(price_completion) THEN NULL ELSE price_completion END AS price FROM snapshots WHERE snapshot_id IS NOT NULL),
kept AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY s, key ORDER BY ingested_at DESC NULLS LAST, row_id DESC) = 1),
line AS (SELECT s, lag(s) OVER (PARTITION BY board ORDER BY o, s) AS before FROM (SELECT s, min(board) AS board, min(ts) AS o FROM kept GROUP BY s)),
states AS (SELECT kept.*, line.before FROM kept JOIN line USING (s))"""
YEAR_STATES = f"""WITH sums AS (SELECT year(o_orderdate) AS y, o_custkey AS k, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n FROM orders GROUP BY 1, 2),
ends AS (SELECT y, min(total) AS lo, max(total) AS hi FROM sums GROUP BY y),
states AS (
  SELECT 'orders' AS board, CAST(y AS BIGINT) AS s, CASE WHEN y - 1 IN (SELECT y FROM ends) THEN y - 1 END AS before, CAST(y AS DOUBLE) AS ts, 'c/' || k AS key, 'Customer ' || k AS name,
         CAST(row_number() OVER (PARTITION BY y ORDER BY total DESC, k) AS INT) AS rank, {_r1('(total - lo) / (CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END) * 100.0')} AS score, NULL::DOUBLE AS intelligence_index, CAST(n AS INT) AS usage_rank,
         total / n / 1e9 AS price, k % 10 = 0 AS noise
  FROM sums JOIN ends USING (y)
)"""
TOLD = "SELECT board, CAST(s AS BIGINT) AS snapshot_id, ord, type, key, name, rank, score, headline, rank_delta, score_delta, old_price, new_price FROM numbered"
DIFF = "SELECT ord, type, key, name, rank, score, ts, headline, rank_delta, score_delta, old_price, new_price FROM numbered WHERE s = 1997"


def _norm(t: str, key: str, x: str, down: bool = False) -> str:
    v = f"({x} - (SELECT min({x}) FROM {t})) / (CASE WHEN (SELECT max({x}) = min({x}) FROM {t}) THEN 1.0 ELSE (SELECT max({x}) - min({x}) FROM {t}) END) * 100.0"
    return f"SELECT {key}, {_r1(f'100.0 - ({v})' if down else v)} AS norm FROM {t}"


LOG = "log AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS batch, event_id AS ord, epoch_us(ts) AS ts, event_type AS type FROM events)"
CAPPED = f"WITH {LOG}, capped AS (SELECT * FROM log ORDER BY batch DESC, ord LIMIT 500)"


def all_sql(custom: dict[str, float] | None) -> dict[str, str]:
    signals = [s.name for s in MODEL_SIGNALS]
    gpu, apple = preset("RTX 5080 / 4080 · 16GB"), preset("Apple M-series (unified)")
    fit_cols = f"key, params_b, {_r1('need_')} AS need, fit, note"
    yearly = f"{YEAR_STATES}, {EVENTS}"
    ev = "SELECT CAST(user_id AS VARCHAR) AS k, event_id, event_type, position FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS position FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id {}) = 1)"
    price = lambda c: f"(CASE WHEN {_number(c)} >= 0 THEN {_number(c)} END) AS {c}"
    out = {
        "unify_sources": f"{UNIFIED} SELECT * FROM unified",
        "weighted_leaderboard": f"{board()} SELECT rank, key, score FROM board",
        "leaderboard_custom_weights": f"{board(custom)} SELECT rank, key, score FROM board",
        "score_breakdown": f"{board()} " + " UNION ALL ".join(f"SELECT key, '{n}' AS signal, {_r1(f'n_{n}')} AS value FROM normed WHERE n_{n} IS NOT NULL" for n in signals),
        "minmax_normalise": _norm("supplier", "s_suppkey", "s_acctbal"),
        "log_minmax": _norm("part", "p_partkey", "log10(p_retailprice + 1.0)"),
        "inverted_minmax": _norm("customer", "c_custkey", "c_acctbal", True),
        "constant_column_norm": "SELECT s_suppkey, CAST(0.0 AS DOUBLE) AS norm FROM supplier",
        "dedupe_last_wins": ev.format("DESC"),
        "dedupe_first_wins": ev.format(""),
        "left_lookup_join": f"{UNIFIED} SELECT u.rec_id, u.hf_id, h.downloads, h.likes FROM usage_ u LEFT JOIN last_ h ON u.hf_id = h.hf_id",
        "anti_join_unmatched": f"{UNIFIED} SELECT hf_id, rec_id, downloads FROM first_ WHERE hf_id NOT IN (SELECT key FROM p)",
        "normalised_name_lookup": f"WITH {USAGE}, {RATINGS} SELECT rec_id, coalesce(nullif(arena_elo, 0), elo) AS arena_elo FROM usage_ LEFT JOIN ratings ON norm = {_squash('name')}",
        "noise_classifier": f"SELECT rec_id, regexp_matches(' ' || coalesce(hf_id, ''), '(?i){SIDELINED}') AS noise FROM hub_models",
        "param_parse": f"SELECT rec_id, {_billions('t')} AS params_b FROM (SELECT rec_id, ' ' || coalesce(hf_id, '') AS t FROM hub_models UNION ALL SELECT rec_id, coalesce(name, '') || ' ' || coalesce(hf_id, '') FROM usage_models)",
        "clean_price": f"SELECT load_id, line_no, {price('price_prompt')}, {price('price_completion')} FROM usage_loads",
        "safe_cast": f"SELECT line_id, {_number('elo')} AS elo FROM arena_lines",
        "json_extract": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
        "array_filter_max": "SELECT vec_id, list_max(list_filter(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda x: x <> 0)) AS best FROM embeddings",
        "ordinal_rank": "SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS ordinal FROM orders",
        "text_search_filter": "SELECT p_partkey, p_name FROM part WHERE contains(lower(coalesce(p_name, '')), 'la') OR contains(lower(coalesce(p_brand, '')), 'la')",
        "sorted_view_nulls": f"{board()} SELECT key, coding_index, CAST(row_number() OVER (ORDER BY coding_index NULLS FIRST, rank) AS INT) AS pos_up, CAST(row_number() OVER (ORDER BY coding_index DESC NULLS LAST, rank) AS INT) AS pos_down FROM board WHERE NOT noise",
        "podium_top3": f"""{board()}, top AS (SELECT * FROM board WHERE NOT noise AND score IS NOT NULL ORDER BY rank LIMIT 3)
SELECT CAST(row_number() OVER (ORDER BY rank) AS INT) AS place, key, name, score, {_r1("CASE WHEN score <> 0 THEN score / greatest(max(score) OVER (), 1.0) * 100 ELSE 0 END")} AS pct,
  coalesce(nullif(concat_ws(' · ', CASE WHEN usage_rank <> 0 THEN 'USAGE #' || usage_rank END, CASE WHEN intelligence_index <> 0 THEN 'INTL ' || intelligence_index END, CASE WHEN arena_elo <> 0 THEN 'ARENA ' || CAST(floor(arena_elo + 0.5) AS BIGINT) END), ''), '—') AS stats FROM top""",
        "row_texts": f"""{board()} SELECT key, lpad(CAST(rank AS VARCHAR), CAST(greatest(2, length(CAST(rank AS VARCHAR))) AS INT), '0') AS rank_text, coalesce(CAST(score AS VARCHAR), '—') AS score_text, {_short('downloads')} AS downloads_text,
  coalesce({_dollars('price_completion')}, '—') AS price_text, CASE WHEN floor(arena_elo + 0.5) <> 0 THEN CAST(CAST(floor(arena_elo + 0.5) AS BIGINT) AS VARCHAR) ELSE '—' END AS arena_text,
  CASE WHEN local THEN 'https://hub.example/' || hf_id ELSE 'https://usage.example/' || or_id END AS link,
  concat_ws(',', CASE WHEN contains(sources, 'hub') THEN 'HF' END, CASE WHEN contains(sources, 'usage') THEN 'OR' END, CASE WHEN intelligence_index <> 0 THEN 'AA' END) AS badges FROM board""",
        "hardware_fit": f"{board()}, {_fitted(Machine())} SELECT {fit_cols} FROM fitted",
        "fit_best_pick": f"{board()}, {_fitted(apple)} SELECT {fit_cols} FROM fitted WHERE fit IN ('fits', 'tight') ORDER BY coalesce(agentic_index, -1) DESC, coalesce(score, 0) DESC, rank LIMIT 1",
        "fit_near_miss": f"""{board()}, {_fitted(gpu)}, parts AS (SELECT *, 1 AS section, coalesce(coding_index, -1) AS a, coalesce(score, 0) AS b FROM fitted WHERE fit IN ('fits', 'tight')
  UNION ALL (SELECT *, 2, coalesce(score, 0), 0 FROM fitted WHERE fit NOT IN ('fits', 'tight') ORDER BY coalesce(score, 0) DESC, rank LIMIT 8))
SELECT {fit_cols}, section, CAST(row_number() OVER (ORDER BY section, a DESC, b DESC, rank) AS INT) AS pos FROM parts""",
        "humanise_numbers": f"""SELECT o_orderkey, {_short('(o_totalprice * 1000)')} AS short, {_short('o_orderkey')} AS short_key, {_dollars('(o_totalprice / 1e9)')} AS dollars,
  CASE WHEN o_orderkey < 60 THEN o_orderkey || 's' WHEN o_orderkey < 3600 THEN CAST(floor(o_orderkey / 60 + 0.5) AS BIGINT) || 'm' ELSE CAST(floor(o_orderkey / 3600 + 0.5) AS BIGINT) || 'h' END AS ago,
  lpad(CAST(o_orderkey % 200 AS VARCHAR), CAST(greatest(2, length(CAST(o_orderkey % 200 AS VARCHAR))) AS INT), '0') AS padded, CAST(floor(o_totalprice + 0.5) AS BIGINT) AS nearest, {_r1('o_totalprice / 7')} AS tenth FROM orders""",
        "snapshot_slim": f"{BOARD_STATES} SELECT key, name, rank, score, intelligence_index, CASE WHEN isnan(coding) THEN NULL ELSE coding END AS coding_index, usage_rank, CASE WHEN isnan(arena) THEN NULL ELSE arena END AS arena_elo, price AS price_completion, noise, CASE WHEN sources IS NULL THEN NULL ELSE '[' || array_to_string(list_transform(sources, lambda x: coalesce('\"' || x || '\"', 'null')), ',') || ']' END AS sources FROM kept",
        "snapshot_latest": f"{BOARD_STATES} SELECT board, s AS snapshot_id, key, rank, score FROM kept JOIN (SELECT board, max(ts) AS ts FROM kept GROUP BY board) USING (board, ts)",
        "snapshot_retention": "SELECT snapshot_id, CAST(count(*) AS BIGINT) AS rows FROM snapshots WHERE snapshot_id IN (SELECT DISTINCT snapshot_id FROM snapshots ORDER BY snapshot_id DESC LIMIT 300) GROUP BY snapshot_id",
        "snapshot_count": "SELECT CAST(count(DISTINCT snapshot_id) AS BIGINT) AS snapshots FROM snapshots",
        "diff_history": f"{BOARD_STATES}, {EVENTS} {TOLD}",
        "social_events": f"{BOARD_STATES}, {EVENTS} {TOLD} WHERE type IN ('new_leader', 'new_model')",
        "diff_all": f"{yearly} {DIFF}",
        "yearly_history": f"{yearly} {TOLD}",
        "streaming_sweep": f"{yearly} {TOLD}",
        "unchanged_check": f"""{YEAR_STATES}, pairs AS (SELECT 'same' AS pair, 1996 AS a, 1996 AS b UNION ALL SELECT 'next year', 1996, 1997)
SELECT pair, (SELECT count(*) FROM states WHERE s = a) > 0 AND (SELECT count(*) FROM (SELECT key, rank, score FROM states WHERE s = a) x FULL JOIN (SELECT key, rank, score FROM states WHERE s = b) y
  ON x.key = y.key AND x.rank = y.rank AND x.score IS NOT DISTINCT FROM y.score WHERE x.key IS NULL OR y.key IS NULL) = 0 AS unchanged FROM pairs""",
        "event_feed": f"{CAPPED} SELECT ord, type FROM capped WHERE ts > (SELECT max(ts) FROM log) - 172800000000 ORDER BY batch DESC, ord LIMIT 50",
        "event_log_append_cap": "SELECT batch, ord FROM (SELECT CAST(floor(dayofyear(ts) / 7) AS INT) AS batch, event_id AS ord FROM events) ORDER BY batch DESC, ord LIMIT 500",
        "csv_lookup_scan": f"WITH {RATINGS} SELECT norm, elo FROM ratings",
        "ttl_cache_roundtrip": """WITH h AS (SELECT count(*) AS rows, count(DISTINCT rec_id) AS ids FROM hub_models), u AS (SELECT count(*) AS rows, count(DISTINCT rec_id) AS ids FROM usage_models)
SELECT 'first' AS step, *, CAST(0 AS DOUBLE) AS age FROM h UNION ALL SELECT 'within', *, 3600 FROM h UNION ALL SELECT 'after', *, 0 FROM u UNION ALL SELECT 'forced', *, 0 FROM h UNION ALL SELECT 'forced again', *, 0 FROM u UNION ALL SELECT 'broken', *, 0 FROM h""",
        "json_sources_scan": "SELECT coalesce(downloads, 0) > 0 AS downloaded, CAST(count(*) AS BIGINT) AS n, CAST(sum(coalesce(likes, 0)) AS BIGINT) AS likes FROM hub_models GROUP BY 1",
    }
    return out | {f"diff_{k}": f"{yearly} {DIFF} AND type = '{k}'" for k in ("new_leader", "new_model", "big_climber", "price_drop")}
