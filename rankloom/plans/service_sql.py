"""SQL counterparts of the service's queries, for DuckDB."""

from __future__ import annotations

from rankloom.operators.fit import Machine
from rankloom.plans.model_sql import EVENTS, NUMS, YEAR_STATES, _fitted, _nan, _number, _r1, board


def all_sql(custom: dict[str, float] | None) -> dict[str, str]:
    tags = """'[' || array_to_string(list_transform(coalesce(tags, []), lambda x: coalesce('"' || x || '"', 'null')), ',') || ']' AS tags"""
    top = f"SELECT nullif(hf_id, '') AS hf_id, coalesce(downloads, 0) AS downloads, coalesce(likes, 0) AS likes, created_at, {tags} FROM hub_models ORDER BY 2 DESC, 1 NULLS FIRST, 3 DESC, 4 NULLS FIRST LIMIT 300"
    price = lambda c: f"(CASE WHEN {_number(c)} >= 0 THEN {_number(c)} END) AS {c}"
    yearly = f"{YEAR_STATES}, {EVENTS}"
    kept = f"{yearly}, kept AS (SELECT * FROM numbered ORDER BY s DESC, ord LIMIT 500)"
    sliders = [("intelligence", "INTELLIGENCE", 30), ("coding", "CODING", 50), ("agentic", "AGENTIC", 10), ("arena", "ARENA ELO", 10), ("usage", "REAL USAGE", 20), ("downloads", "DOWNLOADS", 5), ("likes", "LIKES", 5), ("price", "CHEAP PRICE", 0)]
    machines = [
        ("Custom", "NULL", "false", 24), ("RTX 5090 · 32GB", 32, "false", 32), ("RTX 4090 / 3090 · 24GB", 24, "false", 24), ("RTX 5080 / 4080 · 16GB", 16, "false", 16), ("RTX 4070 Ti / 3060 · 12GB", 12, "false", 12),
        ("RTX 4060 / 3050 · 8GB", 8, "false", 8), ("Apple M-series (unified)", 0, "true", 24), ("A100 · 40GB", 40, "false", 40), ("A100 / H100 · 80GB", 80, "false", 80), ("CPU only", 0, "false", 0),
    ]
    values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) and x not in ("NULL", "true", "false") else str(x) for x in r) + ")" for r in rows)
    blend = "SCORE = WEIGHTED BLEND OF INTELLIGENCE · CODING · AGENTIC · ARENA · USAGE · DOWNLOADS · LIKES · PRICE"
    head = "CAST(count(*) OVER () AS BIGINT) AS count, CAST({coding} AS DOUBLE) AS w_coding, CAST(5 AS DOUBLE) AS w_likes, CAST(12 AS BIGINT) AS hub_age, CAST(NULL AS BIGINT) AS arena_age"
    linked = "contains(key, '/') AND coalesce(name, '') <> '' AND instr(headline, name) > 0"
    return {
        "hub_top300": top,
        "web_source_scan": top,
        "usage_list_scan": f"""SELECT load_id, or_id, name, nullif(hf_id, '') AS hf_id, CAST(row_number() OVER (PARTITION BY load_id ORDER BY line_no) AS INT) AS usage_rank, context_length, {price('price_prompt')}, {price('price_completion')},
  {_nan('', *NUMS[2:5])}, greatest(CASE WHEN isnan(arena_elo) OR arena_elo = 0 THEN NULL ELSE arena_elo END, CASE WHEN isnan(arena_elo) OR arena_elo = 1 THEN NULL ELSE arena_elo - 1 END) AS arena_elo FROM usage_loads""",
        "models_answer": f"{board(custom)} SELECT rank, key, name, score, or_id, downloads, price_completion, noise, params_b, local, {_r1('n_coding')} AS coding, {head.format(coding=(custom or {}).get('coding'))} FROM board",
        "news_answer": f"{kept} SELECT CAST(row_number() OVER (ORDER BY s DESC, ord) - 1 AS INT) AS pos, ord, type, key, rank, score, ts, headline, 7 AS snapshots, 21600 AS poll_interval FROM kept WHERE ts > 1996 ORDER BY s DESC, ord LIMIT 50",
        "replayed_log": f"{kept} SELECT CAST(s AS INT) AS batch, CAST(count(*) AS BIGINT) AS events, max(ord) AS last FROM kept GROUP BY s",
        "stored_states": f"{YEAR_STATES} SELECT key, rank, score, usage_rank, price AS price_completion, noise, 5 AS snapshots FROM states WHERE s = (SELECT max(s) FROM states)",
        "streaming_retry": f"{yearly} SELECT board, CAST(s AS BIGINT) AS snapshot_id, ord, type, key, name, rank, score, headline, rank_delta, score_delta, old_price, new_price FROM numbered",
        "delivered_events": f"""{yearly} SELECT 'log' AS sent_to, CAST(row_number() OVER (ORDER BY ord) AS INT) AS pos, headline, '' AS type FROM numbered WHERE s = 1997
UNION ALL SELECT 'channel', CAST(row_number() OVER (ORDER BY ord) AS INT), headline, type FROM numbered WHERE s = 1997 AND type IN ('new_leader', 'new_model')""",
        "scored_view": f"{board()}, shown AS (SELECT * FROM board WHERE NOT noise AND score IS NOT NULL) SELECT key, downloads, rank, {_r1('CASE WHEN score <> 0 THEN score / greatest(max(score) OVER (), 1.0) * 100 ELSE 0 END')} AS pct, CAST(row_number() OVER (ORDER BY downloads DESC NULLS LAST, rank) AS INT) AS pos FROM shown",
        "weight_sliders": f"SELECT signal, label, CAST(shown AS DOUBLE) AS shown FROM (VALUES {values(sliders)}) t(signal, label, shown)",
        "machine_presets": f"""SELECT label, upper(q) AS quant, CAST(budget AS DOUBLE) AS budget, CAST(floor(budget / (b * 1.2) + 0.5) AS BIGINT) AS largest, CAST(vram AS DOUBLE) AS vram, unified
FROM (VALUES {values(machines)}) m(label, vram, unified, budget), (VALUES ('q4', 0.55), ('q8', 1.0), ('fp16', 2.0)) f(q, b)""",
        "feed_lines": f"""{yearly} SELECT ord, CASE type WHEN 'new_leader' THEN 'NEW #1' WHEN 'new_model' THEN 'NEW MODEL' WHEN 'big_climber' THEN 'CLIMBER' WHEN 'price_drop' THEN 'PRICE DROP' END AS label, CASE WHEN contains(key, '/') THEN 'https://hub.example/' || key END AS link,
  CASE WHEN {linked} THEN substr(headline, 1, CAST(instr(headline, name) - 1 AS BIGINT)) ELSE headline END AS before, CASE WHEN {linked} THEN name ELSE '' END AS linked, CASE WHEN {linked} THEN substr(headline, CAST(instr(headline, name) + length(name) AS BIGINT)) ELSE '' END AS after, '1h' AS age
FROM numbered WHERE s = 1997""",
        "status_texts": f"""{board()}, {_fitted(Machine())}, best AS (SELECT * FROM fitted WHERE fit IN ('fits', 'tight') ORDER BY coalesce(coding_index, -1) DESC, coalesce(score, 0) DESC, rank LIMIT 1)
SELECT 'freshness' AS name, 'HUB 12s · USAGE 3m · ARENA —' AS text
UNION ALL SELECT 'indexed', count(*) || ' MODELS INDEXED · {blend}' FROM board
UNION ALL SELECT 'shown', (count(*) FILTER (WHERE NOT noise AND (contains(lower(coalesce(name, '')), 'chat') OR contains(lower(coalesce(hf_id, '')), 'chat')))) || ' / ' || count(*) || ' MODELS SHOWN · {blend}' FROM board
UNION ALL SELECT 'fits', (count(*) FILTER (WHERE fit IN ('fits', 'tight'))) || ' MODELS FIT · ' || count(*) || ' OPEN-WEIGHT MODELS WITH KNOWN SIZE · EST. VRAM = PARAMS × 0.55B × 1.2 OVERHEAD' FROM fitted
UNION ALL SELECT 'best', 'BEST PICK FOR 24GB VRAM @ Q4: ' || name || ' · ' || params_b || 'B params · ~' || printf('%.1f', need_) || 'GB to load · score ' || coalesce(CAST(score AS VARCHAR), '—') FROM best
UNION ALL SELECT 'nothing', 'Nothing fits 0GB at Q4. Try a smaller quant, or a model under ~0B params.'
UNION ALL SELECT 'steady', 'No changes detected since the last sweep — the index is steady.'
UNION ALL SELECT 'first', 'Calibrating — rankloom takes its first reading on the next sweep.'
UNION ALL SELECT 'error', '{{"error": "the source is down", "models": []}}'""",
    }
