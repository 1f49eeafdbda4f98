"""DuckDB statements that recompute the registered queries from the same tables."""

from __future__ import annotations

from turnledger.catalog.queries import AS_OF, REPORT_TZ, SINCE, UNTIL
from turnledger.schema import TOKEN_COLS, TURN_COLS
from turnledger.sources.price_list import PRICE_LIST

_PRICES = (
    "prices(prefix, r_in, r_out, r_cw, r_cr) AS (VALUES "
    + ", ".join(
        "('{}', {})".format(p, ", ".join(f"CAST({r} AS DECIMAL(12,6))" for r in rates))
        for p, rates in PRICE_LIST.items()
    )
    + ")"
)

_EV = """ev AS (
  SELECT event_id AS line_no, event_type AS tool, CAST(user_id AS VARCHAR) AS session_id,
    CASE WHEN k % 5 = 0 THEN 'claude-opus-5-20260101' WHEN k % 5 = 1 THEN 'claude-sonnet-4-5'
         WHEN k % 5 = 2 THEN 'gpt-5-codex' WHEN k % 5 = 3 THEN 'gpt-4o-mini-2024-07-18'
         WHEN k % 3 = 0 THEN 'house-model-1' ELSE 'o3-pro' END AS model,
    CAST(floor(epoch(ts)) AS BIGINT) AS ts,
    CAST(floor(value * 100) AS BIGINT) AS input_tokens,
    CAST(floor(value * 37) AS BIGINT) AS output_tokens,
    CAST(floor(value * 11) AS BIGINT) AS cache_write_tokens,
    CAST(floor(value * 900) AS BIGINT) AS cache_read_tokens,
    k AS reasoning_tokens,
    event_type IN ('click', 'view') AS is_cumulative,
    k % 7 = 0 AS is_sidechain,
    CASE WHEN k % 10 <> 0 THEN '/p/' || (k % 10) END AS project
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""

_LI = """li_all AS (
  SELECT l_orderkey || ':' || l_linenumber AS dedupe_key, l_returnflag AS tool,
    CAST(l_orderkey AS VARCHAR) AS session_id,
    CASE l_linenumber % 3 WHEN 0 THEN 'gpt-5-mini-2025' WHEN 1 THEN 'claude-haiku-4-5'
         ELSE 'gpt-4.1' END AS model,
    CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts,
    CAST(l_quantity AS BIGINT) AS input_tokens,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS output_tokens,
    CAST(round(l_discount * 100) AS BIGINT) AS cache_write_tokens,
    CAST(round(l_tax * 100) AS BIGINT) AS cache_read_tokens,
    CAST(l_linenumber AS BIGINT) AS reasoning_tokens,
    l_returnflag = 'A' AS is_cumulative, l_linestatus = 'F' AS is_sidechain,
    CAST(NULL AS VARCHAR) AS project,
    lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS source_file,
    l_partkey * 100 + l_linenumber AS line_no
  FROM lineitem
), li AS (
  SELECT * FROM li_all
  QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY source_file, line_no, ts) = 1
)"""


def _turns(source: str, order: str) -> str:
    deltas = ",\n    ".join(
        f"CASE WHEN is_cumulative THEN greatest({c} - lag({c}, 1, CAST(0 AS BIGINT)) OVER w, 0) "
        f"ELSE {c} END AS {c}"
        for c in TOKEN_COLS
    )
    return f"""turns AS (
  SELECT line_no, tool, session_id, model, ts, project, is_sidechain,
    {deltas}
  FROM {source}
  WINDOW w AS (PARTITION BY tool, session_id ORDER BY ts, {order})
)"""


_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in TOKEN_COLS)
_TOTAL = " + ".join(TOKEN_COLS)
_STRICT = "CASE WHEN bool_or(micros IS NULL) THEN NULL ELSE sum(micros) END"
_DAY = f"CAST(timezone('{REPORT_TZ}', to_timestamp(ts)) AS DATE)"
_UTC_DAY = "CAST(timezone('UTC', to_timestamp(ts)) AS DATE)"
_USD = "CAST({} AS DOUBLE) / 1e6"

_RATES = """rates AS (
  SELECT m.model, arg_max(p.prefix, length(p.prefix)) AS prefix
  FROM (SELECT DISTINCT model FROM {source}) m LEFT JOIN prices p ON starts_with(m.model, p.prefix)
  GROUP BY m.model
)"""

_MICROS = (
    "input_tokens * r_in + output_tokens * r_out + cache_write_tokens * r_cw "
    "+ cache_read_tokens * r_cr + reasoning_tokens * r_out"
)


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _costed(keys: str, extra: str = "", where: str = "") -> str:
    """Group turns by ``keys`` and model, then price each group."""
    return f"""grouped AS (
  SELECT {keys}, model, {_SUMS}{extra} FROM turns {where} GROUP BY ALL
), costed AS (
  SELECT g.*, r.prefix, {_MICROS} AS micros
  FROM grouped g LEFT JOIN rates r USING (model) LEFT JOIN prices p ON p.prefix = r.prefix
)"""


_EV_TURNS = (_EV, _turns("ev", "line_no"), _PRICES, _RATES.format(source="ev"))
_LI_TURNS = (_LI, _turns("li", "source_file, line_no"), _PRICES, _RATES.format(source="li"))


def _daily(day: str, where: str = "") -> str:
    return _costed(f"{day} AS d, tool", where=where) + f""", folded AS (
  SELECT d, tool, {_SUMS}, {_STRICT} AS micros FROM costed GROUP BY d, tool
)"""


_DAILY_ROWS = (
    f"SELECT CAST(d AS VARCHAR) AS date, tool, {', '.join(TOKEN_COLS)}, "
    f"{_TOTAL} AS total_tokens, {_USD.format('micros')} AS cost_usd FROM folded"
)
_RANGE = f"WHERE {_DAY} BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}'"

_SESSION_EXTRA = (
    ", min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS turns, "
    "count(*) FILTER (WHERE is_sidechain) AS sidechain_turns, max(project) AS project"
)


def _sessions(where: str = "") -> str:
    return _costed("tool, session_id", _SESSION_EXTRA, where) + f""", sess AS (
  SELECT session_id, tool, max(project) AS project, min(first_ts) AS first_ts,
    max(last_ts) AS last_ts, CAST(sum(turns) AS BIGINT) AS turns,
    CAST(sum(sidechain_turns) AS BIGINT) AS sidechain_turns,
    string_agg(DISTINCT model, ',' ORDER BY model) AS models, {_SUMS},
    {_STRICT} AS micros
  FROM costed GROUP BY tool, session_id
), report AS (
  SELECT * EXCLUDE (micros), {_TOTAL} AS total_tokens, {_USD.format('micros')} AS cost_usd FROM sess
)"""


_NEWEST = "ORDER BY last_ts DESC, tool, session_id LIMIT"
_TURN_LIST = ", ".join(("line_no", *TURN_COLS))
_BY_DAY = f"""days AS (
  SELECT CAST({_DAY} AS VARCHAR) AS date, {_SUMS} FROM turns GROUP BY ALL
)"""

_TURN_DELTAS = _with(_EV, _turns("ev", "line_no")) + f"SELECT {_TURN_LIST} FROM turns"

_BREAKDOWN = " UNION ALL ".join(
    f"SELECT tool, session_id, '{label}' AS component, {c} AS tokens, "
    f"CAST({c} AS DOUBLE) / CAST(total_tokens AS DOUBLE) AS token_share FROM report WHERE {c} > 0"
    for c, label in (
        ("cache_read_tokens", "cache read"),
        ("input_tokens", "input"),
        ("cache_write_tokens", "cache write"),
        ("output_tokens", "output"),
        ("reasoning_tokens", "reasoning"),
    )
)

ORACLES: dict[str, str] = {
    "turn_deltas": _TURN_DELTAS,
    "turn_deltas_one_window": _TURN_DELTAS,
    "turn_deltas_split_sessions": _TURN_DELTAS,
    "turn_deltas_range": _TURN_DELTAS
    + f" WHERE ts >= epoch(DATE '{SINCE}') - 86400 AND ts < epoch(DATE '{UNTIL}') + 172800",
    "delta_totals": _with(_LI, _turns("li", "source_file, line_no"))
    + f"SELECT tool, is_sidechain, count(*) AS turns, {_SUMS} FROM turns GROUP BY ALL",
    "price_match": _with(
        _EV,
        _LI,
        "both_models AS (SELECT model FROM ev UNION ALL SELECT model FROM li_all)",
        _PRICES,
        _RATES.format(source="both_models"),
    )
    + "SELECT r.model, r.prefix AS matched_prefix, CAST(r_in AS DOUBLE) AS input_rate, "
    "CAST(r_out AS DOUBLE) AS output_rate, CAST(r_cw AS DOUBLE) AS cache_write_rate, "
    "CAST(r_cr AS DOUBLE) AS cache_read_rate FROM rates r LEFT JOIN prices p USING (prefix)",
    "cost_strict_floor": _with(*_EV_TURNS, _costed("tool, project"))
    + f"SELECT tool, project, {_USD.format(_STRICT)} AS cost_strict_usd, "
    f"{_USD.format('coalesce(sum(micros), 0)')} AS cost_floor_usd, "
    "bool_or(micros IS NULL) AS has_unpriced FROM costed GROUP BY tool, project",
    "daily": _with(*_EV_TURNS, _daily(_DAY)) + _DAILY_ROWS,
    "daily_lines": _with(*_LI_TURNS, _daily(_UTC_DAY)) + _DAILY_ROWS,
    "daily_totals": _with(*_EV_TURNS, _daily(_DAY, _RANGE))
    + f"SELECT 'TOTAL' AS date, '' AS tool, "
    + ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in TOKEN_COLS)
    + f", CAST(coalesce(sum({_TOTAL}), 0) AS BIGINT) AS total_tokens, "
    f"{_USD.format(_STRICT)} AS cost_usd FROM folded",
    "daily_totals_all": _with(*_EV_TURNS, _daily(_DAY))
    + f"SELECT 'TOTAL' AS date, '' AS tool, "
    + ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in TOKEN_COLS)
    + f", CAST(coalesce(sum({_TOTAL}), 0) AS BIGINT) AS total_tokens, "
    f"{_USD.format(_STRICT)} AS cost_usd FROM folded",
    "unknown_models_all": _with(*_EV_TURNS, _daily(_DAY))
    + "SELECT DISTINCT model FROM costed WHERE prefix IS NULL",
    "price_file": """WITH listed AS (
  SELECT s_suppkey % 50 AS k, 'm-' || k AS prefix, max(s_suppkey) / 4 AS input_rate,
    CAST(min(s_suppkey) AS DOUBLE) AS output_rate,
    CASE WHEN k % 3 <> 0 THEN max(s_suppkey) / 8 END AS cache_write_rate,
    CAST(0.125 AS DOUBLE) AS cache_read_rate
  FROM supplier GROUP BY k
), models AS (SELECT c_custkey, 'm-' || c_custkey AS model FROM customer)
SELECT model, prefix AS matched_prefix, input_rate, output_rate, cache_write_rate, cache_read_rate
FROM models LEFT JOIN listed ON starts_with(model, prefix)
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY length(prefix) DESC) = 1""",
    "daily_filtered": _with(*_EV_TURNS, _daily(_DAY, _RANGE + " AND tool = 'click'")) + _DAILY_ROWS,
    "daily_recent": _with(
        *_EV_TURNS,
        _daily(
            _DAY,
            f"WHERE {_DAY} BETWEEN DATE '{AS_OF}' - INTERVAL 6 DAY AND DATE '{AS_OF}'",
        ),
    )
    + _DAILY_ROWS,
    "unknown_models": _with(*_EV_TURNS, _daily(_DAY, _RANGE))
    + "SELECT DISTINCT model FROM costed WHERE prefix IS NULL",
    "sessions": _with(*_EV_TURNS, _sessions()) + f"SELECT * FROM report {_NEWEST} 25",
    "sessions_of_tool": _with(*_EV_TURNS, _sessions("WHERE tool = 'view'"))
    + f"SELECT * FROM report {_NEWEST} 50",
    "sessions_all": _with(*_LI_TURNS, _sessions()) + "SELECT * FROM report",
    "session_unknown_models": _with(
        *_EV_TURNS, _sessions(), f"newest AS (SELECT * FROM report {_NEWEST} 25)"
    )
    + "SELECT DISTINCT c.model FROM costed c JOIN newest n USING (tool, session_id) "
    "WHERE c.prefix IS NULL",
    "session_breakdown": _with(*_EV_TURNS, _sessions()) + _BREAKDOWN,
    "by_tool": _with(*_EV_TURNS, _daily(_DAY))
    + f""", tools AS (
  SELECT tool, CAST(sum({_TOTAL}) AS BIGINT) AS total_tokens,
    CAST(sum(cache_read_tokens) AS BIGINT) AS cached, coalesce(sum(micros), 0) AS micros,
    bool_or(micros IS NULL) AS has_unpriced, count(*) AS active_days
  FROM folded GROUP BY tool)
SELECT tool, total_tokens,
  {_USD.format("CASE WHEN has_unpriced AND micros = 0 THEN NULL ELSE micros END")} AS cost_floor_usd,
  has_unpriced, CAST(cached AS DOUBLE) / nullif(CAST(total_tokens AS DOUBLE), 0) AS cache_share,
  active_days,
  CAST(total_tokens AS DOUBLE) / CAST(greatest(max(total_tokens) OVER (), 1) AS DOUBLE) AS bar
FROM tools""",
    "by_day": _with(_EV, _turns("ev", "line_no"), _BY_DAY) + "SELECT * FROM days",
    "cache_band": _with(_EV, _turns("ev", "line_no"), _BY_DAY)
    + """, last_days AS (
  SELECT date, cache_read_tokens AS cache, input_tokens + cache_write_tokens AS fresh,
    output_tokens + reasoning_tokens AS out_tokens FROM days ORDER BY date DESC LIMIT 21
), band AS (
  SELECT *, cache + fresh + out_tokens AS total,
    coalesce(CAST(sum(cache) OVER () AS DOUBLE)
      / nullif(CAST(sum(cache + fresh + out_tokens) OVER () AS DOUBLE), 0), 0) AS overall_cached
  FROM last_days)
SELECT date, total, CAST(cache AS DOUBLE) / total AS cache_share,
  CAST(fresh AS DOUBLE) / total AS fresh_share, CAST(out_tokens AS DOUBLE) / total AS out_share,
  overall_cached FROM band WHERE total > 0""",
    "trend": _with(_EV, _turns("ev", "line_no"), _BY_DAY)
    + f""", totals AS (
  SELECT *, {_TOTAL} AS total, greatest(max({_TOTAL}) OVER (), 1) AS busiest FROM days)
SELECT date, """
    + ", ".join(
        f"CAST({c} AS DOUBLE) / CAST(busiest AS DOUBLE) AS {c.replace('_tokens', '_height')}"
        for c in TOKEN_COLS
    )
    + ", CAST(floor(coalesce(CAST(cache_read_tokens AS DOUBLE) / nullif(CAST(total AS DOUBLE), 0), 0)"
    " * 100 + 0.5) AS BIGINT) AS cache_percent FROM totals",
    "models_per_tool": _with(_EV) + "SELECT DISTINCT tool, model FROM ev",
    "distinct_models": _with(_EV) + "SELECT DISTINCT model FROM ev",
    "project_top": _with(_EV, _turns("ev", "line_no"))
    + "SELECT project, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, "
    "count(*) AS turns FROM turns WHERE project IS NOT NULL GROUP BY project "
    "ORDER BY tokens DESC, project LIMIT 10",
    "project_labels": _with(_EV)
    + "SELECT project, count(*) AS turns, "
    "CASE WHEN project IS NOT NULL THEN string_split(project, '/')[-1] END AS label "
    "FROM ev GROUP BY project",
    "cache_ratio": _with(_EV, _turns("ev", "line_no"))
    + f"""SELECT CAST({_DAY} AS VARCHAR) AS day,
  round(CAST(sum(cache_read_tokens) AS DOUBLE)
    / nullif(CAST(sum(cache_read_tokens + input_tokens) AS DOUBLE), 0), 4) AS cache_ratio,
  CAST(sum(cache_read_tokens) AS BIGINT) AS cached, CAST(sum(input_tokens) AS BIGINT) AS fresh
FROM turns GROUP BY 1 ORDER BY 1 DESC LIMIT 21""",
    "model_week": _with(_LI, _turns("li", "source_file, line_no"))
    + f"""SELECT strftime({_DAY}, '%Y-W%W') AS week, model,
  CAST(sum(input_tokens + output_tokens + reasoning_tokens) AS BIGINT) AS tokens
FROM turns GROUP BY 1, 2""",
    "busiest": _with(_EV, _turns("ev", "line_no"))
    + "SELECT session_id, tool, count(*) AS turns, CAST(sum(output_tokens) AS BIGINT) AS output "
    "FROM turns GROUP BY tool, session_id ORDER BY output DESC, tool, session_id LIMIT 15",
    "sidechain_split": _with(_EV, _turns("ev", "line_no"))
    + "SELECT is_sidechain, count(*) AS turns, CAST(sum(output_tokens) AS BIGINT) AS output "
    "FROM turns GROUP BY is_sidechain",
    "output_by_tool": _with(_EV, _turns("ev", "line_no"))
    + "SELECT tool, CAST(sum(output_tokens) AS BIGINT) AS output FROM turns GROUP BY tool",
    "local_days": _with(_LI)
    + f"""SELECT CAST(CAST(timezone('{REPORT_TZ}', to_timestamp(ts + line_no % 86400)) AS DATE)
  AS VARCHAR) AS day, count(*) AS turns FROM li_all GROUP BY 1""",
    "dedupe_first_wins": _with(_LI)
    + "SELECT dedupe_key, tool, session_id, ts, source_file, line_no, "
    + ", ".join(TOKEN_COLS)
    + " FROM li",
    "dedupe_texts": "SELECT md5(text) AS dedupe_key, doc_id, lang, n_chars FROM documents "
    "QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1",
}
