"""DuckDB statements for the ingestion queries, straight from the sample tables."""

from __future__ import annotations

from turnledger.catalog.ingest_queries import SCANNED_AT
from turnledger.catalog.oracles import ORACLES, _EV, _PRICES, _RATES, _turns, _with
from turnledger.schema import TOKEN_COLS, TURN_COLS
from turnledger.sources.price_list import PRICE_LIST_UPDATED

_A = """a_lines AS (
  SELECT *, CASE WHEN k % 31 = 0 THEN 'malformed' WHEN k % 29 = 0 OR k % 41 = 0 THEN 'ignored'
            ELSE 'event' END AS outcome
  FROM (
    SELECT e.*, c.copy FROM (
      SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        CAST(floor(value * 100) AS BIGINT) AS tokens FROM events) e
    JOIN (VALUES (0), (1)) c(copy) ON c.copy = 0 OR e.k % 5 = 0)
), a AS (
  SELECT copy, 'claude_code' AS tool,
    'cc:msg-' || event_id || CASE WHEN k % 13 <> 0 THEN ':req-' || event_id ELSE '' END AS dedupe_key,
    CASE WHEN copy = 1 THEN 'resumed-' ELSE '' END || user_id AS session_id,
    CASE WHEN k % 23 = 0 THEN 'unknown'
         WHEN k % 5 = 0 THEN 'claude-opus-5-20260101' WHEN k % 5 = 1 THEN 'claude-sonnet-4-5'
         WHEN k % 5 = 2 THEN 'gpt-5-codex' WHEN k % 5 = 3 THEN 'gpt-4o-mini-2024-07-18'
         WHEN k % 3 = 0 THEN 'house-model-1' ELSE 'o3-pro' END AS model,
    CAST(floor(epoch(ts)) AS BIGINT) AS ts, k % 7 = 0 AS is_sidechain,
    CASE WHEN k % 10 <> 0 THEN '/p/' || (k % 10) ELSE '/work/logs' END AS project,
    CASE WHEN k % 11 IN (0, 1) THEN 0 ELSE tokens END AS input_tokens,
    CASE WHEN k % 9 <> 0 THEN k * 3 ELSE 0 END AS output_tokens,
    k + 1 AS cache_write_tokens,
    CASE WHEN k % 6 <> 0 THEN tokens * 9 ELSE 0 END AS cache_read_tokens,
    CAST(0 AS BIGINT) AS reasoning_tokens
  FROM a_lines WHERE outcome = 'event'
)"""

_B = """b_lines AS (
  SELECT *, CAST(sum(length(text)) OVER w AS BIGINT) AS heard,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) OVER w AS BIGINT) AS said,
    count(*) OVER w AS thought,
    last_value(CASE WHEN role = 'user' THEN CASE length(text) % 3 WHEN 0 THEN 'gpt-5-codex'
      WHEN 1 THEN 'gpt-5-mini-2025' ELSE 'house-model-1' END END IGNORE NULLS) OVER w AS carried,
    CASE WHEN role = 'user' THEN 'model' WHEN role = 'system' THEN 'ignored'
         WHEN (conv_id + turn) % 7 = 0 THEN 'malformed' ELSE 'event' END AS outcome
  FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
), b AS (
  SELECT 'codex' AS tool, turn AS line_no, 'conv-' || conv_id AS session_id,
    'codex:conv-' || conv_id || ':'
      || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS turn_key,
    coalesce(carried, 'unknown') AS model, 1704067200 + conv_id * 1000 + turn AS ts,
    '/w/' || (conv_id % 4) AS project, false AS is_sidechain, true AS is_cumulative,
    heard AS input_tokens, said AS output_tokens, CAST(0 AS BIGINT) AS cache_write_tokens,
    heard // 3 AS cache_read_tokens, thought AS reasoning_tokens
  FROM b_lines WHERE outcome = 'event'
)"""

_C = """c_lines AS (
  SELECT *, CASE WHEN doc_id % 25 = 7 THEN 'malformed' WHEN doc_id % 10 = 0 THEN 'ignored'
            ELSE 'event' END AS outcome FROM documents
), c AS (
  SELECT 'opencode' AS tool,
    CASE WHEN doc_id % 4 <> 0 THEN 'oc:doc-' || doc_id ELSE 'oc:' END AS dedupe_key,
    lang || '-' || source AS session_id,
    CASE doc_id % 3 WHEN 0 THEN 'gpt-5-mini' WHEN 1 THEN 'gpt-4o' ELSE 'unknown' END AS model,
    1700000000 + doc_id * 60 AS ts, CAST(NULL AS VARCHAR) AS project, n_chars AS input_tokens,
    doc_id % 100 AS output_tokens,
    CASE WHEN doc_id % 9 <> 0 THEN doc_id % 13 ELSE 0 END AS cache_write_tokens,
    CASE WHEN doc_id % 9 <> 0 THEN doc_id * 2 ELSE 0 END AS cache_read_tokens,
    CASE WHEN doc_id % 8 = 0 THEN 0 ELSE doc_id % 7 END AS reasoning_tokens
  FROM c_lines WHERE outcome = 'event'
)"""

_TOKENS = ", ".join(TOKEN_COLS)
_A_ROW = f"dedupe_key, session_id, model, ts, is_sidechain, project, {_TOKENS}"
_TURN_LIST = ", ".join(TURN_COLS)
_B_TURNS = _turns("b", "line_no").replace("turns AS", "b_turns AS", 1)
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in TOKEN_COLS)

_OUTCOMES = """outcomes AS (
  SELECT 'claude_code' AS tool, outcome FROM a_lines
  UNION ALL SELECT 'codex', outcome FROM b_lines
  UNION ALL SELECT 'codex', 'session' FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT 'opencode', outcome FROM c_lines
)"""

_STORED = f"""stored AS (
  SELECT tool, session_id, model, {_TOKENS} FROM a WHERE copy = 0
  UNION ALL SELECT tool, session_id, model, {_TOKENS} FROM b_turns
  UNION ALL SELECT tool, session_id, model, {_TOKENS} FROM c
)"""

_ALL = (_A, _B, _B_TURNS, _C)

# Running totals as stored from whole logs, and from what a rotated log still holds.
_SEQUENCED = """sequenced AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sequence,
    turn + CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS line_no
  FROM b_lines WHERE outcome = 'event'
)"""
_ROTATED = """left_lines AS (
  SELECT *, last_value(CASE WHEN role = 'user' THEN CASE length(text) % 3 WHEN 0 THEN 'gpt-5-codex'
      WHEN 1 THEN 'gpt-5-mini-2025' ELSE 'house-model-1' END END IGNORE NULLS)
      OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS left_carried,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1
      + CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS left_line
  FROM b_lines WHERE turn >= 2 + conv_id % 2
), rotated AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS left_sequence
  FROM left_lines WHERE outcome = 'event'
)"""


def _totals_row(session: str, sequence: str, model: str, project: str, line: str, batch: str) -> str:
    return f"""SELECT {session} AS session_id, {sequence} AS sequence, coalesce({model}, 'unknown') AS model,
  1704067200 + conv_id * 1000 + turn AS ts, {project} AS project, CAST({line} AS BIGINT) AS line_no,
  CAST({batch} AS BIGINT) AS ingest_batch, heard AS input_tokens, said AS output_tokens,
  CAST(0 AS BIGINT) AS cache_write_tokens, heard // 3 AS cache_read_tokens, thought AS reasoning_tokens"""


_CONV, _PLACE = "'conv-' || conv_id", "'/w/' || (conv_id % 4)"
_UNNAMED = "turn < 3 + conv_id % 3 AND conv_id % 2 = 1"

_ADHOC = (
    _with(_EV, _turns("ev", "line_no"))
    + """SELECT tool, session_id, strftime(d, '%Y-W%W') AS week, CAST(d AS VARCHAR) AS day,
  CAST(sum(output_tokens) AS BIGINT) AS output
FROM (SELECT *, CAST(timezone('America/New_York', to_timestamp(ts)) AS DATE) AS d FROM turns)
GROUP BY tool, session_id, d"""
)

INGEST_ORACLES: dict[str, str] = {
    "parse_a": _with(_A) + f"SELECT {_A_ROW} FROM a",
    "parse_b_context": _with(_B)
    + f"SELECT turn_key, session_id, model, ts, project, {_TOKENS} FROM b",
    "parse_b_turns": _with(_B, _B_TURNS) + f"SELECT {_TURN_LIST} FROM b_turns",
    "parse_c": _with(_C) + f"SELECT dedupe_key, session_id, model, ts, project, {_TOKENS} FROM c",
    "parse_damaged": """WITH great AS (
  SELECT CAST(ts AS DATE) AS d, event_id % 4 = 2 AS damaged, CAST(event_id AS HUGEINT) AS said,
    CAST(CASE event_id % 4 WHEN 0 THEN 10000000000000 + event_id WHEN 1 THEN 9007199254740992
      WHEN 3 THEN event_id END AS HUGEINT) AS heard
  FROM events
), days AS (
  SELECT CAST(d AS VARCHAR) AS date, 'claude_code' AS tool, sum(heard) AS heard, sum(said) AS said
  FROM great WHERE NOT damaged GROUP BY d
  UNION ALL SELECT 'TOTAL', '', sum(heard), sum(said) FROM great WHERE NOT damaged
  UNION ALL SELECT 'malformed', 'claude_code', count(*), 0 FROM great WHERE damaged
)
SELECT date, tool, CAST(least(heard, 9223372036854775807) AS BIGINT) AS input_tokens,
  CAST(said AS BIGINT) AS output_tokens, CAST(least(heard + said, 9223372036854775807) AS BIGINT) AS total_tokens
FROM days""",
    "malformed_counts": _with(_A, _B, _C, _OUTCOMES)
    + "SELECT tool, outcome, count(*) AS n_lines FROM outcomes GROUP BY tool, outcome",
    "line_offsets": _with(_A, _B, _C, _OUTCOMES)
    + "SELECT tool, count(*) AS n_lines, CAST(0 AS BIGINT) AS files_with_gaps "
    "FROM outcomes GROUP BY tool",
    "sync_audit": _with(_A, _B, _C, _OUTCOMES)
    + """SELECT tool, true AS detected,
  count(*) FILTER (WHERE outcome = 'event')
    - CASE WHEN tool = 'claude_code' THEN (SELECT count(*) FROM a WHERE copy = 1) ELSE 0 END
    AS new_events,
  CASE WHEN tool = 'claude_code' THEN (SELECT count(*) FROM a WHERE copy = 1) ELSE 0 END
    AS duplicates_ignored,
  count(*) FILTER (WHERE outcome = 'malformed') AS malformed_lines,
  CAST(0 AS BIGINT) AS files_failed
FROM outcomes GROUP BY tool""",
    "append_idempotent": _with(*_ALL, _STORED, _OUTCOMES)
    + """SELECT tool, count(*) AS stored, count(*) AS keys, CAST(0 AS BIGINT) AS added,
  any_value(malformed) AS malformed_lines, CAST(0 AS BIGINT) AS files_skipped,
  any_value(malformed) AS quarantined
FROM stored JOIN (SELECT tool, count(*) FILTER (WHERE outcome = 'malformed') AS malformed
  FROM outcomes GROUP BY tool) USING (tool) GROUP BY tool""",
    "sync_skipped": _with(*_ALL, _STORED)
    + """SELECT tool, true AS all_skipped, CAST(0 AS BIGINT) AS files_scanned,
  CAST(0 AS BIGINT) AS new_events, CAST(0 AS BIGINT) AS duplicates_ignored,
  CAST(0 AS BIGINT) AS malformed_lines
FROM stored GROUP BY tool""",
    "sync_grown": _with(_B, _SEQUENCED)
    + _totals_row(
        f"CASE WHEN {_UNNAMED} THEN 'stem' ELSE {_CONV} END", "sequence", "carried",
        f"CASE WHEN {_UNNAMED} THEN NULL ELSE {_PLACE} END", "line_no",
        "CASE WHEN turn < 3 + conv_id % 3 THEN 0 ELSE 1 END",
    )
    + " FROM sequenced",
    "sync_rotated": _with(_B, _SEQUENCED, _ROTATED)
    + _totals_row(_CONV, "sequence", "carried", _PLACE, "line_no", "0")
    + " FROM sequenced UNION ALL "
    + _totals_row(_CONV, "left_sequence", "left_carried", _PLACE, "left_line", "1")
    + " FROM rotated JOIN (SELECT conv_id, turn, sequence FROM sequenced) USING (conv_id, turn)"
    + " WHERE sequence <> left_sequence",
    "state_after": _with(_B)
    + f"""SELECT conv_id, true AS complete, CAST({SCANNED_AT + 60} AS BIGINT) AS scanned_at,
  count(*) + 1 AS n_lines, count(*) FILTER (WHERE outcome = 'event') AS n_events,
  arg_max(carried, turn) AS last_model, {_CONV} AS session_id, {_PLACE} AS project
FROM b_lines GROUP BY conv_id""",
    "ledger_sessions": _with(*_ALL, _STORED)
    + f"SELECT tool, session_id, count(*) AS turns, {_SUMS} FROM stored GROUP BY tool, session_id",
    "ledger_turns_range": ORACLES["turn_deltas_range"],
    "coverage_report": _with(*_ALL, _STORED, _PRICES, _RATES.format(source="stored"))
    + """SELECT tool, true AS detected, CAST(1 AS BIGINT) AS n_roots, true AS all_scanned, string_agg(DISTINCT model, ',' ORDER BY model) AS models,
  coalesce(string_agg(DISTINCT CASE WHEN prefix IS NULL THEN model END, ',' ORDER BY
    CASE WHEN prefix IS NULL THEN model END), '') AS unknown_models
FROM stored JOIN rates USING (model) GROUP BY tool""",
    "coverage_unpriced": _with(_EV, _PRICES, _RATES.format(source="ev"))
    + "SELECT model FROM rates WHERE prefix IS NULL",
    "meta": _with(*_ALL, _STORED)
    + f"SELECT count(*) AS events, CAST({SCANNED_AT} AS BIGINT) AS last_sync_at, "
    f"'{PRICE_LIST_UPDATED}' AS pricing_updated FROM stored",
    "incremental_status": """WITH manifest AS (
  SELECT l_orderkey AS key, CAST(l_orderkey AS VARCHAR) AS source_file,
    CAST(sum(l_quantity) AS BIGINT) AS size, epoch_ms(max(l_shipdate)) AS mtime_ms
  FROM lineitem GROUP BY l_orderkey
), state AS (
  SELECT key,
    size + CASE key % 5 WHEN 1 THEN 9 WHEN 2 THEN -9 ELSE 0 END AS old_size,
    mtime_ms + CASE WHEN key % 3 = 1 THEN 1000 ELSE 0 END AS old_mtime,
    size + CASE WHEN key % 4 = 1 THEN 50 ELSE -3 END AS old_offset
  FROM manifest JOIN orders ON o_orderkey = key WHERE key % 7 <> 0
)
SELECT source_file,
  CASE WHEN old_size = size AND old_mtime = mtime_ms THEN 'skipped' ELSE 'scanned' END AS status,
  CASE WHEN old_size IS NULL OR size < old_size OR mtime_ms < old_mtime THEN 0
       WHEN old_offset > size THEN 0 ELSE old_offset END AS start_offset
FROM manifest LEFT JOIN state USING (key)""",
    "adhoc_capped": _ADHOC + " ORDER BY output DESC, tool, session_id, day LIMIT 1000",
    "adhoc_all": _ADHOC,
    "adhoc_truncated": "SELECT least(count(*), 1000) AS returned, count(*) > 1000 AS truncated, "
    f"count(*) AS total_rows FROM ({_ADHOC})",
    "stream_ingest_logs": _with(_A) + f"SELECT {_A_ROW} FROM a WHERE copy = 0",
    "stream_replays": _with(_A)
    + f"SELECT dedupe_key, model, ts, is_sidechain, project, {_TOKENS} FROM a WHERE copy = 0",
    "stream_deltas": _with(_EV, _turns("ev", "line_no"))
    + f"SELECT line_no, {_TURN_LIST} FROM turns",
}
