"""Column names and stored schemas shared by every job."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
UNKNOWN_MODEL = "unknown"
# ----------------------------------------------------------------------------

TOKEN_COLS = (
    "input_tokens",
    "output_tokens",
    "cache_write_tokens",
    "cache_read_tokens",
    "reasoning_tokens",
)

# Insertion order of the ledger. It stands in for a surrogate row id wherever two
# rows of a session carry the same timestamp.
ORDER_COLS = ("ingest_batch", "tool_rank", "source_file", "line_no")

SESSION_KEY = ("tool", "session_id")

_USAGE_FIELDS = [
    T.StructField("dedupe_key", T.StringType()),
    T.StructField("tool", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("ts", T.LongType()),
    *[T.StructField(c, T.LongType()) for c in TOKEN_COLS],
    T.StructField("is_cumulative", T.BooleanType()),
    T.StructField("is_sidechain", T.BooleanType()),
    T.StructField("project", T.StringType()),
    T.StructField("source_file", T.StringType()),
]

USAGE_COLS = tuple(f.name for f in _USAGE_FIELDS)

USAGE_EVENTS = T.StructType(
    _USAGE_FIELDS
    + [
        T.StructField("ingest_batch", T.LongType()),
        T.StructField("tool_rank", T.IntegerType()),
        T.StructField("line_no", T.LongType()),
    ]
)

# The eleven columns of the per-turn view, the order tuple standing in for the id.
TURN_COLS = (
    "tool",
    "session_id",
    "model",
    "ts",
    "project",
    "is_sidechain",
    *TOKEN_COLS,
)

SCAN_STATE = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime_ms", T.LongType()),
        T.StructField("byte_offset", T.LongType()),
        T.StructField("scanned_at", T.LongType()),
    ]
)

# What later lines of a file need to know of the lines before its stored offset.
FILE_CONTEXT = T.StructType(
    [
        T.StructField("n_lines", T.LongType()),
        T.StructField("n_events", T.LongType()),
        T.StructField("last_model", T.StringType()),
        T.StructField(
            "first_session",
            T.StructType([T.StructField("session_id", T.StringType()), T.StructField("project", T.StringType())]),
        ),
    ]
)

FILE_STATE = T.StructType([*SCAN_STATE.fields, *FILE_CONTEXT.fields])

MANIFEST = T.StructType(
    [
        T.StructField("tool", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime_ms", T.LongType()),
    ]
)

QUARANTINE = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("raw_md5", T.StringType()),
        T.StructField("reason", T.StringType()),
    ]
)

# The last reading of a session in a span of time, and its place in the turn order.
SESSION_HEADS = T.StructType(
    [
        T.StructField("tool", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("span", T.LongType()),
        T.StructField("reading", T.StructType([T.StructField(c, T.LongType()) for c in TOKEN_COLS])),
        T.StructField(
            "place",
            T.StructType(
                [
                    T.StructField("ts", T.LongType()),
                    T.StructField("ingest_batch", T.LongType()),
                    T.StructField("tool_rank", T.IntegerType()),
                    T.StructField("source_file", T.StringType()),
                    T.StructField("line_no", T.LongType()),
                ]
            ),
        ),
        T.StructField("n_rows", T.LongType()),
    ]
)
