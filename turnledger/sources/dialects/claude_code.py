"""Per-message usage, one assistant entry per line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnledger.functions.coerce import (
    as_count,
    as_string,
    as_timestamp,
    as_true,
    is_object,
)
from turnledger.functions.tokens import digest
from turnledger.schema import UNKNOWN_MODEL
from turnledger.sources.dialects.common import (
    EVENT,
    IGNORED,
    Dialect,
    Field,
    Layout,
    fallback_session,
    fallback_time,
    no_count,
)

# --- fixed values -----------------------------------------------------------
_FIELDS = (
    "message.usage",
    "type",
    "message.id",
    "requestId",
    "sessionId",
    "message.model",
    "timestamp",
    "message.usage.input_tokens",
    "message.usage.output_tokens",
    "message.usage.cache_creation_input_tokens",
    "message.usage.cache_read_input_tokens",
    "isSidechain",
    "cwd",
)
# ----------------------------------------------------------------------------


def message_key(message_id: Column, request_id: Column, line: Column) -> Column:
    """Content-derived key: a replayed message keeps its key under a new session.

    Only a line without a message id falls back to a digest of file and line.
    """
    ids = F.concat_ws(":", F.lit("cc"), message_id, request_id)
    by_line = F.concat(F.lit("cc:"), digest(F.col("file_path"), line))
    return F.when(message_id.isNotNull(), ids).otherwise(by_line)


def _facts(line: Column, at: Field) -> dict[str, Column]:
    usage = at("message.usage")
    carries_usage = (as_string(at("type")) == "assistant") & is_object(usage)
    message_id = as_string(at("message.id"))
    request_id = as_string(at("requestId"))
    return {
        "outcome": F.when(carries_usage, F.lit(EVENT)).otherwise(F.lit(IGNORED)),
        "dedupe_key": F.when(carries_usage, message_key(message_id, request_id, line)),
        "session_id": as_string(at("sessionId")),
        "model": F.coalesce(as_string(at("message.model")), F.lit(UNKNOWN_MODEL)),
        "ts": F.coalesce(as_timestamp(at("timestamp")), fallback_time()),
        "input_tokens": as_count(at("message.usage.input_tokens")),
        "output_tokens": as_count(at("message.usage.output_tokens")),
        "cache_write_tokens": as_count(at("message.usage.cache_creation_input_tokens")),
        "cache_read_tokens": as_count(at("message.usage.cache_read_input_tokens")),
        # Thinking tokens are part of the output count here.
        "reasoning_tokens": no_count(),
        "is_sidechain": as_true(at("isSidechain")),
        "project": as_string(at("cwd")),
    }


def _bind() -> dict[str, Column]:
    return {
        "session_id": fallback_session(),
        "project": F.coalesce(F.col("project"), F.col("file_project")),
    }


CLAUDE_CODE = Dialect(
    tool="claude_code",
    # A project folder, then nested session folders.
    layout=Layout(min_folders=1),
    fields=_FIELDS,
    facts=_facts,
    bind=_bind,
)
