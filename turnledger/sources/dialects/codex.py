"""Typed envelope with running totals per session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnledger.functions.coerce import as_count, as_string, as_timestamp, is_object
from turnledger.functions.tokens import digest
from turnledger.schema import UNKNOWN_MODEL
from turnledger.sources.dialects.common import (
    EVENT,
    IGNORED,
    MODEL,
    SESSION,
    Dialect,
    Field,
    Layout,
    fallback_session,
    fallback_time,
    no_count,
)

# --- fixed values -----------------------------------------------------------
_FIELDS = (
    "type",
    "payload.id",
    "payload.model",
    "payload.info.total_token_usage",
    "payload.type",
    "payload.info.total_token_usage.cached_input_tokens",
    "payload.info.total_token_usage.input_tokens",
    "timestamp",
    "payload.info.total_token_usage.output_tokens",
    "payload.info.total_token_usage.reasoning_output_tokens",
    "payload.cwd",
)
# ----------------------------------------------------------------------------


def _facts(line: Column, at: Field) -> dict[str, Column]:
    entry = as_string(at("type"))
    session = as_string(at("payload.id"))
    model = as_string(at("payload.model"))
    totals = at("payload.info.total_token_usage")
    is_usage = (
        (entry == "event_msg")
        & (as_string(at("payload.type")) == "token_count")
        & is_object(totals)
    )
    outcome = (
        F.when((entry == "session_meta") & session.isNotNull(), F.lit(SESSION))
        .when((entry == "turn_context") & model.isNotNull(), F.lit(MODEL))
        .when(is_usage, F.lit(EVENT))
        .otherwise(F.lit(IGNORED))
    )
    cached = as_count(at("payload.info.total_token_usage.cached_input_tokens"))
    whole_input = as_count(at("payload.info.total_token_usage.input_tokens"))
    return {
        "outcome": outcome,
        # Content part of the key; session and sequence come from the file context.
        "dedupe_key": F.when(outcome == EVENT, F.substring(digest(line), 1, 8)),
        "session_id": F.when(outcome == SESSION, session),
        "model": F.when(outcome == MODEL, model),
        "ts": F.coalesce(as_timestamp(at("timestamp")), fallback_time()),
        # The input total includes cached input; split them so that cache reads are
        # not billed twice.
        "input_tokens": F.when(
            whole_input.isNotNull() & cached.isNotNull(), F.greatest(whole_input - cached, no_count())
        ),
        "output_tokens": as_count(at("payload.info.total_token_usage.output_tokens")),
        "cache_write_tokens": no_count(),
        "cache_read_tokens": cached,
        "reasoning_tokens": as_count(
            at("payload.info.total_token_usage.reasoning_output_tokens")
        ),
        "is_sidechain": F.lit(False),
        "project": F.when(outcome == SESSION, as_string(at("payload.cwd"))),
    }


def _bind() -> dict[str, Column]:
    """Session and project of the file's first session line, the model last set before
    the usage line, and a key from session, sequence and content."""
    session = F.coalesce(F.col("file_session.session_id"), fallback_session())
    return {
        "session_id": session,
        "project": F.col("file_session.project"),
        "model": F.coalesce(F.col("carried_model"), F.lit(UNKNOWN_MODEL)),
        "dedupe_key": F.concat_ws(
            ":", F.lit("codex"), session, F.col("sequence").cast("string"), F.col("dedupe_key")
        ),
    }


CODEX = Dialect(
    tool="codex",
    # Year, month and day folders.
    layout=Layout(min_folders=0),
    fields=_FIELDS,
    facts=_facts,
    bind=_bind,
    cumulative=True,
)
