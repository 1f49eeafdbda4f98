"""Flat entries with a ``tokens`` object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnledger.functions.coerce import (
    as_count,
    as_string,
    as_timestamp,
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
)

# --- fixed values -----------------------------------------------------------
# The first time field that is not null decides, usable or not.
_TIMES = ("time.completed", "time.created", "time", "timestamp")
_FIELDS = (
    "tokens",
    "id",
    "sessionID",
    "modelID",
    "model",
    "tokens.input",
    "tokens.output",
    "tokens.cache.write",
    "tokens.cache.read",
    "tokens.reasoning",
    _TIMES,
)
# ----------------------------------------------------------------------------


def _facts(line: Column, at: Field) -> dict[str, Column]:
    carries_usage = is_object(at("tokens"))
    entry_id = as_string(at("id"))
    return {
        "outcome": F.when(carries_usage, F.lit(EVENT)).otherwise(F.lit(IGNORED)),
        "dedupe_key": F.when(
            carries_usage,
            F.concat(F.lit("oc:"), F.coalesce(entry_id, digest(F.col("file_path"), line))),
        ),
        "session_id": as_string(at("sessionID")),
        "model": F.coalesce(
            as_string(at("modelID")),
            as_string(at("model")),
            F.lit(UNKNOWN_MODEL),
        ),
        "ts": F.coalesce(as_timestamp(at(_TIMES)), fallback_time()),
        "input_tokens": as_count(at("tokens.input")),
        "output_tokens": as_count(at("tokens.output")),
        "cache_write_tokens": as_count(at("tokens.cache.write")),
        "cache_read_tokens": as_count(at("tokens.cache.read")),
        "reasoning_tokens": as_count(at("tokens.reasoning")),
        "is_sidechain": F.lit(False),
        "project": F.lit(None).cast("string"),
    }


def _bind() -> dict[str, Column]:
    return {"session_id": fallback_session()}


OPENCODE = Dialect(
    tool="opencode",
    layout=Layout(
        min_folders=1,
        top_folders=("storage", "session", "sessions", "message"),
    ),
    fields=_FIELDS,
    facts=_facts,
    bind=_bind,
)
