"""Builders for small logs and ledger rows."""

from __future__ import annotations

import json
import os

from turnledger.schema import TOKEN_COLS, USAGE_EVENTS


def usage(key, tool, session, ts, tokens, line_no=0, cumulative=False, model="gpt-5", **more):
    row = {
        "dedupe_key": key,
        "tool": tool,
        "session_id": session,
        "model": model,
        "ts": ts,
        **dict(zip(TOKEN_COLS, tokens)),
        "is_cumulative": cumulative,
        "is_sidechain": False,
        "project": None,
        "source_file": "f",
        "ingest_batch": 0,
        "tool_rank": 0,
        "line_no": line_no,
        **more,
    }
    return tuple(row[name] for name in USAGE_EVENTS.names)


def events(spark, rows):
    return spark.createDataFrame(rows, USAGE_EVENTS)


def assistant(message_id=None, request_id=None, usage=None, **entry):
    message = {"model": "claude-opus-5", "usage": usage if usage is not None else {}}
    if message_id:
        message["id"] = message_id
    line = {"type": "assistant", "message": message, **entry}
    if request_id:
        line["requestId"] = request_id
    return json.dumps(line)


def totals(ts, fresh_and_cached, cached, output, reasoning):
    counts = {
        "input_tokens": fresh_and_cached,
        "cached_input_tokens": cached,
        "output_tokens": output,
        "reasoning_output_tokens": reasoning,
    }
    payload = {"type": "token_count", "info": {"total_token_usage": counts}}
    return json.dumps({"timestamp": ts, "type": "event_msg", "payload": payload})


def session_meta(session, cwd=None):
    return json.dumps({"type": "session_meta", "payload": {"id": session, "cwd": cwd}})


def turn_context(model):
    return json.dumps({"type": "turn_context", "payload": {"model": model}})


def write_log(path, lines, end="\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(("\n".join(lines) + end).encode())
    return path


def append(path, text, forward=2):
    with open(path, "ab") as out:
        out.write(text.encode())
    touch(path, forward)


def touch(path, seconds):
    whole = int(os.stat(path).st_mtime) + seconds
    os.utime(path, (whole, whole))
