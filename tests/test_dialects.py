import json
import os
from dataclasses import replace

import pytest
from helpers import assistant, session_meta, totals, turn_context, write_log

from pyspark.sql import functions as F

from turnledger.operators import normalize
from turnledger.operators.deltas import turn_usage
from turnledger.plans.read_logs import read_logs
from turnledger.plans.reports import daily_report
from turnledger.schema import TOKEN_COLS, USAGE_COLS
from turnledger.plans.sync import sync
from turnledger.sources import dialects, files
from turnledger.sources.files import Source, read_lines
from turnledger.sources.ledger import Ledger
from turnledger.sources.pricing import bundled_pricing


def read(spark, root, tool):
    rows = read_logs(spark, [Source(tool, (str(root),))])
    return [r.asDict() for r in rows.orderBy("source_file", "line_no").collect()]


def split(rows):
    return (
        [r for r in rows if r["outcome"] == "event"],
        [r for r in rows if r["outcome"] == "malformed"],
    )


def test_messages(spark, tmp_path):
    usage = {
        "cache_read_input_tokens": 41_003,
        "input_tokens": 77,
        "cache_creation_input_tokens": 909,
        "output_tokens": 618,
    }
    lines = [
        json.dumps({"type": "user", "message": {"content": "secret words"}}),
        assistant("first", "q1", usage, sessionId="blue", cwd="/srv/blue", timestamp="2026-03-02T23:59:58.250Z"),
        "<<< merge leftovers",
        assistant("second", None, {"output_tokens": 31}, isSidechain=True)[7:],
        json.dumps({"type": "assistant", "message": {"model": "x"}}),
        json.dumps({"type": "summary", "summary": "secret words"}),
        assistant("second", None, {"output_tokens": 31}, isSidechain=True, content="secret words"),
        assistant(None, "q3", {}, timestamp=1_711_111_111_999),
    ]
    path = write_log(str(tmp_path / "projects/-srv-www-shop/deep/green.jsonl"), lines)
    os.utime(path, (1_690_000_000, 1_690_000_000))
    rows = read(spark, tmp_path / "projects", "claude_code")
    good, bad = split(rows)
    assert [r["line_no"] for r in bad] == [2, 3]
    assert [r["line_no"] for r in good] == [1, 6, 7]
    first, second, third = good
    assert first["dedupe_key"] == "cc:first:q1" and second["dedupe_key"] == "cc:second"
    assert third["dedupe_key"].startswith("cc:") and len(third["dedupe_key"]) == 35
    assert tuple(first[c] for c in TOKEN_COLS) == (77, 618, 909, 41_003, 0)
    assert tuple(second[c] for c in TOKEN_COLS) == (0, 31, 0, 0, 0)
    assert (first["session_id"], first["project"], first["ts"]) == ("blue", "/srv/blue", 1_772_495_998)
    # Session from the file name, project from the folder, time from the file.
    assert (second["session_id"], second["project"]) == ("green", "/srv/www/shop")
    assert (second["ts"], third["ts"]) == (1_690_000_000, 1_711_111_111)
    assert [r["is_sidechain"] for r in good] == [False, True, False]
    assert not first["is_cumulative"]
    assert "secret" not in str(rows)
    assert set(USAGE_COLS) <= set(rows[0])


def damaged_usage(counts):
    """A usage line whose counters are given as JSON text."""
    return '{"type":"assistant","message":{"usage":{%s}}}' % counts


def test_lines_that_are_no_single_object(spark, tmp_path):
    lines = [
        "\t\r",
        "false",
        "-0.5",
        "'single': 'quotes'",
        "{'single': 'quotes'}",
        '[{"type":"assistant"}]',
        damaged_usage('"input_tokens":4')[:-1],
        damaged_usage('"input_tokens":4') + "}",
        damaged_usage('"input_tokens":4') + damaged_usage('"input_tokens":4'),
        damaged_usage('"input_tokens":4,'),
        damaged_usage('"input_tokens":NaN'),
        damaged_usage('"input_tokens":04'),
        damaged_usage('"input_tokens":4') + " // note",
        damaged_usage('"input_tokens":4'),
    ]
    write_log(str(tmp_path / "p/s.jsonl"), lines)
    good, bad = split(read(spark, tmp_path, "claude_code"))
    assert [(r["line_no"], r["input_tokens"]) for r in good] == [(13, 4)]
    assert [r["line_no"] for r in bad] == list(range(1, 13))


def test_counters_of_any_type(spark, tmp_path):
    lines = [
        damaged_usage('"input_tokens":{"n":3},"output_tokens":null'),
        damaged_usage('"input_tokens":2.999,"output_tokens":-0.0'),
        damaged_usage('"input_tokens":"17","output_tokens":1e3'),
        damaged_usage('"input_tokens":false,"output_tokens":[8]'),
        damaged_usage('"input_tokens":1e999,"output_tokens":6,"output_tokens":5'),
        "\ufeff  " + damaged_usage('"output_tokens":2') + "\u3000\r",
        '{"type":"assistant","message":[{"usage":{"output_tokens":1}}]}',
        '{"type":"assistant","message":{"usage":"none"}}',
        '{"type":["assistant"],"message":{"usage":{"output_tokens":1}}}',
    ]
    write_log(str(tmp_path / "p/s.jsonl"), lines)
    good, bad = split(read(spark, tmp_path, "claude_code"))
    assert [(r["input_tokens"], r["output_tokens"]) for r in good] == [
        (0, 0), (2, 0), (0, 1000), (0, 0), (0, 5), (0, 2),
    ]
    assert bad == []


def test_huge_lines_and_counts(spark, tmp_path):
    lines = [
        '{"type":"assistant","pad":"%s","message":{"usage":{"output_tokens":3}}}' % ("x" * 25_000_000),
        '{"type":"assistant","pad":%s1%s,"message":{"usage":{"output_tokens":4}}}' % ("[" * 1200, "]" * 1200),
        damaged_usage('"output_tokens":9007199254740994'),
        damaged_usage('"input_tokens":9007199254740992,"output_tokens":1e13'),
    ]
    write_log(str(tmp_path / "p/s.jsonl"), lines)
    good, bad = split(read(spark, tmp_path, "claude_code"))
    assert [(r["line_no"], r["input_tokens"], r["output_tokens"]) for r in good] == [
        (0, 0, 3), (1, 0, 4), (3, 2**53, 10**13),
    ]
    assert [r["line_no"] for r in bad] == [2]
    write_log(str(tmp_path / "b/r.jsonl"), [totals("2026-01-15T10:00:00Z", 5, 10**16, 1, 1)])
    good, bad = split(read(spark, tmp_path / "b", "codex"))
    assert (len(good), len(bad)) == (0, 1)


def test_damaged_times_break_no_report(spark, tmp_path):
    times = [1_700_000_000_000_000_000, -1e17, 9e99, "31/12/2026", "0000-00-00", 1_700_000_000]
    lines = [assistant(f"m{i}", None, {"output_tokens": 1}, timestamp=t) for i, t in enumerate(times)]
    path = write_log(str(tmp_path / "p/s.jsonl"), lines)
    os.utime(path, (86_400, 86_400))
    rows = read_logs(spark, [Source("claude_code", (str(tmp_path),))])
    turns = turn_usage(rows.withColumn("ingest_batch", F.lit(0).cast("bigint")), ("codex",))
    report = daily_report(turns, bundled_pricing(spark)).rows.orderBy("date").collect()
    assert [(r["date"], r["output_tokens"]) for r in report] == [("1970-01-02", 5), ("2023-11-14", 1)]
    stored = turns.withColumn("ts", F.lit(10**16))
    assert [r["date"] for r in daily_report(stored, bundled_pricing(spark)).rows.collect()] == [None]


def test_all_sources_of_a_tool(spark, tmp_path):
    for name in ("one", "two"):
        write_log(str(tmp_path / f"{name}/p/s.jsonl"), [assistant(name, None, {})])
    roots = [str(tmp_path / "one"), str(tmp_path / "two"), str(tmp_path / "absent"), str(tmp_path / "one/p")]
    rows = read_logs(spark, [Source("claude_code", (root,)) for root in roots])
    assert sorted(r["dedupe_key"] for r in rows.collect()) == ["cc:one", "cc:two"]
    assert read_logs(spark, [Source("claude_code", (str(tmp_path / "absent"),))]).count() == 0
    with pytest.raises(ValueError, match="two file name patterns"):
        read_logs(spark, [Source("claude_code", (roots[0],)), Source("claude_code", (roots[3],), "*.txt")])


def test_a_lost_file_is_an_error(spark, tmp_path, monkeypatch):
    for name in ("kept", "lost"):
        write_log(str(tmp_path / f"p/{name}.jsonl"), [assistant(name, None, {})])

    def read_after_loss(session, paths, glob=None):
        os.unlink(tmp_path / "p/lost.jsonl")
        return read_lines(session, paths, glob)

    monkeypatch.setattr("turnledger.plans.read_logs.read_lines", read_after_loss)
    with pytest.raises(RuntimeError, match="incomplete read.*lost.jsonl"):
        read_logs(spark, [Source("claude_code", (str(tmp_path),))])


@pytest.mark.parametrize(
    "value, want",
    [
        ("2026-01-15", 1_768_435_200),
        ("2026-01-15T10:00:05+02:00", 1_768_464_005),
        ("2026-01-15T10:00", 1_768_471_200),
        (1_768_471_205, 1_768_471_205),
        (1_768_471_205_999, 1_768_471_205),
        (12.9, 12),
        ("Mon, 02 Mar 2026 09:30:00 GMT", 1_772_443_800),
        ("2026/3/2", 1_772_409_600),
        ("2026/03/02 09:30:00", 1_772_443_800),
        ("Mon, 42 Mar 2026 09:30:00 GMT", None),
        (1_700_000_000_000_000_000, None),
        (-1e300, None),
        ("10:00", None),
        ("soon", None),
        ("", None),
        (None, None),
        (True, None),
    ],
)
def test_timestamps(spark, tmp_path, value, want):
    path = write_log(str(tmp_path / "p/s.jsonl"), [assistant("m", None, {}, timestamp=value)])
    os.utime(path, (77, 77))
    assert read(spark, tmp_path, "claude_code")[0]["ts"] == (77 if want is None else want)


def test_running_totals(spark, tmp_path):
    lines = [
        totals("2026-01-15T10:00:00Z", 1000, 200, 100, 40),
        turn_context("gpt-5-codex"),
        json.dumps({"type": "event_msg", "payload": {"type": "token_count", "info": None}}),
        json.dumps({"type": "session_meta", "payload": {"cwd": "/no-id"}}),
        session_meta("0196-aa", "/dev/one"),
        session_meta("0196-bb", "/dev/two"),
        "junk",
        totals("2026-01-15T10:00:01Z", 100, 700, 260, 90),
        json.dumps({"type": "turn_context", "payload": {"model": ""}}),
        totals("2026-01-15T10:00:02Z", 4000, 1200, 400, 150),
    ]
    write_log(str(tmp_path / "2026/01/15/rollout.jsonl"), lines)
    good, bad = split(read(spark, tmp_path, "codex"))
    assert len(bad) == 1 and len(good) == 3
    assert [r["model"] for r in good] == ["unknown", "gpt-5-codex", "gpt-5-codex"]
    assert {(r["session_id"], r["project"]) for r in good} == {("0196-aa", "/dev/one")}
    assert [(r["input_tokens"], r["cache_read_tokens"]) for r in good] == [
        (800, 200),
        (0, 700),
        (2800, 1200),
    ]
    assert all(r["is_cumulative"] for r in good)
    import re

    for i, row in enumerate(good):
        assert re.fullmatch(rf"codex:[0-9a-f-]+:{i}:[0-9a-f]{{8}}", row["dedupe_key"])


def test_session_falls_back_to_the_file(spark, tmp_path):
    write_log(str(tmp_path / "roll-1.jsonl"), [totals("2026-01-15T10:00:00Z", 1, 0, 1, 0)])
    row = read(spark, tmp_path, "codex")[0]
    assert (row["session_id"], row["project"], row["model"]) == ("roll-1", None, "unknown")


def test_flat_entries(spark, tmp_path):
    tokens = {"input": 5, "output": 6, "reasoning": 7, "cache": {"read": 8, "write": 9}}
    times = [
        ({"time": {"completed": 1_700_000_001_500, "created": 3}}, 1_700_000_001),
        ({"time": {"completed": None, "created": 1_700_000_002}}, 1_700_000_002),
        ({"time": {}, "timestamp": 1_700_000_003}, 99),
        ({"time": None, "timestamp": "2026-01-15T10:00:05Z"}, 1_768_471_205),
        ({"time": "2026-01-15T10:00:05Z"}, 1_768_471_205),
        ({"time": {"completed": "never", "created": 5}}, 99),
        ({}, 99),
    ]
    lines = [
        json.dumps({"id": f"i{n}", "sessionID": "z", "modelID": "o3", "model": "no", "tokens": tokens, **t})
        for n, (t, _) in enumerate(times)
    ]
    lines += [
        json.dumps({"id": "skip", "tokens": None}),
        json.dumps({"model": "gpt-4o", "tokens": {"input": "5"}}),
        "[1]",
    ]
    path = write_log(str(tmp_path / "message/deep/y.jsonl"), lines)
    os.utime(path, (99, 99))
    write_log(str(tmp_path / "elsewhere/y.jsonl"), lines)
    write_log(str(tmp_path / "y.jsonl"), lines)
    good, bad = split(read(spark, tmp_path, "opencode"))
    assert len(bad) == 1 and len(good) == len(times) + 1
    assert [r["ts"] for r in good[:-1]] == [want for _, want in times]
    assert [r["dedupe_key"] for r in good[:2]] == ["oc:i0", "oc:i1"]
    assert tuple(good[0][c] for c in TOKEN_COLS) == (5, 6, 9, 8, 7)
    assert (good[0]["model"], good[0]["session_id"], good[0]["project"]) == ("o3", "z", None)
    last = good[-1]
    assert (last["model"], last["session_id"], last["input_tokens"]) == ("gpt-4o", "y", 0)
    assert len(last["dedupe_key"]) == 35


def test_a_further_dialect_needs_one_entry(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dialects, "DIALECTS", dict(dialects.DIALECTS))
    monkeypatch.setattr(dialects, "TOOL_RANK", dict(dialects.TOOL_RANK))
    for module in (normalize, files):
        for name in ("DIALECTS", "TOOL_RANK"):
            monkeypatch.setattr(module, name, getattr(dialects, name))
    dialects.register(replace(dialects.CLAUDE_CODE, tool="house"))
    assert dialects.tools() == ("claude_code", "codex", "opencode", "house")
    write_log(str(tmp_path / "logs/p/s.jsonl"), [assistant("m", None, {"output_tokens": 3})])
    sources = [Source("house", (str(tmp_path / "logs"),))]
    result = sync(spark, sources, str(tmp_path / "ledger"))
    audit = {r["tool"]: (r["detected"], r["new_events"]) for r in result.audit().collect()}
    assert audit["house"] == (True, 1) and audit["codex"] == (False, 0)
    row = Ledger(spark, str(tmp_path / "ledger")).turns().first()
    assert (row["tool"], row["tool_rank"], row["output_tokens"]) == ("house", 3, 3)


def test_layouts(spark, tmp_path):
    line = [assistant("m", None, {})]
    write_log(str(tmp_path / "root.jsonl"), line)
    write_log(str(tmp_path / "p/s.jsonl"), line)
    write_log(str(tmp_path / "p/s/subagents/agent-1.jsonl"), line)
    write_log(str(tmp_path / "p/s.txt"), line)
    write_log(str(tmp_path / "p/1/2/3/4/5/6/ok.jsonl"), line)
    write_log(str(tmp_path / "p/1/2/3/4/5/6/7/deep.jsonl"), line)
    names = [os.path.basename(r["source_file"]) for r in read(spark, tmp_path, "claude_code")]
    assert sorted(names) == ["agent-1.jsonl", "deep.jsonl", "ok.jsonl", "s.jsonl"]
    assert len(read(spark, tmp_path, "codex")) == 5
