"""Fields of a log line: how they are taken out, and what odd lines give."""

import pytest

from turnledger.sources.dialects import DIALECTS
from turnledger.sources.dialects.common import line_facts

LINES = "file_path string, mtime_ms bigint, value string"


@pytest.mark.parametrize("tool", sorted(DIALECTS))
def test_no_field_is_looked_up_by_path(spark, tool):
    # A path that a line does not have costs an exception.
    plan = line_facts(spark.createDataFrame([], LINES), DIALECTS[tool])._jdf.queryExecution().optimizedPlan().toString()
    assert "try_variant_get(" in plan
    assert "$[" not in plan and "$." not in plan


def test_odd_lines(spark):
    whole = '{"type":"assistant","sessionId":"s","message":{"id":"m","model":"x","usage":{"input_tokens":7}},"timestamp":9}'
    deep = "[" * 5000 + "]" * 5000
    cases = {
        whole: ("event", "cc:m", "x", 7),
        f" ﻿{whole} ": ("event", "cc:m", "x", 7),
        whole.replace('"x"', "null"): ("event", "cc:m", "unknown", 7),
        whole.replace('"id":"m",', ""): ("event", None, "x", 7),
        whole.replace("7}", "7,\"input_tokens\":8}"): ("event", "cc:m", "x", 8),
        whole.replace('"timestamp"', f'"other":{deep},"timestamp"'): ("event", "cc:m", "x", 7),
        whole.replace('{"input_tokens":7}', "{}"): ("event", "cc:m", "x", 0),
        whole.replace('{"input_tokens":7}', "[7]"): ("ignored", None, "x", 0),
        whole.replace('{"input_tokens":7}', "null"): ("ignored", None, "x", 0),
        '{"type":"assistant","message":"text"}': ("ignored", None, "unknown", 0),
        '{"Type":"assistant","message":{"usage":{}}}': ("ignored", None, "unknown", 0),
        "{}": ("ignored", None, "unknown", 0),
        "": ("ignored", None, "unknown", 0),
        f"{whole},{whole}": ("malformed",),
        f"{whole},2,{whole}": ("malformed",),
        whole[:-1]: ("malformed",),
        whole.replace('"timestamp"', '"other":01,"timestamp"'): ("malformed",),
        whole.replace('"timestamp"', '"other":"\\q","timestamp"'): ("malformed",),
        f"[{whole}]": ("malformed",),
    }
    lines = [(f"file:///r/p/{i}.jsonl", 5000, line) for i, line in enumerate(cases)]
    facts = line_facts(spark.createDataFrame(lines, LINES), DIALECTS["claude_code"])
    rows = {r["file_path"]: r for r in facts.collect()}
    for (path, _, line), wanted in zip(lines, cases.values(), strict=True):
        row = rows[path]
        assert row["outcome"] == wanted[0], line
        if len(wanted) > 1:
            key = row["dedupe_key"]
            # A message without an id has a digest as its key.
            assert key == wanted[1] or (wanted[0], wanted[1], len(key or "")) == ("event", None, 35), line
            assert (row["model"], row["input_tokens"]) == wanted[2:], line
