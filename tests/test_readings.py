"""How often a log line's fields are read, and what odd numbers give."""

import pytest

from turnledger.sources.dialects import DIALECTS
from turnledger.sources.dialects.common import line_facts

LINES = "file_path string, mtime_ms bigint, value string"


@pytest.mark.parametrize("tool", sorted(DIALECTS))
def test_kind_of_a_field_is_asked_once(spark, tool):
    dialect = DIALECTS[tool]
    facts = line_facts(spark.createDataFrame([], LINES), dialect)
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("schemaOfVariant") <= len(dialect.fields)


def test_long_methods_are_not_fused(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_odd_numbers(spark):
    numbers = {
        "12": 12, "12.75": 12, "1e3": 1000, "-3": 0, "-0.5": 0, "1e999": 0, '"12"': 0, "true": 0, "null": 0,
        "{}": 0, "[7]": 0, "9007199254740992": 2**53, "9007199254740994": None, "1e300": None,
        "123456789012345678901234567890123456": None,
    }
    lines = [
        (f"file:///r/p/{i}.jsonl", 5000, '{"id":"%d","tokens":{"input":%s},"time":{"completed":null},"timestamp":7}' % (i, n))
        for i, n in enumerate(numbers)
    ]
    facts = line_facts(spark.createDataFrame(lines, LINES), DIALECTS["opencode"])
    rows = {r["file_path"]: r for r in facts.collect()}
    for (path, _, _), n in zip(lines, numbers.values(), strict=True):
        row = rows[path]
        assert (row["outcome"], row["input_tokens"]) == ("malformed" if n is None else "event", n), path
        # A ``time`` without a usable part decides; the file's time stands in for it.
        assert row["ts"] == 5
