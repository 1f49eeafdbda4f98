"""Line numbers and offsets when a file is read in many splits."""

import json
import random

import pytest
from helpers import session_meta, totals, turn_context

from turnledger.plans.read_logs import read_logs
from turnledger.sources.files import Source


@pytest.fixture
def tiny_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("mark, ending", [(b"", "\n"), (b"\xef\xbb\xbf", "\n"), (b"", ""), (b"\xef\xbb\xbf", "")])
def test_lines_of_a_split_file(spark, tmp_path, tiny_splits, mark, ending):
    rng = random.Random(5)
    lines, model, want = [], "unknown", []
    for i in range(120):
        kind = rng.randrange(4)
        if kind == 0:
            model = f"model-{i}"
            lines.append(turn_context(model))
        elif kind == 1:
            lines.append("é" * rng.randrange(90) + "\r")
        elif kind == 2:
            lines.append(json.dumps({"type": "other", "pad": "x" * rng.randrange(900)}))
        else:
            want.append((len(lines), model, len(want), i * 10))
            lines.append(totals("2026-01-15T10:00:00Z", i * 10, 0, 1, 0))
    lines.append(session_meta("late", "/w"))
    if ending == "":
        lines.append(totals("2026-01-15T10:00:00Z", 5, 0, 1, 0))
    data = mark + ("\n".join(lines) + ending).encode()
    (tmp_path / "big.jsonl").write_bytes(data)

    placed = read_logs(spark, [Source("codex", (str(tmp_path),))])
    rows = placed.orderBy("line_no").collect()
    complete = lines if ending else lines[:-1]
    assert [r["line_no"] for r in rows] == list(range(len(complete)))
    offset = 0
    for row, line in zip(rows, complete):
        length = len(line.encode()) + 1 + (len(mark) if offset == 0 else 0)
        assert (row["start"], row["end"]) == (offset, offset + length)
        offset += length
    got = [
        (r["line_no"], r["model"], int(r["dedupe_key"].split(":")[2]), r["input_tokens"])
        for r in rows
        if r["outcome"] == "event"
    ]
    assert got == want
    assert {r["session_id"] for r in rows if r["outcome"] == "event"} == {"late"}
