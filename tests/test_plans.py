"""Shapes of the plans that matter at scale."""

import re

import pytest
from helpers import events, usage, write_log

import __spark_entry__ as contract
from turnledger.catalog import queries as Q
from turnledger.operators.deltas import turn_usage
from turnledger.operators.file_order import in_file_order
from turnledger.operators.normalize import read_facts
from turnledger.plans import reports
from turnledger.plans.sync import sync
from turnledger.sources.dialects import cumulative_tools
from turnledger.sources.files import Source, read_lines
from turnledger.sources.ledger import Ledger, key_bucket
from turnledger.sources.pricing import bundled_pricing

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_no_nested_loops_or_python(spark, name):
    text = plan(contract.queries()[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert operator not in text


def test_first_wins_is_limited_before_the_shuffle(spark):
    text = plan(Q.dedupe_first_wins(spark, SF_DIR))
    after, before = text.split("Exchange hashpartitioning")
    assert "WindowGroupLimit" in before and "Partial" in before and "Final" in after


def test_unused_deltas_and_columns_are_pruned(spark):
    text = plan(Q.output_by_tool(spark, SF_DIR))
    assert text.count("lag(") == 1
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all("props" not in s or "user_id" in s for s in schemas)


def test_tool_filter_reaches_the_scan(spark):
    text = plan(reports.filter_turns(Q.event_turns(spark, SF_DIR), tool="error"))
    assert text.count("EqualTo(event_type,error)") == 2


@pytest.fixture(scope="module")
def ledger(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("plans"))
    from helpers import assistant, totals

    write_log(f"{base}/a/p/s.jsonl", [assistant("m", None, {"input_tokens": 1}, timestamp=1_700_000_000)])
    write_log(f"{base}/b/s.jsonl", [totals("2026-01-15T10:00:00Z", 1, 0, 1, 0)])
    sources = [Source("claude_code", (f"{base}/a",)), Source("codex", (f"{base}/b",))]
    sync(spark, sources, f"{base}/ledger")
    return Ledger(spark, f"{base}/ledger")


def test_date_range_reaches_the_ledger_scan(spark, ledger):
    report = reports.daily_report(
        ledger.turns(), bundled_pricing(spark), "Asia/Tokyo", "2023-11-01", "2023-11-30"
    )
    text = plan(report.rows)
    scans = [line for line in text.splitlines() if "FileScan parquet" in line]
    bypass = [s for s in scans if "NOT (tool" in s]
    heads = [s for s in scans if "reading" in s]
    assert len(scans) == 3 and len(bypass) == len(heads) == 1
    assert "GreaterThanOrEqual(ts," in bypass[0] and "LessThan(ts," in bypass[0]
    # Of a view over all days, readings before the range are needed for the deltas inside it.
    assert "(ts," not in [s for s in scans if s not in bypass and s not in heads][0]
    assert "source_file" not in bypass[0].split("ReadSchema")[1]
    assert report.rows.count() == 1


def test_a_ranged_view_windows_its_range_only(spark, ledger):
    days = ("2023-11-01", "2023-11-30")
    turns = ledger.turns(*days)
    scans = [line for line in plan(turns).splitlines() if "FileScan parquet" in line]
    assert scans and all("LessThan(ts," in s for s in scans if "reading" not in s)
    # Earlier rows are not read at all: the heads of their sessions are.
    heads = [s for s in scans if "reading" in s]
    assert len(heads) == 1 and "LessThanOrEqual(span," in heads[0]
    assert all("GreaterThanOrEqual(ts," in s for s in scans if s not in heads)
    report = reports.daily_report(turns, bundled_pricing(spark), "Asia/Tokyo", *days)
    assert report.rows.count() == 1


def test_a_view_of_a_ledger_runs_no_job(spark, ledger):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("view", "building a view")
    try:
        ledger.turns()
        ledger.turns("2023-11-01", "2023-11-30")
        assert len(tracker.getJobIdsForGroup("view")) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_one_tool_reads_its_partition_without_a_window(ledger):
    text = plan(reports.filter_turns(ledger.turns(), tool="claude_code"))
    assert "Window" not in text and "Exchange" not in text
    assert re.search(r"PartitionFilters: \[[^]]*tool#\d+ = claude_code", text)


def test_key_check_streams_the_stored_keys(ledger):
    text = plan(ledger.unseen(ledger.events().filter("tool = 'codex'")))
    assert "BroadcastHashJoin" in text and "LeftSemi, BuildRight" in text


def test_key_check_reads_the_buckets_of_the_batch(spark, tmp_path, monkeypatch):
    from turnledger.sources import ledger as stored

    monkeypatch.setattr(stored, "ROWS_PER_BUCKET", 4)
    ledger = Ledger(spark, str(tmp_path / "grown"))
    for first in (0, 200):
        with ledger.commit() as writer:
            rows = [usage(f"k{first + i}", "codex", "s", i, (i, 0, 0, 0, 0), i) for i in range(200)]
            writer.append_events(events(spark, rows))
    parts = ledger.log.latest().events
    assert [p.bits for p in parts] == [6, 6] and [p.rows for p in parts] == [200, 200]
    batch = events(spark, [usage(k, "codex", "s", 0, (0, 0, 0, 0, 0)) for k in ("k7", "k207", "new")])
    left = ledger.unseen(batch)
    scans = re.findall(r"PartitionFilters: \[([^]]*)\]", plan(left))
    named = [s for s in scans if "key_bucket" in s]
    assert named and all(re.search(r"key_bucket#\d+ (IN \(|= )", s) for s in named)
    assert [r["dedupe_key"] for r in left.collect()] == ["new"]
    # Three keys touch three of sixty-four buckets at most.
    wanted = batch.select("dedupe_key").distinct()
    assert wanted.select(key_bucket(6)).distinct().count() <= 3 and len(ledger.events().inputFiles()) > 100


def test_file_context_is_joined_in_place(spark, tmp_path):
    from helpers import totals

    path = write_log(str(tmp_path / "s.jsonl"), [totals("2026-01-15T10:00:00Z", 1, 0, 1, 0)])
    facts = read_facts({"codex": read_lines(spark, [path])})
    files = spark.createDataFrame([(path, 1, 0)], "source_file string, size bigint, start_offset bigint")
    text = plan(in_file_order(facts, files))
    assert "ShuffledHashJoin" in text and "BuildRight" in text
    # Nothing is decoded from the path before the lines are reduced to splits.
    below = text[text.index("partial_count") :]
    assert "UrlCodec" not in below and "regexp" not in below


def test_small_frames_skip_the_hot_session_split(spark):
    rows = [usage("a", "codex", "s", 1, (1, 1, 1, 1, 1), cumulative=True)]
    assert "Join" not in plan(turn_usage(events(spark, rows), cumulative_tools()))
