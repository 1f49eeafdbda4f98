"""Hot sessions found by bucket, sums at the bound, and sorted rows that are not hashed again."""

import random

from helpers import events, usage

from turnledger.catalog.queries import sessions_all
from turnledger.functions.tokens import MOST, add_counts, sum_counts
from turnledger.operators import deltas
from turnledger.schema import TOKEN_COLS


def rows_of(sessions):
    rng = random.Random(5)
    return [
        usage(f"{s}-{i}", "codex", s, rng.randrange(90), tuple(rng.randrange(1000) for _ in TOKEN_COLS), i, cumulative=True)
        for s, n in sessions.items()
        for i in range(n)
    ]


def found(frame):
    return sorted((r["session_id"], r["line_no"], *(r[c] for c in TOKEN_COLS)) for r in frame.collect())


def test_small_sessions_are_not_counted_one_by_one(spark, monkeypatch):
    frame = events(spark, rows_of({f"s{i}": 3 for i in range(20)}))
    whole = found(deltas.turn_usage(frame))
    written = []
    monkeypatch.setattr(deltas, "pin", lambda df, label: written.append(label) or df)
    assert found(deltas.turn_usage(frame, hot_session_rows=50)) == whole
    assert written == []


def test_hot_sessions_among_others_of_their_bucket(spark, monkeypatch):
    frame = events(spark, rows_of({"hot": 80, "warm": 30, "s": 2, "t": 1}))
    whole = found(deltas.turn_usage(frame))
    for buckets in (1, 2, deltas.SIZE_BUCKETS):
        monkeypatch.setattr(deltas, "SIZE_BUCKETS", buckets)
        assert found(deltas.turn_usage(frame, hot_session_rows=40, chunk_rows=15)) == whole


def test_sums_stop_at_the_bound(spark):
    groups = {
        "near": [MOST - 7, 3, 4], "over": [MOST, 1], "far": [MOST] * 40, "low": [2**26 - 1] * 9,
        "one": [MOST], "none": [0, 0], "null": [None, None], "some": [None, 2**53, 5],
    }
    frame = spark.createDataFrame([(g, n) for g, ns in groups.items() for n in ns], "g string, n bigint")
    got = {r["g"]: r["n"] for r in frame.groupBy("g").agg(sum_counts("n").alias("n")).collect()}
    known = {g: [n for n in ns if n is not None] for g, ns in groups.items()}
    assert got == {g: min(sum(ns), MOST) if ns else None for g, ns in known.items()}
    pairs = [(MOST, 0), (MOST, 1), (MOST - 1, 1), (2**62, 2**62 - 1), (2**62, 2**62), (3, None)]
    rows = spark.createDataFrame(pairs, "a bigint, b bigint").select(add_counts("a", "b")).collect()
    assert [r[0] for r in rows] == [None if None in p else min(sum(p), MOST) for p in pairs]


def test_sessions_of_sorted_turns_are_not_hashed(spark):
    report = sessions_all(spark, "/root/testdata/sf0.001")
    assert report.collect()
    assert "ObjectHashAggregate" not in report._jdf.queryExecution().executedPlan().toString()
