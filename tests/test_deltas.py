import random

import pytest
from helpers import events, usage

from turnledger.operators.deltas import difference_in_chunks, turn_usage, turns_between
from turnledger.schema import TOKEN_COLS, USAGE_EVENTS


def deltas(df, *names):
    rows = df.orderBy("session_id", "ts", "line_no").collect()
    return [tuple(r[n] for n in names) for r in rows]


def running(values, session="s"):
    return [
        usage(f"{session}{i}", "codex", session, 100 + i, v, i, cumulative=True)
        for i, v in enumerate(values)
    ]


def test_running_totals_become_turns(spark):
    rows = running([(70, 9, 0, 11, 2), (95, 9, 4, 48, 2), (95, 30, 4, 50, 7), (301, 31, 6, 50, 7)])
    assert deltas(turn_usage(events(spark, rows)), *TOKEN_COLS) == [
        (70, 9, 0, 11, 2),
        (25, 0, 4, 37, 0),
        (0, 21, 0, 2, 5),
        (206, 1, 2, 0, 0),
    ]


def test_reset_is_clamped(spark):
    # Each counter falls on its own; the next reading counts from the fallen one.
    rows = running([(50, 8, 0, 0, 3), (20, 12, 0, 0, 3), (21, 2, 0, 0, 90), (20, 9, 0, 0, 1)])
    got = deltas(turn_usage(events(spark, rows)), "input_tokens", "output_tokens", "reasoning_tokens")
    assert got == [(50, 8, 3), (0, 4, 0), (1, 0, 87), (0, 7, 0)]


def test_other_rows_pass_through(spark):
    """Counts that are no running totals stay as they are, falling ones too."""
    said = [(5, 40), (3, 0), (3, 17), (90, 2)]
    rows = [usage(f"m{i}", "opencode", "z", 9 - i, (a, b, 0, 1, 0), i) for i, (a, b) in enumerate(said)]
    for tools in (None, ("codex",)):
        got = deltas(turn_usage(events(spark, rows), tools), "input_tokens", "output_tokens")
        assert sorted(got) == sorted(said)


def test_unflagged_rows_still_count_as_predecessors(spark):
    rows = [
        usage("a", "t", "s", 1, (50, 0, 0, 0, 0), 0, cumulative=False),
        usage("b", "t", "s", 2, (80, 0, 0, 0, 0), 1, cumulative=True),
    ]
    assert deltas(turn_usage(events(spark, rows)), "input_tokens") == [(50,), (30,)]


def test_flagged_row_outside_the_list_fails(spark):
    rows = running([(1, 1, 1, 1, 1)])
    with pytest.raises(Exception, match="running totals outside"):
        turn_usage(events(spark, rows), ("other",)).collect()


def brute_force(rows):
    names = ["dedupe_key", "tool", "session_id", "model", "ts", *TOKEN_COLS, "cum"]
    table = [dict(zip(names, r)) | {"line_no": r[-1]} for r in rows]
    last, out = {}, {}
    for row in sorted(table, key=lambda r: (r["tool"], r["session_id"], r["ts"], r["line_no"])):
        key = (row["tool"], row["session_id"])
        before = last.get(key, [0] * len(TOKEN_COLS))
        now = [row[c] for c in TOKEN_COLS]
        out[row["line_no"]] = tuple(
            max(n - b, 0) if row["cum"] else n for n, b in zip(now, before)
        )
        last[key] = now
    return out


@pytest.mark.parametrize("seed", range(3))
def test_split_sessions_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [
        usage(
            f"k{i}",
            "codex",
            # One session holds most rows, some timestamps repeat.
            "hot" if rng.random() < 0.7 else f"s{rng.randrange(4)}",
            rng.randrange(60),
            tuple(rng.randrange(1000) for _ in TOKEN_COLS),
            i,
            cumulative=rng.random() < 0.8,
        )
        for i in range(300)
    ]
    df = events(spark, rows)
    want = brute_force(rows)
    for got in (
        turn_usage(df),
        difference_in_chunks(df, 7),
        turn_usage(df, hot_session_rows=50, chunk_rows=20),
    ):
        assert {r["line_no"]: tuple(r[c] for c in TOKEN_COLS) for r in got.collect()} == want


@pytest.mark.parametrize("low, high", [(None, 120), (110, None), (110, 125), (130, 131), (0, 500)])
def test_a_range_equals_the_filtered_view(spark, low, high):
    rng = random.Random(8)
    rows = [
        usage(f"k{i}", tool, f"s{i % 4}", 100 + rng.randrange(40), tuple(rng.randrange(90) for _ in range(5)), i, tool == "codex")
        for i, tool in enumerate(rng.choices(("codex", "opencode"), k=150))
    ]
    frame = events(spark, rows)
    whole = turn_usage(frame, ("codex",))
    if low is not None:
        whole = whole.filter(f"ts >= {low}")
    if high is not None:
        whole = whole.filter(f"ts < {high}")
    part = turns_between(frame, ("codex",), low, high)
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("pieces", [1, 3])
def test_heads_stand_in_for_earlier_rows(spark, tmp_path, monkeypatch, pieces):
    """A ledger filled in pieces, out of order, against the view over all rows at once."""
    import datetime as dt

    from turnledger.operators import deltas as module
    from turnledger.sources.ledger import Ledger

    monkeypatch.setattr(module, "HEAD_SECONDS", 7200)
    draw = random.Random(pieces)
    start = 1_700_006_400
    rows = [
        usage(
            f"k{i}", draw.choice(["codex", "codex", "opencode"]), f"s{draw.randrange(4)}",
            start + draw.randrange(40) * 3600, tuple(draw.randrange(100) for _ in TOKEN_COLS), i,
            cumulative=False, ingest_batch=i % pieces,
        )
        for i in range(200)
    ]
    names = USAGE_EVENTS.names
    flag = names.index("is_cumulative")
    rows = [(*r[:flag], r[names.index("tool")] == "codex", *r[flag + 1 :]) for r in rows]
    ledger = Ledger(spark, str(tmp_path / "l"))
    for piece in range(pieces):
        with ledger.commit() as writer:
            writer.append_events(events(spark, [r for i, r in enumerate(rows) if i % pieces == piece]))
    whole = turn_usage(events(spark, rows), ("codex",))
    assert sorted(map(tuple, ledger.turns().collect())) == sorted(map(tuple, whole.collect()))
    day = dt.datetime.fromtimestamp(start, dt.UTC).date()
    low, high = day + dt.timedelta(days=2), day + dt.timedelta(days=2)
    part = ledger.turns(low.isoformat(), high.isoformat())
    bounds = [int(dt.datetime(d.year, d.month, d.day, tzinfo=dt.UTC).timestamp()) for d in (low, high)]
    inside = whole.filter(whole.ts >= bounds[0] - 86400).filter(whole.ts < bounds[1] + 172800)
    assert 0 < inside.count() < 200
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, inside.collect()))
