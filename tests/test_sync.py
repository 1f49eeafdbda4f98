import os

import pytest
from helpers import append, assistant, session_meta, totals, touch, turn_context, write_log
from pyspark.sql import functions as F

from turnledger.plans.sync import sync
from turnledger.schema import QUARANTINE, TOKEN_COLS, TURN_COLS, USAGE_EVENTS
from turnledger.sources.files import Source, classify, list_files
from turnledger.sources.ledger import Ledger, Writer


pytestmark = pytest.mark.usefixtures("interpreted")


class Setup:
    def __init__(self, spark, base):
        self.spark, self.base = spark, base
        self.sources = [
            Source("claude_code", (f"{base}/projects",)),
            Source("codex", (f"{base}/sessions", f"{base}/absent")),
        ]
        self.ledger = Ledger(spark, f"{base}/ledger")
        self.file = f"{base}/projects/p/s.jsonl"

    def sync(self, **kwargs):
        result = sync(self.spark, self.sources, self.ledger.path, **kwargs)
        return {a.tool: a for a in result.tools}

    def message(self, name, tokens):
        return assistant(name, None, {"input_tokens": tokens}, timestamp=1_700_000_000)

    def stored(self):
        rows = self.ledger.events().select("dedupe_key", "input_tokens").collect()
        return {r[0].removeprefix("cc:"): r[1] for r in rows}

    def offset(self):
        return self.ledger.scan_state().filter(F.col("source_file") == self.file).first()["byte_offset"]


@pytest.fixture
def world(spark, tmp_path):
    return Setup(spark, str(tmp_path))


def counts(audit):
    return (audit.files_scanned, audit.files_skipped, audit.new_events, audit.duplicates_ignored)


def test_a_log_written_in_pieces(world):
    """Every sync stores the lines that got their break since the last one."""
    pieces = [world.message(f"turn-{i}", 7 * i + 3) + "\n" for i in range(6)]
    text = "".join(pieces)
    os.makedirs(os.path.dirname(world.file))
    written = 0
    for stop in (5, len(pieces[0]), len(pieces[0]) + 1, len(text) - 1, len(text)):
        with open(world.file, "a") as out:
            out.write(text[written:stop])
        touch(world.file, stop)
        new = text[:stop].count("\n") - text[:written].count("\n")
        assert counts(world.sync()["claude_code"]) == (1, 0, new, 0)
        assert world.offset() == text[:stop].rfind("\n") + 1
        written = stop
    assert world.stored() == {f"turn-{i}": 7 * i + 3 for i in range(6)}
    assert counts(world.sync()["claude_code"]) == (0, 1, 0, 0)
    lines = [r["line_no"] for r in world.ledger.events().orderBy("line_no").collect()]
    assert lines == list(range(6))


def test_old_lines_are_not_read_again(world, monkeypatch):
    import turnledger.plans.sync as sync_module

    old = [world.message(f"old-{i}", i) for i in range(50)]
    write_log(world.file, old)
    world.sync()
    # Were the old lines read, they would be malformed now.
    size = os.path.getsize(world.file)
    with open(world.file, "r+b") as out:
        out.write(b"#" * (size - 1))
    append(world.file, world.message("new", 1) + "\n{bad\n", 5)
    parsed = []
    real = sync_module.read_facts

    def spy(lines):
        parsed.append({tool: df.count() for tool, df in lines.items()})
        return real(lines)

    monkeypatch.setattr(sync_module, "read_facts", spy)
    audit = world.sync()["claude_code"]
    assert parsed == [{"claude_code": 2}]
    assert counts(audit) == (1, 0, 1, 0) and audit.malformed_lines == 1
    assert world.ledger.quarantine().first()["line_no"] == 51
    assert world.ledger.events().filter("dedupe_key = 'cc:new'").first()["line_no"] == 50


@pytest.mark.parametrize("how", ["small ranges", "no store", "no context"])
def test_every_way_of_reading_a_grown_log_agrees(spark, tmp_path, monkeypatch, how):
    import turnledger.plans.sync as sync_module
    import turnledger.sources.ranges as ranges

    if how == "small ranges":
        monkeypatch.setattr(ranges, "RANGE_BYTES", 37)
        monkeypatch.setattr(ranges, "TASK_BYTES", 100)
    if how == "no store":
        monkeypatch.setattr(sync_module, "can_open", lambda uri: False)
    grown = Setup(spark, str(tmp_path / "grown"))
    if how == "no context":
        plain = Ledger.file_states
        monkeypatch.setattr(
            Ledger, "file_states", lambda self: plain(self).withColumn("n_lines", F.lit(None).cast("bigint"))
        )
    path, whole = f"{grown.base}/sessions/2026/01/15/r.jsonl", rollout(9)
    # The model changes inside the second piece, a line is damaged in the third.
    whole[6:6] = [turn_context("o3")]
    whole[10:10] = ["{bad"]
    for low, high in ((0, 4), (4, 8), (8, len(whole))):
        if low:
            append(path, "\n".join(whole[low:high]) + "\n", 3)
        else:
            write_log(path, whole[:high])
        grown.sync()
    once = Setup(spark, str(tmp_path / "once"))
    write_log(f"{once.base}/sessions/2026/01/15/r.jsonl", whole)
    once.sync()
    assert turns(grown.ledger) == turns(once.ledger)

    def keys(ledger):
        rows = ledger.events().select("dedupe_key", "line_no").collect()
        bad = ledger.quarantine().select("line_no", "raw_md5").collect()
        return sorted(map(tuple, rows)), sorted(map(tuple, bad))

    assert keys(grown.ledger) == keys(once.ledger)
    state = grown.ledger.file_states().first()
    assert (state["byte_offset"], state["last_model"]) == (os.path.getsize(path), "o3")
    if how != "no context":
        assert (state["n_lines"], state["n_events"], state["first_session"]["session_id"]) == (13, 9, "sess")


def test_a_session_line_that_comes_late(spark, tmp_path):
    world = Setup(spark, str(tmp_path))
    path, lines = f"{world.base}/sessions/r.jsonl", rollout(3)
    write_log(path, lines[1:3])
    world.sync()
    append(path, "\n".join([lines[0], *lines[3:]]) + "\n", 3)
    world.sync()
    rows = world.ledger.events().orderBy("line_no").select("session_id", "project", "model", "line_no").collect()
    assert [tuple(r) for r in rows] == [("r", None, "gpt-5", 1), ("sess", "/w", "gpt-5", 3), ("sess", "/w", "gpt-5", 4)]


def test_scratch_tables_are_deleted(world):
    folder = os.path.join(world.spark.conf.get("spark.checkpoint.dir"), "turnledger")

    def labels():
        names = os.listdir(folder) if os.path.isdir(folder) else []
        return sorted(n.rsplit("-", 1)[0] for n in names)

    before = labels()
    write_log(world.file, [world.message("a", 1), "{bad"])
    world.sync()
    added = labels()
    for label in before:
        added.remove(label)
    assert set(added) <= {"manifest", "read-files"}
    assert world.ledger.events().count() == 1 and world.ledger.quarantine().count() == 1
    # Read again from the start: the malformed line is the one already set aside.
    touch(world.file, -60)
    assert world.sync()["claude_code"].duplicates_ignored == 1
    assert world.ledger.quarantine().count() == 1


def test_rotated_logs_are_read_from_the_start(world):
    old = [world.message(f"before-{i}", 100 + i) for i in range(8)]
    write_log(world.file, old)
    world.sync()
    # Shorter: two old lines are met again, one is new.
    write_log(world.file, [old[6], old[1], world.message("after-0", 5)])
    touch(world.file, 9)
    assert counts(world.sync()["claude_code"]) == (1, 0, 1, 2)
    # As long as before but of an earlier time: another file in its place.
    size = os.path.getsize(world.file)
    write_log(world.file, [world.message("after-1", 6)])
    with open(world.file, "a") as out:
        out.write(" " * (size - os.path.getsize(world.file) - 1) + "\n")
    touch(world.file, -3600)
    assert os.path.getsize(world.file) == size
    assert counts(world.sync()["claude_code"]) == (1, 0, 1, 0)
    assert len(world.stored()) == 10 and world.offset() == size


def test_damaged_lines_are_set_aside(world):
    write_log(world.file, ["not json", world.message("fine", 1), "[1, 2]", '{"type": "assistant"'])
    audit = world.sync()["claude_code"]
    assert counts(audit) == (1, 0, 1, 0) and audit.malformed_lines == 3
    rows = world.ledger.quarantine().orderBy("line_no").collect()
    assert [r["line_no"] for r in rows] == [0, 2, 3]
    assert rows[0].asDict().keys() == set(QUARANTINE.names)
    assert {len(r["raw_md5"]) for r in rows} == {32}


def test_replayed_session_keeps_the_first_row(world):
    first = [assistant(f"m{i}", f"r{i}", {"input_tokens": 10 * i}, sessionId="old") for i in (1, 2)]
    replay = [assistant(f"m{i}", f"r{i}", {"input_tokens": 10 * i}, sessionId="new") for i in (1, 2, 3)]
    write_log(f"{world.base}/projects/p/1.jsonl", first)
    assert counts(world.sync()["claude_code"]) == (1, 0, 2, 0)
    write_log(f"{world.base}/projects/p/2.jsonl", replay)
    assert counts(world.sync()["claude_code"]) == (1, 1, 1, 2)
    sessions = {r["dedupe_key"]: r["session_id"] for r in world.ledger.events().collect()}
    assert sessions == {"cc:m1:r1": "old", "cc:m2:r2": "old", "cc:m3:r3": "new"}


def test_replay_within_one_batch(world):
    write_log(f"{world.base}/projects/p/2.jsonl", [assistant("m", "r", {}, sessionId="later")])
    write_log(f"{world.base}/projects/p/1.jsonl", [assistant("m", "r", {}, sessionId="earlier")] * 2)
    assert counts(world.sync()["claude_code"]) == (2, 0, 1, 2)
    assert world.ledger.events().first()["session_id"] == "earlier"


def rollout(n):
    lines = [session_meta("sess", "/w"), turn_context("gpt-5")]
    return lines + [totals(f"2026-01-15T10:00:{i:02d}Z", 100 * i, 0, i, 0) for i in range(1, n + 1)]


def turns(ledger):
    columns = ("session_id", "model", "project", "ts", *TOKEN_COLS)
    return sorted(tuple(r[c] for c in columns) for r in ledger.turns().collect())


def test_grown_running_totals_equal_one_read(spark, tmp_path):
    grown = Setup(spark, str(tmp_path / "grown"))
    path = f"{grown.base}/sessions/2026/01/15/r.jsonl"
    write_log(path, rollout(3))
    assert counts(grown.sync()["codex"]) == (1, 0, 3, 0)
    append(path, "\n".join(rollout(6)[5:]) + "\n")
    assert counts(grown.sync()["codex"]) == (1, 0, 3, 0)

    once = Setup(spark, str(tmp_path / "once"))
    write_log(f"{once.base}/sessions/2026/01/15/r.jsonl", rollout(6))
    once.sync()
    assert turns(grown.ledger) == turns(once.ledger)
    assert [t[4] for t in turns(grown.ledger)] == [100] * 6
    # A rotation re-reads everything and finds the same keys.
    touch(path, -100)
    assert counts(grown.sync()["codex"]) == (1, 0, 0, 6)


def test_paging_gives_the_same_ledger(spark, tmp_path):
    world = Setup(spark, str(tmp_path))
    for i in range(5):
        write_log(f"{world.base}/projects/p/{i}.jsonl", [world.message(f"m{i // 2}", i)])
    write_log(f"{world.base}/sessions/r.jsonl", rollout(2))
    audit = world.sync(files_per_batch=2)
    assert counts(audit["claude_code"]) == (5, 0, 3, 2)
    assert counts(audit["codex"]) == (1, 0, 2, 0)
    assert world.stored()["m0"] == 0 and world.stored()["m1"] == 2
    batches = {r[0] for r in world.ledger.events().select("ingest_batch").collect()}
    assert batches == {0, 1, 2}
    assert counts(world.sync()["claude_code"]) == (0, 5, 0, 0)


def test_interrupted_commit_is_repeated_without_duplicates(world, monkeypatch):
    write_log(world.file, [world.message("a", 10)])

    def fail(*_):
        raise RuntimeError("lost before the state was written")

    with monkeypatch.context() as patch, pytest.raises(RuntimeError):
        patch.setattr(Writer, "append_state", fail)
        world.sync()
    # Events and state come into force together.
    assert world.stored() == {} and world.ledger.scan_state().count() == 0
    assert counts(world.sync()["claude_code"]) == (1, 0, 1, 0)
    assert world.stored() == {"a": 10}


def test_incomplete_read_is_a_failure_and_keeps_the_state(world, monkeypatch):
    import turnledger.plans.sync as sync_module

    write_log(world.file, [world.message("a", 10)])
    write_log(f"{world.base}/projects/p/t.jsonl", [world.message("b", 20)])
    real = sync_module.read_lines
    with monkeypatch.context() as patch:
        patch.setattr(
            sync_module, "read_lines", lambda s, u: real(s, [x for x in u if "t.jsonl" not in x])
        )
        audit = world.sync()["claude_code"]
    assert (audit.files_scanned, audit.files_failed, audit.new_events) == (1, 1, 1)
    assert world.ledger.scan_state().count() == 1
    audit = world.sync()["claude_code"]
    assert (audit.files_scanned, audit.new_events) == (1, 1)
    assert world.stored() == {"a": 10, "b": 20}


def test_vanished_file_is_a_failure(world, monkeypatch):
    import turnledger.plans.sync as sync_module

    write_log(world.file, [world.message("a", 10)])
    gone = write_log(f"{world.base}/projects/p/gone.jsonl", [world.message("b", 20)])
    real = sync_module._read_present

    def remove_first(spark, uris):
        if os.path.exists(gone):
            os.unlink(gone)
        return real(spark, uris)

    with monkeypatch.context() as patch:
        patch.setattr(sync_module, "_read_present", remove_first)
        audit = world.sync()["claude_code"]
    assert (audit.files_scanned, audit.files_failed, audit.new_events) == (1, 1, 1)


def test_classification(spark, tmp_path):
    manifest = spark.createDataFrame(
        [("new", 5, 1), ("same", 5, 1), ("grown", 9, 2), ("short", 3, 2), ("old", 5, 0), ("odd", 5, 2)],
        "source_file string, size bigint, mtime_ms bigint",
    )
    state = spark.createDataFrame(
        [(n, 5, 1, 9 if n == "odd" else 4, 0) for n in ("same", "grown", "short", "old", "odd")],
        "source_file string, size bigint, mtime_ms bigint, byte_offset bigint, scanned_at bigint",
    )
    got = {r["source_file"]: (r["status"], r["start_offset"]) for r in classify(manifest, state).collect()}
    assert got == {
        "new": ("scanned", 0),
        "same": ("skipped", 4),
        "grown": ("scanned", 4),
        "short": ("scanned", 0),
        "old": ("scanned", 0),
        "odd": ("scanned", 0),
    }


def test_odd_names_and_stored_schema(spark, tmp_path):
    world = Setup(spark, str(tmp_path))
    path = f"{world.base}/projects/-w-a b+c%20[d]{{e}}é/s%41 +.jsonl"
    write_log(path, [world.message("a", 10)])
    listed = [r["source_file"] for r in list_files(spark, world.sources).collect()]
    assert listed == [path]
    world.sync()
    row = world.ledger.events().first()
    assert (row["source_file"], row["session_id"]) == (path, "s%41 +")
    assert row["project"] == "/w/a b+c%20[d]{e}é"
    assert world.ledger.events().columns == USAGE_EVENTS.names
    assert set(TURN_COLS) <= set(world.ledger.turns().columns)
    assert "source_file" not in TURN_COLS and len(TURN_COLS) == 11


def test_nothing_to_read(world):
    audit = world.sync()
    assert not audit["claude_code"].detected and not audit["codex"].detected
    assert world.ledger.events().count() == 0 and world.ledger.turns().count() == 0
