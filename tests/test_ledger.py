"""The commit log: atomic commits, one writer, merged parts."""

import os

import pytest
from helpers import events, usage

from turnledger.schema import FILE_STATE, QUARANTINE
from turnledger.sources import ledger as stored
from turnledger.sources.commits import KEPT_COMMITS, SecondWriter
from turnledger.sources.ledger import Ledger, bucket_bits

pytestmark = pytest.mark.usefixtures("interpreted")


def row(key, i=0, batch=0):
    return usage(key, "codex", "s", i, (i, 0, 0, 0, 0), i, ingest_batch=batch)


def state(spark, path, size, **context):
    values = {"source_file": path, "size": size, "mtime_ms": size, "byte_offset": size, "scanned_at": 0} | context
    return spark.createDataFrame([tuple(values.get(n) for n in FILE_STATE.names)], FILE_STATE)


def files_read(df):
    return len(df.inputFiles())


def test_parts_stay_few_over_many_commits(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    seen = []
    for i in range(50):
        with ledger.commit() as writer:
            assert writer.append_events(events(spark, [row(f"k{i}", i), row(f"k{i // 2}", i)])) == {"codex": 1}
            if i % 2 or i > 44:
                writer.append_state(state(spark, f"f{i % 3}", i, n_lines=i))
            if i % 5 == 0:
                bad = [("f", i % 4, "d", "damaged")]
                writer.append_quarantine(spark.createDataFrame(bad, QUARANTINE))
        commit = ledger.log.latest()
        seen.append(max(len(commit.events), len(commit.state), len(commit.quarantine)))
        assert commit.number == i
    assert max(seen) <= stored.MAX_PARTS
    assert files_read(ledger.events()) <= 2 * stored.MAX_PARTS
    assert sorted(r["dedupe_key"] for r in ledger.events().collect()) == sorted(f"k{i}" for i in range(50))
    assert {r["source_file"]: r["size"] for r in ledger.scan_state().collect()} == {"f0": 48, "f1": 49, "f2": 47}
    assert {r["n_lines"] for r in ledger.file_states().collect()} == {47, 48, 49}
    assert sorted(r["line_no"] for r in ledger.quarantine().collect()) == [0, 1, 2, 3]
    # Merged parts and old log files go after a while.
    assert len([n for n in os.listdir(tmp_path / "l/log") if n.endswith(".json")]) == KEPT_COMMITS + 1
    assert len(os.listdir(tmp_path / "l/events")) <= stored.MAX_PARTS + stored.MERGED_PARTS + KEPT_COMMITS


def test_of_two_writers_one_is_refused(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    with pytest.raises(SecondWriter), ledger.commit() as late:
        late.append_events(events(spark, [row("late")]))
        with Ledger(spark, ledger.path).commit() as early:
            early.append_state(state(spark, "f", 1))
    assert ledger.events().count() == 0 and ledger.scan_state().count() == 1
    with ledger.commit() as again:
        assert again.append_events(events(spark, [row("late")])) == {"codex": 1}
    assert ledger.events().count() == 1


def test_a_claim_left_behind_is_stepped_over(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    os.makedirs(tmp_path / "l/log")
    (tmp_path / "l/log/0000000000.claim").touch()
    with ledger.commit() as writer:
        assert writer.batch == 1
        writer.append_state(state(spark, "f", 1))
    assert ledger.log.latest().number == 1 and ledger.scan_state().count() == 1


def test_an_interrupted_commit_is_not_seen(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    with pytest.raises(RuntimeError, match="lost"), ledger.commit() as writer:
        writer.append_events(events(spark, [row("a"), row("b")]))
        raise RuntimeError("lost before the end")
    assert ledger.events().count() == 0 and ledger.log.latest().number == -1
    with ledger.commit() as writer:
        writer.append_events(events(spark, [row("b"), row("c")]))
    # The folder of the lost commit has been overwritten.
    assert sorted(r["dedupe_key"] for r in ledger.events().collect()) == ["b", "c"]


def test_a_commit_takes_events_once(spark, tmp_path):
    with pytest.raises(RuntimeError, match="already"), Ledger(spark, str(tmp_path / "l")).commit() as writer:
        writer.append_events(events(spark, [row("a")]))
        writer.append_events(events(spark, [row("b")]))


def test_a_reader_keeps_its_commit(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    with ledger.commit() as writer:
        writer.append_events(events(spark, [row("a")]))
    before = ledger.events()
    with ledger.commit() as writer:
        writer.append_events(events(spark, [row("b")]))
    assert before.count() == 1 and ledger.events().count() == 2


def test_a_ledger_of_the_time_before_the_log(spark, tmp_path):
    path = str(tmp_path / "l")
    old = events(spark, [row("a", 1, 3), row("b", 2, 3)]).withColumn("key_bucket", stored.key_bucket(4))
    old.write.partitionBy("tool", "key_bucket").parquet(f"{path}/events")
    plain = spark.createDataFrame([("f", 1, 1, 1, 0, 3)], "source_file string, size bigint, mtime_ms bigint, "
                                  "byte_offset bigint, scanned_at bigint, ingest_batch bigint")  # fmt: skip
    plain.write.parquet(f"{path}/scan_state")
    ledger = Ledger(spark, path)
    assert ledger.events().count() == 2 and ledger.file_states().first()["n_lines"] is None
    with ledger.commit() as writer:
        assert writer.batch == 4
        assert writer.append_events(events(spark, [row("b", 5, 4), row("c", 6, 4)])) == {"codex": 1}
    assert sorted(r["dedupe_key"] for r in ledger.events().collect()) == ["a", "b", "c"]


def test_bucket_bits():
    assert [bucket_bits(n) for n in (0, 1, 250_000, 250_001, 10**6, 10**12)] == [0, 0, 0, 1, 2, 14]
