"""Very many log files: listed and opened by tasks, none of them named in the driver."""

import os
from pathlib import Path

import pytest
from helpers import append, assistant, session_meta, totals, turn_context, write_log
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

import turnledger.plans.sync as sync_module
from turnledger.plans.sync import sync
from turnledger.sources import listing
from turnledger.sources.files import Source, list_files, literal_path
from turnledger.sources.ledger import Ledger

pytestmark = pytest.mark.usefixtures("interpreted")


def write_world(base):
    """Logs of two tools: a byte order mark, a line that is no UTF-8, an unfinished line, an empty file."""
    for i in range(5):
        lines = [turn_context(f"m{i}"), totals("2026-01-15T10:00:00Z", 10 * i, 0, 1, 0), "{bad", session_meta(f"s{i}", "/w")]
        write_log(f"{base}/sessions/2026/01/{i}/r-{i}.jsonl", lines)
    for i, data in enumerate((b"\xef\xbb\xbf", b"", b"{\xff\xfe}\n", b"\xef\xbb\xbf\n")):
        path = Path(write_log(f"{base}/projects/p {i}%41/s{i}.jsonl", [assistant(f"a{i}", None, {"input_tokens": i}, timestamp=9), "[1]"]))
        path.write_bytes(data + path.read_bytes() + b'{"unfinished')
    Path(f"{base}/projects/p 0%41/mark.jsonl").write_bytes(b"\xef\xbb\xbf")
    Path(f"{base}/projects/p 0%41/empty.jsonl").touch()
    return [Source("claude_code", (f"{base}/projects",)), Source("codex", (f"{base}/sessions", f"{base}/absent"))]


def stored(ledger, base):
    """Everything in a ledger, with paths below ``base`` only."""
    def below(df):
        own = F.regexp_replace("source_file", f"^{base}", "")
        return sorted(map(str, df.withColumn("source_file", own).drop("mtime_ms", "scanned_at").collect()))

    return below(ledger.events()), below(ledger.quarantine()), below(ledger.file_states())


def synced(spark, base, monkeypatch, named, steps=2, **kwargs):
    taken = []
    real = sync_module.read_lines
    with monkeypatch.context() as patch:
        patch.setattr(sync_module, "NAMED_FILES", named)
        patch.setattr(sync_module, "read_lines", lambda s, uris: taken.extend(uris) or real(s, uris))
        sources, ledger = write_world(str(base)), Ledger(spark, f"{base}/ledger")
        for step in range(steps):
            if step:
                append(f"{base}/sessions/2026/01/3/r-3.jsonl", totals("2026-01-15T11:00:00Z", 99, 0, 1, 0) + "\n", 3)
            result = sync(spark, sources, ledger.path, scanned_at=7, **kwargs)
            assert [a.files_failed for a in result.tools] == [0] * len(result.tools)
    return stored(ledger, str(base)), taken


def test_files_that_tasks_open_give_what_named_files_give(spark, tmp_path, monkeypatch):
    # The same path, for the keys of lines without an id hold it.
    base = tmp_path / "logs"
    want, taken = synced(spark, base, monkeypatch, 100)
    assert len(taken) == 10
    base.rename(tmp_path / "before")
    found, taken = synced(spark, base, monkeypatch, 2)
    assert taken == []
    assert found == want
    assert len(want[0]) == 10 and len(want[1]) == 10


def test_files_that_the_driver_does_not_name_are_one_commit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sync_module, "FILES_PER_BATCH", 2)
    found, _ = synced(spark, tmp_path, monkeypatch, 2, steps=1)
    assert all("ingest_batch=0" in row for row in found[0])


def test_a_store_that_only_spark_opens_is_paged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sync_module, "FILES_PER_BATCH", 4)
    monkeypatch.setattr(sync_module, "can_open", lambda uri: False)
    found, taken = synced(spark, tmp_path, monkeypatch, 2, steps=1)
    assert len(taken) == 10 and {f"ingest_batch={n}" in "".join(found[0]) for n in range(3)} == {True}


@pytest.mark.parametrize("dealt", [1, 3, 1_000])
def test_listing(spark, tmp_path, monkeypatch, dealt):
    """Names and times are those of Spark's listing, which the driver no longer makes."""
    monkeypatch.setattr(listing, "DEALT_FOLDERS", dealt)
    root = tmp_path / "root %41+é"
    names = [
        "p/x.jsonl", "p/_h.jsonl", "p/.h.jsonl", "p/_h=1.jsonl", "_hid/x.jsonl", "_hid=1/x.jsonl", ".hid/x.jsonl",
        "_metadata/x.jsonl", "p/_metadata.jsonl", "p/x.txt", "p/b c%20+é[1]{2}/q?.jsonl", "p/d.jsonl/in.jsonl",
        "p/c.jsonl._COPYING_", *(f"deep/{i}/m/f.jsonl" for i in range(6)),
    ]
    for i, name in enumerate(names):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * (i + 1))
        os.utime(path, ns=(0, 1_700_000_000_123_456_789 + i * 1_000_000))
    (root / "p/empty.jsonl").touch()
    (root / "p/link.jsonl").symlink_to(root / "p/x.jsonl")
    (root / "linked").symlink_to(root / "p")
    (root / "p/broken.jsonl").symlink_to(root / "p/none")
    load = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    files = load.load(literal_path(str(root))).select("path", "length", F.unix_millis("modificationTime"))
    want = {(r[0].removeprefix("file:"), r[1], r[2]) for r in files.collect()}

    def refused(*_, **__):
        raise AssertionError("listed by the driver")

    with monkeypatch.context() as patch:
        patch.setattr(DataFrameReader, "load", refused)
        listed = list_files(spark, [Source("claude_code", (str(root), f"{root}/absent"))])
    assert {(r["source_file"], r["size"], r["mtime_ms"]) for r in listed.collect()} == want
    assert listed.count() == len(want) == 18
