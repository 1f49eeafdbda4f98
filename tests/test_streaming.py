import pytest
from helpers import assistant, events, usage, write_log

from turnledger.operators.deltas import turn_usage
from turnledger.schema import TOKEN_COLS
from turnledger.sources.ledger import Ledger
from turnledger.streaming.deltas import turn_stream
from turnledger.streaming.ingest import stream_ingest, usage_stream


def test_closed_files_and_replays(spark, tmp_path):
    folder, ledger = f"{tmp_path}/in", Ledger(spark, f"{tmp_path}/ledger")

    def run():
        stream_ingest(spark, "claude_code", folder, ledger.path, f"{tmp_path}/ck").awaitTermination()
        return {r["dedupe_key"]: r["session_id"] for r in ledger.events().collect()}

    write_log(f"{folder}/p/1.jsonl", [assistant("a", "r", {}, sessionId="one"), "{bad"])
    assert run() == {"cc:a:r": "one"}
    # The last line of a closed file counts without a line break.
    write_log(
        f"{folder}/p/2.jsonl",
        [assistant("a", "r", {}, sessionId="two"), assistant("b", "r", {}, sessionId="two")],
        end="",
    )
    want = {"cc:a:r": "one", "cc:b:r": "two"}
    assert run() == want
    assert run() == want
    assert ledger.quarantine().count() == 1


def test_replays_within_the_watermark_are_dropped(spark, tmp_path):
    folder = f"{tmp_path}/in"
    day = 86_400

    def run():
        (
            usage_stream(spark, "claude_code", folder, "2 days")
            .writeStream.format("parquet")
            .option("path", f"{tmp_path}/out")
            .option("checkpointLocation", f"{tmp_path}/ck")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
        rows = spark.read.parquet(f"{tmp_path}/out").select("dedupe_key", "session_id", "project").collect()
        return sorted(map(tuple, rows))

    def said(name, at, session=None):
        return assistant(name, "r", {"input_tokens": 1}, timestamp=1_700_000_000 + at, sessionId=session)

    write_log(f"{folder}/projects/-w/1.jsonl", [said("a", 0, "one"), said("b", 0), "{bad"])
    first = [("cc:a:r", "one", "/w"), ("cc:b:r", "1", "/w")]
    assert run() == first
    # A late replay inside two days, and a new message that moves time on.
    write_log(f"{folder}/projects/-w/2.jsonl", [said("a", 0, "two"), said("c", 10 * day)])
    second = sorted([*first, ("cc:c:r", "2", "/w")])
    assert run() == second
    # Behind the watermark rows are dropped; a repeat of the newest one is known.
    write_log(f"{folder}/projects/-w/3.jsonl", [said("d", 0), said("c", 10 * day, "again")])
    assert run() == second
    with pytest.raises(ValueError, match="codex"):
        usage_stream(spark, "codex", folder, "1 day")


def test_stream_deltas_keep_large_counters(spark, tmp_path):
    values = [2**53 + 1, 2**53 + 4]
    rows = [
        usage(f"k{i}", "codex", "s", i, (v, 0, 0, 0, 0), i, cumulative=True) for i, v in enumerate(values)
    ]
    events(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events(spark, []).schema).parquet(f"{tmp_path}/in")
    (
        turn_stream(stream)
        .writeStream.format("parquet")
        .option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/ck")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("line_no").collect()
    assert [r["input_tokens"] for r in got] == [2**53 + 1, 3]


def test_stream_deltas_match_the_batch_view(spark, tmp_path):
    rows = [
        usage(f"k{i}", "codex", f"s{i % 3}", i, tuple((i * 37 * (c + 3)) % 101 for c in range(5)), i, cumulative=i % 4 > 0)
        for i in range(60)
    ]
    df = events(spark, rows)
    for part in range(3):
        df.filter(f"line_no BETWEEN {part * 20} AND {part * 20 + 19}").coalesce(1).write.mode(
            "append"
        ).parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    (
        turn_stream(stream)
        .writeStream.format("parquet")
        .option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/ck")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    columns = ["line_no", *TOKEN_COLS]

    def as_set(frame):
        return {tuple(r) for r in frame.select(*columns).collect()}

    got = as_set(spark.read.parquet(f"{tmp_path}/out"))
    assert got == as_set(turn_usage(df)) and len(got) == 60
