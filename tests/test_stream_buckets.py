"""Streaming deltas take the sessions of a bucket at once."""

from helpers import events, usage

from turnledger.operators.deltas import turn_usage
from turnledger.schema import TURN_COLS, USAGE_EVENTS
from turnledger.streaming.deltas import turn_stream


def test_state_has_a_row_per_bucket_not_per_session(spark, tmp_path):
    rows = [
        usage(f"k{s}-{t}", "codex", f"s{s}", 10 * t, [2**60 + t * (s + 1), t, 0, 5 - t, 1], line_no=t, cumulative=s % 3 > 0)
        for s in range(30)
        for t in range(6)
    ]
    whole = events(spark, rows)
    for low in (0, 30):
        piece = whole.filter(f"ts >= {low} AND ts < {low + 30}")
        piece.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(USAGE_EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = (
        turn_stream(stream, buckets=4)
        .writeStream.format("parquet")
        .option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    done = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(done) == 2
    assert done[-1]["stateOperators"][0]["numRowsTotal"] <= 4
    got = spark.read.parquet(f"{tmp_path}/out").select("line_no", *TURN_COLS)
    want = turn_usage(whole).select("line_no", *TURN_COLS)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
