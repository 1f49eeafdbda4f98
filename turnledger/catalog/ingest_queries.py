"""Registered queries over logs derived from the sample tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.catalog.adapters import EVENT_CUMULATIVE, table, usage_from_events
from turnledger.catalog.queries import SINCE, UNTIL
from turnledger.catalog.logs import (
    TEXT_GLOB,
    overwrite_logs,
    write_all_logs,
    write_entry_logs,
    write_great_count_logs,
    write_message_logs,
    write_running_total_logs,
)
from turnledger.operators.deltas import turn_usage
from turnledger.operators.pinning import pin
from turnledger.plans.adhoc import ROW_CAP, query, register_views
from turnledger.plans.coverage import all_unpriced_models, coverage, ledger_meta
from turnledger.plans.read_logs import read_logs
from turnledger.plans.reports import daily_report
from turnledger.plans.sync import sync
from turnledger.schema import TOKEN_COLS, TURN_COLS
from turnledger.session import configure, scratch_path
from turnledger.sources.dialects import cumulative_tools
from turnledger.sources.files import classify, discover, list_files
from turnledger.sources.ledger import Ledger
from turnledger.sources.pricing import bundled_pricing
from turnledger.streaming.deltas import turn_stream
from turnledger.streaming.ingest import stream_ingest, usage_stream

Query = Callable[[SparkSession, str], DataFrame]

SCANNED_AT = 1_750_000_000
# Micro-batches in which replays arrive, and time slices of running totals.
REPLAY_BATCHES = 4
SLICES = 3


def _events_of(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("outcome") == "event")


def parse_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-message logs: counts, key, time, session, project fallbacks."""
    rows = read_logs(spark, [write_message_logs(configure(spark), sf_dir)])
    return _events_of(rows).select(
        "dedupe_key", "session_id", "model", "ts", "is_sidechain", "project", *TOKEN_COLS
    )


def _without_hash(key: str = "dedupe_key"):
    return F.regexp_extract(key, r"^(codex:.*:\d+):[0-9a-f]{8}$", 1).alias("turn_key")


def parse_b_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals with session, project, model and sequence from the file."""
    rows = read_logs(spark, [write_running_total_logs(configure(spark), sf_dir)])
    return _events_of(rows).select(
        _without_hash(), "session_id", "model", "ts", "project", *TOKEN_COLS
    )


def parse_b_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same logs through the per-turn view."""
    rows = read_logs(spark, [write_running_total_logs(configure(spark), sf_dir)])
    events = _events_of(rows).withColumn("ingest_batch", F.lit(0).cast("bigint"))
    return turn_usage(events, cumulative_tools()).select(*TURN_COLS)


def parse_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat entries: time picks, model fallbacks, keyless lines."""
    rows = read_logs(spark, [write_entry_logs(configure(spark), sf_dir)])
    key = F.when(F.col("dedupe_key").startswith("oc:doc-"), F.col("dedupe_key")).otherwise(
        F.when(F.length("dedupe_key") == 35, "oc:")
    )
    return _events_of(rows).select(
        key.alias("dedupe_key"), "session_id", "model", "ts", "project", *TOKEN_COLS
    )


def parse_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of up to 2^53 through the daily report with its totals, where sums stop at 2^63 - 1,
    and the lines beyond it as one more row."""
    rows = read_logs(spark, [write_great_count_logs(configure(spark), sf_dir)])
    events = _events_of(rows).withColumn("ingest_batch", F.lit(0).cast("bigint"))
    report = daily_report(turn_usage(events, cumulative_tools()), bundled_pricing(spark))
    columns = ["date", "tool", "input_tokens", "output_tokens", "total_tokens"]
    damaged = rows.filter(F.col("outcome") == "malformed").groupBy("outcome", "tool").agg(
        F.count(F.lit(1)).alias("n")
    )
    damaged = damaged.select(
        F.col("outcome").alias("date"), "tool", F.col("n").alias("input_tokens"),
        F.lit(0).cast("bigint").alias("output_tokens"), F.col("n").alias("total_tokens"),
    )
    return report.rows.select(*columns).unionByName(report.totals.select(*columns)).unionByName(damaged)


def malformed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per tool and outcome."""
    rows = read_logs(spark, write_all_logs(configure(spark), sf_dir))
    return rows.groupBy("tool", "outcome").agg(F.count(F.lit(1)).alias("n_lines"))


def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers and byte offsets: the lines of every file tile it without a gap."""
    rows = read_logs(spark, write_all_logs(configure(spark), sf_dir))
    per_file = rows.groupBy("tool", "source_file").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.countDistinct("start").alias("n_starts"),
        (F.max("line_no") + 1).alias("numbered"),
        F.sum(F.col("end") - F.col("start")).alias("n_bytes"),
        F.min("start").alias("first"),
        F.max("end").alias("last"),
        F.max("size").alias("size"),
    )
    tiled = (
        (F.col("first") == 0)
        & (F.col("last") == F.col("size"))
        & (F.col("n_bytes") == F.col("size"))
        & (F.col("numbered") == F.col("n_lines"))
        & (F.col("n_starts") == F.col("n_lines"))
    )
    return per_file.groupBy("tool").agg(
        F.sum("n_lines").alias("n_lines"), F.count_if(~tiled).alias("files_with_gaps")
    )


def _synced(spark: SparkSession, sf_dir: str):
    sources = write_all_logs(configure(spark), sf_dir)
    path = scratch_path(spark, "ledger")
    return sources, path, sync(spark, sources, path, scanned_at=SCANNED_AT)


def sync_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a first sync of all three log folders reports."""
    _, _, result = _synced(spark, sf_dir)
    return result.audit().select(
        "tool", "detected", "new_events", "duplicates_ignored", "malformed_lines", "files_failed"
    )


def append_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second sync that has lost its scan state stores nothing new."""
    sources, path, _ = _synced(spark, sf_dir)
    # Only events and quarantine are carried over, so every line is read again.
    first, kept = Ledger(spark, path), scratch_path(spark, "ledger")
    with Ledger(spark, kept).commit() as writer:
        writer.append_events(first.events())
        writer.append_quarantine(first.quarantine())
    again = sync(spark, sources, kept, scanned_at=SCANNED_AT)
    stored = Ledger(spark, kept).events().groupBy("tool").agg(
        F.count(F.lit(1)).alias("stored"), F.countDistinct("dedupe_key").alias("keys")
    )
    damaged = (
        Ledger(spark, kept)
        .quarantine()
        .join(list_files(spark, sources).select("tool", "source_file"), "source_file")
        .groupBy("tool")
        .agg(F.count(F.lit(1)).alias("quarantined"))
    )
    read = again.audit().select(
        "tool", F.col("new_events").alias("added"), "malformed_lines", "files_skipped"
    )
    return (
        stored.join(read, "tool")
        .join(damaged, "tool", "left")
        .select(
            "tool", "stored", "keys", "added", "malformed_lines", "files_skipped",
            F.coalesce("quarantined", F.lit(0)).alias("quarantined"),
        )
    )


def sync_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second sync of unchanged logs reads no file."""
    sources, path, first = _synced(spark, sf_dir)
    again = sync(spark, sources, path, scanned_at=SCANNED_AT)
    before = first.audit().select("tool", F.col("files_scanned").alias("files"))
    return again.audit().join(before, "tool").select(
        "tool",
        (F.col("files_skipped") == F.col("files")).alias("all_skipped"),
        "files_scanned",
        "new_events",
        "duplicates_ignored",
        "malformed_lines",
    )


# Lines of a first sync, and those a rotated log still has.
EARLY = "turn < 3 + conv_id % 3"
LEFT = "turn < 0 OR turn >= 2 + conv_id % 2"


def _synced_twice(spark: SparkSession, sf_dir: str, before: str, after: str) -> Ledger:
    """A ledger after a sync of some lines of the logs and another of what they became."""
    logs = write_running_total_logs(configure(spark), sf_dir, before)
    path = scratch_path(spark, "ledger")
    sync(spark, [logs], path, scanned_at=SCANNED_AT)
    overwrite_logs(spark, logs, write_running_total_logs(spark, sf_dir, after))
    sync(spark, [logs], path, scanned_at=SCANNED_AT + 60)
    return Ledger(spark, path)


def _stored_totals(ledger: Ledger) -> DataFrame:
    named = F.when(F.col("session_id").startswith("conv-"), F.col("session_id")).otherwise("stem")
    sequence = F.regexp_extract("dedupe_key", r":(\d+):[0-9a-f]{8}$", 1).cast("bigint")
    return ledger.events().select(
        named.alias("session_id"), sequence.alias("sequence"), "model", "ts", "project", "line_no",
        "ingest_batch", *TOKEN_COLS,
    )


def sync_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs that grow between two syncs: the second reads what was appended, and goes on with
    numbers, model and session from what the first has stored."""
    return _stored_totals(_synced_twice(spark, sf_dir, EARLY, "true"))


def sync_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs that are cut short between two syncs are read from their start again."""
    return _stored_totals(_synced_twice(spark, sf_dir, "true", LEFT))


def state_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every file after its log has grown: one row each, with the last sync's values."""
    states = _synced_twice(spark, sf_dir, EARLY, "true").file_states()
    return states.select(
        F.regexp_extract("source_file", r"conv_id=(\d+)", 1).cast("bigint").alias("conv_id"),
        (F.col("byte_offset") == F.col("size")).alias("complete"),
        "scanned_at",
        "n_lines",
        "n_events",
        "last_model",
        F.col("first_session.session_id").alias("session_id"),
        F.col("first_session.project").alias("project"),
    )


def ledger_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-turn sums by session of a synced ledger."""
    _, path, _ = _synced(spark, sf_dir)
    return (
        Ledger(spark, path)
        .turns()
        .groupBy("tool", "session_id")
        .agg(F.count(F.lit(1)).alias("turns"), *[F.sum(c).alias(c) for c in TOKEN_COLS])
    )


def ledger_turns_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-turn view of some days of a ledger filled by three commits, from their rows and
    the stored heads of their sessions."""
    rows = pin(usage_from_events(configure(spark), sf_dir), "usage-rows")
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    for piece in range(3):
        with ledger.commit() as writer:
            writer.append_events(rows.filter(F.col("line_no") % 3 == piece))
    return ledger.turns(SINCE, UNTIL, EVENT_CUMULATIVE).select("line_no", *TURN_COLS)


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models and unpriced models per tool of a synced ledger; all files scanned."""
    sources, path, _ = _synced(spark, sf_dir)
    ledger = Ledger(spark, path)
    listed, detected = discover(spark, sources)
    rows = coverage(
        ledger.events(), ledger.scan_state(), listed, sources, bundled_pricing(spark), detected
    )
    return rows.select(
        "tool",
        "detected",
        F.size("roots").cast("bigint").alias("n_roots"),
        (F.col("log_files") == F.col("scanned_files")).alias("all_scanned"),
        F.concat_ws(",", "models").alias("models"),
        F.concat_ws(",", "unknown_models").alias("unknown_models"),
    )


def coverage_unpriced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_unpriced_models(
        usage_from_events(configure(spark), sf_dir), bundled_pricing(spark)
    )


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, path, _ = _synced(spark, sf_dir)
    ledger = Ledger(spark, path)
    return ledger_meta(ledger.events(), ledger.scan_state(), bundled_pricing(spark))


def incremental_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File classification: line items as the files, orders as their earlier state."""
    configure(spark)
    manifest = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").cast("bigint").alias("size"),
            F.unix_millis(F.max("l_shipdate").cast("timestamp")).alias("mtime_ms"),
        )
        .withColumn("source_file", F.col("l_orderkey").cast("string"))
    )
    key = F.col("o_orderkey")
    state = (
        table(spark, sf_dir, "orders")
        .join(manifest, F.col("o_orderkey") == F.col("l_orderkey"))
        .filter(key % 7 != 0)
        .select(
            "source_file",
            (F.col("size") + F.when(key % 5 == 1, 9).when(key % 5 == 2, -9).otherwise(0)).alias(
                "size"
            ),
            (F.col("mtime_ms") + F.when(key % 3 == 1, 1000).otherwise(0)).alias("mtime_ms"),
            (F.col("size") + F.when(key % 4 == 1, 50).otherwise(-3)).alias("byte_offset"),
        )
    )
    return classify(manifest, state).select("source_file", "status", "start_offset")


_BUSY = """
    WITH busy AS (
      SELECT tool, session_id, week_label(ts) AS week, local_day(ts) AS local_date,
             sum(output_tokens) AS output
      FROM turn_usage GROUP BY ALL
    )
    SELECT tool, session_id, week, cast(local_date AS string) AS day, output
    FROM busy ORDER BY output DESC, tool, session_id, day
"""


def _adhoc(spark: SparkSession, sf_dir: str, cap: int | None):
    events = usage_from_events(configure(spark), sf_dir)
    register_views(spark, events, turn_usage(events, EVENT_CUMULATIVE), tz="America/New_York")
    return query(spark, _BUSY, cap)


def adhoc_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's SQL over the named views, cut at the row cap."""
    return _adhoc(spark, sf_dir, ROW_CAP).rows


def adhoc_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same SQL with every row."""
    return _adhoc(spark, sf_dir, None).rows


def adhoc_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cap leaves: rows returned, whether there are more, and all rows."""
    result = _adhoc(spark, sf_dir, ROW_CAP)
    row = (len(result.fetch()), result.truncated(), result.total_rows())
    return spark.createDataFrame([row], "returned bigint, truncated boolean, total_rows bigint")


def stream_ingest_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-message logs through the streaming path."""
    source = write_message_logs(configure(spark), sf_dir)
    base = scratch_path(spark, "stream")
    # A replay meets its original in the same or an earlier micro-batch.
    stream_ingest(
        spark, source.tool, source.roots[0], f"{base}/ledger", f"{base}/checkpoint", TEXT_GLOB
    ).awaitTermination()
    return Ledger(spark, f"{base}/ledger").events().select(
        "dedupe_key", "session_id", "model", "ts", "is_sidechain", "project", *TOKEN_COLS
    )


def stream_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-message logs as a stream that remembers keys for a time: replays inside it are dropped."""
    source = write_message_logs(configure(spark), sf_dir)
    base = scratch_path(spark, "stream-replays")
    # Originals and replays arrive in one order or the other, a few files at a time; all lie within
    # the time remembered.
    # Every micro-batch goes through all keys remembered, so there are as many whatever the input.
    per_trigger = max(3, math.ceil(list_files(spark, [source]).count() / REPLAY_BATCHES))
    rows = usage_stream(
        spark, source.tool, source.roots[0], "400 days", TEXT_GLOB, files_per_trigger=per_trigger
    )
    (
        rows.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    # The session is that of whichever copy came first.
    return spark.read.parquet(f"{base}/out").select(
        "dedupe_key", "model", "ts", "is_sidechain", "project", *TOKEN_COLS
    )


def stream_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals arriving in three time slices, differenced with state."""
    events = usage_from_events(configure(spark), sf_dir)
    base = scratch_path(spark, "stream-deltas")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    step = (high - low) // SLICES + 1
    # A slice has this many files, whatever its size, and is a micro-batch: each of them opens and
    # commits the state of all partitions, so their number must not grow with the input.
    files = spark.sparkContext.defaultParallelism
    for i in range(SLICES):
        begin = low + i * step
        piece = events.filter((F.col("ts") >= begin) & (F.col("ts") < begin + step))
        # A session's slice stays in one file; slices follow each other in time.
        piece.repartition(files, "tool", "session_id").write.mode("append").parquet(f"{base}/in")
    arriving = (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    )
    (
        turn_stream(arriving)
        .writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{base}/out").select("line_no", *TURN_COLS)


INGEST_QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        parse_a,
        parse_b_context,
        parse_b_turns,
        parse_c,
        parse_damaged,
        malformed_counts,
        line_offsets,
        sync_audit,
        append_idempotent,
        sync_skipped,
        sync_grown,
        sync_rotated,
        state_after,
        ledger_sessions,
        ledger_turns_range,
        coverage_report,
        coverage_unpriced,
        meta,
        incremental_status,
        adhoc_capped,
        adhoc_all,
        adhoc_truncated,
        stream_ingest_logs,
        stream_replays,
        stream_deltas,
    )
}
