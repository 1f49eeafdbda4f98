"""Structured Streaming ingestion of closed log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnledger.functions.paths import plain_path
from turnledger.operators.normalize import bind_alone, place_and_bind, read_facts
from turnledger.operators.pinning import pin
from turnledger.schema import USAGE_COLS, USAGE_EVENTS
from turnledger.session import configure, scratch_scope
from turnledger.sources.dialects import DIALECTS
from turnledger.sources.dialects.common import EVENT, MALFORMED, line_facts
from turnledger.sources.files import LOG_GLOB, literal_path
from turnledger.sources.ledger import Ledger

# Bounds one micro-batch.
FILES_PER_TRIGGER = 1_000


def stream_ingest(
    spark: SparkSession,
    tool: str,
    folder: str,
    ledger_path: str,
    checkpoint: str,
    glob: str = LOG_GLOB,
    files_per_trigger: int = FILES_PER_TRIGGER,
) -> StreamingQuery:
    """Append the usage of files as they arrive in ``folder``.

    The file source hands over whole files once, so it suits logs that no longer grow;
    their last line counts without a line break too. A replayed micro-batch or a
    replayed session adds nothing, because the append checks keys. Growing files are
    the job of the batch sync.
    """
    lines = _arriving_lines(configure(spark), folder, glob, files_per_trigger)
    ledger = Ledger(spark, ledger_path)

    def append(batch: DataFrame, _: int) -> None:
        append_closed_files(batch, tool, ledger)

    return (
        lines.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _arriving_lines(spark: SparkSession, folder: str, glob: str, files_per_trigger: int) -> DataFrame:
    return (
        spark.readStream.format("text")
        .option("lineSep", "\n")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(literal_path(folder))
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            F.unix_millis("_metadata.file_modification_time").alias("mtime_ms"),
            F.col("_metadata.file_block_start").alias("split_start"),
            F.col("_metadata.file_size").alias("size"),
            (F.octet_length("value") + 1).cast("bigint").alias("line_bytes"),
            "value",
        )
    )


def usage_stream(
    spark: SparkSession,
    tool: str,
    folder: str,
    within: str,
    glob: str = LOG_GLOB,
    files_per_trigger: int = FILES_PER_TRIGGER,
) -> DataFrame:
    """Usage rows of files as they arrive, as a stream for any sink, each key once.

    Keys are remembered for ``within`` (``"2 days"``) of event time behind the newest row, so the
    state stays bounded however long the stream runs. A replay that comes later than that passes
    again; the append to a ledger, which checks all keys, does not have that limit. Rows older than
    the watermark are dropped. Only logs whose rows stand alone can be read this way: running totals
    need the order of their file and raise ``ValueError``.
    """
    dialect = DIALECTS[tool]
    if dialect.cumulative:
        raise ValueError(f"{tool}: rows depend on the lines before them")
    lines = _arriving_lines(configure(spark), folder, glob, files_per_trigger)
    rows = bind_alone(line_facts(lines, dialect), dialect).filter(F.col("outcome") == EVENT)
    return (
        rows.withColumn("event_time", F.timestamp_seconds("ts"))
        .withWatermark("event_time", within)
        .dropDuplicatesWithinWatermark(["dedupe_key"])
        .select(*USAGE_COLS)
    )


def append_closed_files(lines: DataFrame, tool: str, ledger: Ledger) -> None:
    """Normalise the lines of complete files and append what is new."""
    with scratch_scope(lines.sparkSession):
        numbered = lines.withColumn("row_id", F.monotonically_increasing_id())
        facts = read_facts({tool: numbered}, keep=("size",))
        files = (
            facts.groupBy("file_path")
            .agg(F.max("size").alias("size"))
            .select(
                plain_path(F.col("file_path")).alias("source_file"),
                "size",
                F.lit(0).cast("bigint").alias("start_offset"),
            )
        )
        kept = pin(
            place_and_bind(facts.drop("size"), files).filter(F.col("outcome").isin(EVENT, MALFORMED)),
            "stream-lines",
        )
        with ledger.commit() as writer:
            kept = kept.withColumn("ingest_batch", F.lit(writer.batch).cast("bigint"))
            writer.append_events(kept.filter(F.col("outcome") == EVENT).select(*USAGE_EVENTS.names))
            malformed = kept.filter(F.col("outcome") == MALFORMED)
            writer.append_quarantine(
                malformed.withColumn("reason", F.lit("not one JSON object, or a count out of range"))
            )
