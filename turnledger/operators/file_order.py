"""Line numbers, byte offsets and carried context in file order.

A file may hold a large part of all lines, so nothing here orders a whole file in one
task. Lines are ordered inside the split they were read from; what crosses a split
border (line count, bytes, last model, first session) is carried over one summary row
per split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions.paths import file_stem, plain_path, project_from_path
from turnledger.schema import FILE_CONTEXT
from turnledger.sources.dialects.common import EVENT, MODEL, SESSION

SPLIT_KEY = ("file_path", "split_start")

# --- fixed values -----------------------------------------------------------
BYTE_ORDER_MARK_BYTES = 3
# ----------------------------------------------------------------------------


def _is(outcome: str) -> Column:
    return F.col("outcome") == outcome


def split_summaries(facts: DataFrame) -> DataFrame:
    """One row per split, combined inside the tasks that read it."""
    session = F.struct("session_id", "project")
    return facts.groupBy(*SPLIT_KEY).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("line_bytes").alias("n_bytes"),
        F.count_if(_is(EVENT)).alias("n_events"),
        F.max_by(F.when(_is(MODEL), F.col("model")), F.when(_is(MODEL), F.col("row_id"))).alias(
            "last_model"
        ),
        F.min_by(F.when(_is(SESSION), session), F.when(_is(SESSION), F.col("row_id"))).alias(
            "first_session"
        ),
    )


def carry_over_splits(summaries: DataFrame) -> DataFrame:
    """What each split inherits from the earlier splits of its file, and what the whole
    file says: its bytes as read and its first session."""
    by_file = Window.partitionBy("file_path").orderBy("split_start")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("bigint")
    return summaries.select(
        *SPLIT_KEY,
        F.coalesce(F.sum("n_lines").over(before), zero).alias("lines_before"),
        F.coalesce(F.sum("n_bytes").over(before), zero).alias("bytes_before"),
        F.coalesce(F.sum("n_events").over(before), zero).alias("events_before"),
        F.last("last_model", ignorenulls=True).over(before).alias("model_before"),
        F.first("first_session", ignorenulls=True).over(whole).alias("file_session"),
        F.sum("n_bytes").over(whole).alias("file_bytes"),
    )


def with_context(files: DataFrame) -> DataFrame:
    """``files`` with the columns that tell where reading began; by default at the start."""
    if "read_from" in files.columns:
        return files
    none = {f.name: F.lit(None).cast(f.dataType) for f in FILE_CONTEXT.fields}
    return files.withColumns({"read_from": F.lit(0).cast("bigint"), **none})


def in_file_order(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Place every line in its file.

    Adds ``line_no`` (from 0), ``start``/``end`` byte offsets, ``size`` and
    ``start_offset`` of the file, ``sequence`` (usage lines before this one),
    ``carried_model``, the file's first ``file_session``, and what its path says.

    ``files`` may say that reading began at ``read_from`` and what was before; positions and
    context then go on from there.

    The reader strips a byte order mark; the missing bytes show as a total below the
    file size and are put back.
    """
    files = with_context(files)
    # Never null, so no null test on the decoded path is pushed down to every line.
    source_file = F.coalesce(plain_path(F.col("file_path")), F.lit(""))
    context = (
        carry_over_splits(split_summaries(facts))
        .withColumn("source_file", source_file)
        .join(files.select("source_file", "size", "start_offset", "read_from", *FILE_CONTEXT.names), "source_file")
        .withColumns(
            {
                "lines_before": F.col("lines_before") + F.coalesce("n_lines", F.lit(0)),
                "bytes_before": F.col("bytes_before") + F.col("read_from"),
                "events_before": F.col("events_before") + F.coalesce("n_events", F.lit(0)),
                "model_before": F.coalesce("model_before", "last_model"),
                "file_session": F.coalesce("first_session", "file_session"),
                "file_stem": file_stem(F.col("source_file")),
                "file_project": project_from_path(F.col("source_file")),
            }
        )
    )
    # The lines are partitioned by split for the window already. Hashing the context, one
    # row per split, joins them in place; the size estimate of compressed facts would
    # rather broadcast the lines.
    in_split = Window.partitionBy(*SPLIT_KEY).orderBy("row_id")
    so_far = in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = facts.withColumns(
        {
            "_row": F.row_number().over(in_split),
            "_bytes": F.sum("line_bytes").over(so_far),
            "_events": F.count_if(_is(EVENT)).over(so_far),
            "_model": F.last(F.when(_is(MODEL), F.col("model")), ignorenulls=True).over(so_far),
        }
    ).join(context.hint("shuffle_hash"), [*SPLIT_KEY])
    marked = (F.col("read_from") == 0) & (F.col("file_bytes") < F.col("size"))
    mark = F.when(marked, BYTE_ORDER_MARK_BYTES).otherwise(0)
    end = F.col("bytes_before") + F.col("_bytes") + mark
    first_line = (F.col("lines_before") + F.col("_row")) == 1
    return placed.select(
        *facts.columns,
        (F.col("lines_before") + F.col("_row") - 1).alias("line_no"),
        F.when(first_line, F.lit(0).cast("bigint")).otherwise(end - F.col("line_bytes")).alias("start"),
        end.alias("end"),
        "size",
        "start_offset",
        (F.col("events_before") + F.col("_events") - F.when(_is(EVENT), 1).otherwise(0)).alias(
            "sequence"
        ),
        F.coalesce("_model", "model_before").alias("carried_model"),
        "file_session",
        "source_file",
        "file_stem",
        "file_project",
    )


def complete_lines(placed: DataFrame) -> DataFrame:
    """Lines that end in a line break.

    The line break assumed for an unterminated last line lies past the file size, as
    does anything appended after the file was listed.
    """
    return placed.filter(F.col("end") <= F.col("size"))


def new_lines(placed: DataFrame) -> DataFrame:
    """Lines past the stored offset."""
    return placed.filter(F.col("start") >= F.col("start_offset"))


def new_complete_lines(placed: DataFrame) -> DataFrame:
    return new_lines(complete_lines(placed))


def consumed_lines(placed: DataFrame) -> DataFrame:
    """Per file, the end of its complete lines and the context they leave to later ones.

    ``placed`` are complete lines in file order with the columns of ``in_file_order``.
    """
    is_event = F.when(_is(EVENT), 1).otherwise(0)
    return placed.groupBy("source_file").agg(
        F.max("end").alias("consumed"),
        (F.max("line_no") + 1).alias("n_lines"),
        F.max(F.col("sequence") + is_event).alias("n_events"),
        F.max_by("carried_model", "line_no").alias("last_model"),
        # A session line that was not complete at the time of reading does not count.
        F.max(F.when(_is(SESSION), F.col("file_session"))).alias("first_session"),
    )
