"""Usage rows straight from log folders, without a ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.functions.paths import plain_path
from turnledger.operators.file_order import BYTE_ORDER_MARK_BYTES, new_complete_lines
from turnledger.operators.normalize import place_and_bind, read_facts
from turnledger.operators.pinning import pin
from turnledger.session import configure
from turnledger.sources.files import Source, list_sources, outermost_roots, read_lines


def read_logs(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """Every complete line of the logs: ``outcome``, usage columns, place in the file.

    All sources of a tool are read; a root that does not exist adds nothing. A file that
    was listed but did not arrive whole raises ``RuntimeError``.
    """
    configure(spark)
    listed, present = list_sources(spark, sources)
    # Written, so the path tests of the listing are not repeated on every line.
    files = pin(listed.withColumn("start_offset", F.lit(0).cast("bigint")), "files")
    lines: dict[str, DataFrame] = {}
    for (tool, glob), roots in outermost_roots(present).items():
        own = read_lines(spark, roots, glob)
        lines[tool] = lines[tool].unionByName(own) if tool in lines else own
    if not lines:
        none = spark.createDataFrame([], _LINES)
        return new_complete_lines(place_and_bind(read_facts({"claude_code": none}), files))
    facts = read_facts(lines)
    _check_arrival(facts, files)
    return new_complete_lines(place_and_bind(facts, files))


_LINES = (
    "file_path string, mtime_ms bigint, split_start bigint, row_id bigint, line_bytes bigint, value string"
)


def _check_arrival(facts: DataFrame, files: DataFrame) -> None:
    """Compare the bytes read with the sizes listed."""
    arrived = facts.groupBy(plain_path(F.col("file_path")).alias("source_file")).agg(
        F.sum("line_bytes").alias("read_bytes")
    )
    lost = (
        files.join(arrived, "source_file", "left")
        .where(F.coalesce("read_bytes", F.lit(0)) < F.col("size") - BYTE_ORDER_MARK_BYTES)
        .select("source_file")
        .limit(5)
        .collect()
    )
    if lost:
        raise RuntimeError("incomplete read: " + ", ".join(row["source_file"] for row in lost))
