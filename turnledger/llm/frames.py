"""Helpers the corpus operators share on the DataFrame side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.operators.pinning import pin
from turnledger.session import scratch_path, shared_dir

__all__ = ["boxed", "identity", "pin", "prepare", "scratch_path", "shared_dir", "text_bytes", "unboxed"]

#: Rows handed to a Python worker at once, so that very long texts stay bounded.
ROWS_PER_BATCH = 1_000
BYTES_PER_BATCH = 16 << 20

#: ``[\x20\x09-\x0D]``
SPACES = " \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> SparkSession:
    """Bound what a Python worker receives at once; safe to call repeatedly."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))
    return spark


def boxed(docs: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that no name can clash with a working column."""
    return docs.select(F.struct("*").alias("row"))


def unboxed(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def text_bytes(column: str = "text") -> Column:
    """The text in UTF-8; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def identity(docs: DataFrame) -> list[Column]:
    """Columns that tell rows apart unless they agree in id and text."""
    return [docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("text_key")]


def crc_of_id() -> Column:
    """Unsigned crc32 of the id written as text; a null id counts as empty."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
