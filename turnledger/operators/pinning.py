"""Cut lineage with a written table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from turnledger.session import scratch_path


def pin(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where a value depends on the physical layout of one evaluation (partition
    numbers, line positions) or where several branches would rescan a large source.
    The written table outlives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
