"""Usage rows derived from the sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Event types that play the part of tools with running totals.
EVENT_CUMULATIVE = ("click", "view")
# Return flags that play that part in the line items.
LINE_CUMULATIVE = ("A",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_model(k: Column) -> Column:
    """Dated variants, exact ids, a neighbour of a listed id and an unpriced model."""
    return (
        F.when(k % 5 == 0, "claude-opus-5-20260101")
        .when(k % 5 == 1, "claude-sonnet-4-5")
        .when(k % 5 == 2, "gpt-5-codex")
        .when(k % 5 == 3, "gpt-4o-mini-2024-07-18")
        .when(k % 3 == 0, "house-model-1")
        .otherwise("o3-pro")
    )


def _bigint(value: Column) -> Column:
    return F.floor(value).cast("bigint")


def usage_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as ledger rows: the type is the tool, the user the session."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    value = F.col("value")
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", k)
        .select(
            F.concat(F.lit("ev:"), F.col("event_id")).alias("dedupe_key"),
            F.col("event_type").alias("tool"),
            F.col("user_id").cast("string").alias("session_id"),
            event_model(F.col("k")).alias("model"),
            F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
            _bigint(value * 100).alias("input_tokens"),
            _bigint(value * 37).alias("output_tokens"),
            _bigint(value * 11).alias("cache_write_tokens"),
            _bigint(value * 900).alias("cache_read_tokens"),
            F.col("k").alias("reasoning_tokens"),
            F.col("event_type").isin(*EVENT_CUMULATIVE).alias("is_cumulative"),
            (F.col("k") % 7 == 0).alias("is_sidechain"),
            F.when(F.col("k") % 10 != 0, F.concat(F.lit("/p/"), (F.col("k") % 10).cast("string"))).alias(
                "project"
            ),
            F.lit("events").alias("source_file"),
            F.lit(0).cast("bigint").alias("ingest_batch"),
            F.lit(0).alias("tool_rank"),
            F.col("event_id").alias("line_no"),
        )
    )


def usage_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as ledger rows with repeated keys (order and line number).

    The supplier stands for the file and the part for the line.
    """
    price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("dedupe_key"),
        F.col("l_returnflag").alias("tool"),
        F.col("l_orderkey").cast("string").alias("session_id"),
        F.when(F.col("l_linenumber") % 3 == 0, "gpt-5-mini-2025")
        .when(F.col("l_linenumber") % 3 == 1, "claude-haiku-4-5")
        .otherwise("gpt-4.1")
        .alias("model"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("ts"),
        F.col("l_quantity").cast("bigint").alias("input_tokens"),
        price.alias("output_tokens"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("cache_write_tokens"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("cache_read_tokens"),
        F.col("l_linenumber").cast("bigint").alias("reasoning_tokens"),
        F.col("l_returnflag").isin(*LINE_CUMULATIVE).alias("is_cumulative"),
        (F.col("l_linestatus") == "F").alias("is_sidechain"),
        F.lit(None).cast("string").alias("project"),
        F.lpad(F.col("l_suppkey").cast("string"), 10, "0").alias("source_file"),
        F.lit(0).cast("bigint").alias("ingest_batch"),
        F.lit(0).alias("tool_rank"),
        (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("line_no"),
    )
