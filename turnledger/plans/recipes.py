"""Ready-made questions over the per-turn view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.functions.dates import local_day, week_label
from turnledger.functions.tokens import sum_counts


def top_projects(turns: DataFrame, limit: int = 20) -> DataFrame:
    """Tokens (input and output) and turns per known project."""
    return (
        turns.filter(F.col("project").isNotNull())
        .groupBy("project")
        .agg(
            sum_counts(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
            F.count(F.lit(1)).alias("turns"),
        )
        .orderBy(F.desc("tokens"), "project")
        .limit(limit)
    )


def cache_ratio_by_day(
    turns: DataFrame, tz: str = "UTC", days: int = 21, digits: int = 4
) -> DataFrame:
    """Cached against fresh input per local day, latest days first."""
    cached, fresh = sum_counts("cache_read_tokens"), sum_counts("input_tokens")
    ratio = cached.cast("double") / F.nullif((cached + fresh).cast("double"), F.lit(0.0))
    return (
        turns.groupBy(local_day(F.col("ts"), tz).alias("local_day"))
        .agg(
            F.round(ratio, digits).alias("cache_ratio"),
            cached.alias("cached"),
            fresh.alias("fresh"),
        )
        .select(F.col("local_day").cast("string").alias("day"), "cache_ratio", "cached", "fresh")
        .orderBy(F.desc("day"))
        .limit(days)
    )


def tokens_by_model_week(turns: DataFrame, tz: str = "UTC", limit: int | None = None) -> DataFrame:
    """Input, output and reasoning tokens per Monday week and model."""
    # Grouped by day first: the label is then built once per day and model, not per turn.
    per_day = turns.groupBy(local_day(F.col("ts"), tz).alias("day"), "model").agg(
        sum_counts(F.col("input_tokens") + F.col("output_tokens") + F.col("reasoning_tokens")).alias(
            "tokens"
        )
    )
    weeks = (
        per_day.groupBy(week_label(F.col("day")).alias("week"), "model")
        .agg(sum_counts("tokens").alias("tokens"))
        .orderBy(F.desc("week"), F.desc("tokens"), "model")
    )
    return weeks if limit is None else weeks.limit(limit)


def busiest_sessions(turns: DataFrame, limit: int = 15) -> DataFrame:
    """Sessions ranked by output tokens."""
    return (
        turns.groupBy("session_id", "tool")
        .agg(F.count(F.lit(1)).alias("turns"), sum_counts("output_tokens").alias("output"))
        .orderBy(F.desc("output"), "tool", "session_id")
        .limit(limit)
    )


def sidechain_split(turns: DataFrame) -> DataFrame:
    """Turns and output tokens of sidechain turns against main turns."""
    return turns.groupBy("is_sidechain").agg(
        F.count(F.lit(1)).alias("turns"), sum_counts("output_tokens").alias("output")
    )


def output_by_tool(turns: DataFrame) -> DataFrame:
    """Output tokens per tool."""
    return turns.groupBy("tool").agg(sum_counts("output_tokens").alias("output"))
