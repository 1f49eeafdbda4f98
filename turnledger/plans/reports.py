"""Reports over the per-turn view. Every function returns lazy DataFrames."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnledger.functions.dates import day_bounds, last_days, local_day
from turnledger.functions.tokens import add_counts, share, sum_counts, sum_tokens, total_tokens
from turnledger.operators.costs import floor_sum, strict_sum, usd, with_cost
from turnledger.schema import TOKEN_COLS
from turnledger.sources.pricing import Pricing

# --- fixed values -----------------------------------------------------------
TOTALS_LABEL = "TOTAL"
SESSION_LIMIT = 25
CACHE_BAND_DAYS = 21
# Order in which a session's token classes are listed.
BREAKDOWN = (
    ("cache_read_tokens", "cache read"),
    ("input_tokens", "input"),
    ("cache_write_tokens", "cache write"),
    ("output_tokens", "output"),
    ("reasoning_tokens", "reasoning"),
)
# ----------------------------------------------------------------------------


class DailyReport(NamedTuple):
    """Rows per day and tool, their total, and the models without a rate."""

    rows: DataFrame
    totals: DataFrame
    unknown_models: DataFrame


class SessionsReport(NamedTuple):
    """Session rows, newest first, and the models without a rate among them."""

    rows: DataFrame
    unknown_models: DataFrame


def filter_turns(
    turns: DataFrame,
    tz: str = "UTC",
    since: str | None = None,
    until: str | None = None,
    tool: str | None = None,
) -> DataFrame:
    """Turns of one tool and of the inclusive local days ``since``..``until``."""
    day = local_day(F.col("ts"), tz)
    low, high = day_bounds(since, until)
    if tool is not None:
        turns = turns.filter(F.col("tool") == tool)
    if low is not None:
        turns = turns.filter((F.col("ts") >= low) & (day >= F.lit(since).cast("date")))
    if high is not None:
        turns = turns.filter((F.col("ts") < high) & (day <= F.lit(until).cast("date")))
    return turns


def recent_turns(turns: DataFrame, as_of: str, days: int, tz: str = "UTC") -> DataFrame:
    """Turns of the ``days`` local days that end on ``as_of``."""
    return filter_turns(turns, tz, since=last_days(as_of, days), until=as_of)


def usage_by_day_model(turns: DataFrame, pricing: Pricing, tz: str = "UTC") -> DataFrame:
    """Sums and cost per local day, tool and model.

    Cost depends on the model, so it is computed here, on grouped rows, and the model
    is folded away afterwards.
    """
    grouped = (
        turns.withColumn("date", local_day(F.col("ts"), tz))
        .groupBy("date", "tool", "model")
        .agg(*sum_tokens())
    )
    return with_cost(grouped, pricing)


def daily_report(
    turns: DataFrame,
    pricing: Pricing,
    tz: str = "UTC",
    since: str | None = None,
    until: str | None = None,
    tool: str | None = None,
) -> DailyReport:
    """Tokens per local day and tool with a cost that is null if any part is unpriced."""
    by_model = usage_by_day_model(filter_turns(turns, tz, since, until, tool), pricing, tz)
    folded = by_model.groupBy("date", "tool").agg(
        *sum_tokens(), strict_sum(F.col("micros")).alias("micros")
    )
    rows = folded.select(
        F.col("date").cast("string").alias("date"),
        "tool",
        *TOKEN_COLS,
        total_tokens().alias("total_tokens"),
        usd(F.col("micros")).alias("cost_usd"),
    ).orderBy("date", "tool")
    return DailyReport(rows, _daily_totals(folded), unpriced_models(by_model))


def _daily_totals(folded: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    sums = folded.agg(
        *[F.coalesce(sum_counts(c), zero).alias(c) for c in TOKEN_COLS],
        strict_sum(F.col("micros")).alias("micros"),
    )
    return sums.select(
        F.lit(TOTALS_LABEL).alias("date"),
        F.lit("").alias("tool"),
        *TOKEN_COLS,
        total_tokens().alias("total_tokens"),
        usd(F.col("micros")).alias("cost_usd"),
    )


def unpriced_models(costed: DataFrame) -> DataFrame:
    """Distinct models without a rate, sorted."""
    return (
        costed.filter(F.col("matched_prefix").isNull()).select("model").distinct().orderBy("model")
    )


def sessions_report(
    turns: DataFrame,
    pricing: Pricing,
    tool: str | None = None,
    limit: int = SESSION_LIMIT,
) -> SessionsReport:
    """One row per session, newest last activity first.

    ``turns`` counts every turn, sidechain turns included. The project is the largest
    one a session names, its models are sorted.
    """
    if isinstance(limit, bool) or not isinstance(limit, int):
        raise ValueError(f"limit must be a number, got {limit!r}")
    rows = (
        session_totals(filter_turns(turns, tool=tool), pricing)
        .orderBy(F.desc("last_ts"), "tool", "session_id")
        .limit(limit)
    )
    models = rows.select(F.explode("models").alias("model"))
    return SessionsReport(rows, unpriced_models(with_cost(_no_tokens(models), pricing)))


def _no_tokens(models: DataFrame) -> DataFrame:
    return models.select("model", *[F.lit(0).cast("bigint").alias(c) for c in TOKEN_COLS])


def session_totals(turns: DataFrame, pricing: Pricing) -> DataFrame:
    """All sessions, unordered, with the columns of the sessions report."""
    by_model = with_cost(
        turns.groupBy("tool", "session_id", "model").agg(
            *sum_tokens(),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.count(F.lit(1)).alias("turns"),
            F.count_if(F.col("is_sidechain")).alias("sidechain_turns"),
            F.max("project").alias("project"),
        ),
        pricing,
    )
    folded = by_model.groupBy("tool", "session_id").agg(
        *sum_tokens(),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.sum("turns").alias("turns"),
        F.sum("sidechain_turns").alias("sidechain_turns"),
        F.max("project").alias("project"),
        F.array_sort(F.collect_set("model")).alias("models"),
        strict_sum(F.col("micros")).alias("micros"),
    )
    return folded.select(
        "session_id",
        "tool",
        "project",
        "first_ts",
        "last_ts",
        "turns",
        "sidechain_turns",
        "models",
        *TOKEN_COLS,
        total_tokens().alias("total_tokens"),
        usd(F.col("micros")).alias("cost_usd"),
    )


def by_tool(turns: DataFrame, pricing: Pricing, tz: str = "UTC") -> DataFrame:
    """Tokens, lower-bound cost, cache share and active days per tool.

    The cost sums the priced day rows; ``has_unpriced`` tells that it is a floor, and
    it is null instead of zero when nothing was priced. ``bar`` is the tool's tokens
    relative to the busiest tool.
    """
    days = (
        usage_by_day_model(turns, pricing, tz)
        .groupBy("date", "tool")
        .agg(*sum_tokens(), strict_sum(F.col("micros")).alias("micros"))
        .withColumn("total_tokens", total_tokens())
    )
    tools = days.groupBy("tool").agg(
        sum_counts("total_tokens").alias("total_tokens"),
        sum_counts("cache_read_tokens").alias("cache_read_tokens"),
        floor_sum(F.col("micros")).alias("micros"),
        F.bool_or(F.col("micros").isNull()).alias("has_unpriced"),
        F.count(F.lit(1)).alias("active_days"),
    )
    # One row per tool, so the unpartitioned window stays tiny.
    busiest = F.greatest(F.max("total_tokens").over(Window.partitionBy()), F.lit(1))
    cost = F.when(F.col("has_unpriced") & (F.col("micros") == 0), F.lit(None)).otherwise(
        F.col("micros")
    )
    return tools.select(
        "tool",
        "total_tokens",
        usd(cost).alias("cost_floor_usd"),
        "has_unpriced",
        share(F.col("cache_read_tokens"), F.col("total_tokens")).alias("cache_share"),
        "active_days",
        share(F.col("total_tokens"), busiest).alias("bar"),
    ).orderBy(F.desc("total_tokens"), "tool")


def by_day(turns: DataFrame, tz: str = "UTC") -> DataFrame:
    """Token sums per local day over all tools, ascending."""
    return (
        turns.groupBy(local_day(F.col("ts"), tz).alias("day"))
        .agg(*sum_tokens())
        .select(F.col("day").cast("string").alias("date"), *TOKEN_COLS)
        .orderBy("date")
    )


def cache_band(days: DataFrame, last: int = CACHE_BAND_DAYS) -> DataFrame:
    """Cache, fresh and output share of the last active days, ascending.

    ``overall_cached`` is the cache share over all of those days; days without tokens
    count among the last days but give no row.
    """
    recent = days.orderBy(F.desc("date")).limit(last).select(
        "date",
        F.col("cache_read_tokens").alias("cache"),
        add_counts("input_tokens", "cache_write_tokens").alias("fresh"),
        add_counts("output_tokens", "reasoning_tokens").alias("out"),
    )
    total = add_counts("cache", "fresh", "out")
    # At most ``last`` rows reach the unpartitioned window.
    everything = Window.partitionBy()
    overall = F.coalesce(
        share(sum_counts("cache", everything), sum_counts("total", everything)), F.lit(0.0)
    )
    return (
        recent.withColumn("total", total)
        .withColumn("overall_cached", overall)
        .filter(F.col("total") > 0)
        .select(
            "date",
            "total",
            share(F.col("cache"), F.col("total")).alias("cache_share"),
            share(F.col("fresh"), F.col("total")).alias("fresh_share"),
            share(F.col("out"), F.col("total")).alias("out_share"),
            "overall_cached",
        )
        .orderBy("date")
    )


def trend(days: DataFrame) -> DataFrame:
    """Each day's token classes relative to the busiest day, and its cache percent."""
    totals = days.withColumn("total", total_tokens())
    # One row per calendar day, so the unpartitioned window stays small.
    busiest = F.greatest(F.max("total").over(Window.partitionBy()), F.lit(1))
    percent = F.floor(
        F.coalesce(share(F.col("cache_read_tokens"), F.col("total")), F.lit(0.0)) * 100 + 0.5
    )
    return totals.withColumn("busiest", busiest).select(
        "date",
        *[share(F.col(c), F.col("busiest")).alias(c.replace("_tokens", "_height")) for c in TOKEN_COLS],
        percent.alias("cache_percent"),
    ).orderBy("date")


def session_breakdown(sessions: DataFrame) -> DataFrame:
    """Token classes of each session in long form, empty classes left out."""
    labelled = sessions.select(
        "tool",
        "session_id",
        "total_tokens",
        *[F.col(c).alias(label) for c, label in BREAKDOWN],
    )
    return (
        labelled.unpivot(
            ["tool", "session_id", "total_tokens"],
            [label for _, label in BREAKDOWN],
            "component",
            "tokens",
        )
        .filter(F.col("tokens") > 0)
        .select(
            "tool",
            "session_id",
            "component",
            "tokens",
            share(F.col("tokens"), F.col("total_tokens")).alias("token_share"),
        )
    )


def distinct_models(events: DataFrame, tool: str | None = None) -> DataFrame:
    """Distinct models overall or of one tool, sorted."""
    if tool is not None:
        events = events.filter(F.col("tool") == tool)
    return events.select("model").distinct().orderBy("model")
