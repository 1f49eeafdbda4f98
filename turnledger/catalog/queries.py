"""Registered queries: every one reads the given tables in full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.catalog.adapters import (
    EVENT_CUMULATIVE,
    table,
    usage_from_events,
    usage_from_lineitem,
)
from turnledger.functions.dates import day_bounds, local_day
from turnledger.functions.paths import project_label
from turnledger.functions.tokens import sum_tokens
from turnledger.operators.costs import floor_sum, resolve_rates, strict_sum, usd, with_rates
from turnledger.operators.dedupe import first_wins
from turnledger.operators.deltas import turn_usage, turns_between
from turnledger.plans import recipes, reports
from turnledger.schema import TOKEN_COLS, TURN_COLS
from turnledger.session import configure, scratch_path
from turnledger.sources.pricing import RATE_COLS, bundled_pricing, load_pricing

Query = Callable[[SparkSession, str], DataFrame]

REPORT_TZ = "America/New_York"
SINCE, UNTIL = "2024-01-08", "2024-01-20"
AS_OF = "2024-01-25"


def event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_usage(usage_from_events(configure(spark), sf_dir), EVENT_CUMULATIVE)


def line_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage_from_lineitem(configure(spark), sf_dir)
    return first_wins(rows, order=("source_file", "line_no", "ts"))


def line_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One window over all rows, as de-duplication has shuffled them anyway: two branches by tool
    # would scan and de-duplicate twice. The rows before it bound the session sizes.
    every_row = usage_from_lineitem(spark, sf_dir)
    return turn_usage(line_events(spark, sf_dir), size_source=every_row)


# --- per-turn deltas --------------------------------------------------------


def turn_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_turns(spark, sf_dir).select("line_no", *TURN_COLS)


def turn_deltas_one_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same view with every tool in the window."""
    return turn_usage(usage_from_events(configure(spark), sf_dir)).select("line_no", *TURN_COLS)


def turn_deltas_split_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same view with every session of a few rows treated as a hot one."""
    rows = usage_from_events(configure(spark), sf_dir)
    turns = turn_usage(rows, EVENT_CUMULATIVE, hot_session_rows=10, chunk_rows=500)
    return turns.select("line_no", *TURN_COLS)


def turn_deltas_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same view of some days, made of their rows and one earlier row a session."""
    low, high = day_bounds(SINCE, UNTIL)
    rows = usage_from_events(configure(spark), sf_dir)
    return turns_between(rows, EVENT_CUMULATIVE, low, high).select("line_no", *TURN_COLS)


def delta_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_turns(spark, sf_dir).groupBy("tool", "is_sidechain").agg(
        F.count(F.lit(1)).alias("turns"), *sum_tokens()
    )


# --- prices -----------------------------------------------------------------


def price_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest-prefix match as a join, per distinct model."""
    models = usage_from_events(configure(spark), sf_dir).select("model").unionByName(
        usage_from_lineitem(spark, sf_dir).select("model")
    )
    matched = resolve_rates(models, bundled_pricing(spark).table())
    return matched.select(
        "model",
        F.col("rates.matched_prefix").alias("matched_prefix"),
        *[F.col(f"rates.{c}").cast("double").alias(f"{c}_rate") for c in ("input", "output", "cache_write", "cache_read")],
    )


def cost_strict_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null-propagating and lower-bound cost per tool and project."""
    turns = event_turns(spark, sf_dir)
    costed = reports.with_cost(
        turns.groupBy("tool", "project", "model").agg(*sum_tokens()), bundled_pricing(spark)
    )
    return costed.groupBy("tool", "project").agg(
        usd(strict_sum(F.col("micros"))).alias("cost_strict_usd"),
        usd(floor_sum(F.col("micros"))).alias("cost_floor_usd"),
        F.bool_or(F.col("micros").isNull()).alias("has_unpriced"),
    )


# --- reports ----------------------------------------------------------------


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_report(event_turns(spark, sf_dir), bundled_pricing(spark), REPORT_TZ).rows


def daily_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_report(line_turns(spark, sf_dir), bundled_pricing(spark)).rows


def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = reports.daily_report(
        event_turns(spark, sf_dir), bundled_pricing(spark), REPORT_TZ, SINCE, UNTIL
    )
    return report.totals


def daily_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_report(
        event_turns(spark, sf_dir), bundled_pricing(spark), REPORT_TZ, SINCE, UNTIL, "click"
    ).rows


def daily_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = reports.recent_turns(event_turns(spark, sf_dir), AS_OF, 7, REPORT_TZ)
    return reports.daily_report(turns, bundled_pricing(spark), REPORT_TZ).rows


def unknown_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = reports.daily_report(
        event_turns(spark, sf_dir), bundled_pricing(spark), REPORT_TZ, SINCE, UNTIL
    )
    return report.unknown_models


def daily_totals_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_report(event_turns(spark, sf_dir), bundled_pricing(spark), REPORT_TZ).totals


def unknown_models_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_report(
        event_turns(spark, sf_dir), bundled_pricing(spark), REPORT_TZ
    ).unknown_models


def price_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of customers' models from a JSON price file made of the suppliers."""
    spark = configure(spark)
    key = F.col("s_suppkey") % 50
    rates = F.struct(
        (F.max("s_suppkey") / 4).alias("input"),
        F.min("s_suppkey").cast("double").alias("output"),
        F.when(key % 3 != 0, F.max("s_suppkey") / 8).alias("cache_write"),
        F.lit(0.125).alias("cache_read"),
    )
    listed = table(spark, sf_dir, "supplier").groupBy(key).agg(
        F.concat(F.lit("m-"), key).alias("prefix"), rates.alias("rates")
    )
    models = F.map_from_entries(F.collect_list(F.struct("prefix", "rates")))
    body = listed.agg(models.alias("models")).select(
        F.to_json(F.struct(F.lit("2026-01-01").alias("updated"), "models")).alias("value")
    )
    path = scratch_path(spark, "price-file")
    body.coalesce(1).write.text(path)
    customers = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("m-"), F.col("c_custkey")).alias("model")
    )
    priced = with_rates(customers, load_pricing(spark, path))
    return priced.select(
        "model",
        F.col("rates.matched_prefix").alias("matched_prefix"),
        *[F.col(f"rates.{c}").cast("double").alias(f"{c}_rate") for c in RATE_COLS],
    )


def _joined_models(sessions: DataFrame) -> DataFrame:
    """Models as one text column: array columns compare badly across engines."""
    return sessions.withColumn("models", F.concat_ws(",", "models"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = reports.sessions_report(event_turns(spark, sf_dir), bundled_pricing(spark))
    return _joined_models(report.rows)


def sessions_of_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = reports.sessions_report(
        event_turns(spark, sf_dir), bundled_pricing(spark), tool="view", limit=50
    )
    return _joined_models(report.rows)


def sessions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined_models(reports.session_totals(line_turns(spark, sf_dir), bundled_pricing(spark)))


def session_unknown_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sessions_report(
        event_turns(spark, sf_dir), bundled_pricing(spark)
    ).unknown_models


def session_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.session_breakdown(
        reports.session_totals(event_turns(spark, sf_dir), bundled_pricing(spark))
    )


def by_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_tool(event_turns(spark, sf_dir), bundled_pricing(spark), REPORT_TZ)


def by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_day(event_turns(spark, sf_dir), REPORT_TZ)


def cache_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cache_band(by_day(spark, sf_dir))


def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.trend(by_day(spark, sf_dir))


def models_per_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage_from_events(configure(spark), sf_dir)
    return rows.select("tool", "model").distinct()


def distinct_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distinct_models(usage_from_events(configure(spark), sf_dir))


# --- recipes ----------------------------------------------------------------


def project_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.top_projects(event_turns(spark, sf_dir), 10)


def project_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = event_turns(spark, sf_dir)
    return (
        turns.groupBy("project")
        .agg(F.count(F.lit(1)).alias("turns"))
        .withColumn("label", project_label(F.col("project")))
    )


def cache_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.cache_ratio_by_day(event_turns(spark, sf_dir), REPORT_TZ)


def model_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.tokens_by_model_week(line_turns(spark, sf_dir), REPORT_TZ)


def busiest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.busiest_sessions(event_turns(spark, sf_dir))


def sidechain_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.sidechain_split(event_turns(spark, sf_dir))


def output_by_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.output_by_tool(event_turns(spark, sf_dir))


def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns per local day of the line items, in a zone with daylight saving."""
    rows = usage_from_lineitem(configure(spark), sf_dir)
    return (
        rows.groupBy(local_day(F.col("ts") + F.col("line_no") % 86_400, REPORT_TZ).alias("day"))
        .agg(F.count(F.lit(1)).alias("turns"))
        .select(F.col("day").cast("string").alias("day"), "turns")
    )


# --- de-duplication ---------------------------------------------------------


def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_events(spark, sf_dir).select(
        "dedupe_key", "tool", "session_id", "ts", "source_file", "line_no", *TOKEN_COLS
    )


def dedupe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document of every distinct text."""
    docs = table(configure(spark), sf_dir, "documents").select(
        F.md5(F.col("text").cast("binary")).alias("dedupe_key"), "doc_id", "lang", "n_chars"
    )
    return first_wins(docs, order=("doc_id",))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        turn_deltas,
        turn_deltas_one_window,
        turn_deltas_split_sessions,
        turn_deltas_range,
        delta_totals,
        price_match,
        cost_strict_floor,
        daily,
        daily_lines,
        daily_totals,
        daily_totals_all,
        unknown_models_all,
        price_file,
        daily_filtered,
        daily_recent,
        unknown_models,
        sessions,
        sessions_of_tool,
        sessions_all,
        session_unknown_models,
        session_breakdown,
        by_tool,
        by_day,
        cache_band,
        trend,
        models_per_tool,
        distinct_models,
        project_top,
        project_labels,
        cache_ratio,
        model_week,
        busiest,
        sidechain_split,
        output_by_tool,
        local_days,
        dedupe_first_wins,
        dedupe_texts,
    )
}
