"""What was found, what was read, and what has no rate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.operators.costs import with_cost
from turnledger.plans.reports import unpriced_models
from turnledger.schema import TOKEN_COLS
from turnledger.sources.dialects import tools as known_tools
from turnledger.sources.files import Source
from turnledger.sources.pricing import Pricing


def under_roots(path: Column, roots: Sequence[str]) -> Column:
    """Whether a path lies below any of the roots, taken literally."""
    return reduce(or_, (path.startswith(r.rstrip("/") + "/") for r in roots), F.lit(False))


def priced_models(models: DataFrame, pricing: Pricing) -> DataFrame:
    """``matched_prefix`` for rows with a ``model``, null when there is no rate."""
    zeros = models.withColumns({c: F.lit(0).cast("bigint") for c in TOKEN_COLS})
    return with_cost(zeros, pricing).drop(*TOKEN_COLS, "micros")


def coverage(
    events: DataFrame,
    state: DataFrame,
    manifest: DataFrame,
    sources: Sequence[Source],
    pricing: Pricing,
    detected: dict[str, bool] | None = None,
) -> DataFrame:
    """Per tool: roots and whether one of them exists (null unless ``detected`` is given),
    log files found, files scanned, models, models without a rate."""
    spark = events.sparkSession
    registry = known_tools()
    roots = {t: [r for s in sources if s.tool == t for r in s.roots] for t in registry}
    found = manifest.groupBy("tool").agg(F.count(F.lit(1)).alias("log_files"))
    # One pass over the state counts for all tools; a file may count for several.
    scanned = state.agg(
        *[F.count_if(under_roots(F.col("source_file"), roots[t])).alias(t) for t in registry]
    ).unpivot([], list(registry), "tool", "scanned_files")
    models = (
        priced_models(events.select("tool", "model").distinct(), pricing)
        .groupBy("tool")
        .agg(
            F.array_sort(F.collect_set("model")).alias("models"),
            F.array_sort(
                F.collect_set(F.when(F.col("matched_prefix").isNull(), F.col("model")))
            ).alias("unknown_models"),
        )
    )
    tools = spark.createDataFrame(
        [(t, i, None if detected is None else detected.get(t, False), roots[t]) for i, t in enumerate(registry)],
        "tool string, rank int, detected boolean, roots array<string>",
    )
    none = F.array().cast("array<string>")
    return (
        tools.join(found, "tool", "left")
        .join(scanned, "tool", "left")
        .join(models, "tool", "left")
        .orderBy("rank")
        .select(
            "tool",
            F.coalesce("log_files", F.lit(0)).alias("log_files"),
            F.coalesce("scanned_files", F.lit(0)).alias("scanned_files"),
            F.coalesce("models", none).alias("models"),
            F.coalesce("unknown_models", none).alias("unknown_models"),
            "detected",
            "roots",
        )
    )


def all_unpriced_models(events: DataFrame, pricing: Pricing) -> DataFrame:
    """Distinct models of any tool without a rate, sorted."""
    return unpriced_models(priced_models(events.select("model").distinct(), pricing))


def ledger_meta(events: DataFrame, state: DataFrame, pricing: Pricing) -> DataFrame:
    """One row: stored events, time of the last sync (null if never), price list date."""
    counted = events.agg(F.count(F.lit(1)).alias("events")).withColumn(
        "last_sync_at", F.lit(None).cast("bigint")
    )
    synced = state.agg(F.max("scanned_at").alias("last_sync_at")).withColumn(
        "events", F.lit(None).cast("bigint")
    )
    return counted.unionByName(synced).agg(
        F.max("events").alias("events"),
        F.max("last_sync_at").alias("last_sync_at"),
        F.lit(pricing.updated).alias("pricing_updated"),
    )
