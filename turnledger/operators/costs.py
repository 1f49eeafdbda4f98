"""Longest-prefix rates and cost aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnledger.sources.pricing import RATE_COLS, RATE_TYPE, Pricing

_RATES = T.StructType(
    [T.StructField("matched_prefix", T.StringType())]
    + [T.StructField(c, RATE_TYPE) for c in RATE_COLS]
)


def resolve_rates(models: DataFrame, prices: DataFrame) -> DataFrame:
    """``model, rates`` for each row of ``models``; null rates where nothing matches.

    Each distinct model is spelled out into its own prefixes and equi-joined with the
    price table, so the match stays a hash join however long the table grows. The
    longest matching prefix wins; an exact match is the longest one possible.
    """
    model = F.col("model")
    candidates = models.select("model").distinct().select(
        "model",
        F.explode(
            F.transform(F.sequence(F.lit(0), F.length(model)), lambda n: F.substring(model, F.lit(1), n))
        ).alias("prefix"),
    )
    listed = prices.select(
        "prefix",
        F.struct(F.col("prefix").alias("matched_prefix"), *[F.col(c) for c in RATE_COLS]).alias("rates"),
    )
    matched_length = F.when(F.col("rates").isNotNull(), F.length("prefix"))
    return (
        candidates.join(listed, "prefix", "left")
        .groupBy("model")
        .agg(F.max_by("rates", matched_length).alias("rates"))
    )


def inline_rates(model: str, inline: tuple[tuple, ...]) -> Column:
    """The same lookup on a column as one expression: prefixes tested longest first."""
    branches = []
    for prefix, *rates in sorted(inline, key=lambda row: -len(row[0])):
        fields = ", ".join(
            f"'{name}', cast({'NULL' if rate is None else repr(str(rate))} AS {RATE_TYPE.simpleString()})"
            for name, rate in zip(RATE_COLS, rates, strict=True)
        )
        text = _sql_text(prefix)
        branches.append(
            f"WHEN startswith({model}, {text}) "
            f"THEN named_struct('matched_prefix', {text}, {fields})"
        )
    if not branches:
        return F.lit(None).cast(_RATES)
    return F.expr(f"CASE {' '.join(branches)} END")


def _sql_text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def with_rates(df: DataFrame, pricing: Pricing) -> DataFrame:
    """Add ``rates`` (a struct, null for an unpriced model) to rows with a ``model``."""
    if pricing.inline is not None:
        return df.withColumn("rates", inline_rates("model", pricing.inline))
    return df.join(resolve_rates(df, pricing.table()), "model", "left")


def micro_cost() -> Column:
    """Exact micro-dollars of the row's token counts, null without rates.

    Rates are USD per million tokens, so tokens times rate is micro-dollars.
    Reasoning tokens are billed at the output rate.
    """

    def part(tokens: str, rate: str) -> Column:
        return F.col(tokens) * F.col(f"rates.{rate}")

    return (
        part("input_tokens", "input")
        + part("output_tokens", "output")
        + part("cache_write_tokens", "cache_write")
        + part("cache_read_tokens", "cache_read")
        + part("reasoning_tokens", "output")
    )


def with_cost(df: DataFrame, pricing: Pricing) -> DataFrame:
    """Add ``matched_prefix`` and ``micros`` (exact, null when unpriced)."""
    return (
        with_rates(df, pricing)
        .withColumns({"matched_prefix": F.col("rates.matched_prefix"), "micros": micro_cost()})
        .drop("rates")
    )


def strict_sum(cost: Column) -> Column:
    """Sum that turns null as soon as one component is null; zero for no rows."""
    total = F.coalesce(F.sum(cost), F.lit(0).cast("decimal(38,6)"))
    return F.when(F.bool_or(cost.isNull()), F.lit(None)).otherwise(total)


def floor_sum(cost: Column) -> Column:
    """Sum of the known components only: a lower bound of the cost."""
    return F.coalesce(F.sum(cost), F.lit(0).cast("decimal(38,6)"))


def usd(micros: Column) -> Column:
    """Dollars as a double, converted once from the exact sum."""
    return micros.cast("double") / F.lit(1e6)
