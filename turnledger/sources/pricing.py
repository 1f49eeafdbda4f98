"""Price table source."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnledger.sources.price_list import PRICE_LIST, PRICE_LIST_UPDATED

RATE_COLS = ("input", "output", "cache_write", "cache_read")
RATE_TYPE = T.DecimalType(12, 6)

# Tables up to this many prefixes are planned as literals; larger ones are joined. Both give
# the same rates: a prefix has one row, and a missing rate is null in either.
MAX_INLINE_PREFIXES = 500

PRICES = T.StructType(
    [T.StructField("prefix", T.StringType())] + [T.StructField(c, RATE_TYPE) for c in RATE_COLS]
)

_FILE_SCHEMA = T.StructType(
    [
        T.StructField("updated", T.StringType()),
        T.StructField(
            "models",
            T.MapType(
                T.StringType(),
                T.StructType([T.StructField(c, RATE_TYPE) for c in RATE_COLS]),
            ),
        ),
    ]
)


@dataclass(frozen=True)
class Pricing:
    """A price table: its date, its rows as literals when few, and as a DataFrame."""

    spark: SparkSession
    updated: str
    inline: tuple[tuple, ...] | None
    large: DataFrame | None = None

    def table(self) -> DataFrame:
        """The rows as ``prefix`` plus the four rates."""
        if self.large is not None:
            return self.large
        return self.spark.createDataFrame(list(self.inline or ()), PRICES)


def pricing_from_table(updated: str, table: DataFrame) -> Pricing:
    """Wrap a price DataFrame, inlining its rows when they are few.

    Of rows with the same prefix the one with the greatest rates counts, null lowest.
    """
    rates = F.struct(*RATE_COLS)
    table = (
        table.where(F.col("prefix").isNotNull())
        .groupBy("prefix")
        .agg(F.max(rates).alias("rates"))
        .select("prefix", *[F.col(f"rates.{c}").cast(RATE_TYPE).alias(c) for c in RATE_COLS])
    )
    head = [tuple(r) for r in table.limit(MAX_INLINE_PREFIXES + 1).collect()]
    if len(head) <= MAX_INLINE_PREFIXES:
        return Pricing(table.sparkSession, updated, tuple(head))
    return Pricing(table.sparkSession, updated, None, table)


def bundled_pricing(spark: SparkSession) -> Pricing:
    """The price list that ships with the package."""
    rows = tuple(
        (prefix, *(Decimal(r) for r in rates)) for prefix, rates in PRICE_LIST.items()
    )
    return Pricing(spark, PRICE_LIST_UPDATED, rows)


def load_pricing(spark: SparkSession, path: str | None = None) -> Pricing:
    """Price table from a JSON file ``{updated, models: {prefix: {four rates}}}``.

    An unreadable file gives an empty table, which makes every model unpriced rather
    than wrongly priced. Without a path the bundled list is used.
    """
    if path is None:
        return bundled_pricing(spark)
    try:
        raw = spark.read.schema(_FILE_SCHEMA).option("multiLine", True).json(path)
        head = raw.select("updated").first()
    except AnalysisException:
        return Pricing(spark, "unknown", ())
    table = raw.select(F.explode("models").alias("prefix", "rates")).select(
        "prefix", *[F.col(f"rates.{c}").alias(c) for c in RATE_COLS]
    )
    updated = head["updated"] if head and head["updated"] else "unknown"
    return pricing_from_table(updated, table)
