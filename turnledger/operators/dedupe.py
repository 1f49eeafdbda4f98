"""First-wins de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.schema import ORDER_COLS


def first_wins(
    rows: DataFrame,
    key: Sequence[str] = ("dedupe_key",),
    order: Sequence[str | Column] = ORDER_COLS,
) -> DataFrame:
    """Keep the earliest row of every key.

    The rank filter is applied inside each map task before the shuffle as well, so a
    key with very many copies sends one row per task.
    """
    window = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")
