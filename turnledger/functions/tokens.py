"""Token arithmetic and content digests."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from turnledger.schema import TOKEN_COLS


# --- fixed values -----------------------------------------------------------
# Sums stop here. Counts have up to 53 bits, so a thousand of them may pass 64 bits.
MOST = 2**63 - 1
# ----------------------------------------------------------------------------

# A count is summed in two parts, of which neither can pass 64 bits below 2^36 rows.
_LOW_BITS = 26


def _low(count: Column) -> Column:
    return count.bitwiseAND(F.lit((1 << _LOW_BITS) - 1).cast("bigint"))


def _high(count: Column) -> Column:
    return F.shiftright(count, _LOW_BITS)


def _bounded(high: Column, low: Column) -> Column:
    """The parts together, exact and at most ``MOST``; null stays null.

    Made of 64-bit integers: decimals would take most of the time of a report with many groups.
    """
    carried = high + _high(low)
    whole = F.shiftleft(carried, _LOW_BITS) + _low(low)
    return F.when(carried > MOST >> _LOW_BITS, F.lit(MOST)).otherwise(whole)


def sum_counts(count: Column | str, over: WindowSpec | None = None) -> Column:
    """Exact sum of counts, at most ``MOST``; null without any."""
    count = F.col(count) if isinstance(count, str) else count
    high, low = F.sum(_high(count)), F.sum(_low(count))
    if over is not None:
        high, low = high.over(over), low.over(over)
    return _bounded(high, low)


def add_counts(*counts: str) -> Column:
    """Exact sum of a row's counts, at most ``MOST``."""
    return _bounded(reduce(add, (_high(F.col(c)) for c in counts)), reduce(add, (_low(F.col(c)) for c in counts)))


def total_tokens() -> Column:
    """All five token classes of the row."""
    return add_counts(*TOKEN_COLS)


def sum_tokens() -> list[Column]:
    """One sum per token class, under the class's own name."""
    return [sum_counts(c).alias(c) for c in TOKEN_COLS]


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, null for an empty whole."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def digest(*parts: Column) -> Column:
    """128-bit content digest of the space-joined parts."""
    return F.md5(F.concat_ws(" ", *parts).cast("binary"))
