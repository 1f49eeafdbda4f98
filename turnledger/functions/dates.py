"""Local days and week labels from unix seconds."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from turnledger.functions.coerce import FIRST_SECOND, LAST_SECOND

_DAY_SECONDS = 86_400


def local_day(ts: Column, tz: str = "UTC") -> Column:
    """Calendar day of a unix-seconds column as seen in ``tz``; null outside the years
    1 to 9999."""
    dated = F.when(ts.between(FIRST_SECOND, LAST_SECOND), ts)
    utc = F.timestamp_seconds(dated).cast("timestamp_ntz")
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), utc))


def week_label(day: Column) -> Column:
    """``YYYY-Www`` with Monday weeks; days before the first Monday are week 00."""
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7)
    return F.concat(
        F.lpad(F.year(day).cast("string"), 4, "0"),
        F.lit("-W"),
        F.lpad(week.cast("string"), 2, "0"),
    )


def day_bounds(since: str | None, until: str | None) -> tuple[int | None, int | None]:
    """Unix-second bounds that surely contain the inclusive local days.

    One day of slack on both sides covers every timezone offset. The bounds are
    literals, so they reach the scan; the exact test on the local day stays above.
    """

    def midnight(day: str) -> int:
        return calendar.timegm(dt.date.fromisoformat(day).timetuple())

    low = midnight(since) - _DAY_SECONDS if since else None
    high = midnight(until) + 2 * _DAY_SECONDS if until else None
    return low, high


def last_days(as_of: str, days: int) -> str:
    """First day of the window of ``days`` days that ends on ``as_of``."""
    return (dt.date.fromisoformat(as_of) - dt.timedelta(days=days - 1)).isoformat()


def valid_zone(spark: SparkSession, tz: str) -> str:
    """The zone if Spark knows it; raises ``ValueError`` otherwise."""
    try:
        spark.sql(
            "SELECT convert_timezone('UTC', :tz, timestamp_ntz'2000-01-01 00:00:00')", args={"tz": tz}
        ).first()
    except Exception as error:
        raise ValueError(f"unknown time zone: {tz!r}") from error
    return tz


def register_sql_functions(spark: SparkSession, tz: str = "UTC") -> None:
    """``local_day(ts)`` and ``week_label(ts)`` for ad-hoc SQL.

    SQL functions are inlined into the plan as plain expressions.
    """
    zone = valid_zone(spark, tz)
    # The parameter must not be called like the column it is given: the optimizer drops
    # such an alias and then fails on a second function over the same column.
    day = (
        f"to_date(convert_timezone('UTC', '{zone}', "
        f"cast(timestamp_seconds(if(unix_ts between {FIRST_SECOND} and {LAST_SECOND}, "
        "unix_ts, null)) as timestamp_ntz)))"
    )
    week = f"floor((dayofyear({day}) + 6 - weekday({day})) / 7)"
    label = (
        f"concat(lpad(cast(year({day}) as string), 4, '0'), '-W', "
        f"lpad(cast({week} as string), 2, '0'))"
    )
    for name, returns, body in (("local_day", "DATE", day), ("week_label", "STRING", label)):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(unix_ts BIGINT) "
            f"RETURNS {returns} RETURN {body}"
        )
