"""Running totals to per-turn usage, clamped at zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnledger.operators.pinning import pin
from turnledger.schema import ORDER_COLS, SESSION_KEY, TOKEN_COLS, TURN_COLS

# A session above this many rows is split over several tasks.
HOT_SESSION_ROWS = 2_000_000
CHUNK_ROWS = 1_000_000
# Length of a span of a session that has a head.
HEAD_SECONDS = 3600
# Buckets of sessions that are counted to find hot ones.
SIZE_BUCKETS = 16_384
# Hot session keys are broadcast only up to this count.
MAX_BROADCAST_KEYS = 10_000

_TURN_ORDER = ("ts", *ORDER_COLS)


def turn_usage(
    events: DataFrame,
    cumulative_tools: Sequence[str] | None = None,
    hot_session_rows: int = HOT_SESSION_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    size_source: DataFrame | None = None,
) -> DataFrame:
    """Per-turn view over ledger rows: the turn columns plus the order tuple.

    Every row of a session takes part in the ordering; only rows flagged cumulative
    are differenced against their predecessor, so a counter reset yields zero.

    ``cumulative_tools`` names the tools that may log running totals. All other tools
    then bypass the window: no shuffle, and date filters reach their scan. A flagged
    row of a tool outside the list fails the query instead of passing undifferenced.

    Sessions above ``hot_session_rows`` rows are split by range into chunks of about
    ``chunk_rows`` rows and stitched, so no session has to fit one task. The row counts for that choice are read when the
    view is built: from ``size_source`` if given, a cheaper frame that has at least
    the rows of ``events`` in every session.
    """
    sized = events if size_source is None else size_source
    if cumulative_tools is None:
        return _difference(events, sized, hot_session_rows, chunk_rows)
    in_list = F.col("tool").isin(*cumulative_tools)
    return _passed_through(events.filter(~in_list)).unionByName(
        _difference(
            events.filter(in_list), sized.filter(in_list), hot_session_rows, chunk_rows
        )
    )


def _passed_through(events: DataFrame) -> DataFrame:
    """Rows of tools without running totals, whose counts are per turn as they are."""
    return events.select(
        *[
            F.when(
                F.col("is_cumulative"),
                F.raise_error(F.lit("running totals outside cumulative_tools")).cast("bigint"),
            )
            .otherwise(F.col(c))
            .alias(c)
            if c in TOKEN_COLS
            else F.col(c)
            for c in (*TURN_COLS, *ORDER_COLS)
        ]
    )


def turns_between(
    events: DataFrame, cumulative_tools: Sequence[str], low: int | None, high: int | None
) -> DataFrame:
    """The per-turn view of rows with ``low <= ts < high`` without windowing other rows.

    A delta only looks back, so later rows are left out of the scan. Of the earlier rows of a
    session only the last is needed: it is found map-side and stands in for all of them.
    """
    if high is not None:
        events = events.filter(F.col("ts") < high)
    if low is None:
        return turn_usage(events, cumulative_tools)
    others = [c for c in events.columns if c not in SESSION_KEY]
    in_list = F.col("tool").isin(*cumulative_tools)
    last = (
        events.filter(in_list & (F.col("ts") < low))
        .groupBy(*SESSION_KEY)
        .agg(F.max_by(F.struct(*others), F.struct(*_TURN_ORDER)).alias("row"))
        .select(*SESSION_KEY, *[F.col(f"row.{c}").alias(c) for c in others])
    )
    inside = events.filter(F.col("ts") >= low)
    # A session's one earlier row does not matter for its size.
    differenced = _difference(
        inside.filter(in_list).unionByName(last), inside.filter(in_list), HOT_SESSION_ROWS, CHUNK_ROWS
    )
    return _passed_through(inside.filter(~in_list)).unionByName(differenced.filter(F.col("ts") >= low))


# --- heads: the last reading of a session in each span of time ----------------------


def session_heads(events: DataFrame) -> DataFrame:
    """Of every session and span the rows, and the last reading with its place in the order."""
    place = F.struct(*_TURN_ORDER)
    return (
        events.withColumn("span", F.floor(F.col("ts") / HEAD_SECONDS).cast("bigint"))
        .groupBy(*SESSION_KEY, "span")
        .agg(
            F.max_by(F.struct(*TOKEN_COLS), place).alias("reading"),
            F.max(place).alias("place"),
            F.count(F.lit(1)).alias("n_rows"),
        )
    )


def merged_heads(heads: DataFrame) -> DataFrame:
    """One row a session and span, whichever commits its rows came with."""
    return heads.groupBy(*SESSION_KEY, "span").agg(
        F.max_by("reading", "place").alias("reading"),
        F.max("place").alias("place"),
        F.sum("n_rows").alias("n_rows"),
    )


def turns_with_heads(
    events: DataFrame, heads: DataFrame, cumulative_tools: Sequence[str], low: int | None, high: int | None
) -> DataFrame:
    """The per-turn view of rows with ``low <= ts < high``, differenced span by span.

    The first row of a session in a span is differenced against the head of the span before.
    So only rows of the range are read, no session has to fit one task, and the plan needs no
    look at the data when it is made. ``heads`` are those of all rows of the tools with running
    totals, in one or more pieces.
    """
    first = None if low is None else low // HEAD_SECONDS
    if high is not None:
        events = events.filter(F.col("ts") < high)
        heads = heads.filter(F.col("span") <= (high - 1) // HEAD_SECONDS)
    by_session = Window.partitionBy(*SESSION_KEY).orderBy("span")
    carried = merged_heads(heads).select(*SESSION_KEY, "span", F.lag("reading").over(by_session).alias("carry"))
    rows = events.filter(F.col("tool").isin(*cumulative_tools))
    if first is not None:
        rows = rows.filter(F.col("ts") >= first * HEAD_SECONDS)
        carried = carried.filter(F.col("span") >= first)
    in_span = Window.partitionBy(*SESSION_KEY, "span").orderBy(*_TURN_ORDER)
    lagged = rows.withColumn("span", F.floor(F.col("ts") / HEAD_SECONDS).cast("bigint")).withColumns(
        {f"previous_{c}": F.lag(c).over(in_span) for c in TOKEN_COLS}
    )
    zero = F.lit(0).cast("bigint")
    # Rows of a span lie together for the window; the heads, far fewer, are brought to them.
    differenced = lagged.join(carried.hint("shuffle_hash"), [*SESSION_KEY, "span"], "left").select(
        *[
            _delta(c, F.coalesce(F.col(f"previous_{c}"), F.col(f"carry.{c}"), zero)) if c in TOKEN_COLS else F.col(c)
            for c in (*TURN_COLS, *ORDER_COLS)
        ]
    )
    others = events.filter(~F.col("tool").isin(*cumulative_tools))
    if low is not None:
        differenced, others = differenced.filter(F.col("ts") >= low), others.filter(F.col("ts") >= low)
    return _passed_through(others).unionByName(differenced)


def _difference(
    rows: DataFrame, sized: DataFrame, hot_session_rows: int, chunk_rows: int
) -> DataFrame:
    # A frame no larger than the limit cannot hold a session above it.
    if sized.count() <= hot_session_rows:
        return _difference_whole_sessions(rows)
    # Sessions are counted by bucket first: only those of a bucket above the limit can be hot.
    bucket = F.pmod(F.xxhash64(*SESSION_KEY), F.lit(SIZE_BUCKETS))
    full = sized.groupBy(bucket.alias("bucket")).count().filter(F.col("count") > hot_session_rows)
    buckets = [r["bucket"] for r in full.collect()]
    if not buckets:
        return _difference_whole_sessions(rows)
    sizes = sized.filter(bucket.isin(buckets)).groupBy(*SESSION_KEY).count()
    hot = pin(sizes.filter(F.col("count") > hot_session_rows), "hot-sessions")
    n_hot, n_rows = hot.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
    if n_hot == 0:
        return _difference_whole_sessions(rows)
    keys = hot.select(*SESSION_KEY)
    if n_hot <= MAX_BROADCAST_KEYS:
        keys = F.broadcast(keys)
    chunks = max(2, -(-n_rows // chunk_rows))
    return _difference_whole_sessions(rows.join(keys, [*SESSION_KEY], "left_anti")).unionByName(
        difference_in_chunks(rows.join(keys, [*SESSION_KEY], "left_semi"), chunks)
    )


def _delta(name: str, previous: Column) -> Column:
    current = F.col(name)
    step = F.greatest(current - previous, F.lit(0).cast("bigint"))
    return F.when(F.col("is_cumulative"), step).otherwise(current).alias(name)


def _difference_whole_sessions(rows: DataFrame) -> DataFrame:
    window = Window.partitionBy(*SESSION_KEY).orderBy(*_TURN_ORDER)
    return rows.select(
        *[
            _delta(c, F.lag(c, 1, 0).over(window)) if c in TOKEN_COLS else F.col(c)
            for c in (*TURN_COLS, *ORDER_COLS)
        ]
    )


def difference_in_chunks(rows: DataFrame, chunks: int) -> DataFrame:
    """The same deltas with each session cut into ordered chunks.

    Range partitioning over the whole turn order spreads one session evenly over
    tasks. The written chunk number freezes that layout. Inside a chunk the previous
    row is a plain lag; the first row of a chunk takes the last reading of the
    session's previous chunk, one small row per session and chunk.
    """
    laid_out = rows.repartitionByRange(chunks, *SESSION_KEY, *_TURN_ORDER).withColumn(
        "chunk", F.spark_partition_id()
    )
    pinned = pin(laid_out, "session-chunks")

    tails = pinned.groupBy(*SESSION_KEY, "chunk").agg(
        F.max_by(F.struct(*TOKEN_COLS), F.struct(*_TURN_ORDER)).alias("tail")
    )
    by_session = Window.partitionBy(*SESSION_KEY).orderBy("chunk")
    carried = tails.select(*SESSION_KEY, "chunk", F.lag("tail").over(by_session).alias("carry"))

    in_chunk = Window.partitionBy("chunk", *SESSION_KEY).orderBy(*_TURN_ORDER)
    lagged = pinned.withColumns({f"previous_{c}": F.lag(c).over(in_chunk) for c in TOKEN_COLS})
    zero = F.lit(0).cast("bigint")
    return lagged.join(carried, [*SESSION_KEY, "chunk"], "left").select(
        *[
            _delta(c, F.coalesce(F.col(f"previous_{c}"), F.col(f"carry.{c}"), zero))
            if c in TOKEN_COLS
            else F.col(c)
            for c in (*TURN_COLS, *ORDER_COLS)
        ]
    )
