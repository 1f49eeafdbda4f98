"""Per-turn deltas on a stream of running totals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnledger.schema import ORDER_COLS, SESSION_KEY, TOKEN_COLS, TURN_COLS, USAGE_EVENTS

_FIELDS = {f.name: f for f in USAGE_EVENTS.fields}
TURNS = T.StructType([_FIELDS[c] for c in (*TURN_COLS, *ORDER_COLS)])
# The sessions of a bucket and their last readings, side by side.
_LAST_READINGS = T.StructType(
    [T.StructField(c, T.ArrayType(_FIELDS[c].dataType)) for c in (*SESSION_KEY, *TOKEN_COLS)]
)
# Buckets the sessions are dealt to. A call of the state step costs far more than the rows of a
# session, so it takes all sessions of a bucket.
BUCKETS = 1024


def turn_stream(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The per-turn view of a stream of ledger rows, in append mode.

    The state of a bucket of sessions is the last reading of the five counters of each. Rows of one
    micro-batch are ordered here; across micro-batches arrival order is taken as turn
    order, so late rows are differenced against what came before them. The batch view
    stays the reference. The source's files-per-trigger limit bounds the rows of a
    bucket that one task holds; ``buckets`` stays the same over the life of a checkpoint.
    """
    return (
        events.select(*TURN_COLS, *ORDER_COLS, "is_cumulative")
        .withColumn("bucket", F.pmod(F.xxhash64(*SESSION_KEY), F.lit(buckets)).cast("int"))
        .groupBy("bucket")
        .applyInPandasWithState(_bucket_step, TURNS, _LAST_READINGS, "append", GroupStateTimeout.NoTimeout)
    )


def _bucket_step(
    key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(chunks)).sort_values([*SESSION_KEY, "ts", *ORDER_COLS])
    sessions = list(zip(*(rows[c].astype(object).where(rows[c].notna(), None) for c in SESSION_KEY), strict=True))
    columns = state.get if state.exists else [[]] * (len(SESSION_KEY) + len(TOKEN_COLS))
    last = {row[: len(SESSION_KEY)]: row[len(SESSION_KEY) :] for row in zip(*columns, strict=True)}
    # Integers throughout: as floats, counters above 2**53 would lose their last digits.
    readings = np.column_stack([rows[c].to_numpy(dtype=np.int64) for c in TOKEN_COLS])
    before = np.concatenate([np.zeros((1, len(TOKEN_COLS)), dtype=np.int64), readings[:-1]])
    for i, session in enumerate(sessions):
        if i == 0 or session != sessions[i - 1]:
            before[i] = last.get(session, 0)
        if i + 1 == len(sessions) or session != sessions[i + 1]:
            last[session] = tuple(int(v) for v in readings[i])
    deltas = np.maximum(readings - before, 0)
    turns = np.where(rows["is_cumulative"].to_numpy(dtype=bool)[:, None], deltas, readings)
    state.update(tuple(list(column) for column in zip(*(k + v for k, v in last.items()), strict=True)))
    own = dict(zip(TOKEN_COLS, turns.T, strict=True))
    yield pd.DataFrame({c: own[c] if c in own else rows[c].array for c in TURNS.names})
