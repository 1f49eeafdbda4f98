"""The stored ledger: usage events, scan state and quarantine as Parquet parts.

Every commit writes its rows into parts of their own and then names all parts in force in the
commit log; until then nothing of it is visible. A commit that is interrupted leaves folders
that the next one overwrites. Small parts are merged now and then, so the number of parts, and
of files read, stays flat however many commits there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnledger.functions.dates import day_bounds
from turnledger.operators.dedupe import first_wins
from turnledger.operators.deltas import merged_heads, session_heads, turns_between, turns_with_heads
from turnledger.schema import FILE_STATE, QUARANTINE, SCAN_STATE, SESSION_HEADS, USAGE_EVENTS
from turnledger.sources.commits import Commit, CommitLog, Part
from turnledger.sources.dialects import cumulative_tools

# Rows of a part from which its keys are dealt to one more bit of buckets.
ROWS_PER_BUCKET = 250_000
MAX_BUCKET_BITS = 14
# Parts of a kind from which the smallest ones are merged, and how many of them.
MAX_PARTS, MERGED_PARTS = 16, 9

_STORED_EVENTS = T.StructType(
    [*USAGE_EVENTS.fields, T.StructField("key_bucket", T.IntegerType())]
)
_STORED_STATE = T.StructType(
    [*FILE_STATE.fields, T.StructField("ingest_batch", T.LongType())]
)
_STORED_QUARANTINE = T.StructType(
    [*QUARANTINE.fields, T.StructField("ingest_batch", T.LongType())]
)
_STORED = {
    "events": _STORED_EVENTS,
    "state": _STORED_STATE,
    "quarantine": _STORED_QUARANTINE,
    "heads": SESSION_HEADS,
}
_LINE = ("source_file", "line_no", "raw_md5")


def key_bucket(bits: int) -> Column:
    """Bucket of a key among ``2 ** bits``: a part of many rows has many, so that a small batch
    touches few of them."""
    return F.pmod(F.xxhash64("dedupe_key"), F.lit(1 << bits)).cast("int")


def bucket_bits(rows: int) -> int:
    """Bits of the buckets of a part, so that a bucket has at most ``ROWS_PER_BUCKET`` rows or so."""
    return min(max(math.ceil(math.log2(max(rows, 1) / ROWS_PER_BUCKET)), 0), MAX_BUCKET_BITS)


@dataclass(frozen=True)
class Ledger:
    """A ledger at a path on shared storage."""

    spark: SparkSession
    path: str

    @property
    def log(self) -> CommitLog:
        return CommitLog(self.spark, self.path)

    def _rows(self, kind: str, commit: Commit | None = None) -> DataFrame:
        return self._read(kind, getattr(commit or self.log.latest(), kind))

    def _read(self, kind: str, parts: tuple[Part, ...]) -> DataFrame:
        schema = _STORED[kind]
        frames = []
        # Folders of the time before the log have no level for the part.
        for old in (False, True):
            paths = [f"{self.path}/{p.path}" for p in parts if p.path.startswith("events/tool=") == old]
            if paths:
                reader = self.spark.read.schema(schema)
                if kind == "events":
                    reader = reader.option("basePath", f"{self.path}/events")
                frames.append(reader.parquet(*paths).select(*schema.names))
        return reduce(DataFrame.unionByName, frames or [self.spark.createDataFrame([], schema)])

    def events(self) -> DataFrame:
        """Raw usage rows as parsed, running totals included."""
        return self._rows("events").select(*USAGE_EVENTS.names)

    def turns(
        self, since: str | None = None, until: str | None = None, cumulative: Sequence[str] | None = None
    ) -> DataFrame:
        """The per-turn view; with days, only what a report on that range can use.

        The range is a day wider on both sides, for any time zone; reports take the same
        days and filter exactly. Rows before the range are not read: the stored heads of the
        sessions stand in for them. ``cumulative`` are the tools with running totals.
        """
        commit = self.log.latest()
        events = self._rows("events", commit).select(*USAGE_EVENTS.names)
        tools, bounds = cumulative or cumulative_tools(), day_bounds(since, until)
        if not commit.headed:
            return turns_between(events, tools, *bounds)
        return turns_with_heads(events, self._rows("heads", commit), tools, *bounds)

    def scan_state(self) -> DataFrame:
        """Latest state of every log file."""
        return self.file_states().select(*SCAN_STATE.names)

    def file_states(self) -> DataFrame:
        """The same with the context that the lines so far leave to those to come."""
        return _latest_states(self._rows("state")).drop("ingest_batch")

    def quarantine(self) -> DataFrame:
        """Malformed lines: where they are and their digest, never their text."""
        return self._rows("quarantine").select(*QUARANTINE.names)

    def unseen(self, rows: DataFrame, commit: Commit | None = None) -> DataFrame:
        """Rows whose key is not stored yet, the earliest row of each key.

        Of every stored part only the buckets that the batch has keys for are read; they are
        named in the plan, so other folders are not even opened. Their keys are matched against
        the batch first, and shuffled only when the batch is too large to broadcast.
        """
        commit = commit or self.log.latest()
        candidates = first_wins(rows)
        wanted = rows.select("dedupe_key").distinct()
        seen = [self._stored_keys(wanted, bits, parts) for bits, parts in _by_bits(commit.events).items()]
        if not seen:
            return candidates
        # On the key alone, the partitioning the candidates already have.
        return candidates.join(reduce(DataFrame.unionByName, seen), "dedupe_key", "left_anti")

    def _stored_keys(self, wanted: DataFrame, bits: int, parts: tuple[Part, ...]) -> DataFrame:
        """Keys of ``wanted`` in parts whose buckets have ``bits`` bits."""
        stored = self._read("events", parts)
        if bits:
            # At most 2 ** MAX_BUCKET_BITS numbers.
            own = [r[0] for r in wanted.select(key_bucket(bits)).distinct().collect()]
            if len(own) < 1 << bits:
                stored = stored.where(F.col("key_bucket").isin(own))
        return stored.join(wanted, "dedupe_key", "left_semi").select("dedupe_key")

    @contextmanager
    def commit(self) -> Iterator[Writer]:
        """Rows appended inside come into force together at its end, or not at all."""
        writer = Writer(self, self.log.latest())
        yield writer
        writer.publish()


def _by_bits(parts: tuple[Part, ...]) -> dict[int, tuple[Part, ...]]:
    return {bits: tuple(p for p in parts if p.bits == bits) for bits in sorted({p.bits for p in parts})}


def _latest_states(rows: DataFrame) -> DataFrame:
    state = F.struct(*[c for c in _STORED_STATE.names if c != "source_file"])
    latest = rows.groupBy("source_file").agg(F.max_by(state, F.col("ingest_batch")).alias("state"))
    return latest.select("source_file", "state.*")


class Writer:
    """One commit in the making."""

    def __init__(self, ledger: Ledger, base: Commit):
        self.ledger, self.base = ledger, base
        self.batch = ledger.log.next_number(base)
        self.next = replace(base, number=self.batch)
        self._taken: set[str] = set()

    def append_events(self, rows: DataFrame) -> dict[str, int]:
        """Append the rows whose keys are new, first row wins; returns new rows by tool.

        ``rows`` should be a written table: it is read once for its keys and once for its rows.
        """
        self._claim("events")
        bits = bucket_bits(rows.count())
        unseen = self.ledger.unseen(rows, self.base).select(*USAGE_EVENTS.names)
        tools = [r[0] for r in rows.select("tool").distinct().collect()]
        counts = [F.count_if(F.col("tool") == tool).alias(f"n{i}") for i, tool in enumerate(tools)]
        path = f"events/part={self.batch:010d}"
        found = self._write_events(unseen, path, bits, counts)
        added = {tool: found[f"n{i}"] for i, tool in enumerate(tools)}
        part = Part(path, sum(added.values()), bits)
        self._add("events", part)
        self._append_heads((part,) if part.rows else ())
        return added

    def _append_heads(self, parts: tuple[Part, ...]) -> None:
        """Heads of new events; of all events, if those stored have none yet."""
        if not self.next.headed:
            parts = (*self.base.events, *parts)
        if parts:
            path = f"heads/{self.batch:010d}"
            heads = session_heads(self.ledger._read("events", parts)).hint("rebalance")
            self._add("heads", Part(path, self._write(heads.select(*SESSION_HEADS.names), path)))
        self.next = replace(self.next, headed=True)

    def append_state(self, rows: DataFrame) -> None:
        """Upsert file states: the row of the highest batch is a file's state."""
        self._append("state", rows.select(*FILE_STATE.names))

    def append_quarantine(self, rows: DataFrame) -> None:
        """Append malformed lines not stored yet: a line is its file, number and digest.

        Only lines of the files at hand are looked up.
        """
        new = rows.select(*QUARANTINE.names).dropDuplicates([*_LINE])
        if self.base.quarantine:
            stored = self.ledger._rows("quarantine", self.base).select(*_LINE)
            stored = stored.join(new.select("source_file").distinct(), "source_file", "left_semi").distinct()
            same = reduce(
                lambda a, b: a & b, (F.col(f"new.{c}").eqNullSafe(F.col(f"stored.{c}")) for c in _LINE)
            )
            new = new.alias("new").join(stored.alias("stored"), same, "left_anti")
        self._append("quarantine", new)

    def _append(self, kind: str, rows: DataFrame) -> None:
        self._claim(kind)
        rows = rows.withColumn("ingest_batch", F.lit(self.batch).cast("bigint"))
        path = f"{kind}/{self.batch:010d}"
        self._add(kind, Part(path, self._write(rows.hint("rebalance"), path)))

    def _write(self, rows: DataFrame, path: str) -> int:
        """Write a part; what an interrupted commit has left there goes."""
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.ledger.path}/{path}")
        return seen.get["n"]

    def _write_events(self, rows: DataFrame, path: str, bits: int, counts: list[Column]) -> dict[str, int]:
        """Write events dealt to tools and buckets, sorted by time so that row groups prune."""
        seen = Observation()
        (
            rows.withColumn("key_bucket", key_bucket(bits))
            .hint("rebalance", "tool", "key_bucket")
            .sortWithinPartitions("tool", "key_bucket", "ts")
            # Counted in the tasks that write, each of which counts once.
            .observe(seen, F.count(F.lit(1)).alias("n"), *counts)
            .write.mode("overwrite")
            .partitionBy("tool", "key_bucket")
            .parquet(f"{self.ledger.path}/{path}")
        )
        return seen.get

    def _claim(self, kind: str) -> None:
        """A commit has one part of a kind: a second one would overwrite the first."""
        if kind in self._taken:
            raise RuntimeError(f"{kind} have been appended to this commit already")
        self._taken.add(kind)

    def _add(self, kind: str, part: Part) -> None:
        if part.rows:
            self.next = self.next.following(kind, (*getattr(self.next, kind), part))

    def publish(self) -> None:
        """Merge small parts where there are many, and put the commit in force."""
        for kind in _STORED:
            parts = getattr(self.next, kind)
            if len(parts) > MAX_PARTS:
                small = tuple(sorted(parts, key=lambda p: p.rows)[:MERGED_PARTS])
                merged = self._merge(kind, small)
                self.next = self.next.following(kind, (*(p for p in parts if p not in small), merged))
        self.ledger.log.publish(self.base, self.next)

    def _merge(self, kind: str, parts: tuple[Part, ...]) -> Part:
        path = f"{kind}/{'part=' if kind == 'events' else ''}{self.batch:010d}-merged"
        rows = self.ledger._read(kind, parts)
        if kind == "events":
            n = sum(p.rows for p in parts)
            bits = bucket_bits(n)
            self._write_events(rows.select(*USAGE_EVENTS.names), path, bits, [])
            return Part(path, n, bits)
        # Of a file's states only the latest is of use, of a session's heads in a span too.
        one_each = {"state": _latest_states, "heads": merged_heads}
        rows = one_each[kind](rows) if kind in one_each else rows
        return Part(path, self._write(rows.select(*_STORED[kind].names).hint("rebalance"), path))
