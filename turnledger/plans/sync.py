"""Incremental, idempotent ingestion of log folders into a ledger."""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from turnledger.functions.paths import plain_path
from turnledger.operators.file_order import BYTE_ORDER_MARK_BYTES, complete_lines, consumed_lines, new_lines
from turnledger.operators.normalize import place_and_bind, read_facts
from turnledger.operators.pinning import pin
from turnledger.schema import FILE_CONTEXT, USAGE_EVENTS
from turnledger.session import configure, is_missing_path, scratch_scope
from turnledger.sources.dialects import tools
from turnledger.sources.dialects.common import EVENT, MALFORMED
from turnledger.sources.files import (
    SCANNED,
    SKIPPED,
    Source,
    classify,
    discover,
    read_lines,
)
from turnledger.sources.ledger import Ledger
from turnledger.sources.ranges import can_open, read_ranges

# Files handled per commit where the driver must name them; bounds the path list it holds.
FILES_PER_BATCH = 100_000
# Files of a tool that Spark's text reader takes by name; where there are more, tasks open them.
NAMED_FILES = 1_000
# What Spark's text reader unpacks by the ending of the name.
_PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|xz)$"
# Requests for the status of a file that are under way at once.
STATUS_REQUESTS = 16


@dataclass
class ToolAudit:
    """What one sync did for one tool."""

    tool: str
    detected: bool
    files_scanned: int = 0
    files_skipped: int = 0
    new_events: int = 0
    duplicates_ignored: int = 0
    malformed_lines: int = 0
    files_failed: int = 0


@dataclass
class SyncResult:
    """Audit per tool in registry order, and the failed files as a DataFrame."""

    elapsed_ms: int
    tools: list[ToolAudit]
    failures: DataFrame
    spark: SparkSession = field(repr=False)

    def audit(self) -> DataFrame:
        """The per-tool audit as rows."""
        return self.spark.createDataFrame([Row(**vars(t)) for t in self.tools])


def sync(
    spark: SparkSession,
    sources: Sequence[Source],
    ledger_path: str,
    files_per_batch: int | None = None,
    scanned_at: int | None = None,
) -> SyncResult:
    """Read what is new in the log folders and append it to the ledger.

    Files go in ledger order (tool, path), ``files_per_batch`` per commit: by default all at once,
    or ``FILES_PER_BATCH`` if some lie in a store that only Spark's readers can open. Events,
    quarantine and state of a commit come into force together; an interrupted sync continues with
    the next run. One writer at a time: of two, the later one to finish fails with ``SecondWriter``.
    """
    configure(spark)
    # The failures of the result are read later.
    with scratch_scope(spark, keep=("manifest", "read-files")):
        return _sync(spark, sources, ledger_path, files_per_batch, scanned_at)


def _sync(
    spark: SparkSession,
    sources: Sequence[Source],
    ledger_path: str,
    files_per_batch: int | None,
    scanned_at: int | None,
) -> SyncResult:
    started = time.monotonic()
    ledger = Ledger(spark, ledger_path)
    listed, detected = discover(spark, sources)
    audits = {t: ToolAudit(t, detected.get(t, False)) for t in tools()}

    manifest = pin(classify(listed, ledger.file_states()), "manifest")
    for row in manifest.filter(F.col("status") == SKIPPED).groupBy("tool").count().collect():
        audits[row["tool"]].files_skipped = row["count"]

    failures = []
    for page in _pages(manifest.filter(F.col("status") == SCANNED), files_per_batch):
        stamp = int(time.time()) if scanned_at is None else scanned_at
        failures.append(_commit(spark, ledger, page, stamp, audits))

    failed = spark.createDataFrame([], "tool string, source_file string, error string")
    for part in failures:
        failed = failed.unionByName(part)
    elapsed = int((time.monotonic() - started) * 1000)
    return SyncResult(elapsed, [audits[t] for t in tools()], failed, spark)


@dataclass
class _Page:
    """Files of one commit: those read whole by path, those that tasks open by how much there is to read."""

    files: DataFrame
    uris: dict[str, list[str]]
    opened: dict[str, _Opened]


@dataclass
class _Opened:
    n_files: int
    n_bytes: int
    all_files: bool


def _pages(changed: DataFrame, size: int | None) -> Iterator[_Page]:
    """Changed files in ledger order, ``size`` at a time. The column ``opened`` marks those that
    tasks open: grown ones, and all of a tool that has very many."""
    order = ("tool_rank", "source_file")
    store = F.regexp_extract("uri", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/]*)?/", 0)
    stores = [row[0] for row in changed.select(store).distinct().collect()]
    if not stores:
        return
    unread = [name for name in stores if not can_open(name)]
    whole = store.isin(unread)
    if unread:
        size = size or FILES_PER_BATCH
        changed = changed.withColumns(
            {
                "read_from": F.when(whole, F.lit(0).cast("bigint")).otherwise(F.col("read_from")),
                **{c: F.when(~whole, F.col(c)) for c in FILE_CONTEXT.names},
            }
        )
    rest = changed
    while True:
        files, more = rest, None
        if size:
            ordered = rest.select(F.struct(*order).alias("at")).orderBy("at").limit(size)
            n, last = ordered.agg(F.count("at"), F.max("at")).first()
            if n == size:
                last = F.struct(*[F.lit(last[c]).alias(c) for c in order])
                files, more = rest.filter(F.struct(*order) <= last), rest.filter(F.struct(*order) > last)
        grown, left = F.col("read_from") > 0, F.col("size") - F.col("read_from")
        fresh = ~grown & ~whole & ~F.col("uri").rlike(_PACKED)
        sizes = files.groupBy("tool").agg(
            *[F.struct(F.count_if(of), F.coalesce(F.sum(F.when(of, left)), F.lit(0))) for of in (grown, fresh)]
        )
        by_tasks = {}
        for tool, tails, new in sizes.collect():
            all_files = new[0] > NAMED_FILES
            n_files, n_bytes = (a + b for a, b in zip(tails, new, strict=True)) if all_files else tails
            if n_files:
                by_tasks[tool] = _Opened(n_files, n_bytes, all_files)
        many = [tool for tool, own in by_tasks.items() if own.all_files]
        files = files.withColumn("opened", grown | (F.col("tool").isin(many) & fresh))
        uris = defaultdict(list)
        for row in files.filter("NOT opened").orderBy(*order).select("tool", "uri").collect():
            uris[row["tool"]].append(row["uri"])
        if not uris and not by_tasks:
            return
        yield _Page(files, dict(uris), by_tasks)
        if more is None:
            return
        rest = more


def _read_present(spark: SparkSession, uris: list[str]) -> DataFrame | None:
    """Lines of the files that still exist."""
    try:
        return read_lines(spark, uris)
    except AnalysisException as error:
        if not is_missing_path(error):
            raise
        # A listed file vanished before the read: ask for the status of each, no job a file.
        with ThreadPoolExecutor(STATUS_REQUESTS) as pool:
            found = list(pool.map(lambda uri: _exists(spark, uri), uris))
        present = [uri for uri, there in zip(uris, found, strict=True) if there]
        return read_lines(spark, present) if present else None


def _exists(spark: SparkSession, uri: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _commit(
    spark: SparkSession, ledger: Ledger, page: _Page, stamp: int, audits: dict[str, ToolAudit]
) -> DataFrame:
    lines = {t: _read_present(spark, uris) for t, uris in page.uris.items()}
    lines = {t: df for t, df in lines.items() if df is not None}
    for tool, own in page.opened.items():
        ranges = read_ranges(page.files.filter((F.col("tool") == tool) & F.col("opened")), own.n_files, own.n_bytes)
        lines[tool] = lines[tool].unionByName(ranges) if tool in lines else ranges
    files = page.files.select(
        "tool", "source_file", "size", "mtime_ms", "start_offset", "read_from", *FILE_CONTEXT.names
    )
    if not lines:
        return _mark_failed(files, audits)
    facts = read_facts(lines)

    # A file counts as read only if all its bytes arrived.
    read_bytes = (
        facts.groupBy("file_path")
        .agg(F.sum("line_bytes").alias("read_bytes"))
        .select(plain_path(F.col("file_path")).alias("source_file"), "read_bytes")
    )
    wanted = F.col("size") - F.col("read_from") - F.when(F.col("read_from") == 0, BYTE_ORDER_MARK_BYTES).otherwise(0)
    arrived = F.coalesce(F.col("read_bytes"), F.lit(0)) >= wanted
    checked = pin(
        files.join(read_bytes, "source_file", "left").withColumn("arrived", arrived), "read-files"
    )
    complete = checked.filter("arrived")

    # Placed once: the rows to store and what each file has consumed are both read from it.
    placed = pin(complete_lines(place_and_bind(facts, complete)), "placed-lines")
    kept = new_lines(placed).filter(F.col("outcome").isin(EVENT, MALFORMED))
    with ledger.commit() as writer:
        kept = kept.withColumn("ingest_batch", F.lit(writer.batch).cast("bigint"))
        stored = writer.append_events(kept.filter(F.col("outcome") == EVENT).select(*USAGE_EVENTS.names))
        malformed = kept.filter(F.col("outcome") == MALFORMED)
        writer.append_quarantine(
            malformed.withColumn("reason", F.lit("not one JSON object, or a count out of range"))
        )
        writer.append_state(file_states_after(complete, consumed_lines(placed), stamp))

    for row in complete.groupBy("tool").count().collect():
        audits[row["tool"]].files_scanned += row["count"]
    for row in kept.groupBy("tool", "outcome").count().collect():
        if row["outcome"] == MALFORMED:
            audits[row["tool"]].malformed_lines += row["count"]
        else:
            audits[row["tool"]].duplicates_ignored += row["count"]
    for tool, count in stored.items():
        audits[tool].new_events += count
        audits[tool].duplicates_ignored -= count
    return _mark_failed(checked.filter("NOT arrived"), audits)


def file_states_after(files: DataFrame, consumed: DataFrame, stamp: int) -> DataFrame:
    """States of ``files`` once the ``consumed`` lines are stored.

    Without a new complete line the offset and its context stay; a context that is not known
    stays unknown, and the file is read whole next time.
    """
    now = consumed.select("source_file", "consumed", F.struct(*FILE_CONTEXT.names).alias("now"))
    some = F.col("consumed").isNotNull()
    context = {c: F.when(some, F.col(f"now.{c}")).otherwise(F.col(c)) for c in FILE_CONTEXT.names}
    # The first session of a file stays its session.
    context["first_session"] = F.coalesce("first_session", "now.first_session")
    return files.join(now, "source_file", "left").select(
        "source_file",
        "size",
        "mtime_ms",
        F.coalesce("consumed", "start_offset").alias("byte_offset"),
        F.lit(stamp).cast("bigint").alias("scanned_at"),
        *[column.alias(name) for name, column in context.items()],
    )


def _mark_failed(files: DataFrame, audits: dict[str, ToolAudit]) -> DataFrame:
    for row in files.groupBy("tool").count().collect():
        audits[row["tool"]].files_failed += row["count"]
    return files.select("tool", "source_file", F.lit("incomplete read").alias("error"))
