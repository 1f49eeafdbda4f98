"""Log discovery, the file manifest, and line reads."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnledger.functions.paths import local_path
from turnledger.operators.pinning import pin
from turnledger.schema import FILE_CONTEXT, MANIFEST
from turnledger.session import is_missing_path
from turnledger.sources.dialects import DIALECTS, TOOL_RANK
from turnledger.sources.dialects.common import Layout
from turnledger.sources.listing import can_list, file_type, list_tree, qualified

# --- fixed values -----------------------------------------------------------
LOG_GLOB = "*.jsonl"
SKIPPED, SCANNED = "skipped", "scanned"
# ----------------------------------------------------------------------------

_LISTED = T.StructType(
    [
        *MANIFEST.fields,
        T.StructField("uri", T.StringType()),
        T.StructField("tool_rank", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class Source:
    """A tool and the folders its logs live in."""

    tool: str
    roots: tuple[str, ...]
    glob: str = LOG_GLOB


def discover(spark: SparkSession, sources: Iterable[Source]) -> tuple[DataFrame, dict[str, bool]]:
    """Manifest of all log files, and per tool whether any of its roots exists."""
    listed, present = list_sources(spark, sources)
    found = {source.tool for source in present}
    return listed, {source.tool: source.tool in found for source in sources}


def list_sources(
    spark: SparkSession, sources: Iterable[Source]
) -> tuple[DataFrame, list[Source]]:
    """Manifest of all log files, and the sources cut down to the roots that exist.

    Each root is listed once and the manifest is written, so it stays as it was found. Only file
    status is read, never content. A root that does not exist adds nothing.
    """
    listings, present = [], []
    for source in sources:
        for root in source.roots:
            files = _list_root(spark, source, root)
            if files is not None:
                listings.append(files)
                present.append(Source(source.tool, (root,), source.glob))
    if not listings:
        return spark.createDataFrame([], _LISTED), present
    # A file reached through two roots is one file.
    listed = reduce(DataFrame.unionByName, listings)
    return pin(listed.dropDuplicates(["tool", "source_file"]), "listed-files"), present


def outermost_roots(sources: Iterable[Source]) -> dict[tuple[str, str], list[str]]:
    """Roots by tool and file name pattern, without those that lie below another one."""
    grouped: dict[tuple[str, str], set[str]] = {}
    for source in sources:
        own = grouped.setdefault((source.tool, source.glob), set())
        own.update(root.rstrip("/") or "/" for root in source.roots)
    for tool, glob in grouped:
        for other, pattern in grouped:
            clash = tool == other and glob != pattern
            if clash and any(_below(a, b) for a in grouped[tool, glob] for b in grouped[other, pattern]):
                raise ValueError(f"{tool}: one folder is given with two file name patterns")
    return {
        key: sorted(r for r in roots if not any(r != o and _below(r, o) for o in roots))
        for key, roots in grouped.items()
    }


def _below(path: str, root: str) -> bool:
    return path == root or path.startswith(root.rstrip("/") + "/")


def list_files(spark: SparkSession, sources: Iterable[Source]) -> DataFrame:
    """Manifest of all log files: tool, path, size and modification time."""
    return discover(spark, sources)[0]


def _open_root(spark: SparkSession, root: str, glob: str) -> DataFrame | None:
    """``uri, size, mtime_ms`` of the files below a root, if there is one."""
    place = qualified(spark, root)
    if can_list(place, glob):
        kind = file_type(place)
        if kind == fs.FileType.NotFound:
            return None
        if kind == fs.FileType.Directory:
            return list_tree(spark, place, glob)
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
    )
    try:
        return reader.load(literal_path(root)).select(
            F.col("path").alias("uri"),
            F.col("length").alias("size"),
            F.unix_millis("modificationTime").alias("mtime_ms"),
        )
    except AnalysisException as error:
        if not is_missing_path(error):
            raise
        return None


def _list_root(spark: SparkSession, source: Source, root: str) -> DataFrame | None:
    files = _open_root(spark, root, source.glob)
    if files is None:
        return None
    path = local_path(F.col("uri"))
    return files.filter(_in_layout(path, root, DIALECTS[source.tool].layout)).select(
        F.lit(source.tool).alias("tool"),
        path.alias("source_file"),
        "size",
        "mtime_ms",
        "uri",
        F.lit(TOOL_RANK[source.tool]).alias("tool_rank"),
    )


def _in_layout(path: Column, root: str, layout: Layout) -> Column:
    # The listing qualifies paths, so the root is located without its scheme.
    anchor = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:", "", root).rstrip("/") + "/"
    anchor = re.sub(r"^/{2,}(?=[^/]*/)", "/", anchor) if root.startswith("file:") else anchor
    below = F.substring(path, F.locate(anchor, path) + F.lit(len(anchor)), F.length(path))
    parts = F.split(below, "/")
    folders = F.size(parts) - 1
    fits = folders >= layout.min_folders
    if layout.max_folders is not None:
        fits = fits & (folders <= layout.max_folders)
    if layout.top_folders:
        fits = fits & F.element_at(parts, 1).isin(*layout.top_folders)
    return fits


def literal_path(path: str) -> str:
    """Escape glob characters so a path names exactly one file or folder."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def classify(manifest: DataFrame, state: DataFrame) -> DataFrame:
    """Add ``status`` and ``start_offset`` to every file of the manifest.

    Same size and time: skipped. Shorter or older than before: replaced, read from the
    start. Otherwise only what follows the stored offset is new.

    If the state has the context of the lines before its offset, it is added as well, with
    ``read_from``: where to begin reading. A file without context is read from its start.
    """
    context = [c for c in FILE_CONTEXT.names if c in state.columns]
    prior = state.select(
        "source_file",
        *context,
        F.col("size").alias("_size"),
        F.col("mtime_ms").alias("_mtime"),
        F.col("byte_offset").alias("_offset"),
    )
    unchanged = (F.col("_size") == F.col("size")) & (F.col("_mtime") == F.col("mtime_ms"))
    replaced = (F.col("size") < F.col("_size")) | (F.col("mtime_ms") < F.col("_mtime"))
    zero = F.lit(0).cast("bigint")
    start = (
        F.when(F.col("_size").isNull() | replaced, zero)
        .when(F.col("_offset") > F.col("size"), zero)
        .otherwise(F.col("_offset"))
    )
    classified = (
        manifest.join(prior, "source_file", "left")
        .withColumn("status", F.when(unchanged, F.lit(SKIPPED)).otherwise(F.lit(SCANNED)))
        .withColumn("start_offset", start)
        .drop("_size", "_mtime", "_offset")
    )
    if not context:
        return classified
    resumed = (F.col("start_offset") > 0) & F.col("n_lines").isNotNull()
    read_from = F.when(resumed, F.col("start_offset")).otherwise(zero)
    return classified.withColumns(
        {"read_from": read_from, **{c: F.when(resumed, F.col(c)) for c in context}}
    )


def read_lines(spark: SparkSession, paths: Sequence[str], glob: str | None = None) -> DataFrame:
    """Every line of the files with its place in the read.

    ``paths`` are files, or folders when a ``glob`` for the files in them is given.

    Files stay splittable. ``row_id`` grows with the line inside one split, splits are
    ordered by ``split_start``; together they give the file order. ``line_bytes``
    counts the line break, which the last line of a file may lack.
    """
    reader = (
        spark.read.option("lineSep", "\n")
        .option("ignoreMissingFiles", True)
        .option("ignoreCorruptFiles", True)
    )
    if glob is not None:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    raw = reader.text([literal_path(path) for path in paths])
    return raw.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.unix_millis("_metadata.file_modification_time").alias("mtime_ms"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("row_id"),
        (F.octet_length("value") + 1).cast("bigint").alias("line_bytes"),
        "value",
    )
