"""Files below a folder, listed by tasks with the Arrow file systems.

Spark's own listing gathers the status of every file in the driver. Here the first task goes down
level by level until there are folders enough to deal out, and many tasks list what lies below
them; nothing passes through the driver. Stores that Arrow cannot open, and patterns beyond ``*``
and ``?``, are left to Spark's listing.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.sources.ranges import can_open, open_store

# Folders known at once from which on they are dealt out, and tasks a core that list them.
DEALT_FOLDERS = 1_000
TASKS_PER_CORE = 4
BATCH_ROWS = 10_000

# A folder to go on from, or a file: where it lies below the root.
_FOUND = pa.schema([("folder", pa.string()), ("file", pa.string()), ("size", pa.int64()), ("mtime_ms", pa.int64())])
_FOUND_ROW = "folder string, file string, size bigint, mtime_ms bigint"


def qualified(spark: SparkSession, path: str) -> str:
    """The URI of a path as Spark's listing spells it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def can_list(root: str, glob: str) -> bool:
    return not re.search(r"[\[\]{}\\]", glob) and can_open(root)


def file_type(uri: str) -> fs.FileType:
    store, path = open_store(uri)
    return store.get_file_info(path).type


def list_tree(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``uri, size, mtime_ms`` of the files below the folder ``root`` whose names fit ``glob``.

    As in Spark's listing, names with ``_`` or ``.`` in front and empty files do not count, links
    are followed, and what vanishes meanwhile is left out.
    """
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    none = F.lit(None)
    top = spark.range(0, 1, 1, 1).select(
        F.lit("").alias("folder"), none.cast("string").alias("file"),
        none.cast("bigint").alias("size"), none.cast("bigint").alias("mtime_ms"),
    )
    known = top.mapInArrow(partial(_list, root, glob, DEALT_FOLDERS), _FOUND_ROW)
    found = known.repartition(tasks).mapInArrow(partial(_list, root, glob, None), _FOUND_ROW)
    return found.select(F.concat(F.lit(root.rstrip("/") + "/"), "file").alias("uri"), "size", "mtime_ms")


def _list(root: str, glob: str, enough: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of the batches and of the folders in them, down to the last level; with ``enough``
    folders known at once those are given back."""
    store, base = open_store(root)
    fits = re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob), re.DOTALL)
    rows: list[tuple] = []
    for batch in batches:
        folders = deque()
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if row[0] is None:
                rows.append(row)
            else:
                folders.append(row[0])
        while folders and (enough is None or len(folders) < enough):
            own = folders.popleft()
            below = f"{own}/" if own else ""
            for name, info in _children(store, f"{base.rstrip('/')}/{own}"):
                if info.type == fs.FileType.Directory:
                    folders.append(below + name)
                elif info.type == fs.FileType.File and info.size and fits.fullmatch(name):
                    modified = None if info.mtime_ns is None else info.mtime_ns // 1_000_000
                    rows.append((None, below + name, info.size, modified))
            if len(rows) >= BATCH_ROWS:
                yield _batch(rows)
                rows = []
        rows += [(own, None, None, None) for own in folders]
    if rows:
        yield _batch(rows)


def _children(store: fs.FileSystem, path: str) -> Iterator[tuple[str, fs.FileInfo]]:
    for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        try:
            name = info.base_name
        except UnicodeDecodeError:
            # No path of Hadoop's file systems names it either.
            continue
        if not _hidden(name, info.type == fs.FileType.Directory):
            yield name, info


def _hidden(name: str, is_folder: bool) -> bool:
    """Names that Spark's readers leave out."""
    if name.startswith(".") or name.endswith("._COPYING_"):
        return True
    if is_folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith("_") and "=" not in name


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), _FOUND, strict=True)],
        schema=_FOUND,
    )
