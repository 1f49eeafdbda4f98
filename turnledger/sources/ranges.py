"""Lines of byte ranges of files: what was appended since a file was last read, and many files at once.

Spark's text reader takes files whole and by name. Here every task opens the files of its ranges
with the Arrow file systems (local, HDFS and the object stores) and reads nothing before the first
byte asked for. Stores that Arrow cannot open are left to the text reader.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes of one range: long tails are read by many tasks.
RANGE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
# Bytes a task should have to read at least, if there are more tasks than files, and files it opens.
TASK_BYTES = 8 << 20
TASK_FILES = 2_000
# Bytes and lines handed on together.
BATCH_BYTES, BATCH_LINES = 4 << 20, 20_000
BYTE_ORDER_MARK = b"\xef\xbb\xbf"

_URI = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/]*)?(/.*)$", re.DOTALL)
_LINES = "file_path string, mtime_ms bigint, split_start bigint, row_id bigint, line_bytes bigint, value binary"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (not percent-encoded, as listings give it) and the path in it."""
    found = _URI.match(uri)
    if not found:
        raise ValueError(f"not an absolute path: {uri}")
    scheme, host, path = found.groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), path
    store, base = fs.FileSystem.from_uri(f"{scheme}:{host or ''}/")
    return store, base.rstrip("/") + path


def can_open(uri: str) -> bool:
    """Whether Arrow knows the store of ``uri``; the file itself may be gone."""
    try:
        store, path = open_store(uri)
        store.get_file_info(path)
        return True
    except (pa.ArrowException, OSError, ValueError, NotImplementedError):
        return False


def read_ranges(files: DataFrame, n_files: int, n_bytes: int) -> DataFrame:
    """Lines that begin between ``read_from`` and ``size`` of each file, as ``read_lines`` gives them.

    ``read_from`` must follow a line break or be zero; a byte order mark at the start of a file is
    left out. ``n_files`` and ``n_bytes`` (an estimate will do) set the number of tasks. A file that
    is gone or cannot be read gives no lines, one that has become shorter gives fewer.
    """
    cores = files.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(n_files, cores), n_bytes // TASK_BYTES, n_files // TASK_FILES, 1)
    starts = F.sequence("read_from", F.col("size") - 1, F.lit(RANGE_BYTES).cast("bigint"))
    ranges = (
        files.where(F.col("read_from") < F.col("size"))
        .select("uri", "mtime_ms", "size", "read_from", F.explode(starts).alias("first"))
        .repartition(int(tasks))
    )
    # Bytes that are no UTF-8 stay as they are, as in the text reader.
    return ranges.mapInArrow(_read, _LINES).withColumn("value", F.col("value").cast("string"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n_bytes, n_lines = [], 0, 0
    for batch in batches:
        for row in batch.to_pylist():
            last = min(row["first"] + RANGE_BYTES, row["size"])
            # Encoded as in the metadata of the text reader, where it matters.
            place, number = (row["uri"].replace("%", "%25"), row["mtime_ms"], row["first"]), 0
            try:
                for lines, sizes in _raw_lines(row["uri"], row["read_from"], row["first"], last, row["size"]):
                    held.append((place, number, sizes, lines))
                    number += len(sizes)
                    n_lines += len(sizes)
                    n_bytes += int(sizes.sum())
                    if n_bytes >= BATCH_BYTES or n_lines >= BATCH_LINES:
                        yield _joint(held)
                        held, n_bytes, n_lines = [], 0, 0
            except OSError:
                # The missing bytes make it a failed file.
                continue
    if held:
        yield _joint(held)


def _joint(held: list[tuple]) -> pa.RecordBatch:
    """Lines of several files or blocks, each with its place and the number of its first line."""
    places, numbers, sizes, lines = zip(*held, strict=True)
    counts = [len(own) for own in sizes]
    at = pa.array(np.repeat(np.arange(len(held)), counts))
    uris, times, starts = zip(*places, strict=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(uris, pa.string()).take(at),
            pa.array(times, pa.int64()).take(at),
            pa.array(starts, pa.int64()).take(at),
            pa.array(np.concatenate([np.arange(n, n + count) for n, count in zip(numbers, counts, strict=True)])),
            pa.array(np.concatenate(sizes)),
            pa.concat_arrays(lines).cast(pa.binary()),
        ],
        names=["file_path", "mtime_ms", "split_start", "row_id", "line_bytes", "value"],
    )


def _lines(uri: str, read_from: int, first: int, last: int, size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """``_raw_lines`` as text; bytes that are no UTF-8 are replaced."""
    for raw, sizes in _raw_lines(uri, read_from, first, last, size):
        yield pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string()), sizes


def _raw_lines(uri: str, read_from: int, first: int, last: int, size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Lines beginning from ``first`` up to ``last``, with their bytes; the file counts up to ``size``.

    The last line may lack its break; it counts one byte more than it has, as in ``read_lines``.
    """
    store, path = open_store(uri)
    with store.open_input_file(path) as source:
        at = first
        if first > read_from:
            # A line that begins here has its break just before.
            at = first - 1
            source.seek(at)
            while True:
                block = source.read(min(BLOCK_BYTES, size - at))
                if not block:
                    return
                cut = block.find(b"\n")
                if cut >= 0:
                    at += cut + 1
                    break
                at += len(block)
        source.seek(at)
        # Lines are counted as if the mark were not there.
        mark = len(BYTE_ORDER_MARK) if at == 0 and source.read(len(BYTE_ORDER_MARK)) == BYTE_ORDER_MARK else 0
        at += mark
        source.seek(at)
        held, begun = [], at
        while begun < last:
            block = source.read(min(BLOCK_BYTES, size - at))
            if not block:
                rest = b"".join(held)
                if rest:
                    yield _text(np.array([0, len(rest)]), rest), np.array([len(rest) + 1])
                return
            at += len(block)
            held.append(block)
            if b"\n" not in block:
                continue
            data = b"".join(held)
            ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1
            bounds = np.concatenate([[0], ends])
            # Lines of the next range are left to it.
            n = int(np.searchsorted(bounds[:-1] + begun, last))
            if n:
                yield _text(bounds[: n + 1], data), np.diff(bounds[: n + 1])
            if n < len(ends):
                return
            held = [data[ends[-1] :]]
            begun += int(ends[-1])


def _text(bounds: np.ndarray, data: bytes) -> pa.Array:
    """Lines with their breaks, which every reader strips."""
    offsets = pa.py_buffer(bounds.astype(np.int64).tobytes())
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(data)])
