"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

_RUNTIME_SETTINGS = {
    # Day buckets convert from UTC explicitly, so the session zone must be UTC.
    "spark.sql.session.timeZone": "UTC",
    # Duplicate keys in a JSON object: the last one wins instead of failing the line.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows that lie sorted by their groups are summed as they come. Lists and sets of models would
    # otherwise go through a hash table of few groups and then be sorted once more.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
}
# Tasks a core that list folders at once. By default every folder gets a task of its own, which
# takes far longer to start than to list it.
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_LISTING_TASKS_PER_CORE = 4
# The JVM never compiles a method above 8,000 bytes, and a chain of steps fused into one longer method
# is interpreted for every row. Such chains run as single steps, which are compiled.
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
_SPARK_METHOD_LIMIT, _COMPILED_METHOD_BYTES = "65535", 8000


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL settings every job relies on; safe to call repeatedly."""
    for key, value in _RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if spark.conf.get(_LISTING, None) is None:
        spark.conf.set(_LISTING, str(_LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    if spark.conf.get(_METHOD_LIMIT) == _SPARK_METHOD_LIMIT:
        spark.conf.set(_METHOD_LIMIT, str(_COMPILED_METHOD_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder visible to every executor, named by ``spark.checkpoint.dir``.

    Only a session without that setting that runs in local mode (tests, notebooks)
    gets a temporary folder; on a cluster the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="turnledger-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_made: ContextVar[list[str] | None] = ContextVar("scratch paths made in the open scope", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/turnledger/{label}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession, keep: tuple[str, ...] = ()) -> Iterator[None]:
    """Delete the scratch tables made inside when it ends, but those with a label in ``keep``."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            if path.rsplit("/", 1)[1].rsplit("-", 1)[0] not in keep:
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def is_missing_path(error: AnalysisException) -> bool:
    """Whether a read failed because its path does not exist, and for no other reason."""
    return error.getCondition() == "PATH_NOT_FOUND"
