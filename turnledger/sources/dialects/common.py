"""What every dialect yields for a log line, before file context is bound."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions.coerce import first_non_null, is_single, members, parse_line, stripped, with_readings
from turnledger.schema import TOKEN_COLS

# --- fixed values -----------------------------------------------------------
EVENT, MODEL, SESSION = "event", "model", "session"
IGNORED, MALFORMED = "ignored", "malformed"
# ----------------------------------------------------------------------------

# A dotted path, or several of which the first that is not null counts.
Path = str | tuple[str, ...]
# Name of the column that holds a line's field, by its path.
Field = Callable[[Path], str]

FACT_COLS = (
    "outcome",
    "dedupe_key",
    "session_id",
    "model",
    "ts",
    *TOKEN_COLS,
    "is_sidechain",
    "project",
)


@dataclass(frozen=True)
class Layout:
    """Where a tool keeps its logs below a root: folder names and depth of a file,
    counted in folders between the root and the file, without an upper bound by default."""

    min_folders: int
    max_folders: int | None = None
    top_folders: tuple[str, ...] = ()


@dataclass(frozen=True)
class Dialect:
    """One log format: its tool id, its layout, and its reading of a line.

    ``fields`` are the paths the format reads. ``facts`` takes the line and a
    lookup of those fields and gives columns named as in ``FACT_COLS``. ``bind`` gives
    the columns that depend on the file: on its path or on other lines in it.
    """

    tool: str
    layout: Layout
    fields: tuple[Path, ...]
    facts: Callable[[Column, Field], dict[str, Column]]
    bind: Callable[[], dict[str, Column]]
    cumulative: bool = False


def line_facts(lines: DataFrame, dialect: Dialect, keep: Sequence[str] = ()) -> DataFrame:
    """Reduce raw lines to counts, ids, model, time and paths.

    Runs before any shuffle, so message text never leaves the reading task. ``lines``
    has ``file_path``, ``mtime_ms`` and ``value``; columns in ``keep`` pass through.
    Nothing derived from the path is built per line.
    """
    names = {path: f"_{i}" for i, path in enumerate(dialect.fields)}
    text = _with_fields(lines.withColumn("line", stripped(F.col("value"))), names, keep)
    text = with_readings(text, list(names.values()))
    facts = dialect.facts(F.col("line"), names.__getitem__)
    columns = {name: facts.get(name, F.lit(None)) for name in FACT_COLS}
    # The outcome looks at the counts as they are, and the digest at the outcome: each in a step
    # of its own, so that none is spelled out again in the next.
    found = text.select(
        *keep, "file_path", "line", "single", *[columns[name].alias(name) for name in FACT_COLS]
    )
    # A count too large to be one is damage: the line is set aside, never rounded to fit.
    damaged = reduce(lambda a, b: a | b, (F.col(name).isNull() for name in TOKEN_COLS))
    outcome = (
        F.when(F.col("line") == "", F.lit(IGNORED))
        .when(~F.col("single"), F.lit(MALFORMED))
        .when((F.col("outcome") == EVENT) & damaged, F.lit(MALFORMED))
        .otherwise(F.col("outcome"))
    )
    return found.withColumn("outcome", outcome).select(
        *keep,
        "file_path",
        *FACT_COLS,
        F.when(F.col("outcome") == MALFORMED, F.md5(F.col("line").cast("binary"))).alias("raw_md5"),
    )


def _with_fields(lines: DataFrame, names: dict[Path, str], keep: Sequence[str]) -> DataFrame:
    """``lines`` with the VARIANT at each path of ``names``, and whether the line is ``single``.

    An object is opened once for all its fields, one step a level, whatever reads them later.
    """
    paths = [tuple(one.split(".")) for path in names for one in ([path] if isinstance(path, str) else path)]
    nodes = list(dict.fromkeys(path[:n] for path in paths for n in range(1, len(path) + 1)))
    at = {node: f"_v{i}" for i, node in enumerate(nodes)}
    inside: dict[tuple[str, ...], list[str]] = {}
    for node in nodes:
        inside.setdefault(node[:-1], []).append(node[-1])
    own = [*keep, "file_path", "mtime_ms", "line", "single"]
    found = lines.withColumn("parsed", parse_line(F.col("line"), inside[()])).select(
        *own[:-1],
        is_single(F.col("parsed")).alias("single"),
        *[F.get("parsed", F.lit(0))[name].alias(at[name,]) for name in inside[()]],
    )
    for depth in range(1, max(map(len, paths))):
        parents = [node for node in inside if len(node) == depth]
        found = found.withColumns({f"{at[node]}_in": members(at[node], inside[node]) for node in parents})
        fields = {at[*node, name]: F.col(f"{at[node]}_in")[name] for node in parents for name in inside[node]}
        found = found.withColumns(fields).drop(*[f"{at[node]}_in" for node in parents])
    values = {
        name: F.col(at[tuple(path.split("."))])
        if isinstance(path, str)
        else first_non_null(*[F.col(at[tuple(one.split("."))]) for one in path])
        for path, name in names.items()
    }
    return found.select(*own, *[value.alias(name) for name, value in values.items()])


def fallback_time() -> Column:
    """Modification time of the log file in unix seconds, zero when unknown."""
    return F.coalesce(F.floor(F.col("mtime_ms") / 1000).cast("bigint"), F.lit(0).cast("bigint"))


def fallback_session() -> Column:
    """The session the line names, else the stem of its file."""
    return F.coalesce(F.col("session_id"), F.col("file_stem"))


def no_count() -> Column:
    return F.lit(0).cast("bigint")
