"""Log lines to usage rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.functions.paths import file_stem, plain_path, project_from_path
from turnledger.operators.file_order import in_file_order
from turnledger.operators.pinning import pin
from turnledger.schema import USAGE_COLS
from turnledger.sources.dialects import DIALECTS, TOOL_RANK
from turnledger.sources.dialects.common import Dialect, line_facts

_PLACE = ("split_start", "row_id", "line_bytes")


def read_facts(lines_by_tool: dict[str, DataFrame], keep: Sequence[str] = ()) -> DataFrame:
    """Facts of all tools' lines in registry order, written once.

    The logs are scanned a single time: every later step reads the written facts,
    which hold no message text. Line positions are frozen with them.
    """
    parts = [
        line_facts(lines_by_tool[tool], dialect, keep=(*_PLACE, *keep)).select(
            F.lit(tool).alias("tool"), "*"
        )
        for tool, dialect in DIALECTS.items()
        if tool in lines_by_tool
    ]
    facts = reduce(DataFrame.unionByName, parts)
    return pin(facts, "line-facts")


def _bound_columns() -> dict[str, Column]:
    """The columns any dialect binds to file context, switched by tool."""
    columns: dict[str, Column] = {}
    for dialect in DIALECTS.values():
        for name, bound in dialect.bind().items():
            other = columns.get(name, F.col(name))
            columns[name] = F.when(F.col("tool") == dialect.tool, bound).otherwise(other)
    return columns


def place_and_bind(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Facts in file order with the columns that depend on the file filled in.

    ``files`` has ``source_file``, ``size`` and ``start_offset``, and the context of the lines
    before if reading began after them. Context so always comes from the complete file:
    reading a grown file gives the same rows as reading it at once.
    """
    placed = in_file_order(facts, files)
    rank = reduce(
        lambda other, item: F.when(F.col("tool") == item[0], item[1]).otherwise(other),
        TOOL_RANK.items(),
        F.lit(None).cast("int"),
    )
    cumulative = F.col("tool").isin(*[t for t, d in DIALECTS.items() if d.cumulative])
    derived = {**_bound_columns(), "is_cumulative": cumulative}
    return placed.select(
        "outcome",
        "raw_md5",
        "start",
        "end",
        "size",
        "start_offset",
        "line_no",
        "sequence",
        "carried_model",
        "file_session",
        rank.alias("tool_rank"),
        *[derived.get(c, F.col(c)).alias(c) for c in USAGE_COLS],
    )


def bind_alone(facts: DataFrame, dialect: Dialect) -> DataFrame:
    """Facts with the columns that depend on the path filled in, but nothing from other lines.

    Right for dialects whose rows stand alone; works on streams too.
    """
    path = plain_path(F.col("file_path"))
    placed = facts.withColumns(
        {"source_file": path, "file_stem": file_stem(path), "file_project": project_from_path(path)}
    )
    known = {
        **dialect.bind(),
        "tool": F.lit(dialect.tool),
        "is_cumulative": F.lit(dialect.cumulative),
    }
    return placed.select("outcome", *[known.get(c, F.col(c)).alias(c) for c in USAGE_COLS])


def normalize(lines: DataFrame, tool: str, files: DataFrame) -> DataFrame:
    """One tool's lines to ``outcome`` and usage columns, with their place in the file."""
    return place_and_bind(read_facts({tool: lines}), files)
