"""Log dialects in registry order. A further tool is one more ``Dialect`` entry."""

from __future__ import annotations

from turnledger.sources.dialects.claude_code import CLAUDE_CODE
from turnledger.sources.dialects.codex import CODEX
from turnledger.sources.dialects.common import Dialect
from turnledger.sources.dialects.opencode import OPENCODE

DIALECTS: dict[str, Dialect] = {}
# Position of a tool in the registry: its rank in the ledger order.
TOOL_RANK: dict[str, int] = {}


def register(dialect: Dialect) -> None:
    """Add a dialect after those known; a tool already known keeps its rank."""
    DIALECTS[dialect.tool] = dialect
    TOOL_RANK.setdefault(dialect.tool, len(TOOL_RANK))


def tools() -> tuple[str, ...]:
    """Tool ids in registry order."""
    return tuple(DIALECTS)


def cumulative_tools() -> tuple[str, ...]:
    """Tools whose counters are running totals per session."""
    return tuple(tool for tool, dialect in DIALECTS.items() if dialect.cumulative)


for _dialect in (CLAUDE_CODE, CODEX, OPENCODE):
    register(_dialect)
