"""Read-only SQL over the named relations of a ledger."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

from py4j.java_gateway import is_instance_of
from pyspark import SparkContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from turnledger.functions.dates import register_sql_functions
from turnledger.session import configure

# --- fixed values -----------------------------------------------------------
ROW_CAP = 1_000
EVENTS_VIEW, TURNS_VIEW, STATE_VIEW = "usage_events", "turn_usage", "scan_state"
_VIEWS = (EVENTS_VIEW, TURNS_VIEW, STATE_VIEW)
# ----------------------------------------------------------------------------


# Functions that call into the JVM, by name and by what they become.
_JVM_CALLS = ("reflect", "java_method", "try_reflect")
_JVM_EXPRESSIONS = ("CallMethodViaReflection", "TryReflect")
# Code of the session's users, which may do anything.
_USER_CODE = ("PythonUDF", "PythonUDAF", "PythonUDTF", "ScalaUDF", "ScalaUDAF", "ScalaAggregator")
# What every subquery inside an expression is.
_SUBQUERY = "org.apache.spark.sql.catalyst.expressions.PlanExpression"
# Leaves that read nothing but what the statement itself spells out.
_SPELLED_OUT = ("OneRowRelation", "LocalRelation", "CTERelationRef", "UnionLoopRef", "Range")


@dataclass(frozen=True)
class QueryResult:
    """The rows up to the cap (all rows without one) and their column names."""

    rows: DataFrame
    columns: list[str]
    _all: DataFrame
    _cap: int | None

    def total_rows(self) -> int:
        """All rows of the query."""
        return self._all.count()

    def fetch(self) -> list[Row]:
        """The rows up to the cap."""
        return self._fetched[0]

    def truncated(self) -> bool:
        """Whether the query has more rows than the cap."""
        return self._fetched[1]

    @cached_property
    def _fetched(self) -> tuple[list[Row], bool]:
        """Rows and flag from one run of the statement, which asks for one row more."""
        if self._cap is None:
            return self._all.collect(), False
        rows = self._all.limit(self._cap + 1).collect()
        return rows[: self._cap], len(rows) > self._cap


def register_views(
    spark: SparkSession,
    events: DataFrame,
    turns: DataFrame,
    state: DataFrame | None = None,
    tz: str = "UTC",
) -> None:
    """Name the relations and the date helpers ``local_day(ts)``, ``week_label(ts)``."""
    configure(spark)
    register_sql_functions(spark, tz)
    events.createOrReplaceTempView(EVENTS_VIEW)
    turns.createOrReplaceTempView(TURNS_VIEW)
    if state is not None:
        state.createOrReplaceTempView(STATE_VIEW)


def query(spark: SparkSession, sql: str, cap: int | None = ROW_CAP) -> QueryResult:
    """Run one SELECT over the named relations; columns are known even without rows.

    ``cap=None`` gives every row. The statement runs as a subquery, so the parser itself
    rejects anything that is not a query. What it reads is decided by the nodes of its plan:
    every leaf must be one of the named relations or spelled out in the statement. Files,
    other tables, names computed by ``IDENTIFIER``, user functions and calls into the JVM are
    refused with ``PermissionError`` before anything runs.
    """
    statement = sql.strip().rstrip(";")
    if not statement.strip():
        raise ValueError("provide a SQL statement")
    wrapped = f"SELECT * FROM (\n{statement}\n)"
    # Resolving a file as a table may read it, so names are judged before they are resolved.
    _check_names(spark._jsparkSession.sessionState().sqlParser().parsePlan(wrapped), frozenset())
    result = spark.sql(wrapped)
    _check_leaves(result._jdf.queryExecution().analyzed())
    return QueryResult(result if cap is None else result.limit(cap), result.columns, result, cap)


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _items(sequence) -> Iterator:
    """Elements of a Scala sequence."""
    return (sequence.apply(i) for i in range(sequence.size()))


def _expressions(node) -> Iterator:
    """All expressions of a plan node, nested ones included, but not the plans inside them."""
    todo = list(_items(node.expressions()))
    while todo:
        expression = todo.pop()
        yield expression
        todo.extend(_items(expression.children()))


def _inner_plans(node) -> Iterator:
    """Plans of the subqueries among a node's expressions."""
    for expression in _expressions(node):
        if is_instance_of(_gateway(), expression, _SUBQUERY):
            yield expression.plan()


def _gateway():
    return SparkContext._active_spark_context._gateway


def _check_names(node, common: frozenset[str]) -> None:
    """Refuse relations, functions and computed names of a parsed plan; ``common`` are names of
    common table expressions in force."""
    kind = _kind(node)
    if kind == "UnresolvedWith":
        for entry in _items(node.cteRelations()):
            own = common | {entry._1().lower()}
            # A recursive definition may name itself.
            _check_names(entry._2(), own)
            common = own
    elif kind in ("UnresolvedRelation", "UnresolvedTableValuedFunction"):
        parts = node.multipartIdentifier() if kind == "UnresolvedRelation" else node.name()
        name = ".".join(_items(parts))
        if name.lower() not in {*_VIEWS, *common}:
            raise PermissionError(f"only the named relations can be read, not {name}")
    elif "UnresolvedIdentifier" in kind:
        raise PermissionError("relations must be named, not computed")
    for expression in _expressions(node):
        own = _kind(expression)
        if "UnresolvedIdentifier" in own:
            raise PermissionError("names must be spelled out, not computed")
        if own == "UnresolvedFunction":
            function = list(_items(expression.nameParts()))[-1].lower()
            if function in _JVM_CALLS:
                raise PermissionError(f"{function} calls into the JVM and is refused")
    for plan in (*_items(node.children()), *_inner_plans(node)):
        _check_names(plan, common)


def _check_leaves(node) -> None:
    """Refuse an analysed plan that reads more than the named relations."""
    kind = _kind(node)
    if kind == "View":
        name = node.desc().identifier()
        if not node.isTempView() or name.database().isDefined() or name.table().lower() not in _VIEWS:
            raise PermissionError(f"only the named relations can be read, not {name.unquotedString()}")
        return
    for expression in _expressions(node):
        own = _kind(expression)
        if own in _JVM_EXPRESSIONS:
            raise PermissionError(f"{own} calls into the JVM and is refused")
        if own in _USER_CODE:
            raise PermissionError("user functions are refused")
    below = [*_items(node.children())]
    if not below and kind not in _SPELLED_OUT:
        raise PermissionError(f"only the named relations can be read, not a {kind}")
    for plan in (*below, *_inner_plans(node)):
        _check_leaves(plan)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object per row in column ``value``, null fields included."""
    return df.select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")
    )


def write_json(df: DataFrame, path: str) -> None:
    """JSON-lines sink for any result."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
