"""Read-only SQL over the active table ``t`` and other registered tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

from py4j.java_gateway import is_instance_of
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

MAX_NAME = 32
ACTIVE_VIEW = "t"

# Functions that leave the loaded tables.
DENIED_FUNCTIONS = ("reflect", "java_method", "try_reflect")
# Functions that make rows from their arguments alone.
TABLE_FUNCTIONS = (
    "range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple collations sql_keywords"
    " variant_explode variant_explode_outer"
).split()
REJECTED_PREFIXES = ("Insert", "Create", "Drop", "Alter", "Replace", "Show", "Set", "Cache", "Add")


def safe_view_name(filename: str, dataset_id: str = "", taken: set[str] | None = None) -> str:
    """View name of a file: extension dropped, other characters to ``_``, at most 32 long."""
    stem = re.sub(r"_+", "_", re.sub(r"[^a-zA-Z0-9_]", "_", filename.rsplit(".", 1)[0])).strip("_") or "ds"
    if stem[0].isdigit():
        stem = f"ds_{stem}"
    name = stem[:MAX_NAME].rstrip("_") or "ds"
    if name == ACTIVE_VIEW or name in (taken or set()):
        name = f"{name}_{dataset_id[:6]}"
    return name


def _require_query(session: SparkSession, query: str) -> None:
    """Accept one query; reject commands, DDL and inserts before anything is analysed."""
    try:
        plan = session._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as exc:
        raise ValueError(f"not a valid query: {str(exc).splitlines()[0]}") from None
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        simple = node.getClass().getSimpleName()
        if (
            ".command." in node.getClass().getName()
            or ".execution." in node.getClass().getName()
            or simple.startswith(REJECTED_PREFIXES)
            or simple.endswith(("Command", "Statement"))
        ):
            raise ValueError(f"only read-only queries are allowed, found {simple}")
        children = node.children()
        nodes.extend(children.apply(i) for i in range(children.size()))


def _sequence(values) -> list:
    return [values.apply(i) for i in range(values.size())]


class _Scopes:
    """Walks the parsed, not yet analysed query with the names that may be read at each place.

    A common table expression is known after its own definition (inside it only where the query says
    RECURSIVE); subqueries see the names around them. Tables, functions and scripts are told by their nodes, so
    text literals and column names are none of them.
    """

    def __init__(self, session: SparkSession):
        self.gateway = session._sc._gateway

    def _is(self, node, name: str) -> bool:
        return is_instance_of(self.gateway, node, f"org.apache.spark.sql.catalyst.{name}")

    def _function(self, parts: list[str]) -> None:
        name = parts[-1].lower()
        if name in DENIED_FUNCTIONS or (len(parts) > 1 and [x.lower() for x in parts[:-1]] not in ([["builtin"], ["system", "builtin"]])):
            raise ValueError(f"not allowed in a query: {'.'.join(parts)}")

    def plan(self, node, known: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            for item in _sequence(node.cteRelations()):
                name = item._1().lower()
                self.plan(item._2(), known | {name} if node.allowRecursion() else known)
                known = known | {name}
        elif kind == "UnresolvedRelation":
            parts = _sequence(node.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in known:
                raise ValueError(f"unknown table in a query: {'.'.join(parts)}")
        elif kind == "UnresolvedTableValuedFunction":
            self._function(_sequence(node.name()))
            if _sequence(node.name())[-1].lower() not in TABLE_FUNCTIONS:
                raise ValueError(f"not allowed in a query: {'.'.join(_sequence(node.name()))}")
        elif "Script" in kind or "UnresolvedIdentifier" in kind or kind in ("UnresolvedTable", "UnresolvedView", "UnresolvedTableOrView"):
            raise ValueError(f"not allowed in a query: {kind}")
        for e in _sequence(node.expressions()):
            self.expression(e, known)
        for child in _sequence(node.children()):
            self.plan(child, known)

    def expression(self, e, known: frozenset[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            self._function(_sequence(e.nameParts()))
        elif "UnresolvedIdentifier" in kind:  # IDENTIFIER('...') names things at run time
            raise ValueError(f"not allowed in a query: {kind}")
        if self._is(e, "expressions.PlanExpression"):
            self.plan(e.plan(), known)
        for child in _sequence(e.children()):
            self.expression(child, known)


def _require_contained(session: SparkSession, query: str, tables: Mapping[str, DataFrame]) -> None:
    """Reject tables that were not handed in, shell scripts and JVM method calls, subqueries included."""
    plan = session._jsparkSession.sessionState().sqlParser().parsePlan(query)
    _Scopes(session).plan(plan, frozenset(name.lower() for name in tables))


def _adopt(session: SparkSession, name: str, table: DataFrame) -> None:
    """Make a table of another session visible as a temporary view of this one."""
    passing = f"tw_{uuid.uuid4().hex}"
    table.createGlobalTempView(passing)
    try:
        session.table(f"global_temp.{passing}").createOrReplaceTempView(name)
    finally:
        table.sparkSession.catalog.dropGlobalTempView(passing)


def sql_query(df: DataFrame, query: str, extra_tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Run a query in an isolated session where ``df`` is ``t``; files cannot be named as tables."""
    session = df.sparkSession.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        session.conf.set(key, df.sparkSession.conf.get(key))
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    tables = {ACTIVE_VIEW: df, **(extra_tables or {})}
    for name, table in tables.items():
        _adopt(session, name, table)
    _require_query(session, query)
    _require_contained(session, query, tables)
    try:
        result = session.sql(query)
    except AnalysisException as exc:
        columns = {name: table.columns for name, table in tables.items()}
        raise ValueError(f"{str(exc).splitlines()[0]} Available columns: {columns}") from None
    return result
