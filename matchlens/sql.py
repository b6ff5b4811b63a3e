"""Bounded read-only SQL over the corpus views.

What a statement may use is judged on Spark's own parse of it, before anything
is resolved: the kinds of plan nodes, the relations and the functions must be on
an allow-list. Comments, quotes and nesting are the parser's business.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import DataFrame, SparkSession

from .schema import TABLES

MAX_ROWS = 500
DEFAULT_ROWS = 100
# Plan nodes of plain queries. Commands, writes, scripts and names made by expressions are not among them.
PLANS = (
    "Aggregate", "Deduplicate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin",
    "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Sample", "Sort", "SubqueryAlias", "Union",
    "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedOrderBy", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases",
    "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedWith", "Unpivot", "WithWindowDefinition",
)
# Groups of Spark's built-in functions that compute from their arguments alone.
FUNCTION_GROUPS = (
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs", "datetime_funcs",
    "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "operator_funcs", "predicate_funcs", "string_funcs",
    "struct_funcs", "url_funcs", "window_funcs",
)
TABLE_FUNCTIONS = ("explode", "explode_outer", "inline", "inline_outer", "posexplode", "posexplode_outer", "range", "stack")
_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"


class Refused(ValueError):
    def __init__(self, what: str):
        super().__init__(f"only corpus views and plain functions may be used, not {what}")


class _Guard:
    """Walks an unresolved plan with everything it holds: children, expressions, subqueries, named queries, windows."""

    def __init__(self, spark: SparkSession, relations: Sequence[str]):
        self.gateway, self.jvm = spark.sparkContext._gateway, spark._jvm
        self.relations = {r.lower() for r in relations}
        self.builtin = self.jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        self.session = spark._jsparkSession.sessionState().functionRegistry()

    def _is(self, x: JavaObject, kind: str) -> bool:
        return is_instance_of(self.gateway, x, kind)

    def _held(self, x: JavaObject) -> Iterator[JavaObject]:
        if self._is(x, "scala.collection.Iterable"):
            it = x.iterator()
        elif self._is(x, "scala.Product"):
            it = x.productIterator()
        else:
            return
        while it.hasNext():
            y = it.next()
            if isinstance(y, JavaObject):
                yield y

    def _function(self, parts: JavaObject) -> None:
        names = [parts.apply(i) for i in range(parts.size())]
        name = ".".join(names)
        if len(names) != 1:
            raise Refused(f"function {name}")
        ident = self.jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(names[0].lower())
        known, used = self.builtin.lookupFunction(ident), self.session.lookupFunction(ident)
        # a session's own function may have taken the name
        if known.isEmpty() or used.isEmpty() or used.get().getClassName() != known.get().getClassName() or known.get().getGroup() not in FUNCTION_GROUPS:
            raise Refused(f"function {name}")

    def check(self, x: JavaObject, named: frozenset[str] = frozenset()) -> None:
        kind = x.getClass().getSimpleName()
        if self._is(x, _LOGICAL) and kind not in PLANS:
            raise Refused(kind)
        if kind in ("ExpressionWithUnresolvedIdentifier", "UnresolvedIdentifier"):
            raise Refused("computed names")
        if kind == "UnresolvedRelation":
            parts = x.multipartIdentifier()
            name = ".".join(parts.apply(i) for i in range(parts.size()))
            if parts.size() != 1 or name.lower() not in self.relations | named:
                raise Refused(f"relation {name}")
            return
        if kind == "UnresolvedTableValuedFunction":
            parts = x.name()
            name = ".".join(parts.apply(i) for i in range(parts.size()))
            if name.lower() not in TABLE_FUNCTIONS:
                raise Refused(f"function {name}")
        if kind == "UnresolvedFunction":
            self._function(x.nameParts())
        if kind == "UnresolvedGenerator" and x.name().unquotedString().lower() not in TABLE_FUNCTIONS:
            raise Refused(f"function {x.name().unquotedString()}")
        if kind == "UnresolvedWith":
            # a named query sees those before it; only the statement below sees them all
            seen, queries = named, x.cteRelations()
            for i in range(queries.size()):
                self.check(queries.apply(i).productElement(1), seen)
                seen = seen | {queries.apply(i).productElement(0).lower()}
            self.check(x.child(), seen)
            return
        for y in self._held(x):
            self.check(y, named)


def _argument(value):
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return 1 if value else 0
    if isinstance(value, (int, float)) and math.isfinite(value):
        return value
    raise ValueError(f"unsupported parameter: {value!r}")


def check_statement(spark: SparkSession, text: str, relations: Sequence[str] = tuple(TABLES)) -> None:
    """Raise unless the text is one query over `relations` with plain functions."""
    if not text.strip().rstrip(";").strip():
        raise ValueError("empty statement")
    _Guard(spark, relations).check(spark._jsparkSession.sessionState().sqlParser().parsePlan(text))


def capped_query(
    spark: SparkSession, text: str, args: Sequence | None = None, max_rows: int = DEFAULT_ROWS, relations: Sequence[str] = tuple(TABLES)
) -> tuple[DataFrame, int]:
    """The statement with one row more than allowed, and the cap."""
    if not isinstance(max_rows, int) or max_rows < 1:
        raise ValueError("max_rows must be a positive integer")
    cap = min(max_rows, MAX_ROWS)
    check_statement(spark, text, relations)
    return spark.sql(text, args=[_argument(a) for a in args or []]).limit(cap + 1), cap


def bounded_sql(
    spark: SparkSession, text: str, args: Sequence | None = None, max_rows: int = DEFAULT_ROWS
) -> tuple[list, list[str], bool]:
    """First rows of a read-only statement, column names, and whether it was cut.

    At most 501 rows reach the driver. `?` marks take `args` in order.
    """
    df, cap = capped_query(spark, text, args, max_rows)
    rows = df.collect()
    return rows[:cap], df.columns, len(rows) > cap
