"""Ad-hoc queries of readers: what their analysed plan may consist of.

The plan is walked node by node, subqueries included, against lists of what is allowed; everything else is
refused by name. A view is a leaf: what it reads and computes is its owner's business.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import DataFrame, SparkSession

RUN_ON_FILES = "spark.sql.runSQLOnFiles"

# Packages and class names of Spark's query plans.
_SQL = "org.apache.spark.sql."
_EXPRESSIONS = f"{_SQL}catalyst.expressions."
SUBQUERY = f"{_EXPRESSIONS}SubqueryExpression"
REPLACED = f"{_EXPRESSIONS}RuntimeReplaceable"
USER_DEFINED = f"{_EXPRESSIONS}UserDefinedExpression"
VIEW, TABLE = "View", "LogicalRelation"
OPERATORS = frozenset(
    """
    Aggregate AsOfJoin CTERelationDef CTERelationRef Deduplicate Distinct Except Expand Filter Generate GlobalLimit
    Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation PipeOperator Pivot Project Range RebalancePartitions
    Repartition RepartitionByExpression ResolvedHint Sample Sort Subquery SubqueryAlias Tail Union UnionLoop
    UnionLoopRef Unpivot Window WithCTE HiveTableRelation LogicalRelation View
    """.split()
)
OPERATOR_PACKAGES = (f"{_SQL}catalyst.plans.logical.", f"{_SQL}execution.datasources.", f"{_SQL}catalyst.catalog.",
                     _EXPRESSIONS)
# Built-in functions and what the grammar makes of operators live in these packages, and nothing else does
# but calls of methods and of functions that users have registered.
EXPRESSION_PACKAGES = (_EXPRESSIONS, f"{_EXPRESSIONS}aggregate.", f"{_EXPRESSIONS}json.", f"{_EXPRESSIONS}xml.",
                       f"{_EXPRESSIONS}variant.", f"{_EXPRESSIONS}st.")
CALLS = frozenset(("ApplyFunctionExpression", "CallMethodViaReflection"))
# Spark writes some of its functions as calls of its own methods; SQL has no words for such a call. The
# last name is the class that pads CHAR columns as they are read.
INVOKES, INVOKES_PACKAGE = frozenset(("Invoke", "StaticInvoke")), f"{_EXPRESSIONS}objects"
PADDING = "CharVarcharCodegenUtils"


class RefusedQuery(ValueError):
    """An ad-hoc query that does more than read tables and views."""


def read_only_query(spark: SparkSession, query: str) -> DataFrame:
    """Analyse an ad-hoc query in a session of its own and let it pass if its plan only reads.

    The query becomes a subquery, where the grammar admits nothing but queries. Its session is a copy
    of the caller's, temporary views and current database included, in which files cannot be named as
    tables; the caller's own session is not touched.
    """
    body = re.sub(r"(?:;\s*(?:--[^\n]*(?:\n\s*|\Z))*)+\Z", "", query.strip())
    apart = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    apart.conf.set(RUN_ON_FILES, "false")
    result = apart.sql(f"SELECT * FROM (\n{body}\n)")
    check_plan(result)
    return result


def check_plan(result: DataFrame) -> None:
    """Raise ``RefusedQuery`` unless every operator, relation and expression of the plan is an allowed one."""
    gateway = result.sparkSession.sparkContext._gateway
    plans = [result._jdf.queryExecution().analyzed()]
    while plans:
        plan = plans.pop()
        name = plan.getClass().getName()
        short = _allowed_operator(name)
        if short == TABLE and not plan.catalogTable().isDefined():
            raise RefusedQuery("files and other sources cannot be read by ad-hoc queries, only tables and views")
        if short == VIEW:
            continue
        plans.extend(_items(plan.children()))
        expressions = [(expression, False) for expression in _items(plan.expressions())]
        while expressions:
            expression, built_in = expressions.pop()
            if is_instance_of(gateway, expression, SUBQUERY):
                plans.append(expression.plan())
            else:
                _check_expression(expression, built_in, is_instance_of(gateway, expression, USER_DEFINED))
            if is_instance_of(gateway, expression, REPLACED):
                built_in = True
                expressions.append((expression.replacement(), True))
            expressions.extend((child, built_in) for child in _items(expression.children()))


def _allowed_operator(name: str) -> str:
    package, _, short = name.rpartition(".")
    if short not in OPERATORS or f"{package}." not in OPERATOR_PACKAGES:
        raise RefusedQuery(f"{short} is not allowed in ad-hoc queries")
    return short


def _check_expression(expression: JavaObject, built_in: bool, user_defined: bool) -> None:
    """``built_in`` says that a built-in function stands for this expression, or that it is an argument of one."""
    package, _, short = expression.getClass().getName().rpartition(".")
    if short in INVOKES and package == INVOKES_PACKAGE:
        padding = short == "StaticInvoke" and expression.staticObject().getName().endswith(f".{PADDING}")
        allowed = built_in or padding
    else:
        allowed = f"{package}." in EXPRESSION_PACKAGES and short not in CALLS and not user_defined
    if not allowed:
        raise RefusedQuery(f"{short} is not allowed in ad-hoc queries: only built-in functions are, none that call JVM methods")


def _items(sequence: JavaObject) -> Iterator[JavaObject]:
    iterator = sequence.iterator()
    while iterator.hasNext():
        yield iterator.next()
