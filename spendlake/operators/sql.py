"""FLT-9: read-only SQL over the ledger tables.

A statement must begin with SELECT, WITH or EXPLAIN, and nothing in its parsed plan may be
a command or a data-changing statement (``WITH ... INSERT`` begins like a query).  The node
types of the parsed plan decide, so words in literals or aliases do not matter.
"""

from __future__ import annotations

import re
import uuid

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession

ALLOWED_PREFIXES = ("SELECT", "WITH", "EXPLAIN")
_PLANS = "org.apache.spark.sql.catalyst.plans.logical"
_CHANGES_STATE = (f"{_PLANS}.Command", f"{_PLANS}.ParsedStatement")

_EXPLAIN = re.compile(r"(EXPLAIN\s+(?:(?:EXTENDED|CODEGEN|COST|FORMATTED)\s+)?)?(.*?)[\s;]*$", re.I | re.S)


class ReadOnlyViolation(ValueError):
    pass


def query_read(spark: SparkSession, sql: str, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run a read-only statement over ``views``.

    The views are the statement's own: it becomes a subquery below a WITH clause that names them, over
    temporary views with names of their own.  Views of the session with the same names are neither seen nor changed."""
    text = sql.strip()
    if not text.upper().startswith(ALLOWED_PREFIXES):
        raise ReadOnlyViolation("This entry point reads only: begin with SELECT, WITH or EXPLAIN.")
    _check_plan(spark, text)
    if not views:
        return spark.sql(text)
    explain, query = _EXPLAIN.match(text).groups(default="")
    private = {name: f"spendlake_{uuid.uuid4().hex}" for name in views}
    names = ", ".join(f"`{name.replace('`', '``')}` AS (SELECT * FROM {view})" for name, view in private.items())
    for name, df in views.items():
        df.createOrReplaceTempView(private[name])
    try:
        return spark.sql(f"{explain}WITH {names} SELECT * FROM (\n{query}\n)")
    finally:
        for view in private.values():
            spark.catalog.dropTempView(view)


def _check_plan(spark: SparkSession, text: str) -> None:
    gateway = spark.sparkContext._gateway
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    if is_instance_of(gateway, plan, "org.apache.spark.sql.execution.command.ExplainCommand"):
        plan = plan.logicalPlan()
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        if any(is_instance_of(gateway, node, name) for name in _CHANGES_STATE):
            raise ReadOnlyViolation("Statement is not read-only.")
        children = node.children()
        nodes.extend(children.apply(i) for i in range(children.size()))
