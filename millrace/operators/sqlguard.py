"""Guarded read-only SQL: the parser decides, not substrings, so ``WITH``, an ``updated_at`` column or a quoted
semicolon pass, and any command or second statement is refused."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession


class Refused(ValueError):
    """The text is not a single read-only query."""


_COMMANDS = ("Command", "Insert", "Create", "Drop", "Alter", "Delete", "Update", "Merge", "Replace", "Set", "Use", "Truncate", "Repair", "Refresh", "Cache", "Uncache", "Load", "Analyze", "Describe", "Show", "Explain", "Call", "CompoundBody")


def _parse(spark: SparkSession, sql: str):
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise Refused("empty query")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as e:
        raise Refused(f"not a single valid statement: {e.getCondition()}") from e
    except Exception as e:  # py4j wraps parser errors of some statements
        raise Refused("not a single valid statement") from e
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName().rstrip("$")
        package = node.getClass().getName()
        if any(name.startswith(c) or name.endswith("Command") for c in _COMMANDS) or ".command." in package:
            raise Refused(f"only queries may run, found {name}")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return text, plan


def run(spark: SparkSession, sql: str, limit: int | None = 100) -> DataFrame:
    """The query's rows; without a LIMIT of its own it gets ``limit`` (None: no limit)."""
    text, plan = _parse(spark, sql)
    df = spark.sql(text)
    limited = plan.getClass().getSimpleName() in ("GlobalLimit", "LocalLimit")
    return df if limited or limit is None else df.limit(limit)


def validate(spark: SparkSession, sql: str) -> tuple[bool, str]:
    """(valid, message) from analysis alone; nothing is executed."""
    try:
        text, _ = _parse(spark, sql)
        spark.sql(text).schema  # noqa: B018
    except Refused as e:
        return False, str(e)
    except AnalysisException as e:
        return False, e.getCondition() or str(e)
    return True, "ok"


def ask(spark: SparkSession, question: str, generate: Callable[[str, str], str], limit: int | None = 100) -> tuple[str, DataFrame]:
    """From a question to rows: list the tables, describe them, let ``generate`` (question, description) write a query, check
    it without running it, and run it. What does not pass the check is refused. Returns the query and its rows."""
    from millrace.sources.tables import catalog

    columns = catalog(spark).orderBy("table", "column").collect()  # a row for each column of the catalog
    tables = {}
    for r in columns:
        tables.setdefault(r["table"], []).append(f"{r['column']} {r['type']}")
    sql = generate(question, "\n".join(f"{t}({', '.join(cols)})" for t, cols in tables.items()))
    valid, message = validate(spark, sql)
    if not valid:
        raise Refused(message)
    return sql, run(spark, sql, limit)
