"""Ad-hoc SQL behind a guard: one SELECT over allowed views, with a bounded result, read from Spark's own parse."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from claimloom.functions.text import strip_fences

MAX_ROWS, TIMEOUT_S = 100, 10.0
#: Plan nodes that a question may be made of; anything else is refused.
PLAN_NODES = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Join SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedHaving Distinct UnresolvedSubqueryColumnAliases "
    "WithWindowDefinition OneRowRelation UnresolvedOrderBy Offset UnresolvedInlineTable CTERelationRef".split()
)
#: Functions that reach out of the query.
FORBIDDEN_FUNCTIONS = frozenset(
    "java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length spark_partition_id current_user session_user user "
    "current_catalog current_database current_schema version raise_error assert_true sleep dblink lo_import lo_export query_to_xml read_files".split()
)
FORBIDDEN_PREFIX = "pg_"


class Refused(ValueError):
    """The query may not run."""


def _sequence(found) -> list:
    return [found.apply(k) for k in range(found.size())]


class _Walk:
    """All plan nodes and expressions of a parsed plan, with those inside subqueries and WITH."""

    def __init__(self, plan) -> None:
        self.nodes, self.functions, self.tables, self.named = [], [], [], set()
        self._plan(plan)

    def _plan(self, plan) -> None:
        kind = plan.getClass().getSimpleName()
        self.nodes.append(kind)
        if kind == "UnresolvedRelation":
            self.tables.append(_sequence(plan.multipartIdentifier()))
        if kind == "UnresolvedWith":
            for pair in _sequence(plan.cteRelations()):
                self.named.add(pair._1().lower())
                self._plan(pair._2())
        for child in _sequence(plan.children()):
            self._plan(child)
        for expression in _sequence(plan.expressions()):
            self._expression(expression)

    def _expression(self, e) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            self.functions.append(".".join(_sequence(e.nameParts())).lower())
        if kind in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
            self._plan(e.plan())
        if kind == "InSubquery":
            self._plan(e.query().plan())
        for child in _sequence(e.children()):
            self._expression(child)


def wide_numerics(sql: str) -> str:
    """Bare ::numeric casts as decimal(38,10), which keeps decimals where Spark's default would round them away."""
    return re.sub(r"::\s*numeric\b(?!\s*\()", "::decimal(38,10)", re.sub(r"::\s*text\b", "::string", sql, flags=re.I), flags=re.I)


def _unquoted(sql: str, change) -> str:
    """sql with `change` applied outside of string literals."""
    parts = re.split(r"('(?:[^']|'')*')", sql)
    return "".join(p if k % 2 else change(p) for k, p in enumerate(parts))


def check(spark: SparkSession, sql: str, allowed: set[str]) -> str:
    """The query as it may run; Refused with the reason otherwise."""
    text = strip_fences(sql or "")
    if not text:
        raise Refused("empty query")
    text = _unquoted(text, wide_numerics)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:  # the parser's own error says what is wrong
        raise Refused(f"not one statement of Spark SQL: {str(e).splitlines()[0]}") from e
    walk = _Walk(plan)
    if odd := sorted(set(walk.nodes) - PLAN_NODES):
        raise Refused(f"only a single SELECT may run, found {', '.join(odd)}")
    for name in walk.tables:
        if len(name) > 1:
            raise Refused(f"qualified name: {'.'.join(name)}")
        if name[0].lower() not in walk.named and name[0].lower() not in allowed:
            raise Refused(f"table {name[0]} is not readable; allowed: {sorted(allowed)}")
    for name in walk.functions:
        if name.startswith(FORBIDDEN_PREFIX) or name in FORBIDDEN_FUNCTIONS or "." in name:
            raise Refused(f"function {name} is not allowed")
    return text


def guarded_sql(spark: SparkSession, sql: str, views: dict[str, Callable[[SparkSession], DataFrame]], max_rows: int = MAX_ROWS) -> DataFrame:
    """The query over nothing but the given views, in a session of its own, with at most max_rows rows. Each view is
    made in that session by its function."""
    text = check(spark, sql, {v.lower() for v in views})
    own = spark.newSession()
    for name, made in views.items():
        made(own).createOrReplaceTempView(name)
    return own.sql(text).limit(max_rows)


def run(df: DataFrame, timeout_s: float = TIMEOUT_S) -> list[dict]:
    """The rows as dicts; the query is interrupted after timeout_s and then refused."""
    context, tag, late = df.sparkSession.sparkContext, f"guard-{uuid.uuid4()}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout_s, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        return [r.asDict(recursive=True) for r in df.collect()]
    except Exception as e:
        if late.is_set():
            raise Refused(f"stopped after {timeout_s:g} s") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def ask(spark: SparkSession, question: str, write_sql: Callable[[str, str | None], str], views: dict) -> dict:
    """question, sql, rows and row_count, or the refusal: write_sql(question, refusal) writes the query and gets one
    chance to correct a refused one."""
    refusal = None
    for _ in range(2):
        sql = write_sql(question, refusal)
        try:
            rows = run(guarded_sql(spark, sql, views))
            return {"question": question, "sql": sql, "rows": rows, "row_count": len(rows), "refusal": None if rows else "no matching record"}
        except (Refused, PySparkException) as e:
            refusal = str(e).splitlines()[0]
    return {"question": question, "sql": sql, "rows": [], "row_count": 0, "refusal": refusal}
