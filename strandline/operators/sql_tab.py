"""Ad-hoc SQL over the events of one session, one SELECT at a time."""

from __future__ import annotations

import datetime
import decimal
import math
import re
import uuid

from py4j.java_gateway import is_instance_of
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from strandline.contract import MAX_SQL, InvalidQuery
from strandline.operators.relation import Source, relation

MAX_ROWS, MAX_CELL, MAX_BODY = 10_000, 64 << 10, 8 << 20
VIEW = ["uuid", "event", "distinct_id", "person_id", "timestamp", "properties"]
# What a SELECT's plan consists of before names are looked up, the table functions that
# make rows of their arguments only, and functions that reach outside the data.
NODES = (
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Range", "Sample", "Sort",
    "SubqueryAlias", "Tail", "Union", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTVFAliases", "UnresolvedTableValuedFunction", "UnresolvedWith", "Unpivot", "Window", "WithWindowDefinition",
)
TABLE_FUNCTIONS = ("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "stack", "inline", "inline_outer", "json_tuple")
FORBIDDEN_FUNCTIONS = ("java_method", "reflect", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "current_catalog", "current_database", "current_schema", "current_user", "session_user", "user", "version", "read_files", "collations", "sql_keywords")
FORBIDDEN_EXPRESSIONS = ("CallMethodViaReflection", "TryReflect", "InputFileName", "InputFileBlockStart", "InputFileBlockLength", "CurrentCatalog", "CurrentDatabase", "CurrentUser", "SessionUser", "SparkVersion", "PythonUDF", "ScalaUDF")
#: Texts, quoted names and comments, which stay as they are, or a call of now_utc.
NOW = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/)|\bnow_utc\s*\(\s*\)""", re.IGNORECASE | re.DOTALL)


def _each(items) -> list:
    """The elements of a Scala sequence."""
    return [items.apply(i) for i in range(items.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName().removesuffix("$")


def _subquery(e) -> object | None:
    """The plan inside an expression, if it has one."""
    has = is_instance_of(SparkContext._gateway, e, "org.apache.spark.sql.catalyst.expressions.PlanExpression")
    return e.plan() if has else None


def _check_expression(e, views: frozenset[str]) -> None:
    if _name(e) == "UnresolvedFunction":
        parts = [p.lower() for p in _each(e.nameParts())]
        if len(parts) > 1 or parts[0] in FORBIDDEN_FUNCTIONS:
            raise InvalidQuery(f"{'.'.join(parts)} is not allowed")
    inner = _subquery(e)
    if inner is not None:
        _check_plan(inner, views)
    for child in _each(e.children()):
        _check_expression(child, views)


def _check_analysed(node) -> None:
    """Refuses what only looking up a name shows, like CURRENT_USER without parentheses."""
    if _name(node) in FORBIDDEN_EXPRESSIONS:
        raise InvalidQuery(f"{_name(node)} is not allowed")
    inner = _subquery(node)
    expressions = _each(node.expressions()) if _is_plan(node) else [inner] if inner is not None else []
    for part in [*_each(node.children()), *expressions]:
        _check_analysed(part)


def _is_plan(node) -> bool:
    return is_instance_of(SparkContext._gateway, node, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")


def _check_plan(node, views: frozenset[str]) -> None:
    """Refuses any part of a parsed statement but those that read `views`, by their plain names. A
    WITH adds its names for what comes after it, so a name used elsewhere is not one."""
    kind = _name(node)
    if kind not in NODES:
        raise InvalidQuery("only SELECT is allowed" if "Command" in kind or "Statement" in kind or "Insert" in kind or "Create" in kind else f"{kind} is not allowed")
    if kind == "UnresolvedRelation":
        parts = _each(node.multipartIdentifier())
        if len(parts) > 1 or parts[0].lower() not in views:
            raise InvalidQuery(f"there is no table {'.'.join(parts)}")
    if kind == "UnresolvedTableValuedFunction":
        parts = [p.lower() for p in _each(node.name())]
        if len(parts) > 1 or parts[0] not in TABLE_FUNCTIONS:
            raise InvalidQuery("this table function is not allowed")
    if kind == "UnresolvedWith":
        for relation_of in _each(node.cteRelations()):
            own = views | {relation_of._1().lower()}
            _check_plan(relation_of._2(), own if node.allowRecursion() else views)
            views = own
    for e in _each(node.expressions()):
        _check_expression(e, views)
    for child in _each(node.children()):
        _check_plan(child, views)


def checked(spark, text: str) -> str:
    """The statement, if it is a single SELECT that reads nothing but the view `events`."""
    if not text.strip() or len(text.encode()) > MAX_SQL:
        raise InvalidQuery("a query has 1 to 20,000 bytes")
    body = text.strip().rstrip(";").strip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
    except Exception as e:  # noqa: BLE001
        raise InvalidQuery(str(e).strip().split("\n", 1)[0] or "the statement can't be parsed") from None
    _check_plan(plan, frozenset({"events"}))
    return body


def uses_now(text: str) -> bool:
    """Whether the statement calls now_utc()."""
    return any(m[1] is None for m in NOW.finditer(text))


def query(source: Source, text: str, now: int) -> DataFrame:
    """The statement's result over the view `events` (with person_id and the promoted columns).

    Files can't be read by path, the catalog can't be reached, and now_utc() is the given moment.
    """
    spark = source.events.sparkSession
    body = checked(spark, text)
    events = relation(source)
    extra = [c for c in events.columns if c not in (*VIEW, "at", "project_id")]
    name = f"events_{uuid.uuid4().hex}"
    events.select(*VIEW, *extra).createOrReplaceTempView(name)
    body = NOW.sub(lambda m: m[1] or f"timestamp_micros({int(now)})", body)
    on_files = spark.conf.get("spark.sql.runSQLOnFiles")
    spark.conf.set("spark.sql.runSQLOnFiles", "false")
    try:
        result = spark.sql(f"WITH events AS (SELECT * FROM {name}) SELECT * FROM ({body}\n) AS result")
        _check_analysed(result._jdf.queryExecution().analyzed())
        return result
    except PySparkException as e:
        raise InvalidQuery(str(e).split("\n", 1)[0].replace(name, "events")) from None
    finally:
        spark.conf.set("spark.sql.runSQLOnFiles", on_files)
        spark.catalog.dropTempView(name)


def cell(value: object) -> object:
    """A result value as JSON: times as RFC 3339, decimals and huge integers as text, numbers that
    are not finite as null, bytes in hex, texts cut at 64 KiB."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return value if -(2**63) <= value < 2**63 else str(value)
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat(timespec="microseconds") + "Z"
    if isinstance(value, datetime.date | datetime.timedelta):
        return str(value)
    if isinstance(value, bytes | bytearray):
        return bytes(value).hex()
    if isinstance(value, dict):
        return [[cell(k), cell(v)] for k, v in value.items()]
    if hasattr(value, "asDict"):
        return {k: cell(v) for k, v in value.asDict().items()}
    if isinstance(value, list | tuple):
        return [cell(v) for v in value]
    text = str(value)
    return text if len(text.encode()) <= MAX_CELL else text.encode()[:MAX_CELL].decode(errors="ignore")


def fetch(result: DataFrame) -> dict:
    """columns, types, rows and whether rows were left out: at most 10,000, at most 8 MiB."""
    rows, size, truncated = [], 0, False
    for row in result.limit(MAX_ROWS + 1).toLocalIterator():
        shown = [cell(v) for v in row]
        size += len(str(shown))
        if len(rows) == MAX_ROWS or size > MAX_BODY:
            truncated = True
            break
        rows.append(shown)
    return {"columns": result.columns, "types": [t for _, t in result.dtypes], "rows": rows, "truncated": truncated}


