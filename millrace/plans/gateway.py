"""Free SQL behind a guard that reads Spark's parsed plan, and results in a plain envelope."""

from __future__ import annotations

import math
import re
import time
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import finite


class GuardError(ValueError):
    """SQL that may not run."""


#: Plan nodes that read; any command, write or unknown root is refused.
READING_NODES = {
    "Project", "Aggregate", "Filter", "Join", "Sort", "GlobalLimit", "LocalLimit", "LimitAll", "Offset", "Distinct", "Union", "Intersect", "Except", "UnresolvedWith", "WithCTE", "CTERelationDef", "CTERelationRef",
    "SubqueryAlias", "UnresolvedRelation", "UnresolvedInlineTable", "LocalRelation", "OneRowRelation", "Window", "UnresolvedHaving", "Generate", "Expand", "Pivot", "Unpivot", "LateralJoin", "UnresolvedSubqueryColumnAliases",
    "WithWindowDefinition", "UnresolvedTableValuedFunction", "ResolvedInlineTable", "Tail", "Sample", "UnresolvedHint", "ResolvedHint", "View", "GroupingSets", "RepartitionByExpression", "UnresolvedWithCTERelations", "Deduplicate", "Range", "AsOfJoin", "NaturalJoin", "UnresolvedTVFAliases", "SetOperation",
}
_FORBIDDEN_FUNCTIONS = {"java_method", "reflect", "try_reflect", "sleep", "benchmark"}
_FILES = {"csv", "json", "parquet", "orc", "text", "avro", "binaryfile", "delta", "jdbc"}


def _walk(plan: Any):
    yield plan
    children = plan.children()
    for i in range(children.length()):
        yield from _walk(children.apply(i))
    inner = plan.innerChildren()
    for i in range(inner.length()):
        child = inner.apply(i)
        if hasattr(child, "nodeName") and "plans.logical" in child.getClass().getName():
            yield from _walk(child)


def clean(sql: str) -> str:
    """Without comments, an output format clause and a final semicolon."""
    keep = r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`)|/\*.*?\*/|--[^\n]*"
    sql = re.sub(keep, lambda m: m[1] or " ", sql, flags=re.S).strip()
    sql = re.sub(r"\s+format\s+\w+\s*;?\s*$", "", sql, flags=re.I)
    return sql.rstrip(";").strip()


def guard(spark: SparkSession, sql: str, allowed: set[str] | None = None, database: str | None = None) -> str:
    """The cleaned SQL if it only reads, and only allowed relations of the own database; else :class:`GuardError`.

    The statement is parsed, not searched for words: names like ``replace`` are harmless, unions of reads are reads, and
    every relation counts, in joins and subqueries too.
    """
    text = clean(sql)
    if not text:
        raise GuardError("SQL query is empty")
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", "''", text)
    if ";" in bare:
        raise GuardError("only one statement is allowed")
    if not re.match(r"(?i)\(*\s*(select|with)\b", text):
        raise GuardError("only SELECT queries are allowed")
    for f in _FORBIDDEN_FUNCTIONS:
        if re.search(rf"(?i)\b{f}\s*\(", bare):
            raise GuardError(f"function {f} is not allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:  # noqa: BLE001 - parser errors come through the gateway
        raise GuardError(f"cannot be parsed: {str(e).splitlines()[0]}") from None
    ctes = {m.lower() for m in re.findall(r"(?i)(?:\bwith|,)\s+`?(\w+)`?\s*(?:\([^()]*\)\s*)?as\s*\(", bare)}
    dump = plan.treeString()
    for node in _walk(plan):
        name = node.nodeName()
        if name not in READING_NODES and ("Command" in name or "Insert" in name or "Create" in name or "Drop" in name or "Statement" in name or name.startswith(("Alter", "Set", "Delete", "Update", "Merge", "Replace", "Truncate"))):
            raise GuardError(f"{name} is not allowed")
    for parts in re.findall(r"'?UnresolvedRelation \[([^\]]*)\]", dump):
        names = [p.strip().strip("`").lower() for p in parts.split(",")]
        if len(names) > 1 and names[0] in _FILES:
            raise GuardError("reading files by path is not allowed")
        if len(names) == 1 and names[0] in ctes:
            if allowed is not None and names[0] not in {a.lower() for a in allowed} and spark.catalog.tableExists(names[0]):
                raise GuardError(f"{names[0]!r} hides a relation that is not allowed")
            continue
        if database and len(names) > 1 and names[-2] != database.lower():
            raise GuardError(f"wrong database: {names[-2]}")
        if allowed is not None and names[-1] not in {a.lower() for a in allowed}:
            raise GuardError(f"relation {names[-1]!r} is not allowed")
    return text


def run(spark: SparkSession, sql: str, allowed: set[str] | None = None, database: str | None = None) -> DataFrame:
    """The lazy result of a guarded query."""
    return spark.sql(guard(spark, sql, allowed, database))


def plain(value: Any) -> Any:
    """A value as JSON holds it: NaN and infinities 0, decimals as floats, times as ISO text."""
    if isinstance(value, float):
        return value if math.isfinite(value) else 0.0
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return [plain(v) for v in value]
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return value.isoformat() if hasattr(value, "isoformat") else value


def finite_columns(df: DataFrame) -> DataFrame:
    """NaN and infinities of number columns as 0."""
    return df.select(*[finite(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def execute(spark: SparkSession, sql: str, allowed: set[str] | None = None, database: str | None = None, max_rows: int = 10_000) -> dict:
    """Envelope with status, columns, rows (at most ``max_rows``, said in ``truncated``) and seconds."""
    began = time.monotonic()
    try:
        df = run(spark, sql, allowed, database)
        rows = df.limit(max_rows + 1).collect()
    except GuardError as e:
        return {"status": "rejected", "error": str(e), "columns": [], "rows": [], "row_count": 0, "seconds": time.monotonic() - began}
    except Exception as e:  # noqa: BLE001 - reported to the caller
        return {"status": "error", "error": str(e).splitlines()[0], "columns": [], "rows": [], "row_count": 0, "seconds": time.monotonic() - began}
    shown = [plain(r) for r in rows[:max_rows]]
    return {"status": "success", "error": None, "columns": [{"name": n, "type": t} for n, t in df.dtypes], "rows": shown, "row_count": len(shown), "truncated": len(rows) > max_rows, "seconds": time.monotonic() - began}


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def describe(df: DataFrame) -> list[dict]:
    return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in df.schema.fields]
