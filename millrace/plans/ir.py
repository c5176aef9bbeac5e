"""The query representation and its compilation to a lazy DataFrame (one table, conjunctive filters)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.times import GRANULARITIES, bucket

AGGREGATIONS = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count}
OPERATORS = {"=", "!=", ">", "<", ">=", "<=", "IN", "LIKE", "BETWEEN"}


class QueryError(ValueError):
    """A representation that cannot be compiled for its table."""


@dataclass(frozen=True)
class Ratio:
    """``numerator / denominator``, each a column with an optional aggregation; null where the denominator is 0."""

    numerator: tuple[str, str | None]
    denominator: tuple[str, str | None]
    safe: bool = True


@dataclass(frozen=True)
class Metric:
    column: str
    aggregation: str | None = None
    alias: str = ""
    ratio: Ratio | None = None

    @property
    def name(self) -> str:
        if self.alias:
            return self.alias
        if self.aggregation is None:
            return self.column
        return f"{self.aggregation.lower()}_{'rows' if self.column == '*' else self.column}"


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: Any


@dataclass(frozen=True)
class Order:
    column: str
    direction: str = "ASC"


@dataclass(frozen=True)
class QueryIR:
    table: str
    metrics: tuple[Metric, ...] = ()
    dimensions: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    order_by: tuple[Order, ...] = ()
    limit: int | None = None
    time_column: str = ""
    time_granularity: str = ""
    preserve_grain: bool = False
    kpi: bool = False
    row_count_requested: bool = False
    explicit_top_n: bool = False
    casts: dict[str, str] = field(default_factory=dict)
    intent: str = ""
    mode: str = ""
    operations: tuple[str, ...] = ()
    ambiguities: tuple[dict, ...] = ()
    case_insensitive: bool = False
    week_start: str = "sunday"


#: Name of the time bucket in results.
PERIOD = "period"


def _numeric(schema: T.StructType, name: str, casts: dict[str, str]) -> bool:
    if name in casts:
        return casts[name].split("(")[0] in ("double", "float", "int", "bigint", "decimal", "long", "smallint", "tinyint")
    return isinstance(schema[name].dataType, T.NumericType)


def normalise(ir: QueryIR, schema: T.StructType, business: tuple[str, ...] = ()) -> QueryIR:
    """Checks and rewrites before any plan is built.

    COUNT over a numeric business column becomes SUM unless a row count was asked for; a time series is ordered by its
    period and keeps a limit only for an explicit top N; a limited aggregate needs a dimension unless it is one figure.
    """
    names = schema.fieldNames()
    for n in [*ir.dimensions, *[f.column for f in ir.filters], *([ir.time_column] if ir.time_column else [])]:
        if n not in names:
            raise QueryError(f"unknown column {n!r} in {ir.table}")
    metrics = []
    for m in ir.metrics:
        if m.ratio is None and m.column != "*" and m.column not in names:
            raise QueryError(f"unknown column {m.column!r} in {ir.table}")
        if m.ratio is not None:
            for c, a in (m.ratio.numerator, m.ratio.denominator):
                if c not in names:
                    raise QueryError(f"unknown column {c!r} in {ir.table}")
                if a is not None and a not in AGGREGATIONS:
                    raise QueryError(f"unknown aggregation {a!r}")
        elif m.aggregation is not None and m.aggregation not in AGGREGATIONS:
            raise QueryError(f"unknown aggregation {m.aggregation!r}")
        elif m.aggregation in ("SUM", "AVG", "MIN", "MAX") and (m.column == "*" or not _numeric(schema, m.column, ir.casts)):
            raise QueryError(f"{m.aggregation} needs a numeric column, not {m.column!r}")
        elif m.aggregation == "COUNT" and m.column in business and not ir.row_count_requested and _numeric(schema, m.column, ir.casts):
            m = replace(m, aggregation="SUM", alias=m.alias.replace("count_", "sum_", 1) if m.alias else "")
        if m not in metrics:
            metrics.append(m)
    if ir.limit is not None and (not isinstance(ir.limit, int) or isinstance(ir.limit, bool) or ir.limit <= 0):
        raise QueryError("limit must be a positive number")
    if ir.time_granularity and ir.time_granularity not in GRANULARITIES:
        raise QueryError(f"unknown granularity {ir.time_granularity!r}")
    if ir.time_granularity == "hour" and not isinstance(schema[ir.time_column].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise QueryError("hours need a timestamp column")
    series = bool(ir.time_granularity and ir.time_column)
    order, limit = ir.order_by, ir.limit
    if series:
        if not ir.explicit_top_n:
            limit = None
            order = (Order(PERIOD if not ir.preserve_grain else ir.time_column, "ASC"),)
    aggregated = any(m.aggregation or (m.ratio and (m.ratio.numerator[1] or m.ratio.denominator[1])) for m in metrics)
    if limit and aggregated and not ir.dimensions and not series and not ir.kpi and any(isinstance(f.dataType, T.StringType) for f in schema.fields):
        raise QueryError("a ranking needs a dimension")
    known = {PERIOD, *names, *[m.name for m in metrics]}
    for o in order:
        if o.column not in known:
            raise QueryError(f"cannot order by unknown column {o.column!r}")
    for f in ir.filters:
        if f.operator not in OPERATORS:
            raise QueryError(f"unknown operator {f.operator!r}")
        if f.operator == "IN" and isinstance(f.value, (list, tuple, set)) and not f.value:
            raise QueryError(f"empty list for {f.column!r}")
    return replace(ir, metrics=tuple(metrics), order_by=tuple(order), limit=limit)


def predicate(f: Filter, df: DataFrame, casts: dict[str, str], case_insensitive: bool = False) -> Column:
    """A filter as a column."""
    c = F.col(f"`{f.column}`")
    if f.column in casts:
        c = c.try_cast(casts[f.column])
    text = isinstance(df.schema[f.column].dataType, T.StringType) and f.column not in casts
    if text and case_insensitive:
        c = F.lower(c)
        low = lambda v: v.lower() if isinstance(v, str) else v
    else:
        low = lambda v: v
    v = f.value
    if f.operator == "IN":
        return c.isin([low(x) for x in (v if isinstance(v, (list, tuple, set)) else [v])])
    if f.operator == "BETWEEN":
        a, b = (v["low"], v["high"]) if isinstance(v, dict) else v
        return c.between(a, b)
    if f.operator == "LIKE":
        return c.like(low(v))
    v = int(v) if isinstance(v, bool) and not isinstance(df.schema[f.column].dataType, T.BooleanType) else low(v)
    return {"=": c == v, "!=": c != v, ">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}[f.operator]


def _value(df: DataFrame, name: str, casts: dict[str, str]) -> Column:
    c = F.col(f"`{name}`")
    return c.try_cast(casts[name]) if name in casts else c


def _operand(df: DataFrame, part: tuple[str, str | None], casts: dict[str, str]) -> Column:
    c = _value(df, part[0], casts)
    return AGGREGATIONS[part[1]](c) if part[1] else c


def metric_column(df: DataFrame, m: Metric, casts: dict[str, str]) -> Column:
    if m.ratio is not None:
        a, b = _operand(df, m.ratio.numerator, casts).cast("double"), _operand(df, m.ratio.denominator, casts).cast("double")
        return (F.try_divide(a, b) if m.ratio.safe else a / b).alias(m.name)
    if m.column == "*":
        return F.count("*").alias(m.name)
    c = _value(df, m.column, casts)
    return (AGGREGATIONS[m.aggregation](c) if m.aggregation else c).alias(m.name)


def compile_ir(ir: QueryIR, df: DataFrame, business: tuple[str, ...] = ()) -> DataFrame:
    """The lazy DataFrame of a representation over its table. Nulls sort last in both directions."""
    ir = normalise(ir, df.schema, business)
    if ir.filters:
        df = df.where(reduce(lambda a, b: a & b, [predicate(f, df, ir.casts, ir.case_insensitive) for f in ir.filters]))
    series = bool(ir.time_granularity and ir.time_column)
    dims: list[Column] = []
    for d in dict.fromkeys(ir.dimensions):
        if series and d == ir.time_column:
            continue
        dims.append(F.col(f"`{d}`"))
    if series:
        t = F.col(f"`{ir.time_column}`")
        if isinstance(df.schema[ir.time_column].dataType, T.StringType):
            t = t.try_cast("date") if ir.time_granularity != "hour" else t.try_cast("timestamp")
        dims.insert(0, t.alias(ir.time_column) if ir.preserve_grain else bucket(t, ir.time_granularity, ir.week_start).alias(PERIOD))
    aggregated = [m for m in ir.metrics if m.aggregation or m.column == "*" or (m.ratio and (m.ratio.numerator[1] or m.ratio.denominator[1]))]
    plain = [m for m in ir.metrics if m not in aggregated]
    if aggregated:
        keys = [*dims, *[metric_column(df, m, ir.casts) for m in plain]]
        aggs = [metric_column(df, m, ir.casts) for m in aggregated]
        out = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    else:
        cols = [*dims, *[metric_column(df, m, ir.casts) for m in plain]]
        out = df.select(*cols) if cols else df
    if ir.order_by:
        keys = []
        for o in ir.order_by:
            desc = str(o.direction).upper() == "DESC"
            if o.column not in out.columns:
                raise QueryError(f"cannot order by {o.column!r}: not in the result")
            keys.append(F.col(f"`{o.column}`").desc_nulls_last() if desc else F.col(f"`{o.column}`").asc_nulls_last())
        ties = [F.col(f"`{c}`").asc_nulls_last() for c in out.columns if c not in {o.column for o in ir.order_by}] if ir.limit else []
        out = out.orderBy(*keys, *ties)
    return out.limit(ir.limit) if ir.limit else out


def to_sql(ir: QueryIR) -> str:
    """SQL text of a representation, for people to read; plans are built without it."""

    def lit(v: Any) -> str:
        if isinstance(v, bool):
            return "1" if v else "0"
        if isinstance(v, (list, tuple, set)):
            return "(" + ", ".join(lit(x) for x in v) + ")"
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    def op(part: tuple[str, str | None]) -> str:
        return f"{part[1]}({part[0]})" if part[1] else part[0]

    def met(m: Metric) -> str:
        if m.ratio:
            den = op(m.ratio.denominator)
            text = f"({op(m.ratio.numerator)} / {f'NULLIF({den}, 0)' if m.ratio.safe else den})"
        else:
            text = f"{m.aggregation or 'COUNT'}({m.column})" if m.aggregation or m.column == "*" else m.column
        return f"{text} AS {m.name}" if m.name != text else text

    series = bool(ir.time_granularity and ir.time_column)
    dims = [d for d in ir.dimensions if not (series and d == ir.time_column)]
    head = [f"{ir.time_granularity}({ir.time_column}) AS {PERIOD}"] * (series and not ir.preserve_grain) + [ir.time_column] * (series and ir.preserve_grain) + dims + [met(m) for m in ir.metrics]
    sql = f"SELECT {', '.join(dict.fromkeys(head)) or '*'} FROM {ir.table}"
    if ir.filters:
        sql += " WHERE " + " AND ".join(f"{f.column} BETWEEN {lit(list(f.value)[0])} AND {lit(list(f.value)[1])}" if f.operator == "BETWEEN" and not isinstance(f.value, dict) else f"{f.column} {f.operator} {lit(f.value if f.operator != 'IN' or isinstance(f.value, (list, tuple)) else [f.value])}" for f in ir.filters)
    keys = ([PERIOD] if series and not ir.preserve_grain else [ir.time_column] if series else []) + dims + [m.column for m in ir.metrics if not m.aggregation and not m.ratio and m.column != "*"]
    if keys and any(m.aggregation or m.ratio or m.column == "*" for m in ir.metrics):
        sql += " GROUP BY " + ", ".join(keys)
    if ir.order_by:
        sql += " ORDER BY " + ", ".join(f"{o.column} {'DESC' if o.direction.upper() == 'DESC' else 'ASC'}" for o in ir.order_by)
    return sql + (f" LIMIT {ir.limit}" if ir.limit else "")
