"""Which chart shows a result: by the query's intent first, by the result's shape otherwise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.times import parse_time
from millrace.plans.ir import PERIOD, QueryIR

SAMPLE = 25


@dataclass(frozen=True)
class Shape:
    columns: tuple[str, ...]
    numeric: tuple[str, ...]
    times: tuple[str, ...]
    rows: int


def shape(df: DataFrame) -> Shape:
    """Roles of the columns by type; text columns are looked at in at most ``SAMPLE`` rows. ``rows`` stops at 26."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    head = df.limit(SAMPLE + 1)
    row = head.agg(F.count("*").alias("n"), *[F.avg(parse_time(F.col(f"`{c}`")).isNotNull().cast("int")).alias(f"t_{c}") for c in texts], *[F.avg(F.col(f"`{c}`").try_cast("double").isNotNull().cast("int")).alias(f"n_{c}") for c in texts]).first()
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) or (f.name in texts and (row[f"t_{f.name}"] or 0) >= 0.8 and (row[f"n_{f.name}"] or 0) < 0.8)]
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) or (f.name in texts and f.name not in times and (row[f"n_{f.name}"] or 0) >= 0.8)]
    return Shape(tuple(df.columns), tuple(numeric), tuple(times), row["n"])


def by_shape(s: Shape) -> dict:
    """Line, scatter, bar, histogram, card or table."""
    others = [c for c in s.columns if c not in s.numeric]
    if s.rows == 1 and len(s.columns) == 1 and s.numeric:
        return {"type": "card", "metric": s.numeric[0]}
    if s.rows and s.times and s.numeric:
        return {"type": "line", "x": s.times[0], "y": s.numeric[0]}
    if s.rows > 1 and len(s.numeric) >= 2 and not others:
        return {"type": "scatter", "x": s.numeric[0], "y": s.numeric[1]}
    if s.rows > 1 and len(s.numeric) == 1 and not others:
        return {"type": "histogram", "x": s.numeric[0]}
    if s.rows and s.numeric and others:
        return {"type": "bar", "x": others[0], "y": s.numeric[0]}
    return {"type": "table"}


def recommend(ir: QueryIR, s: Shape | None = None) -> dict:
    """The chart of an analytical query."""
    names = [m.name for m in ir.metrics]
    if ir.mode == "relationship" and len(names) >= 2:
        return {"type": "scatter", "x": names[0], "y": names[1]}
    if ir.time_granularity and names:
        return {"type": "line", "x": ir.time_column if ir.preserve_grain else PERIOD, "y": names[0]}
    if ir.mode == "distribution" and names:
        return {"type": "histogram", "x": names[0]}
    if len(names) == 1 and ir.dimensions:
        return {"type": "bar", "x": ir.dimensions[0], "y": names[0], "sorted": ir.limit is not None}
    if len(names) == 1 and not ir.dimensions and (s is None or s.rows <= 1):
        return {"type": "card", "metric": names[0]}
    return by_shape(s) if s else {"type": "table"}


def forecast_chart() -> dict:
    """Two series, solid for what was and dashed for what is expected."""
    series = [{"series_type": "actual", "label": "Actual", "color_role": "actual", "dash": False}, {"series_type": "forecast", "label": "Forecast", "color_role": "forecast", "dash": True}]
    return {"type": "line", "x": "ds", "y": "value", "mode": "actual_plus_predicted", "series_field": "series_type", "series": series}


def resolve_axes(chart: dict, s: Shape) -> dict:
    """Replace axes that the result lacks by columns of the right kind."""
    out = dict(chart)
    if "x" in out and out["x"] not in s.columns:
        pool = s.times if out["type"] == "line" else s.numeric if out["type"] in ("scatter", "histogram") else [c for c in s.columns if c not in s.numeric]
        out["x"] = next(iter(pool), s.columns[0] if s.columns else None)
    if "y" in out and out["y"] not in s.columns:
        out["y"] = next((c for c in s.numeric if c != out.get("x")), None)
    return out
