"""Time series: preparation, spacing, filling and the straight-line forecast; models of other kinds plug in per group."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.times import bucket, parse_time

NAME_PRIORITY = ("ds", "date", "timestamp", "created_at")
VALUE_WORDS = ("total", "sales", "revenue", "amount", "value", "count", "orders", "quantity")
MIN_POINTS = 14


def parse_share(df: DataFrame, columns: list[str], make: Callable[[Column], Column]) -> dict[str, float]:
    """Share of the non-null values of each column that can be read by ``make``: one row to the driver."""
    if not columns:
        return {}
    row = df.agg(*[F.avg(F.when(F.col(f"`{c}`").isNotNull(), make(F.col(f"`{c}`")).isNotNull().cast("int"))).alias(c) for c in columns]).first()
    return {c: float(row[c] or 0.0) for c in columns}


def choose_time(df: DataFrame, requested: str | None = None, dimensions: tuple[str, ...] = ()) -> str | None:
    """The requested column, one by name, one that is at least 80 % times, or a dimension."""
    from millrace.plans.planner import is_technical

    if requested in df.columns:
        return requested
    names = [c for c in df.columns if not is_technical(c)]
    for n in NAME_PRIORITY:
        if n in names:
            return n
    shares = parse_share(df, names, lambda c: parse_time(c))
    good = [n for n in names if shares[n] >= 0.8 and df.schema[n].dataType.typeName() not in ("double", "float", "integer", "long", "decimal", "short", "byte")]
    return good[0] if good else next((d for d in dimensions if d in names), None)


def choose_value(df: DataFrame, time: str, hint: str | None = None) -> str | None:
    """The hinted column if at least 80 % numbers, else the best by share of numbers and by name."""
    names = [c for c in df.columns if c != time]
    shares = parse_share(df, names, lambda c: c.cast("string").try_cast("double"))
    if hint in names and shares[hint] >= 0.8:
        return hint
    ranked = sorted(names, key=lambda n: (-(shares[n] + 0.2 * any(w in n.lower() for w in VALUE_WORDS)), names.index(n)))
    return ranked[0] if ranked and shares[ranked[0]] > 0 else None


def clean_series(df: DataFrame, time: str, value: str, order: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by,) ds, value``: times and numbers that can be read, finite, one per time (the last by ``order`` wins)."""
    v = F.col(value).cast("string").try_cast("double")
    rows = df.select(*by, parse_time(F.col(time)).alias("ds"), v.alias("value"), (F.col(order) if order else F.monotonically_increasing_id()).alias("__o"))
    rows = rows.where("ds is not null and value is not null and not isnan(value) and abs(value) < double('infinity')")
    return rows.groupBy(*by, "ds").agg(F.max_by("value", "__o").alias("value"))


def history(df: DataFrame, time: str, value: str, granularity: str) -> DataFrame:
    """Sums per bucket as ``ds, value``; buckets are dates (the year too)."""
    rows = df.where(F.col(time).isNotNull() & F.col(value).isNotNull())
    return rows.groupBy(bucket(F.col(time), granularity, year_as_date=True).alias("ds")).agg(F.sum(F.col(value).cast("double")).alias("value"))


def steps(series: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Seconds between successive times (only positive ones)."""
    w = Window.partitionBy(*by).orderBy("ds") if by else Window.orderBy("ds")
    at = F.unix_micros(F.col("ds").cast("timestamp")) / 1e6
    return series.select(*by, (at - F.lag(at).over(w)).alias("step")).where("step > 0")


def spacing(series: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``n_steps, step_seconds`` (median, a day if there is none), ``regular_share, is_regular, granularity``.

    Regular: at least 80 % of steps within 20 % (a second at least) of the median.
    """
    s = steps(series, by)
    med = s.groupBy(*by).agg(F.median("step").alias("m"), F.count("*").alias("n_steps"))
    near = F.abs(F.col("step") - F.col("m")) <= F.greatest(F.lit(1.0), 0.2 * F.col("m"))
    joined = s.join(med, list(by)) if by else s.join(med, F.lit(True))  # one row of medians
    out = joined.groupBy(*by).agg(F.coalesce(F.max("n_steps"), F.lit(0)).alias("n_steps"), F.coalesce(F.max("m"), F.lit(86400.0)).alias("step_seconds"), F.coalesce(F.avg(near.cast("double")), F.lit(0.0)).alias("regular_share"))
    return out.withColumns({"is_regular": F.col("regular_share") >= 0.8, "granularity": granularity_of(F.col("step_seconds"))})


def granularity_of(seconds: Column) -> Column:
    return F.when(seconds <= 3600, "hour").when(seconds <= 86400, "day").when(seconds <= 8 * 86400, "week").when(seconds <= 35 * 86400, "month").otherwise("year")


def fill(series: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Missing values from the value before, leading ones from the first value."""
    w = Window.partitionBy(*by).orderBy("ds")
    before = F.last("value", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("value", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return series.withColumn("value", F.coalesce(before, after))


def naive_forecast(series: DataFrame, horizon: int, step_seconds: Column | float, by: tuple[str, ...] = ()) -> DataFrame:
    """Continues the line from the first to the last point: ``(by,) ds, value, q10, q90``; nothing for fewer than 2 points."""
    ends = series.groupBy(*by).agg(F.min_by("value", "ds").alias("v0"), F.max_by("value", "ds").alias("v1"), F.max("ds").cast("timestamp").alias("last"), F.count("*").alias("n")).where("n >= 2")
    slope = (F.col("v1") - F.col("v0")) / (F.col("n") - 1)
    step = step_seconds if isinstance(step_seconds, Column) else F.lit(float(step_seconds))
    out = ends.select(*by, "v1", slope.alias("slope"), "last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("k"))
    ds = F.timestamp_micros(F.unix_micros("last") + (step * 1e6 * F.col("k")).cast("bigint"))
    v = F.col("v1") + F.col("slope") * F.col("k")
    return out.select(*by, ds.alias("ds"), v.alias("value"), (v * 0.95).alias("q10"), (v * 1.05).alias("q90"))


def forecast(series: DataFrame, horizon: int, models: tuple[Callable[[Any, int], Any], ...] = (), least: int = MIN_POINTS) -> tuple[DataFrame, dict]:
    """Actual rows followed by forecast rows in long form, with what was decided.

    ``models`` are tried in order on the (bounded) series as a pandas frame and may return None; the straight line
    is the last. A series with too few points or irregular steps is returned as it is.
    """
    if horizon < 1:
        raise ValueError("horizon must be positive")
    actual = series.select(F.col("ds").cast("timestamp").alias("ds"), "value", F.lit("actual").alias("series_type"), F.lit("Actual").alias("series_label"), F.lit("actual").alias("preferred_color_role"))
    s = spacing(series).first()
    n = series.count()
    need = max(5, least)
    info = {"points": n, "granularity": s["granularity"], "step_seconds": s["step_seconds"], "forecast_available": True, "reason": None, "boundary_index": n}
    if n < need or not s["is_regular"]:
        return actual, info | {"forecast_available": False, "reason": "not enough points" if n < need else "irregular spacing"}
    for model in models:
        ahead = model(series.orderBy("ds").toPandas(), horizon)
        if ahead is not None:
            future = series.sparkSession.createDataFrame(ahead)
            break
    else:
        future = naive_forecast(series, horizon, s["step_seconds"])
    predicted = future.select(F.col("ds").cast("timestamp").alias("ds"), F.col("value").cast("double").alias("value"), F.lit("forecast").alias("series_type"), F.lit("Forecast").alias("series_label"), F.lit("forecast").alias("preferred_color_role"))
    return actual.unionByName(predicted), info
