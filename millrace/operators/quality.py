"""Quality scores of rows and batches, trends, and the running deviation test of a batch metric."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols, F.lit(0))


def filled(df: DataFrame, name: str) -> Column:
    """1 where the value is neither null nor blank."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.when(c.isNotNull() & (F.trim(c) != ""), 1).otherwise(0)
    return F.when(c.isNotNull(), 1).otherwise(0)


def completeness(df: DataFrame, required: list[str]) -> Column:
    """Share of required fields that are filled; 1 where none is required. A field that is absent is not filled."""
    if not required:
        return F.lit(1.0)
    return _total([filled(df, n) if n in df.columns else F.lit(0) for n in required]) / F.lit(float(len(required)))


def validity(n_errors: Column) -> Column:
    """1 less a tenth for each error, not below 0."""
    return F.greatest(F.lit(0.0), 1.0 - 0.1 * n_errors)


def overall(c: Column, v: Column, weight_c: float = 0.4, weight_v: float = 0.6) -> Column:
    if abs(weight_c + weight_v - 1) > 1e-9:
        raise ValueError("weights must add up to 1")
    return weight_c * c + weight_v * v


def score_rows(df: DataFrame, required: list[str], n_errors: Column) -> DataFrame:
    """Adds ``_completeness_score, _validity_score, _quality_score``."""
    out = df.withColumns({"_completeness_score": completeness(df, required), "_validity_score": validity(n_errors)})
    return out.withColumn("_quality_score", overall(F.col("_completeness_score"), F.col("_validity_score")))


def batch_summary(scored: DataFrame, by: list[str], warnings: str = "_warnings", errors: str = "_errors") -> DataFrame:
    """Per group: rows, mean, least and most quality, rows with warnings and errors, and their shares."""
    n = F.count("*")
    warned, failed = F.count_if(F.size(warnings) > 0), F.count_if(F.size(errors) > 0)
    return scored.groupBy(*by).agg(
        n.alias("n_rows"), F.avg("_quality_score").alias("avg_quality"), F.min("_quality_score").alias("min_quality"), F.max("_quality_score").alias("max_quality"),
        warned.alias("n_warned"), failed.alias("n_failed"), (warned / n).alias("warning_rate"), (failed / n).alias("error_rate"),
    )


def batch_metrics(df: DataFrame, by: list[str], fields: list[str], valid: Column) -> DataFrame:
    """Per group: filled share of all cells, mean validity, share of fields of one type, and their mean.

    A text field is of one type in a batch where all its values look like whole numbers, all like numbers, all like
    truth values, or none of these; a typed column always is.
    """
    aggs = [F.count("*").alias("row_count"), F.avg(valid).alias("validity")]
    cells = _total([F.sum(filled(df, n)) for n in fields])
    aggs.append((cells / (F.count("*") * len(fields)) if fields else F.lit(0.0)).alias("completeness"))
    uniform = []
    for n in fields:
        if isinstance(df.schema[n].dataType, T.StringType):
            c = F.trim(F.col(f"`{n}`"))
            look = F.when(c.rlike(r"^[+-]?[0-9]+$"), "int").when(c.rlike(r"^[+-]?[0-9]*\.[0-9]+$"), "float").when(F.lower(c).isin("true", "false"), "bool").when(c.isNotNull(), "text")
            uniform.append(F.when(F.count_distinct(look) <= 1, 1).otherwise(0))
        else:
            uniform.append(F.lit(1))
    aggs.append((_total(uniform) / len(fields) if fields else F.lit(0.0)).alias("consistency"))
    out = df.groupBy(*by).agg(*aggs)
    mean = (F.col("completeness") + F.col("validity") + F.col("consistency")) / 3.0
    return out.withColumn("quality", F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)))


def deviation(metrics: DataFrame, by: list[str], order: list[str], value: str, window: int = 20, least: int = 5, limit: float = 3.0, include_current: bool = False, floor: float = 1e-9) -> DataFrame:
    """Adds ``n_seen, baseline, spread, zscore, is_anomaly`` from the last ``window`` values of a series.

    ``include_current=True`` counts the value itself among them, as the reference pipeline does, which keeps the score
    under the square root of one less than their number; by default only the history counts. A spread of ``floor`` or less
    is the noise of adding up equal values and gives no score.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    frame = w.rowsBetween(-(window - 1), 0) if include_current else w.rowsBetween(-window, -1)
    v = F.col(value)
    out = metrics.withColumns({"n_seen": F.count(v).over(frame), "baseline": F.avg(v).over(frame), "spread": F.stddev_pop(v).over(frame)})
    z = F.when((F.col("n_seen") >= least) & (F.col("spread") > floor), (v - F.col("baseline")) / F.col("spread"))
    out = out.withColumn("zscore", z)
    return out.withColumn("is_anomaly", F.coalesce(F.abs("zscore") >= limit, F.lit(False)))


def daily_trend(metrics: DataFrame, time: str, scores: list[str], rows: str) -> DataFrame:
    """Per day: mean of each score and the sum of rows."""
    return metrics.groupBy(F.to_date(time).alias("day")).agg(*[F.avg(s).alias(f"avg_{s}") for s in scores], F.sum(rows).alias("total_rows"))
