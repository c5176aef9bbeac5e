"""Deduplication, idempotent loads and lineage on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``; rows with a null key part form a key too.

    Written as ``min_by`` over a struct of the row, so rows are combined before the shuffle and a key that holds a
    third of all rows is one row per task.
    """
    cols = df.columns
    held = df.withColumn("__order", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    best = held.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in cols]), "__order").alias("__row"))
    return best.select("__row.*")


def latest_per_key(df: DataFrame, keys: list[str], time: str, tie: str | None = None) -> DataFrame:
    """The row of the latest ``time`` of each key (null times first, ties by ``tie``), combined before the shuffle."""
    rank = F.struct(F.col(time).isNotNull(), F.col(time), *([F.col(tie)] if tie else []))
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), rank).alias("__row"))
    return best.select("__row.*")


def anti_load(staging: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Staging rows whose key the target lacks; null key parts match each other. Only the keys of the target are read."""
    t = target.select(*[F.col(k).alias(f"__{k}") for k in keys])
    match = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return staging.join(t, match, "left_anti")


def claim_winners(log: DataFrame, keys: list[str], row: str, time: str) -> DataFrame:
    """First writer of each key: its row id by the earliest time, ties by row id."""
    return log.groupBy(*keys).agg(F.min_by(row, F.struct(F.col(time).isNull(), time, row)).alias("winner"))


def won_rows(rows: DataFrame, log: DataFrame, keys: list[str], row: str, time: str) -> DataFrame:
    """Rows whose claim won (semi join with the winners)."""
    w = claim_winners(log, keys, row, time).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("winner").alias("__w"))
    return rows.join(w, [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col(row) == F.col("__w")], "left_semi")


def stage_stats(log: DataFrame, batch: str = "_batch_id", stage: str = "_stage") -> DataFrame:
    """Logged rows per batch and stage."""
    return log.groupBy(batch, stage).agg(F.count("*").alias("n"))


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """``n_left, n_right, difference, percent`` of two row counts."""
    a, b = left.agg(F.count("*").alias("n_left")), right.agg(F.count("*").alias("n_right"))
    both = a.join(b, F.lit(True))  # one row on each side
    diff = F.abs(F.col("n_left") - F.col("n_right"))
    return both.withColumns({"difference": diff, "percent": F.when(F.col("n_left") > 0, 100.0 * diff / F.col("n_left")).otherwise(F.lit(0.0))})


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Parents and children of each node, one row each: ``id, relation, neighbour``. Edges are ``parent, child``.

    A hub's neighbours are rows, not one list, so nothing is gathered per node; repeated edges count once and a node
    without neighbours has no row.
    """
    once = edges.select("parent", "child").distinct()
    ends = once.select(F.inline(F.array(F.struct(F.col("child").alias("id"), F.lit("parent").alias("relation"), F.col("parent").alias("neighbour")), F.struct(F.col("parent").alias("id"), F.lit("child").alias("relation"), F.col("child").alias("neighbour")))))
    return ends.join(nodes.select("id").distinct(), "id", "left_semi")


def last_value_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One value per key, that of the last row in input order."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def last_in_window(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by a window; for orders that no single struct can express."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def rollback_claims(log: DataFrame, failed: DataFrame, keys: list[str], row: str) -> DataFrame:
    """The log without the claims of rows that could not be written: ``failed`` holds the keys and row ids."""
    f = failed.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(row).alias("__row")).distinct()
    return log.join(f, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col(row).eqNullSafe(F.col("__row"))], "left_anti")
