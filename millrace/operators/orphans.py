"""References to records that do not exist: sorted keys as integers, runs of parents, an as-of match.

Keys are canonical bytes (a UUID is its 128 bits, any other text itself). The distinct keys of parents and references
are ranked together in sorted order, block by block, which turns them into dense integers: the parents' integers then
form contiguous runs that only an orphan interrupts, so the runs of a block number its orphans plus one however the keys
are spread. A reference is matched as-of to the last run that starts at or before it and is an orphan if it lies beyond
that run's end; a run's rows are its start and length, nothing is looked up key by key.

Blocks are hash buckets of about ``BLOCK_KEYS`` keys, so no sort is larger than a block whatever the distribution of the
keys (sequential, random or time-ordered ones), and no key is in a sort more than once: both sides are reduced to
distinct keys with a map-side combine first, so a key that a third of all rows hold is one row there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_KEYS = 4096


def uuid_key(c: Column) -> Column:
    """The 16 bytes of a UUID however it is written (case, braces, dashes, urn prefix); of any other text, its own bytes after a mark."""
    bare = F.replace(F.translate(F.lower(c), "-{}() \t\r\n", ""), F.lit("urn:uuid:"), F.lit(""))
    bits = F.when(F.length(bare) == 32, F.unhex(bare))
    return F.coalesce(bits, F.encode(F.concat(F.lit("?"), c), "utf-8"))


def text_key(c: Column) -> Column:
    """The bytes of the text as it is."""
    return F.encode(c, "utf-8")


@dataclass(frozen=True)
class Reference:
    """A column of the child table that names rows of a parent table, and the deletions of that table."""

    field: str
    key: Callable[[Column], Column]
    parent: DataFrame
    parent_key: str
    parent_time: str
    tombstones: DataFrame
    tombstone_key: str = "target_key"


def runs(keys: DataFrame) -> DataFrame:
    """Adds ``rank, run_start, run_end`` to distinct ``keys(field, block, key, is_parent, ...)``.

    ``rank`` is the place of the key in its block's sorted order; a run is a contiguous stretch of parents; every key gets
    the last run that starts at or before it (null where there is none).
    """
    w = Window.partitionBy("field", "block").orderBy("key")
    starts = F.when(F.col("is_parent") & ~F.coalesce(F.lag("is_parent").over(w), F.lit(False)), F.col("rank"))
    ranked = keys.withColumn("rank", F.row_number().over(w)).withColumn("run_start", starts).withColumn("run_start", F.last("run_start", True).over(w))
    size = F.sum(F.col("is_parent").cast("int")).over(Window.partitionBy("field", "block", "run_start"))
    return ranked.withColumn("run_end", F.when(F.col("run_start").isNotNull(), F.col("run_start") + size - 1))


def run_table(keys: DataFrame) -> DataFrame:
    """The runs alone, one row each: ``field, block, run_start, run_end``."""
    return runs(keys).where("run_start is not null").select("field", "block", "run_start", "run_end").distinct()


def distinct_keys(child: DataFrame, time_col: str, references: list[Reference], blocks: int) -> DataFrame:
    """Keys of both sides, once each: ``field, block, key, is_parent, parent_at, is_ref, first_ref, deleted``."""
    named = F.array(*[F.struct(F.lit(r.field).alias("field"), r.key(F.col(r.field).cast("string")).alias("key")) for r in references])
    sides = [child.select(F.col(time_col).cast("timestamp").alias("at"), F.explode(named).alias("k")).select("k.field", "k.key", "at", F.lit(1).alias("side"))]
    for r in references:
        sides.append(r.parent.select(F.lit(r.field).alias("field"), r.key(F.col(r.parent_key).cast("string")).alias("key"), F.col(r.parent_time).cast("timestamp").alias("at"), F.lit(0).alias("side")))
        sides.append(r.tombstones.select(F.lit(r.field).alias("field"), r.key(F.col(r.tombstone_key).cast("string")).alias("key"), F.lit(None).cast("timestamp").alias("at"), F.lit(2).alias("side")))
    every = sides[0]
    for s in sides[1:]:
        every = every.unionByName(s)
    side = F.col("side")
    keys = every.where("key is not null").groupBy("field", "key").agg(
        F.max(side == 0).alias("is_parent"), F.min(F.when(side == 0, F.col("at"))).alias("parent_at"), F.max(side == 1).alias("is_ref"), F.min(F.when(side == 1, F.col("at"))).alias("first_ref"), F.max(side == 2).alias("deleted")
    )
    return keys.where("is_parent or is_ref").withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))


def orphan_keys(child: DataFrame, time_col: str, references: list[Reference]) -> DataFrame:
    """``field, key, found, deleted, parent_at`` of each referenced key beyond its run, or whose parent is later than at least one reference.

    Null references are none; null times are never late; empty inputs are allowed.
    """
    n = sum(r.parent.count() for r in references)
    matched = runs(distinct_keys(child, time_col, references, max(1, n // BLOCK_KEYS)))
    inside = F.coalesce(F.col("rank") <= F.col("run_end"), F.lit(False))
    return matched.where("is_ref").select("field", "key", inside.alias("found"), "deleted", "parent_at", "first_ref").where("not found or parent_at > first_ref").drop("first_ref")


def reference_problems(child: DataFrame, id_col: str, time_col: str, references: list[Reference]) -> DataFrame:
    """One row per child row and broken reference: ``id_col, ref_field, kind, time_col``; identical child rows count once.

    ``kind`` is ``late`` (the target's earliest time is after the child's), ``deleted`` (no target, a tombstone names it) or
    ``missing``. A missing key that very many rows name is split over tasks by adaptive skew handling.
    """
    bad = orphan_keys(child, time_col, references)
    named = F.array(*[F.struct(F.lit(r.field).alias("field"), r.key(F.col(r.field).cast("string")).alias("key")) for r in references])
    rows = child.select(F.col(id_col).alias("__id"), F.col(time_col).cast("timestamp").alias("__at"), F.explode(named).alias("k")).select("__id", "__at", "k.field", "k.key").where("key is not null")
    kind = F.when(~F.col("found"), F.when(F.col("deleted"), "deleted").otherwise("missing")).when(F.col("parent_at") > F.col("__at"), "late")
    return rows.join(bad, ["field", "key"]).select(F.col("__id").alias(id_col), F.col("field").alias("ref_field"), kind.alias("kind"), F.col("__at").alias(time_col)).where("kind is not null").distinct()
