"""Identifiers: row hashes, batch ids, dedup keys and name-based UUIDs, all as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_hash(*columns: str) -> Column:
    """SHA-256 of the named columns in name order as JSON text; nulls count, so a null differs from an absent column."""
    ordered = sorted(columns)
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in ordered]), {"ignoreNullFields": "false"}), 256)


def batch_id(source: Column, offset: Column) -> Column:
    """``batch_{source}_{offset}_{first 8 hex digits of sha256(source:offset)}``."""
    off = offset.cast("string")
    return F.concat_ws("_", F.lit("batch"), source, off, F.substring(F.sha2(F.concat_ws(":", source, off), 256), 1, 8))


def dedup_key(source: Column, batch: Column, row: Column) -> Column:
    """``source:batch:hash``."""
    return F.concat_ws(":", source, batch, row)


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """Version 5 UUID of a name; null for null."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.when(
        name.isNotNull(),
        F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12)),
    )


def lineage_id(source: Column, batch: Column, key: Column, stage: str) -> Column:
    """Name-based id of a record at a stage."""
    return uuid5(F.concat_ws(":", source, batch, key, F.lit(stage)))
