"""The batch pipeline: bronze, clean, contract, rules, scores, silver or quarantine, load. One set of frame functions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X
from millrace.functions.ids import batch_id, lineage_id, row_hash
from millrace.operators.contracts import Contract, validate
from millrace.operators.inference import infer_types, typed
from millrace.operators.quality import batch_metrics, score_rows
from millrace.operators.rules import Rule, apply_rules
from millrace.session import materialise
from millrace.sources.writers import quarantine_rows


def _key(names: list[str], source: str, offset: int, key_with_batch: bool) -> Column:
    content = row_hash(*names)
    return F.sha2(F.concat_ws(":", batch_id(F.lit(source), F.lit(offset)), content), 256) if key_with_batch else F.sha2(F.concat_ws(":", F.lit(source), content), 256)


def _with_lineage(keyed: DataFrame, names: list[str], source: str, offset: int, at: Column | None) -> DataFrame:
    lineage = {"_batch_id": batch_id(F.lit(source), F.lit(offset)), "_source_id": F.lit(source), "_extracted_at": at if at is not None else F.current_timestamp()}
    out = keyed.withColumns(lineage)
    return out.withColumn("_row_id", lineage_id(F.col("_source_id"), F.col("_batch_id"), F.col("_dedup_key"), "extract")).select("_row_id", *lineage, "_dedup_key", *[F.col(f"`{c}`") for c in names])


def bronze(df: DataFrame, source: str, offset: int = 0, at: Column | None = None, key_with_batch: bool = False) -> DataFrame:
    """Lineage columns and all data as text: ``_row_id, _batch_id, _source_id, _extracted_at, _dedup_key`` and the fields.

    The key hashes the content alone, so a row that comes again in another batch has the same key;
    ``key_with_batch`` hashes the batch id too. ``_row_id`` is name-based, so a second run gives the same ids.
    """
    names = df.columns
    out = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    return _with_lineage(out.withColumn("_dedup_key", _key(names, source, offset, key_with_batch)), names, source, offset, at)


def bronze_fresh(df: DataFrame, source: str, offset: int = 0, at: Column | None = None, target: DataFrame | None = None) -> DataFrame:
    """:func:`bronze` of the rows whose key ``target`` lacks: the keys are made and compared first, the rest only for what is new."""
    names = df.columns
    keyed = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names]).withColumn("_dedup_key", _key(names, source, offset, False))
    if target is not None:
        keyed = keyed.join(target.select("_dedup_key"), "_dedup_key", "left_anti").select(*names, "_dedup_key")
    return _with_lineage(keyed, names, source, offset, at)


def bronze_again(table: DataFrame, source: str | None = None, batch: str | None = None) -> DataFrame:
    """Bronze rows read again as messages for another run: ``key, value``, the value a JSON object as the extractor sends it."""
    rows = table
    for c, v in (("_source_id", source), ("_batch_id", batch)):
        if v is not None:
            rows = rows.where(F.col(c) == v)
    data = F.struct(*[F.col(f"`{c}`") for c in data_columns(table)])
    body = F.struct(F.col("_source_id").alias("source_id"), F.col("_batch_id").alias("batch_id"), F.col("_dedup_key").alias("_dedup_key"), F.col("_row_id").alias("row_id"), data.alias("data"))
    return rows.select(F.col("_row_id").alias("key"), F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


#: White space of all kinds, as Unicode has it.
_SPACES = "\t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def clean_text(c: Column) -> Column:
    """Each run of white space becomes one space, ends are cut, blank becomes null; one plain pattern a value."""
    flat = F.trim(F.regexp_replace(F.translate(c, _SPACES, " " * len(_SPACES)), " {2,}", " "))
    return F.when(flat != "", flat)


def coerce(c: Column, want: str) -> tuple[Column, Column]:
    """(typed value, whether a filled value could not be typed): whole numbers also from texts like ``12.0``."""
    if want == "integer":
        n = c.try_cast("double")
        out = F.coalesce(c.try_cast("bigint"), F.when(~F.isnan(n), n.try_cast("bigint")))
    elif want == "float":
        out = c.try_cast("double")
    elif want == "boolean":
        out = X.to_bool(c)
    elif want == "date":
        out = c.try_cast("date")
    elif want == "timestamp":
        out = c.try_cast("timestamp")
    else:
        return c, F.lit(False)
    return out, c.isNotNull() & out.isNull()


@dataclass
class Outcome:
    """Frames that a batch falls into."""

    silver: DataFrame
    quarantine: DataFrame
    metrics: DataFrame
    checked: DataFrame = field(repr=False, default=None)


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def transform(raw: DataFrame, contract: Contract | None, rules: list[Rule] = (), missing: str = "warn", version: str = "1.0.0", at: Column | None = None, store: bool = True) -> Outcome:
    """Clean, type, validate and score bronze rows; each row goes to silver or, with a reason, to quarantine.

    Reasons, the first that holds: ``empty_row``, ``missing_schema_contract``, ``validation_failed``,
    ``transformation_errors``. A value that does not fit its type counts as violation and keeps its text in the
    quarantined original. The checked rows are written once (``store``), and silver, quarantine and metrics read them:
    otherwise each would clean and check all rows again, with the cleaning repeated inside every later expression.
    """
    if missing not in ("strict", "warn", "quarantine_only"):
        raise ValueError(f"unknown mode {missing!r}")
    names = data_columns(raw)
    kinds = {f.name: f.type for f in contract.fields} if contract else {}
    original = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(None).cast("string").alias("none"))
    cleaned = raw.withColumn("__original", original)
    if names:
        cleaned = cleaned.withColumns({c: clean_text(F.col(f"`{c}`").cast("string")) for c in names})
    empty = F.lit(True)
    for c in names:
        empty = empty & F.col(f"`{c}`").isNull()
    cleaned = cleaned.withColumn("__empty", empty)
    misfits, typed = [], {}
    for c in names:
        value, bad = coerce(F.col(f"`{c}`"), kinds.get(c, "string"))
        typed[c] = value
        misfits.append(F.when(bad, f"{c}: not {kinds.get(c)}"))
    cleaned = cleaned.withColumn("__misfits", F.array_compact(F.array(*misfits)) if misfits else F.array().cast("array<string>")).withColumns(typed)
    ruled = apply_rules(cleaned, list(rules))
    if contract:
        seen = validate(ruled, contract)
    else:
        seen = ruled.withColumns({"_violations": F.array().cast("array<string>"), "_validation_warnings": F.array().cast("array<string>"), "_contract_score": F.lit(1.0), "_validity": F.lit(True)})
    seen = seen.withColumn("_violations", F.array_union("__misfits", "_violations"))
    scored = score_rows(seen, contract.required() if contract else [], F.size("_violations"))
    scored = scored.withColumn("_transform_score", (F.col("_rule_score") + F.col("_contract_score")) / 2)
    no_contract = F.lit(contract is None and missing != "warn")
    reason = F.when(F.col("__empty"), "empty_row").when(no_contract, "missing_schema_contract").when(F.size("_violations") > 0, "validation_failed").when(F.size("_errors") > 0, "transformation_errors")
    checked = scored.withColumn("__reason", reason)
    if store:
        checked = materialise(checked, "checked")
    lineage = [c for c in ("_row_id", "_batch_id", "_source_id", "_dedup_key", "_extracted_at") if c in checked.columns]
    good = checked.where("__reason is null")
    silver = good.select(*[F.col(c).alias("_bronze_row_id") if c == "_row_id" else F.col(c) for c in lineage], (at if at is not None else F.current_timestamp()).alias("_cleaned_at"), F.lit(version).alias("_cleaning_version"), *[F.col(f"`{c}`") for c in data_columns(ruled) if not c.startswith("__")], "_quality_score", "_completeness_score", "_validity_score", "_applied_rules", F.col("_validation_warnings").alias("_warnings"))
    bad = checked.where("__reason is not null")
    originals = bad.select("__original.*", *[F.col(c).alias(f"__l{c}") for c in lineage], "__reason", F.concat("_violations", "_errors").alias("__errors"))
    keep = [f.name for f in checked.schema["__original"].dataType.fields]
    src = F.col("__l_source_id") if "_source_id" in lineage else F.lit(None).cast("string")
    bat = F.col("__l_batch_id") if "_batch_id" in lineage else F.lit(None).cast("string")
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in keep]), {"ignoreNullFields": "false"})
    quarantine = originals.select(F.sha2(F.concat_ws("\u0001", bat, text), 256).alias("_quarantine_id"), *([F.col("__l_row_id").alias("_row_id")] if "_row_id" in lineage else []), bat.alias("_batch_id"), src.alias("_source_id"), (at if at is not None else F.current_timestamp()).alias("_quarantined_at"), F.col("__reason").alias("_quarantine_reason"), F.col("__errors").alias("_validation_errors"), text.alias("_original_row"), F.lit(False).alias("_reprocessed"))
    by = [c for c in ("_source_id", "_batch_id") if c in checked.columns]
    metrics = batch_metrics(checked, by, [c for c in names if c in checked.columns], F.col("_transform_score")) if names else None
    return Outcome(silver, quarantine, metrics, checked)


def reprocess(quarantine: DataFrame, contract: Contract, rules: list[Rule] = (), version: str = "1.0.0") -> tuple[Outcome, DataFrame]:
    """Run rows put aside again, those not yet done whose original is readable; returns the outcome and the ids that are now silver."""
    rows = quarantine.where("not coalesce(_reprocessed, false)").select("_quarantine_id", "_batch_id", "_source_id", F.from_json("_original_row", f"struct<{', '.join(f'`{n}`:string' for n in contract.names())}>").alias("r")).where("r is not null")
    raw = rows.select(F.col("_quarantine_id").alias("_row_id"), "_batch_id", "_source_id", "r.*")
    out = transform(raw, contract, rules, version=version)
    return out, out.silver.select(F.col("_bronze_row_id").alias("_quarantine_id"))


def silver_schema(contract: Contract, fields: list[T.StructField] | None = None) -> T.StructType:
    """Typed fields of a contract, or those given, between lineage and quality columns."""
    lineage = [("_bronze_row_id", T.StringType()), ("_batch_id", T.StringType()), ("_source_id", T.StringType()), ("_cleaned_at", T.TimestampType()), ("_cleaning_version", T.StringType())]
    quality = [("_quality_score", T.DoubleType()), ("_completeness_score", T.DoubleType()), ("_validity_score", T.DoubleType()), ("_applied_rules", T.ArrayType(T.StringType())), ("_warnings", T.ArrayType(T.StringType()))]
    return T.StructType([*[T.StructField(n, t) for n, t in lineage], *(contract.struct().fields if fields is None else fields), *[T.StructField(n, t) for n, t in quality]])


def silver_schema_from(bronze_table: DataFrame, strategy: str = "conservative") -> T.StructType:
    """The silver schema of a bronze table: its text columns with the types their values have, between lineage and quality columns."""
    names = data_columns(bronze_table)
    found = infer_types(bronze_table.select(*[F.col(f"`{c}`") for c in names]), strategy)
    kinds = typed(bronze_table.select(*[F.col(f"`{c}`") for c in names]).limit(0), found).schema
    return silver_schema(Contract("inferred", "1.0.0", ()), kinds.fields)


__all__ = ["Outcome", "bronze", "clean_text", "coerce", "data_columns", "quarantine_rows", "reprocess", "silver_schema", "silver_schema_from", "transform"]
