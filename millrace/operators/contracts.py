"""Schema contracts: model, row validation as column expressions, comparison of versions, stores and look-up."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Formats a text constraint can ask for.
FORMATS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "url": r"^https?://[^\s/$.?#].[^\s]*$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
}
SPARK_TYPES = {"string": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "array": T.ArrayType(T.StringType()), "object": T.StringType()}


@dataclass(frozen=True)
class Constraint:
    """``kind`` of min, max, range, regex, enum, format, unique, required; only severity ``error`` fails a row."""

    kind: str
    value: Any = None
    severity: str = "error"


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    nullable: bool = True
    constraints: tuple[Constraint, ...] = ()
    default: Any = None
    description: str = ""


@dataclass(frozen=True)
class Contract:
    schema_id: str
    version: str
    fields: tuple[Field, ...]

    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def required(self) -> list[str]:
        return [f.name for f in self.fields if not f.nullable]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, SPARK_TYPES[f.type], f.nullable) for f in self.fields])

    def to_json(self) -> str:
        return json.dumps({"schema_id": self.schema_id, "version": self.version, "fields": [{"name": f.name, "type": f.type, "nullable": f.nullable, "default_value": f.default, "description": f.description, "constraints": [{"type": c.kind, "value": c.value, "severity": c.severity} for c in f.constraints]} for f in self.fields]})

    @staticmethod
    def from_json(text: str) -> Contract:
        doc = json.loads(text)
        fields = tuple(Field(f["name"], f["type"], f.get("nullable", True), tuple(Constraint(c["type"], c.get("value"), c.get("severity", "error")) for c in f.get("constraints") or ()), f.get("default_value"), f.get("description") or "") for f in doc["fields"])
        return Contract(doc["schema_id"], doc["version"], fields)


# ---- rows -----------------------------------------------------------------------------------------------


def type_ok(c: Column, have: T.DataType, want: str) -> Column:
    """The non-null value is of the contract type: strict, but whole numbers pass as float and ISO texts as times."""
    text = isinstance(have, T.StringType)
    if want == "string":
        return F.lit(text)
    if want == "integer":
        return F.lit(isinstance(have, T.IntegralType))
    if want == "float":
        return F.lit(isinstance(have, T.NumericType))
    if want == "boolean":
        return F.lit(isinstance(have, T.BooleanType))
    if want == "date":
        return F.try_to_timestamp(F.split_part(c, F.lit("T"), F.lit(1)), F.lit("yyyy-MM-dd")).isNotNull() if text else F.lit(isinstance(have, (T.DateType, T.TimestampType, T.TimestampNTZType)))
    if want == "timestamp":
        return c.try_cast("timestamp").isNotNull() & c.rlike(r"^\d{4}-\d{2}-\d{2}") if text else F.lit(isinstance(have, (T.DateType, T.TimestampType, T.TimestampNTZType)))
    if want == "array":
        return F.lit(isinstance(have, T.ArrayType))
    if want == "object":
        return F.lit(isinstance(have, (T.StructType, T.MapType, T.VariantType)))
    raise ValueError(f"unknown contract type {want!r}")


def constraint_ok(c: Column, have: T.DataType, k: Constraint) -> Column:
    """The non-null value meets the constraint; min and max bound the length of texts and lists."""
    measure = F.length(c) if isinstance(have, T.StringType) else F.size(c) if isinstance(have, T.ArrayType) else c
    text = isinstance(have, T.StringType)
    if k.kind == "min":
        return measure >= k.value
    if k.kind == "max":
        return measure <= k.value
    if k.kind == "range":
        return c.between(*k.value) if isinstance(have, T.NumericType) else F.lit(False)
    if k.kind == "regex":
        return c.rlike(f"^(?:{k.value})") if text else F.lit(False)
    if k.kind == "enum":
        return c.isin(list(k.value))
    if k.kind == "format":
        return c.rlike(FORMATS[k.value]) if text and k.value in FORMATS else F.lit(text)
    if k.kind == "unique":
        return F.col(f"__n_{k.value}") <= 1
    if k.kind == "required":
        return F.lit(True)
    raise ValueError(f"unknown constraint {k.kind!r}")


def validate(df: DataFrame, contract: Contract) -> DataFrame:
    """Adds ``_violations``, ``_validation_warnings`` (arrays of text), ``_validity`` and ``_contract_score``.

    The score is the mean over the contract's fields of 1 (valid), 0 (invalid) or 0.5 (absent but nullable).
    Constraint ``unique`` counts equal values in the frame, combined before the shuffle; only values that occur more than
    once are joined back, so the join is small where the data are sound, and rows of a hot repeated value may be split by
    adaptive skew handling. Fields the contract does not know give a warning.
    """
    unique = [f.name for f in contract.fields if f.name in df.columns and any(c.kind == "unique" for c in f.constraints)]
    out = df
    for name in unique:
        counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("__k")).agg(F.count("*").alias("__n")).where("__n > 1")
        out = out.join(counts, F.col(name) == F.col("__k"), "left").withColumn(f"__n_{name}", F.coalesce("__n", F.lit(1).cast("bigint"))).drop("__k", "__n")
    bad: list[Column] = []
    scores: list[Column] = []
    for f in contract.fields:
        if f.name not in df.columns:
            if f.nullable:
                scores.append(F.lit(0.5))
            else:
                scores.append(F.lit(0.0))
                bad.append(F.lit(f"{f.name}: missing"))
            continue
        c, have = F.col(f"`{f.name}`"), df.schema[f.name].dataType
        null_problem = F.lit(None).cast("string") if f.nullable else F.when(c.isNull(), f"{f.name}: null")
        fits = type_ok(c, have, f.type)
        problems = [null_problem, F.when(c.isNotNull() & ~fits, f"{f.name}: not {f.type}")]
        for k in f.constraints:
            if k.severity == "error":
                k = Constraint(k.kind, f.name, k.severity) if k.kind == "unique" else k
                try:
                    met = constraint_ok(c, have, k)
                except TypeError:
                    met = F.lit(False)
                problems.append(F.when(c.isNotNull() & fits & ~F.coalesce(met, F.lit(False)), f"{f.name}: {k.kind}"))
        bad.extend(problems)
        scores.append(F.when(F.coalesce(*problems).isNull(), 1.0).otherwise(0.0))
    unknown = [n for n in df.columns if n not in contract.names() and not n.startswith("_")]
    score = sum(scores[1:], scores[0]) / len(scores) if scores else F.lit(1.0)
    violations = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
    out = out.withColumns({"_violations": violations, "_validation_warnings": F.array(*[F.lit(f"{n}: unknown field") for n in unknown]).cast("array<string>"), "_contract_score": score.cast("double")})
    return out.withColumn("_validity", F.size("_violations") == 0).drop(*[f"__n_{n}" for n in unique])


def split_valid(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows."""
    checked = validate(df, contract)
    return checked.where("_validity"), checked.where("NOT _validity")


def batch_validation(df: DataFrame, contract: Contract) -> DataFrame:
    """One row: ``n_rows, n_valid, n_invalid, mean_score`` (null for no rows)."""
    return validate(df, contract).agg(F.count("*").alias("n_rows"), F.count_if("_validity").alias("n_valid"), F.count_if(~F.col("_validity")).alias("n_invalid"), F.avg("_contract_score").alias("mean_score"))


# ---- versions --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Evolution:
    changes: tuple[str, ...]
    change_type: str
    backward_compatible: bool
    next_version: str
    severity: str


def _tighter(kind: str, old: Any, new: Any) -> bool:
    if kind == "min":
        return new > old
    if kind == "max":
        return new < old
    if kind == "range":
        return new[0] > old[0] or new[1] < old[1]
    if kind == "enum":
        return not set(old) <= set(new)
    return True


def evolve(old: Contract, new: Contract) -> Evolution:
    """Differences of two contracts, whether old data still pass, the next semantic version and how severe it is."""
    before, after = {f.name: f for f in old.fields}, {f.name: f for f in new.fields}
    notes: list[str] = []
    kinds: set[str] = set()
    safe = True
    for n in sorted(after.keys() - before.keys()):
        kinds.add("ADDITION")
        notes.append(f"added {n} ({after[n].type})")
        safe &= after[n].nullable or after[n].default is not None
    for n in sorted(before.keys() - after.keys()):
        kinds.add("DELETION")
        notes.append(f"removed {n}")
        safe = False
    for n in sorted(before.keys() & after.keys()):
        a, b = before[n], after[n]
        told = len(notes)
        if a.type != b.type:
            notes.append(f"{n}: type {a.type} -> {b.type}")
            safe = False
        if a.nullable != b.nullable:
            notes.append(f"{n}: {'nullable' if b.nullable else 'not nullable'}")
            safe &= b.nullable
        x, y = {c.kind: c for c in a.constraints}, {c.kind: c for c in b.constraints}
        for k in sorted(x.keys() | y.keys()):
            if k not in x:
                notes.append(f"{n}: constraint {k} added")
                safe = False
            elif k not in y:
                notes.append(f"{n}: constraint {k} removed")
            elif x[k].value != y[k].value:
                notes.append(f"{n}: constraint {k} {x[k].value} -> {y[k].value}")
                safe &= not _tighter(k, x[k].value, y[k].value)
        if len(notes) > told:
            kinds.add("MODIFICATION")
    kind = next((k for k in ("DELETION", "MODIFICATION", "ADDITION") if k in kinds), "NO_CHANGE")
    if m := re.fullmatch(r"(\d+)\.(\d+)\.(\d+)", old.version):
        major, minor, patch = map(int, m.groups())
        following = old.version if kind == "NO_CHANGE" else f"{major + 1}.0.0" if not safe else f"{major}.{minor + 1}.0" if kind == "ADDITION" else f"{major}.{minor}.{patch + 1}"
    else:
        following = f"{old.version}.1"
    severity = "ERROR" if not safe else "WARNING" if kind == "MODIFICATION" else "INFO"
    return Evolution(tuple(notes), kind, safe, following, severity)


# ---- look-up ---------------------------------------------------------------------------------------------


class ContractResolver:
    """Look-up in order: in the message, by (source, version), by (schema id, version), in the stores, else None.

    ``missing`` says what happens to rows without a contract: ``strict`` and ``quarantine_only`` put them aside,
    ``warn`` lets them pass.
    """

    def __init__(self, stores: tuple[Callable[[str, str], str | None], ...] = (), missing: str = "warn"):
        if missing not in ("strict", "warn", "quarantine_only"):
            raise ValueError(f"unknown mode {missing!r}")
        self.stores, self.missing = stores, missing
        self.by_source: dict[tuple[str, str], Contract] = {}
        self.by_schema: dict[tuple[str, str], Contract] = {}

    def register(self, source: str, contract: Contract) -> None:
        self.by_source[source, contract.version] = contract
        self.by_schema[contract.schema_id, contract.version] = contract

    def resolve(self, source: str, version: str, inline: str | None = None, schema_id: str | None = None) -> Contract | None:
        if inline:
            return Contract.from_json(inline)
        found = self.by_source.get((source, version)) or self.by_schema.get((schema_id or source, version))
        for store in self.stores:
            if found:
                break
            text = store(source, version)
            found = Contract.from_json(text) if text else None
        return found


def table_store(contracts: DataFrame) -> Callable[[str, str], str | None]:
    """A store over a table of contracts (latest registration wins)."""

    def get(source: str, version: str) -> str | None:
        row = contracts.where((F.col("source_id") == source) & (F.col("schema_version") == version)).orderBy(F.desc_nulls_last("updated_at"), F.desc("contract_json")).select("contract_json").first()
        return row[0] if row else None

    return get
