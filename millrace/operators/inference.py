"""Type inference of text columns and statistical contracts, one aggregation for all columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.contracts import Constraint, Contract, Field

# Patterns of the types, and the share a strategy asks for.
PATTERNS = {
    "boolean": r"^(?i:true|false|yes|no|1|0|t|f|y|n)$",
    "integer": r"^-?\d+$",
    "float": r"^-?\d+\.\d+$",
    "datetime": r"^(?:\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2})",
    "date": r"^(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})$",
}
STRATEGIES = {"strict": 0.99, "conservative": 0.95, "lenient": 0.90}


def _looks(v: Column, kind: str) -> Column:
    if kind == "integer":
        return v.rlike(PATTERNS["integer"]) & ~v.rlike(r"^0\d+$")
    return v.rlike(PATTERNS[kind])


def _shares(name: str) -> list[Column]:
    v = F.trim(F.col(f"`{name}`"))
    some = v.isNotNull() & (v != "")
    n = F.count_if(some)

    def share(test: Column) -> Column:
        return F.count_if(some & test) / F.greatest(n, F.lit(1))

    number = v.try_cast("decimal(38,0)")
    parts = F.transform(F.split(v, ","), lambda x: F.trim(x))
    whole = F.sum(F.when(some, F.size(F.filter(parts, lambda x: _looks(x, "integer")))))
    real = F.sum(F.when(some, F.size(F.filter(parts, lambda x: x.rlike(PATTERNS["float"]))) + 0.5 * F.size(F.filter(parts, lambda x: x.rlike(PATTERNS["integer"])))))
    every = F.greatest(F.sum(F.when(some, F.size(parts))), F.lit(1))
    return [
        F.count("*").alias(f"{name}__total"), n.alias(f"{name}__filled"),
        share(_looks(v, "boolean")).alias(f"{name}__boolean"), share(_looks(v, "integer")).alias(f"{name}__integer"),
        ((F.count_if(some & _looks(v, "float")) + 0.5 * F.count_if(some & v.rlike(PATTERNS["integer"]))) / F.greatest(n, F.lit(1))).alias(f"{name}__float"),
        share(_looks(v, "datetime")).alias(f"{name}__datetime"), share(_looks(v, "date")).alias(f"{name}__date"), share(v.contains(",")).alias(f"{name}__comma"),
        (whole / every).alias(f"{name}__whole"), (real / every).alias(f"{name}__real"),
        F.min(F.when(_looks(v, "integer"), number)).alias(f"{name}__min"), F.max(F.when(_looks(v, "integer"), number)).alias(f"{name}__max"),
    ]


def integer_width(name: str, low: int, high: int) -> str:
    """Smallest integer type: unsigned for id columns without negatives, else signed."""
    lower = name.lower()
    if ("_id" in lower or lower.endswith("id")) and low >= 0:
        return next((f"UInt{b}" for b in (8, 16, 32) if high < 2**b), "UInt64")
    return next((f"Int{b}" for b in (8, 16, 32) if -(2 ** (b - 1)) <= low and high < 2 ** (b - 1)), "Int64")


def infer_types(df: DataFrame, strategy: str = "conservative") -> dict[str, tuple[str, float]]:
    """(type, confidence) of each text column over all its rows: one pass, one row to the driver.

    The first of boolean, integer, float, datetime, date and array whose share of the filled values is above 0.95 and,
    times the share of filled values, meets the strategy; else String.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return {}
    row = df.agg(*[a for n in names for a in _shares(n)]).first()
    out: dict[str, tuple[str, float]] = {}
    need = STRATEGIES[strategy]
    for n in names:
        total, some = row[f"{n}__total"], row[f"{n}__filled"]
        out[n] = ("String", 1.0 if some else 0.0)
        if not some:
            continue
        present = some / total
        candidates = [("boolean", "Bool"), ("integer", None), ("float", "Float64"), ("datetime", "DateTime64(3)"), ("date", "Date")]
        for kind, label in candidates:
            share = float(row[f"{n}__{kind}"])
            if share > 0.95 and share * present >= need:
                out[n] = (label or integer_width(n, int(row[f"{n}__min"]), int(row[f"{n}__max"])), share * present)
                break
        else:
            if row[f"{n}__comma"] >= 0.8:
                whole, real = float(row[f"{n}__whole"]), float(row[f"{n}__real"])
                kind, share = ("Array(Int64)", whole) if whole > 0.95 else ("Array(Float64)", real) if real > 0.95 else ("Array(String)", 0.9)
                if share * present >= need:
                    out[n] = (kind, share * present)
    return out


SPARK_OF = {"Bool": "boolean", "Float64": "double", "DateTime64(3)": "timestamp", "Date": "date", "Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint", "UInt8": "smallint", "UInt16": "int", "UInt32": "bigint", "UInt64": "decimal(20,0)", "String": "string"}


def _element(kind: str):
    return lambda x: F.trim(x).try_cast(kind)


def typed(df: DataFrame, types: dict[str, tuple[str, float]]) -> DataFrame:
    """Cast text columns to their inferred types; a value that does not fit becomes null."""
    cols = []
    for f in df.schema.fields:
        kind = types.get(f.name, (None,))[0]
        c = F.col(f"`{f.name}`")
        if kind is None or kind == "String":
            cols.append(c)
        elif kind.startswith("Array("):
            element = {"Int64": "bigint", "Float64": "double", "String": "string"}[kind[6:-1]]
            cols.append(F.transform(F.split(c, ","), _element(element)).alias(f.name))
        else:
            cols.append(F.trim(c).try_cast(SPARK_OF[kind]).alias(f.name))
    return df.select(*cols)


def infer_contract(df: DataFrame, schema_id: str, version: str = "1.0.0", max_enum: int = 10) -> Contract:
    """A contract from typed columns: nullability, bounds of numbers and lengths, and short lists of values."""
    kinds = {T.StringType: "string", T.BooleanType: "boolean", T.DateType: "date", T.TimestampType: "timestamp", T.ArrayType: "array", T.StructType: "object", T.MapType: "object"}
    names = [f.name for f in df.schema.fields if not f.name.startswith("_")]
    if not names:
        return Contract(schema_id, version, ())
    aggs = []
    for n in names:
        c, t = F.col(f"`{n}`"), df.schema[n].dataType
        size = F.length(c) if isinstance(t, T.StringType) else c if isinstance(t, T.NumericType) else F.lit(None).cast("int")
        distinct = F.approx_count_distinct(c) if isinstance(t, (T.StringType, T.IntegralType)) else F.lit(None).cast("bigint")
        day = F.avg(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), 1.0).otherwise(0.0)) if isinstance(t, T.StringType) else F.lit(0.0)
        clock = F.avg(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:"), 1.0).otherwise(0.0)) if isinstance(t, T.StringType) else F.lit(0.0)
        aggs += [F.count_if(c.isNull()).alias(f"{n}__null"), F.min(size).alias(f"{n}__min"), F.max(size).alias(f"{n}__max"), distinct.alias(f"{n}__distinct"), day.alias(f"{n}__day"), clock.alias(f"{n}__clock")]
    row = df.agg(*aggs).first()
    fields = []
    for n in names:
        t = df.schema[n].dataType
        kind = "integer" if isinstance(t, T.IntegralType) else "float" if isinstance(t, T.NumericType) else kinds.get(type(t), "string")
        if kind == "string" and (row[f"{n}__clock"] or 0) > 0.8:
            kind = "timestamp"
        elif kind == "string" and (row[f"{n}__day"] or 0) > 0.8:
            kind = "date"
        rules = []
        low, high = row[f"{n}__min"], row[f"{n}__max"]
        if kind in ("integer", "float", "string") and low is not None:
            if low > 0:
                rules.append(Constraint("min", low))
            if high < (1000 if kind == "string" else 1_000_000):
                rules.append(Constraint("max", high))
        if kind in ("string", "integer") and row[f"{n}__distinct"] and row[f"{n}__distinct"] <= max_enum:
            values = df.select(n).where(F.col(n).isNotNull()).distinct().limit(2 * max_enum + 1).collect()
            if len(values) <= max_enum:
                rules.append(Constraint("enum", sorted(v[0] for v in values)))
        fields.append(Field(n, kind, row[f"{n}__null"] > 0, tuple(rules)))
    return Contract(schema_id, version, tuple(fields))


def confidence(sample: float, one_type: float, complete: float) -> float:
    """0.3 of the sample's size, 0.4 of type agreement, 0.3 of completeness."""
    return 0.3 * sample + 0.4 * one_type + 0.3 * complete


def share_of_type(df: DataFrame, name: str) -> DataFrame:
    """Values of a text column by what they look like."""
    v = F.trim(F.col(name))
    kind = reduce(lambda acc, k: acc.when(_looks(v, k), k), ["integer", "float", "datetime", "date"], F.when(v.isNull() | (v == ""), "empty").when(_looks(v, "boolean"), "boolean")).otherwise("string")
    return df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def loader_type(name: str, value: object) -> str:
    """Type of a loaded column from its name (times end in ``_at``) and one value of it."""
    import datetime as dt
    import re

    if name.endswith("_at") or isinstance(value, dt.datetime):
        return "timestamp"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint"
    if isinstance(value, float):
        return "double"
    if isinstance(value, dt.date):
        return "date"
    if isinstance(value, str) and re.match(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}", value):
        return "timestamp"
    return "string"
