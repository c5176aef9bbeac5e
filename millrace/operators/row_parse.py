"""Delimited records that may not parse: generated regular expressions.

One anchored expression per source accepts a whole valid row. Rows that fail go through the generated prefixes of
it, field by field; the first prefix that fails names the broken field. Everything stays inside JVM expressions, and
all loops in the patterns are possessive, which the expression engine runs without recursion or going back, so rows of
any length and number of quotes take the same way in linear time.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The contract's patterns of the fields.
USERNAME = r"[a-zA-Z0-9_]{3,20}"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"

_LEAP = r"(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
DATE = r"(?!0000)(?:[0-9]{4}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))|" + _LEAP + r"-02-29)"

#: name -> (pattern of the value or None for any text, Spark type)
FIELDS: dict[str, tuple[str | None, str]] = {
    "id": (r"0*[1-9][0-9]*", "decimal(38,0)"),
    "username": (USERNAME, "string"),
    "email": (EMAIL, "string"),
    "age": (r"(?:0*(?:[0-9]|[1-9][0-9]|1[0-4][0-9]|150))?", "int"),
    "signup_date": (DATE, "date"),
    "amount": (r"-?[0-9]+(?:\.[0-9]+)?", "decimal(38,10)"),
    "active": (r"(?:true|false)", "boolean"),
    "note": (None, "string"),
}


class RowFormat:
    """How one source writes its records, and the expressions generated from it."""

    def __init__(self, source: str, delimiter: str, header: str, fields: dict[str, tuple[str | None, str]] = FIELDS):
        self.source, self.delimiter = source, delimiter
        self.names = header.split(delimiter)
        self.fields = [fields.get(n, (None, "string")) for n in self.names]
        d = re.escape(delimiter)
        self.any_field = rf'(?:"[^"]*+(?:""[^"]*+)*+"|[^"{d}]*+)'
        self.d = d
        parts = [self.any_field if p is None else rf'(?:{p}|"{p}")' for p, _ in self.fields]
        self.whole = rf"\A{d.join(parts)}\z"
        self.prefixes = [rf"\A{d.join(parts[:k])}(?:{d}|\z)" for k in range(1, len(parts) + 1)]
        self.quoting = rf"\A{self.any_field}(?:{d}{self.any_field})*+\z"
        n = len(parts)
        self.count = rf"\A{self.any_field}(?:{d}{self.any_field}){{{n - 1}}}\z"
        self.field_at = [rf"\A(?:{self.any_field}{d}){{{k}}}({self.any_field})(?:{d}|\z)" for k in range(n)]


def _unquote(field: Column) -> Column:
    return F.when(field.startswith('"'), F.replace(field.substr(F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))).otherwise(field)


def classify(rows: DataFrame, formats: list[RowFormat]) -> DataFrame:
    """Adds ``_fields array<string>`` (null unless valid), ``_quarantine_reason`` (null if valid) and ``_validation_errors``.

    ``rows`` needs ``_source_id`` and ``_original_row``. Reasons, the first that holds: ``broken_quoting``,
    ``column_count``, ``invalid_value``; a null row has no columns (``column_count``), a source without format is
    ``unknown_source``. Extra columns pass through. A row that the whole pattern refuses goes through the field prefixes;
    a row of sound quoting and width is an invalid value because a prefix fails, and that prefix names the field.
    """
    row = F.col("_original_row")
    states = []
    for f in formats:
        n = len(f.names)
        first_bad = reduce(lambda acc, k: acc.when(~row.rlike(f.prefixes[k]), F.lit(k)), range(1, n), F.when(~row.rlike(f.prefixes[0]), F.lit(0)))
        refused = F.when(~row.rlike(f.whole), F.struct(first_bad.alias("at"), row.rlike(f.quoting).alias("quoting"), row.rlike(f.count).alias("width")))
        field = F.get(F.array(*[F.lit(x) for x in f.names]), F.col("__bad.at"))
        got = F.array(*[_unquote(F.regexp_extract(row, p, 1)) for p in f.field_at])
        states.append((f.source, refused, field, got, n))

    def per_source(pick):
        return reduce(lambda acc, s: acc.when(F.col("_source_id") == s[0], pick(s)), states[1:], F.when(F.col("_source_id") == states[0][0], pick(states[0])))

    known = F.col("_source_id").isin([s[0] for s in states])
    bad = F.col("__bad")
    reason = F.when(~F.coalesce(known, F.lit(False)), "unknown_source").when(row.isNull(), "column_count").when(~bad["quoting"], "broken_quoting").when(~bad["width"], "column_count").when(bad["at"].isNotNull(), "invalid_value")
    out = rows.withColumn("__bad", per_source(lambda s: s[1])).withColumn("_quarantine_reason", reason)
    bad_row = F.col("_quarantine_reason")
    width = per_source(lambda s: F.lit(s[4]))
    error = (
        F.when(bad_row == "broken_quoting", F.concat(F.coalesce(per_source(lambda s: s[2]), F.lit("row")), F.lit(": broken quoting")))
        .when(bad_row == "column_count", F.concat(F.lit("row: not "), F.coalesce(width.cast("string"), F.lit("?")), F.lit(" fields")))
        .when(bad_row == "invalid_value", F.concat(F.coalesce(per_source(lambda s: s[2]), F.lit("row")), F.lit(": invalid value")))
        .when(bad_row.isNotNull(), F.lit("source: no format"))
    )
    return out.withColumn("_validation_errors", F.when(error.isNull(), F.array().cast("array<string>")).otherwise(F.array(error))).withColumn("_fields", F.when(bad_row.isNull(), per_source(lambda s: s[3]))).drop("__bad")


def valid_rows(classified: DataFrame, formats: list[RowFormat], keep: list[str]) -> DataFrame:
    """Typed columns of the valid rows, next to the columns ``keep``; empty ``age`` is null, an empty note stays empty."""
    names = list(dict.fromkeys(n for f in formats for n in f.names))
    kinds = {n: k for f in formats for n, (_, k) in zip(f.names, f.fields)}
    good = classified.where("_quarantine_reason is null")

    def value(name: str) -> Column:
        picks = [(f.source, F.get("_fields", F.lit(f.names.index(name)))) for f in formats if name in f.names]
        col = reduce(lambda acc, s: acc.when(F.col("_source_id") == s[0], s[1]), picks[1:], F.when(F.col("_source_id") == picks[0][0], picks[0][1]))
        return (col if kinds[name] == "string" else col.try_cast(kinds[name])).alias(name)

    return good.select(*keep, *[value(n) for n in names])


def quarantined(classified: DataFrame, keep: list[str]) -> DataFrame:
    """The rows that cannot be read with reason, errors and the original."""
    return classified.where("_quarantine_reason is not null").select(*keep, "_quarantine_reason", "_validation_errors", "_original_row")


def formats_of(table: DataFrame) -> list[RowFormat]:
    """Formats from the small configuration table (one row per source)."""
    rows = table.select("_source_id", "delimiter", "header_line").where("_source_id is not null and delimiter is not null and header_line is not null").distinct().collect()
    return [RowFormat(r[0], r[1], r[2]) for r in sorted(rows)]
