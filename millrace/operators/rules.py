"""Transformation rules: conditions, actions, the engine that folds them over a frame, the YAML form and versions.

A rule row is a frame whose columns are the fields; a field is absent when the frame has no such column. In map mode
(one column ``data map<string,string>``) a field is absent when its key is. Conditions are columns that are never
null; actions change columns and give an error text where ``on_error`` asks for one. The engine applies a rule only
to rows that meet its condition and whose action gave no error, so later rules see the unchanged row otherwise.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X

RESERVED = ("_applied_rules", "_errors", "_warnings", "_rule_score")


class RuleType(Enum):
    CLEAN = "CLEAN"
    VALIDATE = "VALIDATE"
    TRANSFORM = "TRANSFORM"
    ENRICH = "ENRICH"


class RuleError(ValueError):
    """A rule that cannot be built."""


def _safe(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns and name not in RESERVED


# ---- conditions: DataFrame -> Column ------------------------------------------------------------------

Condition = Callable[[DataFrame], Column]


def always(df: DataFrame) -> Column:
    return F.lit(True)


def never(df: DataFrame) -> Column:
    return F.lit(False)


def _on(name: str, test: Callable[[Column, T.DataType], Column]) -> Condition:
    return lambda df: _safe(test(F.col(f"`{name}`"), df.schema[name].dataType)) if _has(df, name) else F.lit(False)


def field_exists(name: str) -> Condition:
    return lambda df: F.lit(_has(df, name))


def field_not_exists(name: str) -> Condition:
    return lambda df: F.lit(not _has(df, name))


def field_is_null(name: str) -> Condition:
    return _on(name, lambda c, t: c.isNull())


def field_is_not_null(name: str) -> Condition:
    return _on(name, lambda c, t: c.isNotNull())


_KINDS = {
    "string": (T.StringType,), "str": (T.StringType,), "integer": (T.IntegralType, T.BooleanType), "int": (T.IntegralType, T.BooleanType),
    "float": (T.FractionalType,), "boolean": (T.BooleanType,), "bool": (T.BooleanType,), "date": (T.DateType,), "timestamp": (T.TimestampType, T.TimestampNTZType),
    "list": (T.ArrayType,), "array": (T.ArrayType,), "dict": (T.MapType, T.StructType), "object": (T.MapType, T.StructType),
}


def field_type(name: str, expected: str) -> Condition:
    """The field has a value of the type; a boolean passes as integer."""
    kinds = _KINDS.get(str(expected).lower())
    if kinds is None:
        raise RuleError(f"unknown type {expected!r}")
    return _on(name, lambda c, t: c.isNotNull() if isinstance(t, kinds) else F.lit(False))


def field_value_equals(name: str, value: Any) -> Condition:
    return _on(name, lambda c, t: c.isNull() if value is None else _typed(c, t) == F.lit(value) if _comparable(t, value) else F.lit(False))


def _comparable(t: T.DataType, value: Any) -> bool:
    if isinstance(value, bool):
        return isinstance(t, (T.BooleanType, T.NumericType))
    if isinstance(value, (int, float)):
        return isinstance(t, (T.NumericType, T.BooleanType))
    if isinstance(value, str):
        return isinstance(t, T.StringType)
    return True


def _typed(c: Column, t: T.DataType) -> Column:
    return c.cast("int") if isinstance(t, T.BooleanType) else c


def field_value_in(name: str, values: list) -> Condition:
    return lambda df: reduce(lambda a, b: a | b, [field_value_equals(name, v)(df) for v in values], F.lit(False))


def field_value_matches(name: str, pattern: str) -> Condition:
    """The text begins with a match of the pattern; a bad pattern or another type never matches."""
    import re

    try:
        re.compile(pattern)
    except re.error:
        return never
    return _on(name, lambda c, t: c.rlike(f"^(?:{pattern})") if isinstance(t, T.StringType) else F.lit(False))


def field_value_contains(name: str, part: str) -> Condition:
    return _on(name, lambda c, t: c.contains(part) if isinstance(t, T.StringType) else F.lit(False))


def field_value_range(name: str, least: float | None = None, most: float | None = None) -> Condition:
    """Between both ends, inclusive; an end may be open. Texts are in no range of numbers."""

    def test(c: Column, t: T.DataType) -> Column:
        if not isinstance(t, (T.NumericType, T.BooleanType)):
            return F.lit(False)
        v = _typed(c, t)
        inside = c.isNotNull()
        if isinstance(t, (T.FloatType, T.DoubleType)):
            inside = inside & ~F.isnan(v)
        if least is not None:
            inside = inside & (v >= least)
        if most is not None:
            inside = inside & (v <= most)
        return inside

    return _on(name, test)


def all_fields_exist(names: list[str]) -> Condition:
    return lambda df: F.lit(all(_has(df, n) for n in names))


def any_field_exists(names: list[str]) -> Condition:
    return lambda df: F.lit(any(_has(df, n) for n in names))


def all_of(*conditions: Condition) -> Condition:
    return lambda df: reduce(lambda a, b: a & b, [c(df) for c in conditions], F.lit(True))


def any_of(*conditions: Condition) -> Condition:
    return lambda df: reduce(lambda a, b: a | b, [c(df) for c in conditions], F.lit(False))


def negate(condition: Condition) -> Condition:
    return lambda df: ~condition(df)


def custom(make: Callable[[DataFrame], Column]) -> Condition:
    """A condition of the user's; null counts as false."""
    return lambda df: _safe(make(df))


# ---- actions -------------------------------------------------------------------------------------------


@dataclass
class Change:
    """What an action does to a frame: new values, dropped and renamed fields, and an error text (null: none)."""

    values: dict[str, Column] = field(default_factory=dict)
    drops: list[str] = field(default_factory=list)
    error: Column | None = None


Action = Callable[[DataFrame], Change]


def field_condition(name: str, exists: bool = True) -> Condition:
    """Builder: the column is there, or is not."""
    return field_exists(name) if exists else field_not_exists(name)


def type_condition(name: str, expected: str) -> Condition:
    """Builder: the column is there and its value has the type."""
    return all_of(field_exists(name), field_type(name, expected))


def regex_condition(name: str, pattern: str) -> Condition:
    """Builder: the column is there and its text begins with a match of the pattern."""
    return all_of(field_exists(name), field_value_matches(name, pattern))


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in RESERVED]


def _each(make: Callable[[Column], Column], names: list[str] | None = None) -> Action:
    def act(df: DataFrame) -> Change:
        return Change({n: make(F.col(f"`{n}`")) for n in (_strings(df) if names is None else [n for n in names if n in _strings(df)])})

    return act


def trim_strings() -> Action:
    return _each(X.strip)


def trim_field(name: str) -> Action:
    return _each(X.strip, [name])


def uppercase_strings() -> Action:
    return _each(F.upper)


def uppercase_field(name: str) -> Action:
    return _each(F.upper, [name])


def lowercase_strings() -> Action:
    return _each(F.lower)


def lowercase_field(name: str) -> Action:
    return _each(F.lower, [name])


def normalize_whitespace() -> Action:
    return _each(X.collapse)


def normalize_whitespace_field(name: str) -> Action:
    return _each(X.collapse, [name])


def _cast(name: str, make: Callable[[Column, T.DataType], Column], on_error: str, what: str) -> Action:
    """A cast; ``on_error`` raise records an error and leaves the row, skip keeps the value as text, null empties it."""
    if on_error not in ("raise", "skip", "null"):
        raise RuleError(f"on_error must be raise, skip or null, not {on_error!r}")

    def act(df: DataFrame) -> Change:
        if not _has(df, name):
            return Change()
        c = F.col(f"`{name}`")
        new = make(c, df.schema[name].dataType)
        failed = c.isNotNull() & new.isNull()
        if on_error == "skip":
            return Change({name: F.when(failed, c.cast("string")).otherwise(new.cast("string"))})
        error = F.when(failed, F.concat(F.lit(f"cannot cast {name} to {what}: "), c.cast("string"))) if on_error == "raise" else None
        return Change({name: new}, error=error)

    return act


def cast_to_int(name: str, on_error: str = "raise") -> Action:
    def make(c: Column, t: T.DataType) -> Column:
        return c.try_cast("bigint") if isinstance(t, (T.NumericType, T.BooleanType)) else X.to_int(c.cast("string"))

    return _cast(name, make, on_error, "int")


def cast_to_float(name: str, on_error: str = "raise") -> Action:
    return _cast(name, lambda c, t: c.cast("double") if isinstance(t, (T.NumericType, T.BooleanType)) else X.to_float(c.cast("string")), on_error, "float")


def cast_to_bool(name: str, on_error: str = "raise") -> Action:
    return _cast(name, lambda c, t: c.cast("boolean") if isinstance(t, (T.NumericType, T.BooleanType)) else X.to_bool(c.cast("string")), on_error, "bool")


def cast_to_date(name: str, format: str = "%Y-%m-%d", on_error: str = "raise") -> Action:
    return _cast(name, lambda c, t: c.cast("date") if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else X.to_date(c.cast("string"), format), on_error, "date")


def regex_replace(name: str, pattern: str, replacement: str, ignore_case: bool = False, multi_line: bool = False, dot_all: bool = False) -> Action:
    p = X.flagged(pattern, ignore_case, multi_line, dot_all)
    return _each(lambda c: F.regexp_replace(c, p, X.java_replacement(replacement)), [name])


def regex_extract(name: str, pattern: str, group: int = 0, on_no_match: str = "skip") -> Action:
    """Group of the first match; without one the text is kept (skip), emptied (null) or an error recorded (raise)."""
    if on_no_match not in ("raise", "skip", "null"):
        raise RuleError(f"on_no_match must be raise, skip or null, not {on_no_match!r}")

    def act(df: DataFrame) -> Change:
        if name not in _strings(df):
            return Change()
        c = F.col(f"`{name}`")
        got = X.regex_extract(c, pattern, group)
        if on_no_match == "skip":
            return Change({name: F.coalesce(got, c)})
        miss = c.isNotNull() & got.isNull()
        return Change({name: got}, error=F.when(miss, F.lit(f"no match in {name}")) if on_no_match == "raise" else None)

    return act


def remove_field(name: str) -> Action:
    return lambda df: Change(drops=[name] if _has(df, name) else [])


def remove_null_fields() -> Action:
    """In map mode drops keys without value; columns of a fixed schema stay."""
    return lambda df: Change({f.name: F.map_filter(f"`{f.name}`", lambda k, v: v.isNotNull()) for f in df.schema.fields if isinstance(f.dataType, T.MapType)})


def rename_field(old: str, new: str) -> Action:
    return lambda df: Change({new: F.col(f"`{old}`")}, drops=[old]) if _has(df, old) and old != new else Change()


def copy_field(source: str, target: str) -> Action:
    return lambda df: Change({target: F.col(f"`{source}`")}) if _has(df, source) else Change()


def replace_value(name: str, old: Any, new: Any) -> Action:
    def act(df: DataFrame) -> Change:
        if not _has(df, name):
            return Change()
        c, t = F.col(f"`{name}`"), df.schema[name].dataType
        return Change({name: F.when(field_value_equals(name, old)(df), F.lit(new).cast(t)).otherwise(c)})

    return act


def default_value(name: str, value: Any) -> Action:
    def act(df: DataFrame) -> Change:
        if not _has(df, name):
            return Change({name: F.lit(value)})
        return Change({name: F.coalesce(F.col(f"`{name}`"), F.lit(value).cast(df.schema[name].dataType))})

    return act


def compose(*actions: Action) -> list[Action]:
    """Actions from left to right as one rule's action."""
    return list(actions)


# ---- rules and engine ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    rule_id: str
    rule_type: RuleType
    priority: int
    condition: Condition
    action: Any
    metadata: dict = field(default_factory=dict)


def validate_rules(rules: list[Rule]) -> list[str]:
    """What is wrong with a list of rules: repeated ids, bad priorities."""
    seen: set[str] = set()
    problems = []
    for r in rules:
        if not r.rule_id:
            problems.append("a rule has no id")
        if r.rule_id in seen:
            problems.append(f"duplicate rule id {r.rule_id}")
        seen.add(r.rule_id)
        if r.priority < 0:
            problems.append(f"negative priority of {r.rule_id}")
    return problems


def filter_rules(rules: list[Rule], kind: RuleType) -> list[Rule]:
    return [r for r in rules if r.rule_type == kind]


def get_rule(rules: list[Rule], rule_id: str) -> Rule | None:
    return next((r for r in rules if r.rule_id == rule_id), None)


def rule_score(errors: Column, warnings: Column) -> Column:
    """1 less up to a half for ten errors and up to a fifth for ten warnings, not below 0."""
    return F.greatest(F.lit(0.0), 1.0 - 0.5 * F.least(errors / 10.0, F.lit(1.0)) - 0.2 * F.least(warnings / 10.0, F.lit(1.0)))


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Fold the rules by priority (stable) over the frame; adds ``_applied_rules, _errors, _warnings, _rule_score``.

    A field that a rule drops or renames for some rows only is null in the others' new column. Casts that may keep
    a text turn the column into text, as a column has one type.
    """
    text = F.array().cast("array<string>")
    out = df.withColumns({"_applied_rules": text, "_errors": text, "_warnings": text})
    for rule in sorted(rules, key=lambda r: r.priority):
        for k, action in enumerate(rule.action if isinstance(rule.action, list) else [rule.action]):
            hold = F.col("__meets") if k else None
            if not k:
                out = out.withColumn("__meets", rule.condition(out))
                hold = F.col("__meets")
            change = action(out)
            ok = hold & change.error.isNull() if change.error is not None else hold
            new = {}
            for name, value in change.values.items():
                if name in out.columns and name not in change.drops:
                    new[name] = _merge(ok, value, name, out, action)
                else:
                    new[name] = F.when(ok, value)
            new["__ok"] = ok
            if change.error is not None:
                new["_errors"] = F.when(hold & change.error.isNotNull(), F.array_append("_errors", F.concat(F.lit(f"{rule.rule_id}: "), change.error))).otherwise(F.col("_errors"))
            out = out.withColumns(new).withColumn("__meets", F.col("__ok"))
            if change.drops:
                kept = [n for n in change.drops if n in out.columns]
                certain = rule.condition in (always,)
                out = out.drop(*kept) if certain else out.withColumns({n: F.when(~F.col("__ok"), F.col(f"`{n}`")) for n in kept})
        out = out.withColumn("_applied_rules", F.when(F.col("__meets"), F.array_append("_applied_rules", F.lit(rule.rule_id))).otherwise(F.col("_applied_rules")))
    return out.withColumn("_rule_score", rule_score(F.size("_errors"), F.size("_warnings"))).drop("__meets", "__ok")


def _merge(ok: Column, value: Column, name: str, df: DataFrame, action: Action) -> Column:
    probe = df.select(value.alias("v")).schema["v"].dataType
    old = df.schema[name].dataType
    keep = F.col(f"`{name}`")
    if probe == old:
        return F.when(ok, value).otherwise(keep)
    if isinstance(old, T.StringType) and isinstance(probe, (T.LongType, T.DoubleType, T.BooleanType, T.DateType)):
        return F.when(ok, value).otherwise(keep.try_cast(probe))
    return F.when(ok, value).otherwise(keep.try_cast(probe))


# ---- YAML -------------------------------------------------------------------------------------------------

_CONDITIONS: dict[str, Callable[[dict], Condition]] = {
    "always": lambda d: always,
    "field_exists": lambda d: field_exists(d["field_name"]),
    "field_not_exists": lambda d: field_not_exists(d["field_name"]),
    "field_is_null": lambda d: field_is_null(d["field_name"]),
    "field_is_not_null": lambda d: field_is_not_null(d["field_name"]),
    "field_type": lambda d: field_type(d["field_name"], d["expected_type"]),
    "field_value_equals": lambda d: field_value_equals(d["field_name"], d["value"]),
    "field_value_in": lambda d: field_value_in(d["field_name"], d["values"]),
    "field_value_matches": lambda d: field_value_matches(d["field_name"], d["pattern"]),
    "field_value_contains": lambda d: field_value_contains(d["field_name"], d["substring"]),
    "field_value_range": lambda d: field_value_range(d["field_name"], d.get("min_value"), d.get("max_value")),
    "all_fields_exist": lambda d: all_fields_exist(d["field_names"]),
    "any_field_exists": lambda d: any_field_exists(d["field_names"]),
    "and": lambda d: all_of(*map(condition_of, d["conditions"])),
    "or": lambda d: any_of(*map(condition_of, d["conditions"])),
    "not": lambda d: negate(condition_of(d["condition"])),
}
_ACTIONS: dict[str, Callable[[dict], Any]] = {
    "trim_strings": lambda d: trim_strings(),
    "trim_field": lambda d: trim_field(d["field_name"]),
    "uppercase_strings": lambda d: uppercase_strings(),
    "uppercase_field": lambda d: uppercase_field(d["field_name"]),
    "lowercase_strings": lambda d: lowercase_strings(),
    "lowercase_field": lambda d: lowercase_field(d["field_name"]),
    "normalize_whitespace": lambda d: normalize_whitespace(),
    "normalize_whitespace_field": lambda d: normalize_whitespace_field(d["field_name"]),
    "cast_to_int": lambda d: cast_to_int(d["field_name"], d.get("on_error", "raise")),
    "cast_to_float": lambda d: cast_to_float(d["field_name"], d.get("on_error", "raise")),
    "cast_to_bool": lambda d: cast_to_bool(d["field_name"], d.get("on_error", "raise")),
    "cast_to_date": lambda d: cast_to_date(d["field_name"], d.get("format", "%Y-%m-%d"), d.get("on_error", "raise")),
    "regex_replace": lambda d: regex_replace(d["field_name"], d["pattern"], d["replacement"], d.get("ignore_case", False)),
    "regex_extract": lambda d: regex_extract(d["field_name"], d["pattern"], d.get("group", 0), d.get("on_no_match", "skip")),
    "remove_field": lambda d: remove_field(d["field_name"]),
    "remove_null_fields": lambda d: remove_null_fields(),
    "rename_field": lambda d: rename_field(d["old_name"], d["new_name"]),
    "copy_field": lambda d: copy_field(d["source_name"], d["dest_name"]),
    "replace_value": lambda d: replace_value(d["field_name"], d["old_value"], d["new_value"]),
    "default_value": lambda d: default_value(d["field_name"], d["default_value"]),
    "compose": lambda d: compose(*map(action_of, d["actions"])),
}


def _build(registry: dict, data: Any, what: str) -> Any:
    if not isinstance(data, dict) or "type" not in data:
        raise RuleError(f"a {what} needs a type")
    if data["type"] not in registry:
        raise RuleError(f"unknown {what} {data['type']!r}")
    try:
        return registry[data["type"]](data)
    except KeyError as e:
        raise RuleError(f"{what} {data['type']!r} lacks {e.args[0]!r}") from None


def condition_of(data: Any) -> Condition:
    return _build(_CONDITIONS, data, "condition")


def action_of(data: Any) -> Any:
    return _build(_ACTIONS, data, "action")


def rule_of(data: dict) -> Rule:
    """A rule from its YAML mapping."""
    needed = ("rule_id", "rule_type", "priority", "condition", "action")
    for k in needed:
        if k not in data:
            raise RuleError(f"missing required field: {k}")
    if not isinstance(data["rule_id"], str) or not data["rule_id"]:
        raise RuleError("rule_id must be a non-empty string")
    if data["rule_type"] not in RuleType.__members__:
        raise RuleError(f"invalid rule_type {data['rule_type']!r}")
    if not isinstance(data["priority"], int) or isinstance(data["priority"], bool) or data["priority"] < 0:
        raise RuleError("priority must be a non-negative integer")
    return Rule(data["rule_id"], RuleType[data["rule_type"]], data["priority"], condition_of(data["condition"]), action_of(data["action"]), {k: v for k, v in data.items() if k not in needed})


def load_rules(text: str) -> list[Rule]:
    """Rules of a YAML document with the list ``transformation_rules``."""
    import yaml

    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise RuleError(f"not YAML: {e}") from None
    if not isinstance(doc, dict) or not isinstance(doc.get("transformation_rules"), list):
        raise RuleError("transformation_rules must be a list")
    return [rule_of(d) for d in doc["transformation_rules"]]


# ---- versions -----------------------------------------------------------------------------------------------


@dataclass
class RuleVersion:
    version: str
    definition: list[dict]
    content_hash: str
    status: str = "draft"
    notes: str = ""


class RuleHistory:
    """Versions of a rule set: create, activate, deprecate, compare, verify."""

    def __init__(self) -> None:
        self.versions: dict[str, RuleVersion] = {}
        self.log: list[tuple[str, str]] = []

    @staticmethod
    def digest(definition: list[dict]) -> str:
        return hashlib.sha256(json.dumps(definition, sort_keys=True, default=str).encode()).hexdigest()

    def create(self, version: str, definition: list[dict], notes: str = "") -> RuleVersion:
        if version in self.versions:
            raise RuleError(f"version {version} exists")
        parts = version.split(".")
        if len(parts) != 3 or not all(p.isdigit() for p in parts):
            raise RuleError(f"not a semantic version: {version!r}")
        self.versions[version] = RuleVersion(version, definition, self.digest(definition), notes=notes)
        self.log.append((version, "created"))
        return self.versions[version]

    def activate(self, version: str) -> None:
        for v in self.versions.values():
            if v.status == "active":
                v.status = "inactive"
        self.versions[version].status = "active"
        self.log.append((version, "activated"))

    def deprecate(self, version: str) -> None:
        self.versions[version].status = "deprecated"
        self.log.append((version, "deprecated"))

    def active(self) -> RuleVersion | None:
        return next((v for v in self.versions.values() if v.status == "active"), None)

    def latest(self) -> RuleVersion | None:
        return max(self.versions.values(), key=lambda v: tuple(map(int, v.version.split("."))), default=None)

    def verify(self, version: str) -> bool:
        v = self.versions[version]
        return v.content_hash == self.digest(v.definition)

    def compare(self, a: str, b: str) -> dict[str, list[str]]:
        x, y = ({r["rule_id"]: r for r in self.versions[v].definition} for v in (a, b))
        return {"added": sorted(y.keys() - x.keys()), "removed": sorted(x.keys() - y.keys()), "modified": sorted(k for k in x.keys() & y.keys() if x[k] != y[k])}
