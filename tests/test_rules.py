import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import rules as R


def one(spark, row, *actions, condition=R.always, schema=None):
    df = spark.createDataFrame([row], schema) if schema else spark.createDataFrame([row])
    out = R.apply_rules(df, [R.Rule("r", R.RuleType.CLEAN, 1, condition, list(actions))])
    return out.first().asDict()


def test_actions(spark):
    row = {"name": "  John  ", "age": "42", "note": "New\tYork  x", "phone": "(555) 123-4567", "mail": "john@example.com", "yes": "Yes", "no": "no", "born": "1990-01-15", "price": "19.99", "bad": "not-a-number"}
    got = one(spark, row, R.trim_strings(), R.cast_to_int("age"), R.normalize_whitespace_field("note"), R.regex_replace("phone", "[^0-9]", ""), R.regex_extract("mail", "([^@]+)@", 1), R.cast_to_bool("yes"), R.cast_to_bool("no"), R.cast_to_date("born"), R.cast_to_float("price"), R.cast_to_int("bad", "null"))
    assert got["name"] == "John" and got["age"] == 42 and got["note"] == "New York x" and got["phone"] == "5551234567"
    assert got["mail"] == "john" and got["yes"] is True and got["no"] is False and str(got["born"]) == "1990-01-15" and got["price"] == 19.99 and got["bad"] is None
    assert got["_applied_rules"] == ["r"] and got["_rule_score"] == 1.0


def test_unicode_strip_and_case(spark):
    got = one(spark, {"a": "  x y\n", "b": "john", "c": "JOHN"}, R.trim_field("a"), R.uppercase_field("b"), R.lowercase_field("c"))
    assert (got["a"], got["b"], got["c"]) == ("x y", "JOHN", "john")


def test_regex_groups_and_no_match(spark):
    got = one(spark, {"a": "ab12", "b": "none", "c": "cost $5"}, R.regex_replace("a", r"([a-z]+)(\d+)", r"\2-\1"), R.regex_extract("b", r"(\d+)", 1, "null"), R.regex_replace("c", "cost", "$"))
    assert got["a"] == "12-ab" and got["b"] is None and got["c"] == "$ $5"


def test_cast_errors_leave_row_and_are_kept(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,), ("3.7",)], "a string")
    done = R.apply_rules(df, [R.Rule("c", R.RuleType.TRANSFORM, 1, R.always, R.cast_to_int("a"))]).collect()
    assert [r["a"] for r in done] == [1, None, None, None]
    assert [len(r["_errors"]) for r in done] == [0, 1, 0, 1]
    assert [r["_applied_rules"] for r in done] == [["c"], [], ["c"], []]
    assert done[1]["_rule_score"] == pytest.approx(0.95)


def test_skip_keeps_text(spark):
    df = spark.createDataFrame([("1",), ("x",)], "a string")
    done = R.apply_rules(df, [R.Rule("c", R.RuleType.TRANSFORM, 1, R.always, R.cast_to_int("a", "skip"))]).collect()
    assert [r["a"] for r in done] == ["1", "x"]


def test_rename_copy_remove_default_replace(spark):
    got = one(spark, {"a": "x", "b": "y", "c": None}, R.copy_field("a", "d"), R.rename_field("a", "e"), R.remove_field("b"), R.default_value("c", "z"), R.default_value("new", 5), R.replace_value("d", "x", "q"), schema="a string, b string, c string")
    assert "a" not in got and "b" not in got and got["e"] == "x" and got["c"] == "z" and got["new"] == 5 and got["d"] == "q"


def test_conditional_rename_keeps_other_rows(spark):
    df = spark.createDataFrame([("x",), ("y",)], "a string")
    done = R.apply_rules(df, [R.Rule("n", R.RuleType.CLEAN, 1, R.field_value_equals("a", "x"), R.rename_field("a", "b"))]).collect()
    assert [(r["a"], r["b"]) for r in done] == [(None, "x"), ("y", None)]


def test_remove_null_fields_in_map_mode(spark):
    df = spark.createDataFrame([({"a": "1", "b": None},)], "data map<string,string>")
    assert R.apply_rules(df, [R.Rule("n", R.RuleType.CLEAN, 1, R.always, R.remove_null_fields())]).first()["data"] == {"a": "1"}


CONDITIONS = [
    (R.field_exists("s"), True), (R.field_not_exists("s"), False), (R.field_exists("zz"), False), (R.field_is_null("n"), True), (R.field_is_null("s"), False), (R.field_is_not_null("s"), True),
    (R.field_type("i", "integer"), True), (R.field_type("i", "string"), False), (R.field_type("b", "integer"), True), (R.field_type("n", "string"), False),
    (R.field_value_equals("s", "abc"), True), (R.field_value_equals("i", 5), True), (R.field_value_equals("s", 5), False), (R.field_value_equals("n", None), True),
    (R.field_value_in("i", [1, 5]), True), (R.field_value_in("i", []), False), (R.field_value_matches("s", "ab"), True), (R.field_value_matches("s", "bc"), False), (R.field_value_matches("s", "("), False), (R.field_value_matches("i", "5"), False),
    (R.field_value_contains("s", "bc"), True), (R.field_value_contains("n", "x"), False), (R.field_value_range("i", 5, 5), True), (R.field_value_range("i", 6), False), (R.field_value_range("s", 0), False), (R.field_value_range("f", 0), False),
    (R.all_fields_exist(["s", "i"]), True), (R.any_field_exists(["zz", "i"]), True), (R.any_field_exists([]), False),
    (R.all_of(R.always, R.never), False), (R.any_of(R.always, R.never), True), (R.negate(R.never), True), (R.custom(lambda df: F.col("n") == "x"), False),
]


def test_conditions(spark):
    df = spark.createDataFrame([("abc", 5, True, None, float("nan"))], "s string, i int, b boolean, n string, f double")
    got = df.select(*[c(df).alias(f"c{i}") for i, (c, _) in enumerate(CONDITIONS)]).first()
    assert list(got) == [want for _, want in CONDITIONS]


def test_engine_order_priority_and_current_row(spark):
    df = spark.createDataFrame([(" 42 ",)], "a string")
    made = [R.Rule("late", R.RuleType.ENRICH, 5, R.field_value_range("a", 40), R.default_value("old", True)), R.Rule("trim", R.RuleType.CLEAN, 1, R.always, R.trim_strings()), R.Rule("cast", R.RuleType.TRANSFORM, 2, R.field_type("a", "string"), R.cast_to_int("a"))]
    row = R.apply_rules(df, made).first()
    assert row["_applied_rules"] == ["trim", "cast", "late"] and row["old"] is True and row["a"] == 42


def test_no_rules_and_empty_frame(spark):
    df = spark.createDataFrame([], T.StructType([T.StructField("a", T.StringType())]))
    out = R.apply_rules(df, [R.Rule("c", R.RuleType.CLEAN, 1, R.always, R.trim_strings())])
    assert out.count() == 0
    row = R.apply_rules(spark.createDataFrame([("x",)], "a string"), []).first()
    assert row["a"] == "x" and row["_rule_score"] == 1.0 and row["_applied_rules"] == []


def test_yaml():
    text = """
transformation_rules:
  - {rule_id: a, rule_type: CLEAN, priority: 1, description: d, condition: {type: and, conditions: [{type: always}, {type: not, condition: {type: field_is_null, field_name: x}}]}, action: {type: compose, actions: [{type: trim_strings}, {type: uppercase_field, field_name: x}]}}
"""
    made = R.load_rules(text)
    assert made[0].rule_id == "a" and made[0].metadata == {"description": "d"} and len(made[0].action) == 2
    for bad in ("transformation_rules: 5", "transformation_rules: [{rule_id: a}]", "transformation_rules: [{rule_id: a, rule_type: X, priority: 1, condition: {type: always}, action: {type: trim_strings}}]", "transformation_rules: [{rule_id: a, rule_type: CLEAN, priority: -1, condition: {type: always}, action: {type: trim_strings}}]", "transformation_rules: [{rule_id: a, rule_type: CLEAN, priority: 1, condition: {type: nope}, action: {type: trim_strings}}]", "transformation_rules: [{rule_id: a, rule_type: CLEAN, priority: 1, condition: {type: always}, action: {type: trim_field}}]", "{: :"):
        with pytest.raises(R.RuleError):
            R.load_rules(bad)


def test_every_yaml_kind_builds():
    args = {"field_name": "a", "field_names": ["a"], "expected_type": "string", "value": 1, "values": [1], "pattern": "x", "substring": "x", "conditions": [{"type": "always"}], "condition": {"type": "always"}, "replacement": "y", "old_name": "a", "new_name": "b", "source_name": "a", "dest_name": "b", "old_value": 1, "new_value": 2, "default_value": 0, "actions": [{"type": "trim_strings"}]}
    assert len(R._CONDITIONS) == 16 and len(R._ACTIONS) == 21
    for k in R._CONDITIONS:
        assert R.condition_of({"type": k, **args})
    for k in R._ACTIONS:
        assert R.action_of({"type": k, **args})


def test_rule_lists_and_history():
    a, b = (R.Rule(i, t, 1, R.always, R.trim_strings()) for i, t in (("a", R.RuleType.CLEAN), ("b", R.RuleType.ENRICH)))
    assert R.validate_rules([a, b]) == [] and R.validate_rules([a, a]) == ["duplicate rule id a"]
    assert R.filter_rules([a, b], R.RuleType.ENRICH) == [b] and R.get_rule([a, b], "a") is a and R.get_rule([a], "z") is None
    h = R.RuleHistory()
    h.create("1.0.0", [{"rule_id": "a", "priority": 1}])
    h.create("1.1.0", [{"rule_id": "a", "priority": 2}, {"rule_id": "b"}])
    h.activate("1.0.0")
    h.activate("1.1.0")
    assert h.active().version == "1.1.0" and h.versions["1.0.0"].status == "inactive" and h.latest().version == "1.1.0"
    assert h.compare("1.0.0", "1.1.0") == {"added": ["b"], "removed": [], "modified": ["a"]} and h.verify("1.0.0")
    h.versions["1.0.0"].definition.append({"rule_id": "x"})
    assert not h.verify("1.0.0")
    with pytest.raises(R.RuleError):
        h.create("1.0.0", [])
