"""Queries for the operators of the pipeline and the query layer, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import ids, times
from millrace.operators import contracts, dedup, inference, quality, rules, series
from millrace.plans import charts, gateway, pipeline, planner
from millrace.plans.ir import PERIOD, Filter, Metric, Order, QueryIR, Ratio, compile_ir
from millrace.session import scratch_path, spread, table
from millrace.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def _ir(name: str, sql: str, ir: QueryIR, rounded: tuple[str, ...] = (), business: tuple[str, ...] = ()) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = compile_ir(ir, table(spark, d, ir.table), business)
        return out.withColumns({c: F.round(c, 2) for c in rounded}) if rounded else out

    query(sql, name)(run)


# ---- query representation ---------------------------------------------------------------------------------

_ir("ir_projection", "SELECT p_brand, p_size, p_retailprice FROM part", QueryIR("part", (Metric("p_size"), Metric("p_retailprice")), ("p_brand",)))
_ir("ir_filter_cmp", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.05 AND l_linestatus <> 'F'", QueryIR("lineitem", (Metric("l_orderkey"), Metric("l_linenumber"), Metric("l_quantity")), filters=(Filter("l_quantity", ">", 45), Filter("l_discount", "<=", 0.05), Filter("l_linestatus", "!=", "F"))))
_ir("ir_filter_in", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", QueryIR("customer", (Metric("c_custkey"),), ("c_mktsegment",), (Filter("c_mktsegment", "IN", ["BUILDING", "MACHINERY"]),)))
_ir("ir_filter_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20", QueryIR("part", (Metric("p_partkey"), Metric("p_size")), filters=(Filter("p_size", "BETWEEN", [10, 20]),)))
_ir("ir_filter_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%S%'", QueryIR("part", (Metric("p_partkey"),), ("p_type",), (Filter("p_type", "LIKE", "%S%"),)))
for _a in ("SUM", "AVG", "MIN", "MAX", "COUNT"):
    _m = Metric("l_quantity", _a)
    _ir(f"ir_agg_{_a.lower()}", f"SELECT l_returnflag, l_linestatus, {'' if _a == 'COUNT' else 'round('}{_a}(l_quantity){'' if _a == 'COUNT' else ', 2)'} AS {_m.name} FROM lineitem GROUP BY 1, 2", QueryIR("lineitem", (_m,), ("l_returnflag", "l_linestatus")), () if _a == "COUNT" else (_m.name,))
_ir("ir_count_star_grouped", "SELECT o_orderpriority, count(*) AS count_rows FROM orders GROUP BY 1", QueryIR("orders", (Metric("*", "COUNT"),), ("o_orderpriority",)))
_ir("ir_mixed_group", "SELECT p_brand, p_size, count(*) AS count_rows FROM part GROUP BY 1, 2", QueryIR("part", (Metric("p_size"), Metric("*", "COUNT")), ("p_brand",)))
_ir("ir_ratio_safe_div", "SELECT l_returnflag, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 2) AS price_per_unit FROM lineitem GROUP BY 1", QueryIR("lineitem", (Metric("l_extendedprice", "SUM", "price_per_unit", Ratio(("l_extendedprice", "SUM"), ("l_quantity", "SUM"))),), ("l_returnflag",)), ("price_per_unit",))
_ir("ir_ratio_zero", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0), 2) AS per_discount FROM lineitem", QueryIR("lineitem", (Metric("l_orderkey"), Metric("l_linenumber"), Metric("l_extendedprice", None, "per_discount", Ratio(("l_extendedprice", None), ("l_discount", None))))), ("per_discount",))
_ir("ir_cast_metric", "SELECT _source_id, round(avg(try_cast(age AS DOUBLE)), 2) AS avg_age FROM bronze_customers GROUP BY 1", QueryIR("bronze_customers", (Metric("age", "AVG"),), ("_source_id",), casts={"age": "double"}), ("avg_age",))
_ir("ir_topk", "SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC NULLS LAST, 1 LIMIT 10", QueryIR("orders", (Metric("o_totalprice", "SUM", "spent"),), ("o_custkey",), order_by=(Order("spent", "DESC"),), limit=10), ("spent",))
_ir("ir_bottomk", "SELECT o_custkey, count(o_orderkey) AS n_orders FROM orders GROUP BY 1 ORDER BY 2 ASC NULLS LAST, 1 LIMIT 10", QueryIR("orders", (Metric("o_orderkey", "COUNT", "n_orders"),), ("o_custkey",), order_by=(Order("n_orders", "ASC"),), limit=10))
_ir("ir_count_to_sum", "SELECT l_returnflag, round(sum(l_quantity), 2) AS sum_l_quantity FROM lineitem GROUP BY 1", QueryIR("lineitem", (Metric("l_quantity", "COUNT"),), ("l_returnflag",)), ("sum_l_quantity",), ("l_quantity",))

# ---- time ---------------------------------------------------------------------------------------------------

_BUCKETS = {"hour": "date_trunc('hour', {0})", "day": "CAST({0} AS DATE)", "week": "CAST(CAST({0} AS DATE) - CAST(dayofweek(CAST({0} AS DATE)) AS INTEGER) AS DATE)", "month": "CAST(date_trunc('month', {0}) AS DATE)", "quarter": "CAST(date_trunc('quarter', {0}) AS DATE)", "year": "CAST(year({0}) AS INTEGER)"}
for _g, _sql in _BUCKETS.items():
    _t, _c, _v = ("events", "ts", "value") if _g in ("hour", "day") else ("orders", "o_orderdate", "o_totalprice")
    _ir(f"ts_{_g}" + ("_sunday" if _g == "week" else ""), f"SELECT {_sql.format(_c)} AS {PERIOD}, round(sum({_v}), 2) AS total FROM {_t} GROUP BY 1", QueryIR(_t, (Metric(_v, "SUM", "total"),), time_column=_c, time_granularity=_g), ("total",))
_ir("ts_preserve_grain", "SELECT o_orderdate, o_totalprice FROM orders", QueryIR("orders", (Metric("o_totalprice"),), time_column="o_orderdate", time_granularity="day", preserve_grain=True))
_ir("relationship_pair", "SELECT l_quantity, l_extendedprice FROM lineitem", QueryIR("lineitem", (Metric("l_quantity"), Metric("l_extendedprice")), mode="relationship"))
_ir("distribution", "SELECT o_totalprice FROM orders", QueryIR("orders", (Metric("o_totalprice"),), mode="distribution"))


@query("SELECT event_id, CAST(to_timestamp(CAST(floor(epoch(ts)) AS BIGINT)) AT TIME ZONE 'UTC' AS TIMESTAMP) AS parsed FROM events")
def time_parse(spark, d):
    """Times written in several ways and read again."""
    t = F.date_trunc("second", F.col("ts").cast("timestamp"))
    written = F.when(F.col("event_id") % 3 == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.unix_seconds(t).cast("string"))
    return table(spark, d, "events").select("event_id", times.parse_time(written).cast("timestamp_ntz").alias("parsed"))


# ---- questions ------------------------------------------------------------------------------------------------


def _ask(spark, d, question: str, *names: str, **extra) -> DataFrame:
    frames = {n: table(spark, d, n) for n in names}
    ir = planner.plan(question, planner.catalog(frames), extra or None)
    return compile_ir(ir, frames[ir.table])


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS sum_l_quantity FROM lineitem GROUP BY 1 ORDER BY 2 DESC LIMIT 1")
def ask_top_flag(spark, d):
    """The flagship: a question to a ranked aggregate."""
    return _ask(spark, d, "Which l_returnflag has the highest total l_quantity?", "lineitem", "orders").withColumn("sum_l_quantity", F.round("sum_l_quantity", 2))


@query("SELECT o_orderpriority, round(avg(o_totalprice), 2) AS avg_o_totalprice FROM orders GROUP BY 1")
def ask_average_per_group(spark, d):
    return _ask(spark, d, "What is the average o_totalprice per o_orderpriority?", "orders").withColumn("avg_o_totalprice", F.round("avg_o_totalprice", 2))


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY 1")
def ask_monthly(spark, d):
    return _ask(spark, d, "What is the total o_totalprice per month?", "orders").withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2))


@query("SELECT c_mktsegment, c_acctbal FROM customer WHERE c_acctbal > 5000")
def ask_filtered(spark, d):
    ir = QueryIR("customer", (Metric("c_acctbal"),), ("c_mktsegment",), tuple(planner.filters_of("show customers where c_acctbal is above 5000", planner.table_info("customer", table(spark, d, "customer").schema))[0]))
    return compile_ir(ir, table(spark, d, "customer"))


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 1")
def gateway_sql(spark, d):
    """Free SQL behind the guard."""
    for n in ("customer", "nation"):
        table(spark, d, n).createOrReplaceTempView(f"gw_{n}")
    return gateway.run(spark, "SELECT n_name, count(*) AS n FROM gw_customer JOIN gw_nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 1;", {"gw_customer", "gw_nation"})


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE CAST(label AS DOUBLE) END AS v FROM embeddings")
def gateway_finite(spark, d):
    bad = F.when(F.col("vec_id") % 3 == 0, F.lit("NaN").cast("double")).otherwise(F.col("label").cast("double"))
    return gateway.finite_columns(table(spark, d, "embeddings").select("vec_id", bad.alias("v")))


@query()
def chart_choice(spark, d):
    """Chart of several results by shape and by intent."""
    o = table(spark, d, "orders")
    rows = []
    for q in ("total o_totalprice per month", "Which o_orderpriority has the highest o_totalprice?", "How is o_totalprice distributed?", "overall total o_totalprice"):
        ir = planner.plan(q, [planner.table_info("orders", o.schema)])
        c = charts.recommend(ir, charts.shape(compile_ir(ir, o)))
        rows.append((q, c["type"], c.get("x"), c.get("y")))
    return spark.createDataFrame(rows, "question string, type string, x string, y string")


# ---- series ------------------------------------------------------------------------------------------------------


def _daily(spark, d):
    return series.history(table(spark, d, "events"), "ts", "value", "day")


_DAILY = "h AS (SELECT CAST(ts AS DATE) AS ds, sum(CAST(value AS DOUBLE)) AS value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1)"


@query(f"WITH {_DAILY} SELECT ds, round(value, 2) AS value FROM h")
def forecast_history(spark, d):
    return _daily(spark, d).withColumn("value", F.round("value", 2))


@query(f"WITH {_DAILY}, e AS (SELECT arg_min(value, ds) AS v0, arg_max(value, ds) AS v1, max(ds) AS last, count(*) AS n FROM h) SELECT CAST(last + CAST(k AS INTEGER) AS TIMESTAMP) AS ds, round(v1 + (v1 - v0) / (n - 1) * k, 2) AS value, round((v1 + (v1 - v0) / (n - 1) * k) * 0.95, 2) AS q10, round((v1 + (v1 - v0) / (n - 1) * k) * 1.05, 2) AS q90 FROM e, range(1, 8) r(k) WHERE n >= 2")
def forecast_naive(spark, d):
    out = series.naive_forecast(_daily(spark, d), 7, 86400.0)
    return out.select(F.col("ds").cast("timestamp_ntz").alias("ds"), *[F.round(c, 2).alias(c) for c in ("value", "q10", "q90")])


@query(f"WITH {_DAILY}, s AS (SELECT CAST(epoch(CAST(ds AS TIMESTAMP)) - epoch(CAST(lag(ds) OVER (ORDER BY ds) AS TIMESTAMP)) AS DOUBLE) AS step FROM h), p AS (SELECT step FROM s WHERE step > 0), m AS (SELECT median(step) AS m, count(*) AS n FROM p) SELECT max(n) AS n_steps, max(m) AS step_seconds, avg(CASE WHEN abs(step - m) <= greatest(1.0, 0.2 * m) THEN 1.0 ELSE 0.0 END) AS regular_share, avg(CASE WHEN abs(step - m) <= greatest(1.0, 0.2 * m) THEN 1.0 ELSE 0.0 END) >= 0.8 AS is_regular, CASE WHEN max(m) <= 3600 THEN 'hour' WHEN max(m) <= 86400 THEN 'day' WHEN max(m) <= 691200 THEN 'week' WHEN max(m) <= 3024000 THEN 'month' ELSE 'year' END AS granularity FROM p, m")
def series_spacing(spark, d):
    return series.spacing(_daily(spark, d))


@query("WITH g AS (SELECT event_type, CAST(ts AS DATE) AS ds, CASE WHEN day(ts) % 4 = 0 THEN NULL ELSE count(*) END AS v FROM events GROUP BY 1, 2, day(ts)) SELECT event_type, ds, CAST(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS BIGINT) AS value FROM g")
def series_fill(spark, d):
    g = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("ds")).agg(F.count("*").alias("value"))
    return series.fill(g.withColumn("value", F.when(F.dayofmonth("ds") % 4 != 0, F.col("value"))), ("event_type",))


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def series_last_wins(spark, d):
    return dedup.last_value_wins(table(spark, d, "events"), "user_id", "value", "event_id")


# ---- rules ---------------------------------------------------------------------------------------------------------


def _rule(spark, d, name: str, columns: list[str], *actions, condition=rules.always) -> DataFrame:
    df = table(spark, d, name).select(*columns)
    done = rules.apply_rules(df, [rules.Rule("r", rules.RuleType.CLEAN, 1, condition, list(actions))])
    return done.drop(*rules.RESERVED)


_WS = r"[\s]+"


@query("SELECT _row_id, regexp_replace(regexp_replace(region, '^\\s+', ''), '\\s+$', '') AS region FROM bronze_customers")
def rule_trim(spark, d):
    return _rule(spark, d, "bronze_customers", ["_row_id", "region"], rules.trim_strings())


@query("SELECT _row_id, upper(region) AS region, lower(name) AS name FROM bronze_customers")
def rule_case(spark, d):
    return _rule(spark, d, "bronze_customers", ["_row_id", "region", "name"], rules.uppercase_field("region"), rules.lowercase_field("name"))


@query("SELECT _row_id, regexp_replace(name, '\\s+', ' ', 'g') AS name FROM bronze_customers")
def rule_ws(spark, d):
    return _rule(spark, d, "bronze_customers", ["_row_id", "name"], rules.normalize_whitespace_field("name"))


_NUM = "CASE WHEN regexp_full_match(trim(age), '[+-]?[0-9]+') THEN try_cast(trim(age) AS BIGINT) END"


@query(f"SELECT _row_id, {_NUM} AS age FROM bronze_customers")
def rule_cast_int(spark, d):
    return _rule(spark, d, "bronze_customers", ["_row_id", "age"], rules.cast_to_int("age", "null"))


@query("SELECT _row_id, try_cast(trim(age) AS DOUBLE) AS age FROM bronze_customers")
def rule_cast_float(spark, d):
    return _rule(spark, d, "bronze_customers", ["_row_id", "age"], rules.cast_to_float("age", "null"))


@query("SELECT o_orderkey, CASE WHEN lower(trim(o_orderstatus)) IN ('true','yes','1','on','t','y') THEN true WHEN lower(trim(o_orderstatus)) IN ('false','no','0','off','f','n','') THEN false END AS o_orderstatus FROM orders")
def rule_cast_bool(spark, d):
    return _rule(spark, d, "orders", ["o_orderkey", "o_orderstatus"], rules.cast_to_bool("o_orderstatus", "null"))


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def rule_cast_date(spark, d):
    df = table(spark, d, "events").select("event_id", F.date_format("ts", "dd/MM/yyyy").alias("day"))
    return rules.apply_rules(df, [rules.Rule("r", rules.RuleType.TRANSFORM, 1, rules.always, rules.cast_to_date("day", "%d/%m/%Y"))]).drop(*rules.RESERVED)


@query("SELECT p_partkey, regexp_replace(p_name, '[^a-z]', '', 'g') AS p_name FROM part")
def rule_regex_replace(spark, d):
    return _rule(spark, d, "part", ["p_partkey", "p_name"], rules.regex_replace("p_name", "[^a-z]", ""))


@query("SELECT _row_id, CASE WHEN regexp_matches(email, '([^@]+)@') THEN regexp_extract(email, '([^@]+)@', 1) END AS email FROM bronze_customers")
def rule_regex_extract(spark, d):
    return _rule(spark, d, "bronze_customers", ["_row_id", "email"], rules.regex_extract("email", "([^@]+)@", 1, "null"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def rule_replace(spark, d):
    return _rule(spark, d, "orders", ["o_orderkey", "o_orderstatus"], rules.replace_value("o_orderstatus", "F", "final"))


@query("SELECT _row_id, coalesce(region, 'unknown') AS region, 'web' AS channel FROM bronze_customers")
def rule_default(spark, d):
    return _rule(spark, d, "bronze_customers", ["_row_id", "region"], rules.default_value("region", "unknown"), rules.default_value("channel", "web"))


@query("SELECT r_regionkey, r_name AS label, r_name AS copied FROM region")
def rule_rename_copy(spark, d):
    return _rule(spark, d, "region", ["r_regionkey", "r_name"], rules.copy_field("r_name", "copied"), rules.rename_field("r_name", "label"))


_YAML = """
transformation_rules:
  - {rule_id: trim, rule_type: CLEAN, priority: 1, condition: {type: always}, action: {type: trim_strings}}
  - {rule_id: age, rule_type: TRANSFORM, priority: 2, condition: {type: field_is_not_null, field_name: age}, action: {type: cast_to_int, field_name: age, on_error: raise}}
  - {rule_id: young, rule_type: ENRICH, priority: 3, condition: {type: field_value_range, field_name: age, min_value: 0, max_value: 29}, action: {type: replace_value, field_name: region, old_value: Westmoor, new_value: Young Westmoor}}
"""


@query(
    f"WITH a AS (SELECT _row_id, regexp_replace(regexp_replace(region, '^\\s+', ''), '\\s+$', '') AS region, regexp_replace(regexp_replace(age, '^\\s+', ''), '\\s+$', '') AS age FROM bronze_customers), b AS (SELECT _row_id, region, age AS t, {_NUM} AS age FROM a) "
    "SELECT _row_id, age, CASE WHEN age BETWEEN 0 AND 29 AND region = 'Westmoor' THEN 'Young Westmoor' ELSE region END AS region, 1 + CAST(age IS NOT NULL AS INTEGER) + CAST(coalesce(age BETWEEN 0 AND 29, false) AS INTEGER) AS n_applied, CAST(t IS NOT NULL AND age IS NULL AS INTEGER) AS n_errors, CAST(CASE WHEN t IS NOT NULL AND age IS NULL THEN 0.95 ELSE 1.0 END AS DOUBLE) AS score FROM b"
)
def rule_engine_chain(spark, d):
    """Rules from YAML: order by priority, conditions on the current row, errors that leave the row as it was."""
    done = rules.apply_rules(table(spark, d, "bronze_customers").select("_row_id", "age", "region"), rules.load_rules(_YAML))
    return done.select("_row_id", F.col("age").cast("bigint").alias("age"), "region", F.size("_applied_rules").alias("n_applied"), F.size("_errors").alias("n_errors"), F.col("_rule_score").cast("double").alias("score"))


_COND = {
    "equals": (rules.field_value_equals("p_size", 10), "p_size = 10"),
    "in": (rules.field_value_in("p_size", [1, 5, 9]), "p_size IN (1, 5, 9)"),
    "matches": (rules.field_value_matches("p_brand", "Brand#1"), "regexp_matches(p_brand, '^(?:Brand#1)')"),
    "contains": (rules.field_value_contains("p_name", "al"), "contains(p_name, 'al')"),
    "range": (rules.field_value_range("p_retailprice", 950, 1000), "p_retailprice BETWEEN 950 AND 1000"),
    "null": (rules.field_is_null("p_type"), "p_type IS NULL"),
    "exists": (rules.all_of(rules.all_fields_exist(["p_name", "p_size"]), rules.field_not_exists("nothing"), rules.any_field_exists(["x", "p_size"])), "true"),
    "type": (rules.field_type("p_size", "integer"), "p_size IS NOT NULL"),
    "and_or_not": (rules.any_of(rules.all_of(rules.field_value_range("p_size", 10), rules.field_value_contains("p_type", "S")), rules.negate(rules.field_value_range("p_size", None, 45))), "(p_size >= 10 AND contains(p_type, 'S')) OR NOT (p_size <= 45)"),
}
for _k, (_cond, _sql) in _COND.items():
    query(f"SELECT p_partkey FROM part WHERE coalesce({_sql}, false)", f"cond_{_k}")(lambda spark, d, c=_cond: (lambda df: df.where(c(df)).select("p_partkey"))(table(spark, d, "part")))

# ---- contracts and quality ------------------------------------------------------------------------------------------

_CUSTOMER = contracts.Contract("customer", "1.0.0", (
    contracts.Field("c_custkey", "integer", False, (contracts.Constraint("min", 1), contracts.Constraint("unique"))),
    contracts.Field("c_name", "string", False, (contracts.Constraint("min", 3), contracts.Constraint("max", 18))),
    contracts.Field("c_acctbal", "float", True, (contracts.Constraint("range", [-500, 9000]),)),
    contracts.Field("c_mktsegment", "string", True, (contracts.Constraint("enum", ["BUILDING", "MACHINERY", "AUTOMOBILE"]),)),
    contracts.Field("c_phone", "string", True),
))
_SCORE = "(CASE WHEN c_custkey >= 1 THEN 1.0 ELSE 0.0 END + CASE WHEN length(c_name) BETWEEN 3 AND 18 THEN 1.0 ELSE 0.0 END + CASE WHEN c_acctbal IS NULL OR c_acctbal BETWEEN -500 AND 9000 THEN 1.0 ELSE 0.0 END + CASE WHEN c_mktsegment IS NULL OR c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 1.0 ELSE 0.0 END + 0.5) / 5"
_BAD = "NOT (c_custkey >= 1 AND length(c_name) BETWEEN 3 AND 18 AND (c_acctbal IS NULL OR c_acctbal BETWEEN -500 AND 9000) AND (c_mktsegment IS NULL OR c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')))"


@query(f"SELECT c_custkey, round({_SCORE}, 4) AS score, NOT ({_BAD}) AS valid FROM customer")
def contract_row_score(spark, d):
    return contracts.validate(table(spark, d, "customer"), _CUSTOMER).select("c_custkey", F.round("_contract_score", 4).alias("score"), F.col("_validity").alias("valid"))


@query(f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT ({_BAD})) AS n_valid, count(*) FILTER (WHERE {_BAD}) AS n_invalid, round(avg({_SCORE}), 4) AS mean_score FROM customer")
def contract_batch(spark, d):
    return contracts.batch_validation(table(spark, d, "customer"), _CUSTOMER).withColumn("mean_score", F.round("mean_score", 4))


@query(f"SELECT c_custkey FROM customer WHERE {_BAD}")
def contract_split(spark, d):
    return contracts.split_valid(table(spark, d, "customer"), _CUSTOMER)[1].select("c_custkey")


@query("SELECT _row_id, regexp_full_match(email, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}') AS ok FROM bronze_customers")
def constraint_format(spark, d):
    df = table(spark, d, "bronze_customers")
    return df.select("_row_id", contracts.constraint_ok(F.col("email"), df.schema["email"].dataType, contracts.Constraint("format", "email")).alias("ok"))


_REQ = ["customer_id", "email", "age", "phone"]
_C = "(CAST(customer_id IS NOT NULL AS INTEGER) + CAST(coalesce(trim(email) <> '', false) AS INTEGER) + CAST(age IS NOT NULL AS INTEGER) + CAST(coalesce(trim(phone) <> '', false) AS INTEGER)) / 4.0"
_V = "greatest(0.0, 1 - 0.1 * coalesce(len(_warnings), 0))"


def _scored(spark, d):
    df = table(spark, d, "silver_customers").drop("_quality_score", "_completeness_score", "_validity_score")
    return quality.score_rows(df, _REQ, F.coalesce(F.size("_warnings"), F.lit(0)))


@query(f"SELECT _row_id, round({_C}, 4) AS c, round(CAST({_V} AS DOUBLE), 4) AS v, round(0.4 * {_C} + 0.6 * {_V}, 4) AS q FROM silver_customers")
def quality_row(spark, d):
    return _scored(spark, d).select("_row_id", F.round("_completeness_score", 4).alias("c"), F.round("_validity_score", 4).alias("v"), F.round("_quality_score", 4).alias("q"))


@query(f"WITH s AS (SELECT _batch_id, 0.4 * {_C} + 0.6 * {_V} AS q, _warnings AS w FROM silver_customers) SELECT _batch_id, count(*) AS n_rows, round(avg(q), 4) AS avg_quality, round(min(q), 4) AS min_quality, round(max(q), 4) AS max_quality, count(*) FILTER (WHERE len(w) > 0) AS n_warned, round(count(*) FILTER (WHERE len(w) > 0) / count(*), 4) AS warning_rate FROM s GROUP BY 1")
def quality_batch_summary(spark, d):
    out = quality.batch_summary(_scored(spark, d), ["_batch_id"], errors="_applied_rules")
    return out.select("_batch_id", "n_rows", *[F.round(c, 4).alias(c) for c in ("avg_quality", "min_quality", "max_quality")], "n_warned", F.round("warning_rate", 4).alias("warning_rate"))


@query("SELECT CAST(_cleaned_at AS DATE) AS day, round(avg(_quality_score), 3) AS avg__quality_score, round(avg(_validity_score), 3) AS avg__validity_score, CAST(sum(customer_id) AS BIGINT) AS total_rows FROM silver_customers GROUP BY 1")
def quality_daily_trend(spark, d):
    out = quality.daily_trend(table(spark, d, "silver_customers"), "_cleaned_at", ["_quality_score", "_validity_score"], "customer_id")
    return out.select("day", *[F.round(F.col(c), 3).alias(c) for c in ("avg__quality_score", "avg__validity_score")], "total_rows")


_DEV = "WITH r AS (SELECT DISTINCT _anomaly_id, _source_id, _metric, _detected_at, CAST(_value AS DOUBLE) AS v FROM quality_anomalies WHERE _value IS NOT NULL AND isfinite(_value)), w AS (SELECT *, count(v) OVER k AS n_seen, avg(v) OVER k AS b, stddev_pop(v) OVER k AS s FROM r WINDOW k AS (PARTITION BY _source_id, _metric ORDER BY _detected_at, _anomaly_id ROWS BETWEEN {0})) SELECT _anomaly_id, n_seen, coalesce(n_seen >= 5 AND s > 1e-9 AND abs(v - b) / s >= 3, false) AS is_anomaly FROM w"


def _deviation(spark, d, current: bool):
    rows = table(spark, d, "quality_anomalies").select("_anomaly_id", "_source_id", "_metric", "_detected_at", F.col("_value").cast("double").alias("v")).where("v is not null and not isnan(v) and abs(v) < double('infinity')").distinct()
    out = quality.deviation(rows, ["_source_id", "_metric"], ["_detected_at", "_anomaly_id"], "v", include_current=current)
    return out.select("_anomaly_id", "n_seen", "is_anomaly")


@query(_DEV.format("20 PRECEDING AND 1 PRECEDING"))
def quality_anomaly(spark, d):
    return _deviation(spark, d, False)


@query(_DEV.format("19 PRECEDING AND CURRENT ROW"))
def quality_anomaly_with_current(spark, d):
    return _deviation(spark, d, True)


@query()
def quality_batch_metrics(spark, d):
    """Completeness, validity and consistency of bronze batches."""
    df = table(spark, d, "bronze_customers")
    return quality.batch_metrics(df, ["_source_id", "_batch_id"], ["id", "name", "email", "age", "region", "city"], F.lit(1.0))


# ---- keys and lineage ------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) AS rn FROM events) WHERE rn = 1")
def dedup_first_wins(spark, d):
    return dedup.first_wins(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def dedup_anti_load(spark, d):
    have = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return dedup.anti_load(table(spark, d, "orders").select("o_orderkey", "o_custkey"), have, ["o_custkey"])


@query("SELECT extraction_id, status, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY extraction_id ORDER BY updated_at DESC NULLS LAST, correlation_id DESC NULLS LAST) AS rn FROM extraction_checkpoints) WHERE rn = 1")
def latest_per_key(spark, d):
    return dedup.latest_per_key(table(spark, d, "extraction_checkpoints").select("extraction_id", "status", "updated_at", "correlation_id"), ["extraction_id"], "updated_at", "correlation_id").select("extraction_id", "status", "updated_at")


@query("SELECT _stage, _batch_id, first(_row_id ORDER BY _processed_at NULLS LAST, _row_id) AS winner FROM deduplication_log GROUP BY 1, 2")
def claim_winner(spark, d):
    return dedup.claim_winners(table(spark, d, "deduplication_log"), ["_stage", "_batch_id"], "_row_id", "_processed_at")


@query("SELECT _batch_id, _stage, count(*) AS n FROM deduplication_log GROUP BY 1, 2")
def processing_stats(spark, d):
    return dedup.stage_stats(table(spark, d, "deduplication_log"))


@query("SELECT (SELECT count(*) FROM bronze_customers) AS n_left, (SELECT count(*) FROM silver_customers) AS n_right, abs((SELECT count(*) FROM bronze_customers) - (SELECT count(*) FROM silver_customers)) AS difference, round(100.0 * abs((SELECT count(*) FROM bronze_customers) - (SELECT count(*) FROM silver_customers)) / (SELECT count(*) FROM bronze_customers), 4) AS percent")
def recon_counts(spark, d):
    return dedup.reconcile(table(spark, d, "bronze_customers"), table(spark, d, "silver_customers")).withColumn("percent", F.round(F.col("percent").cast("double"), 4))


@query("""SELECT r_regionkey, sha256('{"r_name":"' || r_name || '","r_regionkey":"' || r_regionkey || '"}') AS hash FROM region""")
def row_hash(spark, d):
    return table(spark, d, "region").select("r_regionkey", ids.row_hash("r_regionkey", "r_name").alias("hash"))


@query("SELECT n_nationkey, 'batch_' || n_name || '_' || n_nationkey || '_' || substr(sha256(n_name || ':' || n_nationkey), 1, 8) AS batch FROM nation")
def batch_ids(spark, d):
    return table(spark, d, "nation").select("n_nationkey", ids.batch_id(F.col("n_name"), F.col("n_nationkey")).alias("batch"))


@query("WITH h AS (SELECT o_orderkey, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('src:b:' || o_orderkey || ':extract')) AS s FROM orders) SELECT o_orderkey, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(s, 17, 1))::INTEGER % 4 + 1 AS INTEGER), 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS id FROM h")
def lineage_uuid5(spark, d):
    return table(spark, d, "orders").select("o_orderkey", ids.lineage_id(F.lit("src"), F.lit("b"), F.col("o_orderkey").cast("string"), "extract").alias("id"))


@query("WITH e AS (SELECT DISTINCT 'o' || l_orderkey AS p, 'p' || l_partkey AS c FROM lineitem) SELECT c AS id, 'parent' AS relation, p AS neighbour FROM e UNION ALL SELECT p, 'child', c FROM e")
def lineage_neighbours(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("parent"), F.concat(F.lit("p"), "l_partkey").alias("child"))
    return dedup.neighbours(e.select(F.explode(F.array("parent", "child")).alias("id")), e)


# ---- inference, pipeline, sinks ---------------------------------------------------------------------------------------


@query()
def infer_types(spark, d):
    """Types of the raw text columns, over all rows."""
    found = inference.infer_types(table(spark, d, "bronze_customers").select("id", "name", "email", "age", "region", "city"))
    return spark.createDataFrame([(k, t, float(c)) for k, (t, c) in found.items()], "column_name string, type string, confidence double")


@query("SELECT CASE WHEN age IS NULL OR trim(age) = '' THEN 'empty' WHEN regexp_full_match(trim(age), '(?i)(true|false|yes|no|1|0|t|f|y|n)') THEN 'boolean' WHEN regexp_full_match(trim(age), '-?[0-9]+') AND NOT regexp_full_match(trim(age), '0[0-9]+') THEN 'integer' WHEN regexp_full_match(trim(age), '-?[0-9]+\\.[0-9]+') THEN 'float' ELSE 'string' END AS kind, count(*) AS n FROM bronze_customers GROUP BY 1")
def infer_kinds(spark, d):
    return inference.share_of_type(table(spark, d, "bronze_customers"), "age")


@query()
def infer_contract(spark, d):
    """A contract inferred from a typed table."""
    c = inference.infer_contract(table(spark, d, "part"), "part")
    return spark.createDataFrame([(f.name, f.type, f.nullable, len(f.constraints)) for f in c.fields], "name string, type string, nullable boolean, n_constraints int")


_BRONZE = contracts.Contract("bronze", "1.0.0", (
    contracts.Field("id", "integer", False, (contracts.Constraint("min", 1),)),
    contracts.Field("name", "string", True), contracts.Field("email", "string", True, (contracts.Constraint("format", "email"),)),
    contracts.Field("age", "integer", True, (contracts.Constraint("range", [0, 150]),)), contracts.Field("region", "string", True), contracts.Field("city", "string", True),
))


def _raw(spark, d):
    return pipeline.bronze(spread(table(spark, d, "bronze_customers").select("id", "name", "email", "age", "region", "city")), "crm", 0, F.lit("2025-01-01").cast("timestamp"))


def _outcome(spark, d):
    return pipeline.transform(_raw(spark, d), _BRONZE, rules.load_rules("transformation_rules: [{rule_id: low, rule_type: CLEAN, priority: 1, condition: {type: field_exists, field_name: email}, action: {type: lowercase_field, field_name: email}}]"), at=F.lit("2025-01-01").cast("timestamp"))


@query()
def bronze_rows(spark, d):
    return _raw(spark, d)


@query()
def silver_rows(spark, d):
    return _outcome(spark, d).silver


@query()
def quarantine_rows(spark, d):
    return _outcome(spark, d).quarantine


_CL = "nullif(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '')"
_INT = "coalesce(try_cast({0} AS BIGINT) IS NOT NULL AND regexp_full_match({0}, '[+-]?[0-9]+(\\.[0-9]*)?'), false)"


@query(
    f"WITH c AS (SELECT {', '.join(_CL.format(x) + ' AS ' + x for x in ('id', 'name', 'email', 'age', 'region', 'city'))} FROM bronze_customers), "
    f"k AS (SELECT *, coalesce(id, name, email, age, region, city) IS NULL AS nothing, id IS NULL OR NOT {_INT.format('id')} OR try_cast(id AS DOUBLE) < 1 OR NOT coalesce(email IS NULL OR regexp_full_match(lower(email), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}'), false) OR (age IS NOT NULL AND (NOT {_INT.format('age')} OR NOT coalesce(try_cast(age AS DOUBLE) BETWEEN 0 AND 150, false))) AS bad FROM c) "
    "SELECT CASE WHEN nothing THEN 'empty_row' WHEN bad THEN 'validation_failed' ELSE 'silver' END AS outcome, count(*) AS n FROM k GROUP BY 1"
)
def pipeline_outcomes(spark, d):
    """Where the rows of a batch go."""
    return _outcome(spark, d).checked.groupBy(F.coalesce("__reason", F.lit("silver")).alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_loaded, count(DISTINCT o_custkey) AS n_keys FROM (SELECT o_custkey FROM orders GROUP BY 1)")
def staged_load(spark, d):
    """Two overlapping loads into one table: every key once."""
    path = scratch_path(spark, "load")
    o = table(spark, d, "orders")
    writers.staged_load(o.where("o_orderkey % 3 <> 0"), path, ["o_custkey"], [F.col("o_orderkey")])
    writers.staged_load(o, path, ["o_custkey"], [F.col("o_orderkey")])
    return spark.read.parquet(path).agg(F.count("*").alias("n_loaded"), F.count_distinct("o_custkey").alias("n_keys"))


@query("SELECT _quarantine_id, _quarantined_at FROM quarantine WHERE _reprocessed = false ORDER BY _quarantined_at DESC NULLS LAST, _quarantine_id NULLS LAST LIMIT 20 OFFSET 10")
def quarantine_page(spark, d):
    """A page is the feature: 20 rows after the first 10."""
    return writers.quarantine_page(table(spark, d, "quarantine"), reprocessed=False, limit=20, offset=10).select("_quarantine_id", "_quarantined_at")


@query("SELECT _reprocessed OR coalesce(_source_id = 'crm_main', false) AS done, count(*) AS n FROM quarantine GROUP BY 1")
def quarantine_mark(spark, d):
    q = table(spark, d, "quarantine")
    return writers.mark_reprocessed(q, q.where("_source_id = 'crm_main'")).groupBy(F.col("_reprocessed").alias("done")).agg(F.count("*").alias("n"))


@query("SELECT upper(trim(status)) AS status, count(*) AS n, CAST(coalesce(sum(rows_extracted), 0) AS BIGINT) AS n_rows FROM extraction_checkpoints GROUP BY 1")
def product_counters(spark, d):
    return table(spark, d, "extraction_checkpoints").groupBy(F.upper(F.trim("status")).alias("status")).agg(F.count("*").alias("n"), F.coalesce(F.sum("rows_extracted"), F.lit(0)).alias("n_rows"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def message_explode(spark, d):
    """Rows of JSON messages, one message per event."""
    e = table(spark, d, "events")
    body = F.to_json(F.struct(F.lit("events").alias("source_id"), F.array(F.map_from_arrays(F.array(F.lit("event_id"), F.lit("k")), F.array(F.col("event_id").cast("string"), F.get_json_object("props", "$.k")))).alias("rows")))
    rows = readers.explode_messages(e.select(body.alias("value")), "value")
    return rows.select(F.col("data")["event_id"].cast("bigint").alias("event_id"), F.col("data")["k"].alias("k"))


@query("SELECT table_name, last_key FROM (SELECT 'orders' AS table_name, CAST(max(o_orderkey) AS VARCHAR) AS last_key FROM orders)")
def high_water_mark(spark, d):
    o = table(spark, d, "orders")
    first = readers.advance(None, o.where("o_orderkey % 2 = 0"), "orders", "o_orderkey")
    return readers.advance(first, o, "orders", "o_orderkey")


# ---- streams -----------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    """A file stream of the events without repeated (user, type), run to its end."""
    from millrace.streaming import jobs

    out = scratch_path(spark, "stream")
    source = table(spark, d, "events")
    folder = scratch_path(spark, "stream-in")
    source.select("user_id", "event_type").write.parquet(folder)
    s = jobs.dedup_stream(jobs.file_stream(spark, folder, "user_id bigint, event_type string"), ["user_id", "event_type"])
    jobs.run_available(s, lambda b, k: b.write.mode("overwrite").parquet(f"{out}/micro_batch={k}"), out + "-checkpoint")
    return spark.read.parquet(out).select("user_id", "event_type")


@query()
def stream_pipeline(spark, d):
    """Bronze rows through the streamed pipeline: counts of what was written."""
    from millrace.streaming import jobs

    out, folder = scratch_path(spark, "medallion"), scratch_path(spark, "medallion-in")
    table(spark, d, "bronze_customers").select("id", "name", "email", "age", "region", "city").write.parquet(folder)
    s = jobs.file_stream(spark, folder, "id string, name string, email string, age string, region string, city string")
    jobs.run_available(s, jobs.medallion(out, "crm", _BRONZE), out + "-checkpoint")
    parts = [spark.read.parquet(f"{out}/{k}").agg(F.lit(k).alias("layer"), F.count("*").alias("n")) for k in ("bronze", "silver", "quarantine")]
    return reduce(DataFrame.unionByName, parts)
