import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import series
from millrace.plans import charts, gateway, language, planner
from millrace.plans.ir import Filter, Metric, Order, QueryError, QueryIR, Ratio, compile_ir, to_sql

KINDS = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "date": T.DateType(), "timestamp": T.TimestampType()}


def info(name, ddl):
    return planner.table_info(name, T.StructType([T.StructField(p.split()[0], KINDS[p.split()[1]]) for p in ddl.split(", ")]))


POP = [info("population", "region string, city string, total_population double, age double, employment_rate double")]
SEX = [info("population", "region string, male_population double, female_population double")]
TS = [info("population", "ds string, region string, city string, total_population double, customers bigint, orders bigint, total_sales double, avg_age double")]
SALES = [info("sales_fact", "order_date date, customers bigint, orders bigint, total_sales double, revenue double")]

GOLDEN = [
    (POP, "Which region has the highest population?", "SELECT region, SUM(total_population) AS sum_total_population FROM population GROUP BY region ORDER BY sum_total_population DESC LIMIT 1"),
    (POP, "What is the average age per region?", "SELECT region, AVG(age) AS avg_age FROM population GROUP BY region"),
    (POP, "Show employment rate by city", "SELECT city, employment_rate FROM population"),
    (POP, "How many cities are in each region?", "SELECT region, COUNT(city) AS count_city FROM population GROUP BY region"),
    (POP, "What region has the lowest employment rate?", "SELECT region, AVG(employment_rate) AS avg_employment_rate FROM population GROUP BY region ORDER BY avg_employment_rate ASC LIMIT 1"),
    (SEX, "Show male and female population by region", "SELECT region, SUM(male_population) AS sum_male_population, SUM(female_population) AS sum_female_population FROM population GROUP BY region"),
    (POP, "Show the city with the highest population", "SELECT city, SUM(total_population) AS sum_total_population FROM population GROUP BY city ORDER BY sum_total_population DESC LIMIT 1"),
    (POP, "Show the 2 regions with the lowest average age", "SELECT region, AVG(age) AS avg_age FROM population GROUP BY region ORDER BY avg_age ASC LIMIT 2"),
    (POP, "Show cities in the North region", "SELECT city FROM population WHERE region = 'north'"),
    (TS, "what is the total population per week", "SELECT week(ds) AS period, SUM(total_population) AS sum_total_population FROM population GROUP BY period ORDER BY period ASC"),
    (TS, "How many customers do we have per day?", "SELECT day(ds) AS period, SUM(customers) AS sum_customers FROM population GROUP BY period ORDER BY period ASC"),
    (TS, "What is the average order value per day?", "SELECT day(ds) AS period, (SUM(total_sales) / NULLIF(SUM(orders), 0)) AS average_order_value FROM population GROUP BY period ORDER BY period ASC"),
    (TS, "What is the relationship between customers and total sales?", "SELECT customers, total_sales FROM population"),
    (SALES, "How are orders distributed?", "SELECT orders FROM sales_fact"),
    (SALES, "total sales by day", "SELECT order_date, total_sales FROM sales_fact ORDER BY order_date ASC"),
]


@pytest.mark.parametrize("tables,question,want", GOLDEN, ids=[g[1] for g in GOLDEN])
def test_golden_plans(tables, question, want):
    assert to_sql(planner.plan(question, tables)) == want


def test_conditions_of_questions():
    ir = planner.plan("Show total population for cities where employment rate is above 55", POP)
    assert Filter("employment_rate", ">", 55) in ir.filters and ir.metrics[0].column == "total_population"
    f, _ = planner.filters_of("cities where age between 18 and 65 and region is south", POP[0])
    assert Filter("age", ">=", 18) in f and Filter("age", "<=", 65) in f and Filter("region", "=", "south") in f
    assert planner.filters_of("city contains york", POP[0])[0] == [Filter("city", "LIKE", "%york%")]
    kept, said = planner.sanitise("population in north", QueryIR("t", filters=(Filter("region", "=", "north"), Filter("region", "=", "south"))))
    assert len(kept.filters) == 1 and said == ["filter on region is not in the question"]


def test_table_choice_drafts_and_errors():
    both = [*POP, *SALES]
    assert planner.plan("total revenue per month", both).table == "sales_fact"
    assert planner.plan("anything", both, {"table": "etl.population"}).table == "population"
    assert planner.check_draft({"table": "population", "metrics": [{"column": "city"}, {"column": "age"}], "order_by": [{"column": "age"}]}, both)["metrics"][0]["aggregation"] == "COUNT"
    with pytest.raises(QueryError):
        planner.check_draft({"table": "population", "metrics": [{"column": "zz"}]}, both)
    with pytest.raises(QueryError):
        planner.plan("orders by hour", SALES)
    with pytest.raises(QueryError):
        planner.plan("x", [])
    assert planner.restrict(both, ("sales_fact",)) == SALES and planner.rank_tables("revenue", both)[0].name == "sales_fact"
    assert planner.is_technical("_batch_id") and not planner.is_technical("region")


def test_forecast_plans():
    f = planner.plan_forecast("forecast total sales for the next 14 days", SALES)
    assert (f.value_column, f.horizon, f.granularity) == ("total_sales", 14, "day")
    f = planner.plan_forecast("predict revenue next month", SALES)
    assert (f.value_column, f.horizon) == ("revenue", 30) and planner.plan_forecast("revenue next year", SALES).granularity == "month"


def test_compile_filters_nulls_and_errors(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", None, "5"), (None, 3.0, "x")], "k string, v double, t string")
    top = compile_ir(QueryIR("t", (Metric("v", "SUM", "s"),), ("k",), order_by=(Order("s", "DESC"),)), df).collect()
    assert [r["k"] for r in top] == [None, "a", "b"]
    assert compile_ir(QueryIR("t", (Metric("t", "SUM", "s"),), casts={"t": "double"}), df).first()["s"] == 5.0
    r = compile_ir(QueryIR("t", (Metric("v", None, "q", Ratio(("v", None), ("v", None))),)), df).collect()
    assert [x["q"] for x in r] == [1.0, None, 1.0]
    assert compile_ir(QueryIR("t", (Metric("v"),), filters=(Filter("k", "IN", "a"),)), df).count() == 1
    assert compile_ir(QueryIR("t", (Metric("v"),), filters=(Filter("v", "BETWEEN", {"low": 1, "high": 3}),)), df).count() == 2
    assert compile_ir(QueryIR("t", (Metric("v"),), filters=(Filter("k", "=", "A"),), case_insensitive=True), df).count() == 1
    assert compile_ir(QueryIR("t", (Metric("*", "COUNT"),)), df.limit(0)).first()[0] == 0
    for bad in (QueryIR("t", (Metric("zz"),)), QueryIR("t", (Metric("k", "SUM"),)), QueryIR("t", (Metric("v"),), order_by=(Order("zz"),)), QueryIR("t", (Metric("v"),), filters=(Filter("k", "IN", []),)), QueryIR("t", (Metric("v"),), limit=0), QueryIR("t", (Metric("v", "SUM"),), limit=3), QueryIR("t", (Metric("v"),), filters=(Filter("k", "~", 1),))):
        with pytest.raises(QueryError):
            compile_ir(bad, df)


def test_series_rules(spark):
    df = spark.createDataFrame([("2024-05-05", 1.0), ("2024-05-11", 2.0), ("2024-05-12", 4.0)], "ds string, v double")
    rows = compile_ir(QueryIR("t", (Metric("v", "SUM", "s"),), time_column="ds", time_granularity="week", limit=1), df).collect()
    assert [(str(r["period"]), r["s"]) for r in rows] == [("2024-05-05", 3.0), ("2024-05-12", 4.0)]


GUARDED = [
    ("select * from t", True), ("with a as (select id from t) select * from a", True), ("select replace('a', 'a', 'b')", True), ("select * from t union all select * from t", True), ("select ';--' x from t", True),
    ("", False), ("drop table t", False), ("insert into t values (1)", False), ("with a as (select 1) insert into t select * from a", False), ("select * from t; drop table t", False), ("select * from t join secret using (id)", False),
    ("select * from t where id in (select id from secret)", False), ("with secret as (select * from secret) select * from secret", False), ("select * from parquet.`/etc`", False), ("select java_method('a', 'b')", False), ("selec 1", False), ("select id from other.t", False), ("select (", False),
]


@pytest.mark.parametrize("sql,ok", GUARDED, ids=[g[0][:40] for g in GUARDED])
def test_guard(spark, sql, ok):
    spark.range(3).createOrReplaceTempView("t")
    spark.range(3).createOrReplaceTempView("secret")
    if ok:
        gateway.guard(spark, sql, {"t"}, "main")
    else:
        with pytest.raises(gateway.GuardError):
            gateway.guard(spark, sql, {"t"}, "main")


def test_execute_envelope(spark):
    spark.range(5).selectExpr("id", "double('nan') v", "cast(1.5 as decimal(4,2)) d", "date'2024-01-01' day").createOrReplaceTempView("t")
    got = gateway.execute(spark, "select * from t order by id", {"t"}, max_rows=2)
    assert got["status"] == "success" and got["row_count"] == 2 and got["truncated"] and got["rows"][0] == {"id": 0, "v": 0.0, "d": 1.5, "day": "2024-01-01"}
    assert gateway.execute(spark, "drop table t")["status"] == "rejected" and gateway.execute(spark, "select zz from t")["status"] == "error"


def _series(spark, values, start="2026-01-01", days=None):
    d0 = dt.datetime.fromisoformat(start)
    days = days or range(len(values))
    return spark.createDataFrame([(d0 + dt.timedelta(days=k), float(v)) for k, v in zip(days, values)], "ds timestamp, value double")


def test_naive_forecast(spark):
    out, made = series.forecast(_series(spark, [10, 11, 12, 13, 14]), 2, least=5)
    rows = out.where("series_type = 'forecast'").orderBy("ds").collect()
    assert made["forecast_available"] and made["boundary_index"] == 5
    assert [(r["ds"], r["value"]) for r in rows] == [(dt.datetime(2026, 1, 6), 15.0), (dt.datetime(2026, 1, 7), 16.0)]
    q = series.naive_forecast(_series(spark, [10, 14]), 1, 86400.0).first()
    assert q["q10"] == pytest.approx(18 * 0.95) and q["q90"] == pytest.approx(18 * 1.05)


def test_forecast_fallbacks_and_models(spark):
    few, made = series.forecast(_series(spark, [1, 2]), 3)
    assert not made["forecast_available"] and few.count() == 2
    odd, made = series.forecast(_series(spark, [1, 2, 3, 4, 5, 6], days=[0, 1, 9, 10, 45, 46]), 3, least=5)
    assert made["reason"] == "irregular spacing"
    model = lambda pdf, h: pdf.tail(1).assign(value=99.0)
    out, _ = series.forecast(_series(spark, range(20)), 1, (lambda pdf, h: None, model))
    assert out.where("series_type = 'forecast'").first()["value"] == 99.0


def test_clean_fill_spacing_choices(spark):
    df = spark.createDataFrame([("2024-01-01", "1", 0), ("2024-01-01", "2", 1), ("x", "3", 2), ("2024-01-02", "nan", 3), ("2024-01-03", None, 4)], "day string, amount string, o int")
    rows = series.clean_series(df, "day", "amount", "o").collect()
    assert [(r["ds"], r["value"]) for r in rows] == [(dt.datetime(2024, 1, 1), 2.0)]
    assert series.choose_time(df) == "day" or series.choose_time(df) is None
    assert series.choose_value(df, "day") in ("amount", "o") and series.choose_time(df, "amount") == "amount"
    filled = series.fill(spark.createDataFrame([(1, None), (2, 5.0), (3, None)], "ds int, value double")).orderBy("ds").collect()
    assert [r["value"] for r in filled] == [5.0, 5.0, 5.0]
    s = series.spacing(_series(spark, [1])).first()
    assert s["n_steps"] == 0 or s["step_seconds"] == 86400.0


def test_charts(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    s = charts.shape(df)
    assert charts.by_shape(s) == {"type": "bar", "x": "k", "y": "v"} and charts.by_shape(charts.shape(df.select("v"))) == {"type": "histogram", "x": "v"}
    assert charts.by_shape(charts.shape(df.select("v").limit(1)))["type"] == "card" and charts.by_shape(charts.shape(df.select("k")))["type"] == "table"
    assert charts.by_shape(charts.shape(df.selectExpr("v", "v + 1 w")))["type"] == "scatter" and charts.by_shape(charts.shape(df.select(F.lit("2024-01-01").alias("d"), "v")))["type"] == "line"
    types = [charts.recommend(planner.plan(q, TS))["type"] for q in ("relationship between customers and total sales", "total sales per week", "How are orders distributed?", "total sales by region", "overall total sales")]
    assert types == ["scatter", "line", "histogram", "bar", "card"] and charts.forecast_chart()["mode"] == "actual_plus_predicted"
    assert charts.resolve_axes({"type": "bar", "x": "zz", "y": "yy"}, s) == {"type": "bar", "x": "k", "y": "v"}


def test_language():
    assert [language.classify_input(q) for q in ("", "12 34", "!!!??##", "hello there", "forecast sales", "top 3 cities", "aaaa bbbb")] == ["empty", "numeric", "noise", "conversational", "predictive", "analytical", "noise"]
    assert language.segment("totalsales", {"total", "sales"}) == ["total", "sales"]
    assert language.clean_question("um show show totalpopulation please", {"total", "population"}) == "show total population"
    assert language.correct_spelling("averge populaton by regionn", POP)[0] == "averge population by region"
    assert language.business_terms("turnover by clients", SALES) == "revenue by customers"
    d = language.diagnose("populaton by region", POP)
    assert d.table == "population" and "region" in d.columns and ("populaton", "population") in d.suggestions
    assert language.confidence({k: 1.0 for k in language.CONFIDENCE_WEIGHTS}) == pytest.approx(1.0)
    assert language.review("top 5 cities per region", QueryIR("t", limit=3)) == ["asked for 5 rows, limit is 3", "asked for groups, none in the plan"]
