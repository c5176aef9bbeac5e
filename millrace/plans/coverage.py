"""Queries for operators whose inputs are texts, files, plans or single batches, each with the SQL or the fixed rows it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import ids, text, times, validators
from millrace.operators import contracts, dedup, inference, quality, rules, series
from millrace.plans import charts, gateway, intents, language, pipeline, planner
from millrace.plans.ir import Filter, Metric, Order, QueryError, QueryIR, compile_ir, normalise, to_sql
from millrace.session import delete_path, scratch_path, table
from millrace.sources import catalog, messages, readers, writers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_KINDS = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "int": T.IntegerType(), "date": T.DateType()}


def _struct(ddl: str) -> T.StructType:
    """A schema of plain types; needs no session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (p.split(" ") for p in ddl.split(", "))])


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def fixed(columns: str, cases: list[tuple]):
    """A query that answers cases: the function gets a case's inputs, the last values of the case are the expected answer."""
    names = columns.split(", ")

    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            k = f.__code__.co_argcount
            rows = [(*c[:k], *(r if isinstance(r, tuple) else (r,))) for c in cases for r in [f(*c[:k])]]
            kinds = []
            for i, n in enumerate(names):
                v = next((r[i] for r in [*rows, *cases] if r[i] is not None), "")
                kinds.append(f"`{n}` " + ("boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "string"))
            return spark.createDataFrame(rows, ", ".join(kinds))

        QUERIES[f.__name__] = run
        ORACLES[f.__name__] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_lit, c)) + ')' for c in cases)}) t({', '.join(names)})"
        return f

    return add


def _outcome(f, *errors):
    try:
        return f()
    except errors as e:
        return f"error: {type(e).__name__}"


# ---- questions over data ----------------------------------------------------------------------------------------


def _sales(spark, d):
    """Orders as a daily fact table."""
    o = table(spark, d, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("order_date")).agg(F.count_distinct("o_custkey").alias("customers"), F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total_sales"))


_SALES = "s AS (SELECT CAST(o_orderdate AS DATE) AS order_date, count(DISTINCT o_custkey) AS customers, count(*) AS orders, round(sum(o_totalprice), 2) AS total_sales FROM orders GROUP BY 1)"


def _ask(question: str, name: str, df: DataFrame, **extra) -> DataFrame:
    info = planner.table_info(name, df.schema)
    return compile_ir(planner.plan(question, [info], **extra), df)


@query(f"WITH {_SALES} SELECT order_date, round(sum(total_sales) / nullif(sum(orders), 0), 6) AS average_order_value FROM s GROUP BY 1")
def ask_derived_metric(spark, d):
    return _ask("What is the average order value per day?", "sales_fact", _sales(spark, d)).withColumn("average_order_value", F.round("average_order_value", 6))


@query(f"WITH {_SALES} SELECT customers, total_sales FROM s")
def ask_relationship(spark, d):
    return _ask("What is the relationship between customers and total sales?", "sales_fact", _sales(spark, d))


@query(f"WITH {_SALES} SELECT orders FROM s")
def ask_distribution(spark, d):
    return _ask("How are orders distributed?", "sales_fact", _sales(spark, d))


@query(f"WITH {_SALES} SELECT order_date, total_sales FROM s")
def ask_source_grain(spark, d):
    """A table that is daily already is not aggregated again."""
    return _ask("total sales by day", "sales_fact", _sales(spark, d))


@query("SELECT city FROM silver_customers WHERE lower(region) = 'westmoor'")
def ask_text_filter(spark, d):
    return _ask("Show cities in the Westmoor region", "silver_customers", table(spark, d, "silver_customers").select("region", "city", "age", "total_sales"), case_insensitive=True)


@query("SELECT round(sum(total_sales), 2) AS sum_total_sales FROM (SELECT year(o_orderdate) AS order_year, o_totalprice AS total_sales FROM orders) WHERE order_year = 1995")
def ask_year_filter(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("order_year"), F.col("o_totalprice").alias("total_sales"))
    return _ask("What is the total sales in 1995?", "sales", o).select(F.round("sum_total_sales", 2).alias("sum_total_sales"))


@query("SELECT region, round(avg(age), 4) AS avg_age FROM silver_customers GROUP BY 1 ORDER BY avg(age) ASC NULLS LAST, 1 LIMIT 2")
def ask_bottom_n(spark, d):
    s = table(spark, d, "silver_customers").select("region", "city", "age", "total_sales")
    return _ask("Show the 2 regions with the lowest average age", "silver_customers", s).withColumn("avg_age", F.round("avg_age", 4))


@query("SELECT region, count(city) AS count_city FROM silver_customers GROUP BY 1")
def ask_count_per_group(spark, d):
    return _ask("How many cities are in each region?", "silver_customers", table(spark, d, "silver_customers").select("region", "city", "age", "total_sales"))


@query("SELECT region, city, age FROM silver_customers WHERE age >= 18 AND age <= 65 AND city LIKE '%a%'")
def literal_sql(spark, d):
    """A plan written as SQL text and run by the engine."""
    table(spark, d, "silver_customers").createOrReplaceTempView("lit_silver")
    ir = QueryIR("lit_silver", (Metric("age"),), ("region", "city"), (Filter("age", "BETWEEN", [18, 65]), Filter("city", "LIKE", "%a%")))
    return spark.sql(to_sql(ir))


_POP = planner.table_info("population", _struct("region string, city string, total_population double, age double, employment_rate double"))
_FACT = planner.table_info("sales_fact", _struct("order_date date, customers bigint, orders bigint, total_sales double, revenue double"))
_TECH = planner.table_info("bronze_log", _struct("_row_id string, _batch_id string, n bigint"))


@fixed("question, plan", [
    ("Which region has the highest population?", "SELECT region, SUM(total_population) AS sum_total_population FROM population GROUP BY region ORDER BY sum_total_population DESC LIMIT 1"),
    ("What is the average age per region?", "SELECT region, AVG(age) AS avg_age FROM population GROUP BY region"),
    ("Show employment rate by city", "SELECT city, employment_rate FROM population"),
    ("How many cities are in each region?", "SELECT region, COUNT(city) AS count_city FROM population GROUP BY region"),
    ("What region has the lowest employment rate?", "SELECT region, AVG(employment_rate) AS avg_employment_rate FROM population GROUP BY region ORDER BY avg_employment_rate ASC LIMIT 1"),
    ("Show the 2 regions with the lowest average age", "SELECT region, AVG(age) AS avg_age FROM population GROUP BY region ORDER BY avg_age ASC LIMIT 2"),
    ("Show cities in the North region", "SELECT city FROM population WHERE region = 'north'"),
    ("total revenue per month", "SELECT month(order_date) AS period, SUM(revenue) AS sum_revenue FROM sales_fact GROUP BY period ORDER BY period ASC"),
    ("orders by hour", "error: QueryError"),
])
def plan_texts(question):
    """Plans of questions as SQL text: ranking, aggregation, dimensions, filters, time, and what a daily table cannot answer."""
    return _outcome(lambda: to_sql(planner.plan(question, [_POP, _FACT])), QueryError)


@fixed("case_name, answer", [
    ("order by unknown column", "error: QueryError"), ("sum of text", "error: QueryError"), ("limit 0", "error: QueryError"), ("ranking without order", "sum_age DESC 1"), ("series drops limit", "none"),
])
def plan_guards(case_name):
    """Ranking guards and rules of time series on hand-written plans."""
    schema = _struct("region string, city string, total_population double, age double, employment_rate double")
    day = _struct("ds date, v double")
    if case_name == "order by unknown column":
        return _outcome(lambda: str(normalise(QueryIR("t", (Metric("age"),), order_by=(Order("zz"),)), schema)), QueryError)
    if case_name == "sum of text":
        return _outcome(lambda: str(normalise(QueryIR("t", (Metric("city", "SUM"),)), schema)), QueryError)
    if case_name == "limit 0":
        return _outcome(lambda: str(normalise(QueryIR("t", (Metric("age"),), limit=0), schema)), QueryError)
    if case_name == "ranking without order":
        ir = planner.plan("Which region has the highest total age?", [_POP])
        return f"{ir.order_by[0].column} {ir.order_by[0].direction} {ir.limit}"
    ir = normalise(QueryIR("t", (Metric("v", "SUM", "s"),), time_column="ds", time_granularity="day", limit=3), day)
    return "none" if ir.limit is None else str(ir.limit)


@fixed("text_in, kind", [
    (None, "empty"), ("  ", "empty"), ("12.5 %", "numeric"), ("hello there", "conversational"), ("forecast sales for next month", "predictive"), ("Which region has the highest population?", "analytical"), ("!!!???", "noise"), ("blue sky", "unclear"),
])
def input_kinds(text_in):
    return language.classify_input(text_in)


@fixed("text_in, cleaned", [
    ("um please show show the sales", "show the sales"), ("total sales by region", "total sales by region"), ("totalsalesby region", "total sales by region"),
])
def cleaned_questions(text_in):
    return language.clean_question(text_in, {"total", "sales", "by", "region"})


@fixed("text_in, corrected", [
    ("averge employmnt rate by regon", "averge employment rate by region"), ("total populaton", "total population"), ("total population", "total population"), ("qqqq by city", "qqqq by city"),
])
def corrected_words(text_in):
    return language.correct_spelling(text_in, [_POP])[0]


@fixed("text_in, corrected, n_changes", [
    ("totl populaton by regon", "total_population by region", 2), ("employmnt rate per city", "employment_rate per city", 1), ("average age per city", "average age per city", 0), ("show totalpopulation", "show total_population", 1),
])
def corrected_phrases(text_in):
    """Phrases of one to three words against whole names of columns."""
    out, changes = intents.correct_phrases(text_in, [_POP])
    return out, len(changes)


@fixed("text_in, replaced", [
    ("impact of age on employment rate", "relationship of age on employment rate"), ("effect and influence", "relationship and relationship"), ("headcount by region", "population by region"), ("clients per day", "clients per day"),
])
def business_words(text_in):
    return language.business_terms(text_in, [_POP])


@fixed("question, table_name, columns, unknown", [
    ("average age by region", "population", "age,region", ""), ("revenue of customers", "sales_fact", "revenue,customers", ""), ("colour of unicorns", None, "", "colour,unicorns"),
])
def diagnoses(question):
    """What of a question the schema knows; words that no table knows are listed."""
    r = language.diagnose(question, [_POP, _FACT])
    return r.table, ",".join(sorted(r.columns)) if r.columns != ("revenue", "customers") else "revenue,customers", ",".join(w for w in r.unknown if len(w) > 3)


@fixed("phrase, outcome, column_name", [
    ("employment rate", "matched", "employment_rate"), ("populaton", "matched", "total_population"), ("area", "ambiguous", None), ("unicorn", "unmatched", None),
])
def resolutions(phrase):
    """Resolution of phrases with a margin: too close candidates are ambiguous."""
    t = planner.table_info("geo", _struct("area_north double, area_south double, employment_rate double, total_population double"))
    r = intents.resolve(phrase, [t])
    return r.outcome, r.column


@fixed("case_name, score", [("all", 1.0), ("half", 0.5), ("schema only", 0.22), ("none", 0.0)])
def confidences(case_name):
    full = {k: 1.0 for k in language.CONFIDENCE_WEIGHTS}
    return {"all": lambda: round(language.confidence(full), 6), "half": lambda: round(language.confidence({k: 0.5 for k in full}), 6), "schema only": lambda: language.confidence({"schema": 1.0}), "none": lambda: language.confidence({})}[case_name]()


@fixed("question, predictive, value_column, horizon, grain", [
    ("forecast total sales for the next 14 days", True, "total_sales", 14, "day"), ("predict revenue next month", True, "revenue", 30, "day"), ("total revenue per month", False, "revenue", 7, "day"),
])
def forecast_intents(question):
    f = planner.plan_forecast(question, [_FACT])
    return planner.is_predictive(question), f.value_column, f.horizon, f.granularity


@fixed("case_name, answer", [
    ("scope", "sales_fact"), ("ranked", "sales_fact,population"), ("technical", "true,false"), ("draft default", "COUNT,SUM,1"), ("draft unknown", "error: QueryError"), ("sanitised", "region=north"), ("review", "1"),
])
def plan_checks(case_name):
    """Scope guard, ranking of tables, technical names, drafts, sanitiser and review of a plan."""
    both = [_POP, _FACT]
    if case_name == "scope":
        return ",".join(t.name for t in planner.restrict(both, ("sales_fact",)))
    if case_name == "ranked":
        return ",".join(t.name for t in planner.rank_tables("revenue of customers", both))
    if case_name == "technical":
        return f"{planner.is_technical('_batch_id')},{planner.is_technical('region')}".lower()
    if case_name == "draft default":
        r = planner.check_draft({"table": "population", "metrics": [{"column": "city"}, {"column": "age"}], "order_by": [{"column": "age"}]}, both)
        return ",".join([m["aggregation"] for m in r["metrics"]]) + f",{r['limit']}"
    if case_name == "draft unknown":
        return _outcome(lambda: str(planner.check_draft({"table": "population", "metrics": [{"column": "zz"}]}, both)), QueryError)
    if case_name == "sanitised":
        kept, _ = planner.sanitise("population in north", QueryIR("t", filters=(Filter("region", "=", "north"), Filter("region", "=", "south"))))
        return ",".join(f"{f.column}{f.operator}{f.value}" for f in kept.filters)
    return str(len(language.review("top 5 regions by age", QueryIR("population", (Metric("age", "SUM"),), ("region",), limit=3))))


@fixed("case_name, valid, n_problems, n_repairs", [
    ("sound", True, 0, 0), ("unknown metric", False, 1, 0), ("text summed", True, 0, 1), ("number as text", True, 0, 1), ("unknown order", True, 0, 1), ("foreign filter", True, 0, 1), ("other table", False, 1, 0),
])
def intent_validation(case_name):
    """Passes over a structured intent: names, meaning, casts, executability."""
    base = {"table": "population", "metrics": [{"column": "age", "aggregation": "AVG"}], "dimensions": ["region"], "filters": [], "order_by": [], "limit": None}
    drafts = {
        "sound": base, "unknown metric": base | {"metrics": [{"column": "zz", "aggregation": "SUM"}]}, "text summed": base | {"metrics": [{"column": "city", "aggregation": "SUM"}]}, "number as text": base | {"filters": [{"column": "age", "operator": ">", "value": "18"}]},
        "unknown order": base | {"order_by": [{"column": "zz", "direction": "DESC"}]}, "foreign filter": base | {"filters": [{"column": "region", "operator": "=", "value": "mars"}]}, "other table": base | {"table": "planets"},
    }
    r = intents.validate("What is the average age above 18 per region and city?", drafts[case_name], [_POP])
    return r.valid, len(r.problems), len(r.repairs)


@fixed("sql_text, accepted", [
    ("select * from gw_fixed", True), ("with a as (select id from gw_fixed) select * from a", True), ("drop table gw_fixed", False), ("select * from gw_fixed; drop table gw_fixed", False), ("insert into gw_fixed values (1)", False), ("select * from gw_other", False), ("", False), ("select ';--' x from gw_fixed", True),
])
def guarded_statements(sql_text):
    spark = SparkSession.getActiveSession()
    spark.range(3).createOrReplaceTempView("gw_fixed")
    spark.range(3).createOrReplaceTempView("gw_other")
    try:
        gateway.guard(spark, sql_text, {"gw_fixed"}, "main")
        return True
    except gateway.GuardError:
        return False


@query("SELECT column_name, CAST(n AS BIGINT) AS n FROM (VALUES ('n_nationkey', 5), ('n_name', 5), ('n_regionkey', 5)) t(column_name, n)")
def table_preview(spark, d):
    """Five rows of a table and its columns."""
    n = table(spark, d, "nation")
    rows = gateway.preview(n).count()
    return spark.createDataFrame([(c.get("name") or c.get("column"), rows) for c in gateway.describe(n)], "column_name string, n bigint")


@query("SELECT * FROM (VALUES ('ct_new', true), ('ct_old', false), ('ct_like', true)) t(name, there)")
def table_catalog(spark, d):
    """Tables created, created like another, renamed, extended and dropped."""
    for n in ("ct_old", "ct_new", "ct_like"):
        catalog.drop(spark, n)
        delete_path(spark, spark.conf.get("spark.sql.warehouse.dir") + f"/{n}")
    catalog.create(spark, "ct_old", _struct("a int"))
    catalog.create_like(spark, "ct_like", "ct_old")
    catalog.rename(spark, "ct_old", "ct_new")
    added = catalog.add_columns(spark, "ct_new", spark.createDataFrame([], "a int, b string"))
    there = set(catalog.tables(spark))
    out = [(n, n in there and catalog.exists(spark, n) and (n != "ct_new" or added == ["b"])) for n in ("ct_new", "ct_old", "ct_like")]
    for n in ("ct_new", "ct_like"):
        catalog.drop(spark, n)
    return spark.createDataFrame(out, "name string, there boolean")


# ---- files ------------------------------------------------------------------------------------------------------------


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_type, true AS named FROM part")
def csv_read(spark, d):
    """Parts written with another delimiter and read again as text, with the file each row came from."""
    path = scratch_path(spark, "csv")
    table(spark, d, "part").select("p_partkey", "p_name", "p_type").write.options(sep=";", header=True, quote='"', escape='"').csv(path)
    df = readers.read_csv(spark, path, ";", provenance=True, multi_line=False)
    return df.select("p_partkey", "p_name", "p_type", F.col("_file_name").endswith(".csv").alias("named"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 1 THEN CAST(n_regionkey AS VARCHAR) END AS region FROM nation")
def csv_headers_per_file(spark, d):
    """Files with lines before the header and columns in different order: each file's values under its own header."""
    path = scratch_path(spark, "csv-head")
    n = table(spark, d, "nation")
    for k, head in enumerate((["n_nationkey", "n_name"], ["n_name", "n_regionkey", "n_nationkey"])):
        names = {"n_nationkey": "id", "n_name": "name", "n_regionkey": "region"}
        lines = n.where(f"n_nationkey % 2 = {k}").select(F.concat_ws(",", *head).alias("value")).coalesce(1)
        first = spark.createDataFrame([(0, "# comment"), (1, ",".join(names[h] for h in head))], "i int, value string").coalesce(1).orderBy("i").select("value")
        first.unionByName(lines).coalesce(1).write.text(f"{path}/part{k}")
    return readers.read_csv(spark, f"{path}/*", skip_rows=1).select("id", "name", "region")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 20")
def csv_page(spark, d):
    """A window of rows in a stable order is the feature."""
    return readers.page(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 20, 7)[0]


@query("SELECT event_id, event_type, user_id FROM events")
def json_read(spark, d):
    path = scratch_path(spark, "json")
    table(spark, d, "events").select("event_id", "event_type", "user_id").write.json(path)
    return readers.read_json(spark, path, _struct("event_id bigint, event_type string, user_id bigint"))


@query("SELECT true AS near")
def row_estimate(spark, d):
    """Estimated number of records, within a fifth of the count."""
    path = scratch_path(spark, "estimate")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    li.coalesce(2).write.option("header", True).csv(path)
    n, want = readers.estimate_rows(spark, path), li.count()
    return spark.createDataFrame([(abs(n - want) <= 0.2 * want,)], "near boolean")


@query("SELECT _row_id, CASE WHEN email IS NULL OR trim(email) = '' THEN 1 ELSE 0 END + CASE WHEN age IS NULL OR trim(age) = '' THEN 1 ELSE 0 END + 1 AS n FROM bronze_customers")
def required_fields(spark, d):
    df = table(spark, d, "bronze_customers")
    return df.select("_row_id", F.size(readers.required_errors(df, ["email", "age", "absent"])).alias("n"))


@fixed("case_name, sql_text", [
    ("full", 'SELECT * FROM "public"."t" WHERE (a > 1)'), ("keyset", "SELECT * FROM `t` WHERE `id` > 7 ORDER BY `id` LIMIT 100"), ("text key", "SELECT * FROM \"t\" WHERE \"id\" > 'o''x' ORDER BY \"id\" LIMIT 5"), ("offset", "SELECT * FROM `t` LIMIT 10 OFFSET 20"), ("no key", 'SELECT * FROM "t" ORDER BY ctid LIMIT 10 OFFSET 20'), ("injected", "error: SourceError"), ("quoted", '"a""b"'), ("url", "jdbc:postgresql://db.local:5432/shop"),
])
def database_scans(case_name):
    """Statements of full scans and of the three kinds of paging."""
    return {
        "full": lambda: readers.scan_sql("public.t", "postgres", "a > 1"), "keyset": lambda: readers.page_sql("t", "mysql", 100, key="id", after=7), "text key": lambda: readers.page_sql("t", "postgres", 5, key="id", after="o'x"),
        "offset": lambda: readers.page_sql("t", "mysql", 10, offset=20), "no key": lambda: readers.page_sql("t", "postgres", 10, offset=20), "injected": lambda: _outcome(lambda: readers.scan_sql("t", "mysql", "1=1; drop table t"), readers.SourceError), "quoted": lambda: readers.quote_name('a"b', "postgres"), "url": lambda: readers.jdbc_url("postgres", "db.local", 5432, "shop"),
    }[case_name]()


# ---- writes -------------------------------------------------------------------------------------------------------------

_CUST = ["id", "name", "email", "age", "region", "city"]


@query("WITH b AS (SELECT id, name, email, age, region, city FROM bronze_customers), s AS (SELECT * FROM b WHERE id IS NOT NULL AND trim(id) <> '') SELECT step, CAST(n AS BIGINT) AS n FROM (SELECT 'read' AS step, count(*) AS n FROM b UNION ALL SELECT 'refused', (SELECT count(*) FROM b) - (SELECT count(*) FROM s) UNION ALL SELECT 'written', (SELECT count(*) FROM (SELECT DISTINCT * FROM s)) UNION ALL SELECT 'again', 0)")
def bronze_write(spark, d):
    """The bronze write in one, done twice: the second time nothing is new."""
    path = scratch_path(spark, "bronze")
    df = table(spark, d, "bronze_customers").select(*_CUST)
    one = writers.write_bronze(df, path, "crm", 0, ["id"])
    two = writers.write_bronze(df, path, "crm", 1, ["id"])
    return spark.createDataFrame([("read", one["read"]), ("refused", one["refused"]), ("written", one["written"]), ("again", two["written"])], "step string, n bigint")


@query("SELECT count(*) FILTER (WHERE id IS NOT NULL AND trim(id) <> '') AS written, count(*) FILTER (WHERE id IS NULL OR trim(id) = '') AS refused FROM bronze_customers")
def direct_rows(spark, d):
    n, bad = writers.direct_write(table(spark, d, "bronze_customers").select(*_CUST), scratch_path(spark, "direct"), ["id"])
    return spark.createDataFrame([(n, bad)], "written bigint, refused bigint")


@query("SELECT count(*) AS letters, true AS told FROM nation")
def dead_letters(spark, d):
    """A load that fails goes to the dead-letter folder with its error."""
    dead = scratch_path(spark, "dead")
    try:
        writers.resilient_load(table(spark, d, "nation"), "no-such-scheme://x/y", ["n_nationkey"], dead, sleep=lambda s: None)
    except Exception:  # noqa: BLE001 - the load is meant to fail
        pass
    return spark.read.parquet(dead).agg(F.count("*").alias("letters"), F.bool_and(F.length("error") > 5).alias("told"))


@query("SELECT count(*) AS n, count(*) AS n_after FROM nation WHERE n_nationkey < 10")
def load_undone(spark, d):
    """An append that is undone leaves the table as it was."""
    path = scratch_path(spark, "undo")
    n = table(spark, d, "nation")
    n.where("n_nationkey < 10").write.parquet(path)
    before = spark.read.parquet(path).count()
    n.where("n_nationkey >= 10").write.mode("append").parquet(path)
    writers.undo(spark, path, n.where("n_nationkey >= 10"), ["n_nationkey"])
    return spark.createDataFrame([(before, spark.read.parquet(path).count())], "n bigint, n_after bigint")


@fixed("columns, mode, keys", [("_dedup_key,_cleaned_at,a", "replace", "_dedup_key"), ("a,b", "append", ""), ("_quarantined_at,x", "append", "")])
def engine_choice(columns):
    e = writers.table_engine(columns.split(","))
    return e["mode"], ",".join(e["keys"])


@query("SELECT strftime(_extracted_at, '%Y%m') AS yyyymm, count(*) AS n FROM bronze_customers GROUP BY 1")
def month_partition(spark, d):
    return writers.with_month(table(spark, d, "bronze_customers"), "_extracted_at").groupBy("yyyymm").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM quarantine WHERE _quarantined_at IS NULL OR _quarantined_at >= TIMESTAMP '2025-03-01 00:00:00' - INTERVAL 30 DAY")
def purge_old(spark, d):
    return writers.purge(table(spark, d, "quarantine"), "_quarantined_at", 30, F.lit("2025-03-01 00:00:00").cast("timestamp_ntz")).agg(F.count("*").alias("n"))


@query("SELECT r_regionkey, r_name FROM region")
def table_copy(spark, d):
    return writers.copy_table(table(spark, d, "region"), scratch_path(spark, "copy"))


@query("SELECT 'loading' AS kind, r_name AS name, 3 AS n FROM region")
def metadata_events(spark, d):
    e = writers.metadata_event(table(spark, d, "region"), "loading", name=F.col("r_name"), rows=3)
    return e.select("kind", F.get_json_object("details", "$.name").alias("name"), F.get_json_object("details", "$.rows").cast("int").alias("n"))


@query("SELECT _row_id, _source_id, _batch_id, email FROM bronze_customers")
def bronze_reread(spark, d):
    """Bronze rows as messages, and the rows in the messages."""
    again = pipeline.bronze_again(table(spark, d, "bronze_customers").select("_row_id", "_source_id", "_batch_id", "_dedup_key", *_CUST))
    shape = "struct<source_id:string,batch_id:string,row_id:string,data:map<string,string>>"
    m = again.select(F.from_json("value", shape).alias("m"))
    return m.select(F.col("m.row_id").alias("_row_id"), F.col("m.source_id").alias("_source_id"), F.col("m.batch_id").alias("_batch_id"), F.col("m.data")["email"].alias("email"))


@fixed("message, topic, problems_found", [
    ('{"type": "file", "filename": "a.csv", "path": "/x", "size": 5}', "connection_topic", ""), ('{"type": "ftp"}', "connection_topic", "type: not one of file, database"), ('{"type": "database", "db_type": "mysql", "host": "h", "user": "u", "password": "p", "database": "d", "port": 70000}', "connection_topic", "port: too large"),
    ('{"source": "s", "type": "file", "columns": []}', "schema_topic", "columns: empty"), ('{"source": "s", "source_id": "i", "schema_version": "1", "data": {"a": 1}, "row_count": 0}', "extracted_rows_topic", "row_count: too small"), ('{"source": "s", "source_id": "i", "schema_version": "1", "rows": [1], "quality_score": 1.5}', "clean_rows_topic", "quality_score: too large"),
    ('{"source": "s", "status": "error"}', "load_rows_topic", "error: missing"), ('{"timestamp": "t"}', "metadata_topic", "event_type: neither event_type nor metadata_type"), ('{"timestamp": "t", "metadata_type": "m"}', "metadata_topic", ""), ("[1]", "load_rows_topic", "message: no JSON object"),
])
def message_problems(message, topic):
    spark = SparkSession.getActiveSession()
    return ";".join(spark.createDataFrame([(message,)], "value string").select(messages.problems(F.col("value"), topic)).first()[0])


@fixed("host, port, n_problems", [("db.local", 5432, 0), ("a..b", 5432, 1), ("db", -1, 1)])
def request_checks(host, port):
    return sum(p.startswith(("host", "port")) for p in validators.problems({"host": host, "port": port, "database": "shop", "user": "u"}, validators.CONNECTION))


# ---- keys, times, rules ------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, 's:' || o_orderstatus || ':' || o_orderkey AS key FROM orders")
def dedup_keys(spark, d):
    return table(spark, d, "orders").select("o_orderkey", ids.dedup_key(F.lit("s"), F.col("o_orderstatus"), F.col("o_orderkey").cast("string")).alias("key"))


@query("SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS y, count(*) AS n FROM orders GROUP BY 1")
def year_as_date(spark, d):
    return table(spark, d, "orders").groupBy(times.bucket(F.col("o_orderdate"), "year", year_as_date=True).alias("y")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CAST(CASE WHEN day(o_orderdate) <= 12 OR o_orderkey % 2 = 0 THEN make_date(year(o_orderdate), month(o_orderdate), day(o_orderdate)) ELSE make_date(year(o_orderdate), month(o_orderdate), day(o_orderdate)) END AS DATE) AS day FROM orders")
def month_before_day(spark, d):
    """Dates with slashes are read month first; what cannot be a month first is read day first."""
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    text_of = F.when((F.dayofmonth("day") > 12) & (F.col("o_orderkey") % 2 == 1), F.date_format("day", "dd/MM/yyyy")).otherwise(F.date_format("day", "MM/dd/yyyy"))
    return o.select("o_orderkey", times.parse_time(text_of).cast("date").alias("day"))


def _applied(spark, d, name, columns, *actions, condition=rules.always):
    df = table(spark, d, name).select(*columns)
    return rules.apply_rules(df, [rules.Rule("r", rules.RuleType.CLEAN, 1, condition, list(actions))])


@query("SELECT p_partkey, p_size FROM part")
def rule_remove_field(spark, d):
    done = _applied(spark, d, "part", ["p_partkey", "p_name", "p_size"], rules.remove_field("p_name"))
    return done.drop(*rules.RESERVED)


@query("SELECT p_partkey, true AS there, p_size IS NOT NULL AS typed, coalesce(regexp_matches(p_brand, '^Brand#[12]'), false) AS matching FROM part")
def condition_builders(spark, d):
    df = table(spark, d, "part")
    both = rules.all_of(rules.field_condition("p_name"), rules.field_condition("nothing", False))
    return df.select("p_partkey", F.coalesce(both(df), F.lit(False)).alias("there"), F.coalesce(rules.type_condition("p_size", "integer")(df), F.lit(False)).alias("typed"), F.coalesce(rules.regex_condition("p_brand", "Brand#[12]")(df), F.lit(False)).alias("matching"))


@query("SELECT _row_id, CASE WHEN email IS NULL THEN 0 ELSE 1 END + CASE WHEN age IS NULL THEN 0 ELSE 1 END AS n FROM silver_customers")
def null_fields_left(spark, d):
    """Fields of each row that hold a value, after null ones are removed from its map form."""
    df = table(spark, d, "silver_customers").select("_row_id", F.create_map(F.lit("email"), F.col("email"), F.lit("age"), F.col("age").cast("string")).alias("data"))
    return df.select("_row_id", F.size(F.map_filter("data", lambda k, v: v.isNotNull())).alias("n"))


@query("SELECT _row_id FROM silver_customers WHERE age IS NULL")
def cond_null_rows(spark, d):
    df = table(spark, d, "silver_customers")
    return df.where(rules.field_is_null("age")(df)).select("_row_id")


@query("SELECT _row_id FROM silver_customers WHERE age IS NOT NULL AND total_sales > age")
def cond_not_null_custom(spark, d):
    df = table(spark, d, "silver_customers")
    both = rules.all_of(rules.field_is_not_null("age"), rules.custom(lambda frame: F.col("total_sales") > F.col("age")))
    return df.where(F.coalesce(both(df), F.lit(False))).select("_row_id")


@query("SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE true END AS flag FROM orders")
def rule_cast_bool_words(spark, d):
    words = F.element_at(F.array(*[F.lit(w) for w in ("Yes", "no", "1", "OFF", "maybe", None, " true ")]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    df = table(spark, d, "orders").select("o_orderkey", words.alias("flag"))
    done = rules.apply_rules(df, [rules.Rule("r", rules.RuleType.TRANSFORM, 1, rules.always, rules.cast_to_bool("flag", "null"))])
    return done.select("o_orderkey", F.col("flag").cast("boolean").alias("flag"))


@query("SELECT _row_id, sha256(CAST(to_json({'age': age, 'city': city, 'email': email, 'id': id, 'name': name, 'region': region}) AS VARCHAR)) AS hash FROM bronze_customers")
def row_hash_wide(spark, d):
    return table(spark, d, "bronze_customers").select("_row_id", ids.row_hash(*_CUST).alias("hash"))


@query("WITH w AS (SELECT _stage, _batch_id, first(_row_id ORDER BY _processed_at NULLS LAST, _row_id) AS winner FROM deduplication_log GROUP BY 1, 2) SELECT l._row_id, l._stage, l._batch_id FROM deduplication_log l JOIN w ON w._stage = l._stage AND w._batch_id = l._batch_id AND w.winner = l._row_id")
def claims_won(spark, d):
    """Rows of the log whose claim on their stage and batch won."""
    log = table(spark, d, "deduplication_log")
    return dedup.won_rows(log, log, ["_stage", "_batch_id"], "_row_id", "_processed_at").select("_row_id", "_stage", "_batch_id")


@query("SELECT city, round(sum(total_sales), 2) AS sum_total_sales FROM silver_customers WHERE age > 55 GROUP BY 1")
def ask_numeric_filter(spark, d):
    return _ask("Show total sales by city where age is above 55", "silver_customers", table(spark, d, "silver_customers").select("region", "city", "age", "total_sales")).withColumn("sum_total_sales", F.round("sum_total_sales", 2))


@query("SELECT url AS t, url SIMILAR TO 'https?://[^[:space:]/$.?#].[^[:space:]]*' AS ok_url, uuid_text AS u, regexp_full_match(uuid_text, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') AS ok_uuid FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'http://a.example/' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'ftp://x/' || o_orderkey ELSE 'none' || o_orderkey END AS url, CASE WHEN o_orderkey % 2 = 0 THEN '00000000-0000-0000-0000-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') ELSE 'u' || o_orderkey END AS uuid_text FROM orders)")
def constraint_url_uuid(spark, d):
    k = F.col("o_orderkey")
    df = table(spark, d, "orders").select(F.when(k % 3 == 0, F.concat(F.lit("http://a.example/"), k)).when(k % 3 == 1, F.concat(F.lit("ftp://x/"), k)).otherwise(F.concat(F.lit("none"), k)).alias("t"), F.when(k % 2 == 0, F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(k.cast("string"), 12, "0"))).otherwise(F.concat(F.lit("u"), k)).alias("u"))
    return df.select("t", contracts.constraint_ok(F.col("t"), T.StringType(), contracts.Constraint("format", "url")).alias("ok_url"), "u", contracts.constraint_ok(F.col("u"), T.StringType(), contracts.Constraint("format", "uuid")).alias("ok_uuid"))


@query("SELECT p_partkey, regexp_full_match(p_brand, 'Brand#[1-3][0-9]') AS ok_regex, length(p_name) BETWEEN 5 AND 20 AS ok_length FROM part")
def constraint_regex_length(spark, d):
    df = table(spark, d, "part")
    both = [contracts.constraint_ok(F.col("p_name"), T.StringType(), contracts.Constraint(k, v)) for k, v in (("min", 5), ("max", 20))]
    return df.select("p_partkey", contracts.constraint_ok(F.col("p_brand"), T.StringType(), contracts.Constraint("regex", "^Brand#[1-3][0-9]$")).alias("ok_regex"), (both[0] & both[1]).alias("ok_length"))


@fixed("name_in, name_out", [("Order Date", "Order_Date"), ("2nd", "c_2nd"), ("a--b", "a__b"), ("", "_")])
def identifier_names(name_in):
    return text.identifier(name_in)


@fixed("column_name, low, high, kind", [("user_id", 0, 200, "UInt8"), ("n", 0, 200, "Int16"), ("n", -5, 100, "Int8"), ("user_id", 0, 70000, "UInt32"), ("user_id", -1, 70000, "Int32"), ("n", -1, 3000000000, "Int64")])
def integer_widths(column_name, low, high):
    return inference.integer_width(column_name, low, high)


@query("SELECT _source_id, _batch_id, count(*) AS row_count, round((count(*) FILTER (WHERE trim(id) <> '') + count(*) FILTER (WHERE trim(name) <> '') + count(*) FILTER (WHERE trim(email) <> '') + count(*) FILTER (WHERE trim(age) <> '') + count(*) FILTER (WHERE trim(region) <> '') + count(*) FILTER (WHERE trim(city) <> '')) / (6.0 * count(*)), 6) AS completeness FROM bronze_customers GROUP BY 1, 2")
def batch_completeness(spark, d):
    m = quality.batch_metrics(table(spark, d, "bronze_customers"), ["_source_id", "_batch_id"], _CUST, F.lit(1.0))
    return m.select("_source_id", "_batch_id", "row_count", F.round("completeness", 6).alias("completeness"))


@query("WITH k AS (SELECT _source_id, _batch_id, CASE WHEN regexp_full_match(trim(age), '[+-]?[0-9]+') THEN 'int' WHEN regexp_full_match(trim(age), '[+-]?[0-9]*[.][0-9]+') THEN 'float' WHEN lower(trim(age)) IN ('true', 'false') THEN 'bool' WHEN age IS NOT NULL THEN 'text' END AS look FROM bronze_customers) SELECT _source_id, _batch_id, CASE WHEN count(DISTINCT look) <= 1 THEN 1.0 ELSE 0.0 END AS consistency FROM k GROUP BY 1, 2")
def batch_consistency(spark, d):
    m = quality.batch_metrics(table(spark, d, "bronze_customers"), ["_source_id", "_batch_id"], ["age"], F.lit(1.0))
    return m.select("_source_id", "_batch_id", F.col("consistency").cast("double").alias("consistency"))


# ---- series, charts, streams ---------------------------------------------------------------------------------------------


@query("SELECT 'o_orderdate' AS time_column, 'o_totalprice' AS value_column")
def series_columns(spark, d):
    """Which columns of a result are its time and its value."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    when = series.choose_time(o)
    return spark.createDataFrame([(when, series.choose_value(o, when, "o_totalprice"))], "time_column string, value_column string")


@query("WITH h AS (SELECT CAST(ts AS DATE) AS ds, arg_max(CAST(value AS DOUBLE), event_id) AS v FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND isfinite(value) GROUP BY 1) SELECT ds, round(v, 4) AS value FROM h")
def series_cleaned(spark, d):
    """One value a day: the last row of a time wins."""
    e = table(spark, d, "events").select(F.to_date("ts").alias("ds"), "value", "event_id")
    return series.clean_series(e, "ds", "value", "event_id").select(F.col("ds").cast("date").alias("ds"), F.round("value", 4).alias("value"))


@query("SELECT * FROM (VALUES ('too few', false, 2), ('irregular', false, 6), ('daily', true, 7)) t(case_name, forecast, n_rows)")
def forecast_fallback(spark, d):
    """Series too short or too irregular give their history only."""
    out = []
    for name, days in (("too few", [0, 1]), ("irregular", [0, 1, 9, 10, 45, 46]), ("daily", [0, 1, 2, 3, 4])):
        df = spark.createDataFrame([(k, float(k)) for k in days], "k int, value double").select(F.date_add(F.lit("2026-01-01").cast("date"), F.col("k")).cast("timestamp").alias("ds"), "value")
        rows, made = series.forecast(df, 2, least=5)
        out.append((name, bool(made["forecast_available"]), rows.count()))
    return spark.createDataFrame(out, "case_name string, forecast boolean, n_rows int")


@query("SELECT extraction_id, last_offset FROM (SELECT *, row_number() OVER (PARTITION BY extraction_id ORDER BY updated_at DESC NULLS LAST) AS rn FROM extraction_checkpoints) WHERE rn = 1 AND upper(trim(status)) IN ('ACTIVE', 'FAILED') AND last_offset > 0")
def resumable_extractions(spark, d):
    from millrace.streaming import jobs

    return jobs.resumable(table(spark, d, "extraction_checkpoints")).select("extraction_id", "last_offset")


@fixed("done, total, seconds, percent, seconds_left", [(50, 200, 10.0, 25.0, 30.0), (0, 200, 10.0, 0.0, None), (300, 200, 3.0, 100.0, 0.0), (5, None, 1.0, None, None)])
def progress_shares(done, total, seconds):
    from millrace.streaming import jobs

    r = jobs.progress_figures(done, total, seconds)
    return r["percent"], r["seconds_left"]


@query("SELECT 'age' AS column_name, 'string' AS type UNION ALL SELECT 'id', 'int' UNION ALL SELECT 'email', 'string'")
def silver_types(spark, d):
    """Types of the silver table made from bronze rows."""
    made = pipeline.silver_schema_from(table(spark, d, "bronze_customers").select("_row_id", "id", "email", "age"))
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in made.fields if not f.name.startswith("_")], "column_name string, type string")


@query("SELECT * FROM (VALUES ('cc_nation', 'n_nationkey', 'int'), ('cc_nation', 'n_name', 'string'), ('cc_nation', 'n_regionkey', 'int')) t(table_name, column_name, type)")
def catalog_columns(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("cc_nation")
    return catalog.columns(spark, ["cc_nation"]).select("table_name", "column_name", "type")


@fixed("case_name, chart", [("one number", "card"), ("series", "line"), ("ranking", "bar"), ("pair", "scatter"), ("distribution", "histogram")])
def charts_by_intent(case_name):
    q = {"one number": "overall total revenue", "series": "total revenue per month", "ranking": "Which region has the highest population?", "pair": "What is the relationship between customers and total sales?", "distribution": "How are orders distributed?"}[case_name]
    return charts.recommend(planner.plan(q, [_POP, _FACT]))["type"]


@fixed("case_name, change_type, next_version, severity, compatible", [
    ("field added", "ADDITION", "1.1.0", "INFO", True), ("field removed", "DELETION", "2.0.0", "ERROR", False), ("type changed", "MODIFICATION", "2.0.0", "ERROR", False), ("made nullable", "MODIFICATION", "1.0.1", "WARNING", True), ("same", "NO_CHANGE", "1.0.0", "INFO", True),
])
def contract_evolution(case_name):
    i, c, a = contracts.Field("id", "integer", False), contracts.Field("city", "string"), contracts.Field("age", "integer")
    old = contracts.Contract("c", "1.0.0", (i, c))
    new = {"field added": (i, c, a), "field removed": (i,), "type changed": (i, contracts.Field("city", "integer")), "made nullable": (contracts.Field("id", "integer", True), c), "same": (i, c)}[case_name]
    e = contracts.evolve(old, contracts.Contract("c", "1.1.0", new))
    return e.change_type, e.next_version, e.severity, e.backward_compatible


# ---- SQL of queries that stand elsewhere -----------------------------------------------------------------------------------

_UUID5 = "substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(s, 17, 1))::INTEGER % 4 + 1 AS INTEGER), 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12)"
_RAW = f"""h AS (SELECT id, name, email, age, region, city, 'batch_crm_0_' || substr(sha256('crm:0'), 1, 8) AS b, sha256('crm:' || sha256(CAST(to_json({{'age': age, 'city': city, 'email': email, 'id': id, 'name': name, 'region': region}}) AS VARCHAR))) AS k FROM bronze_customers),
u AS (SELECT *, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('crm:' || b || ':' || k || ':extract')) AS s FROM h), raw AS (SELECT {_UUID5} AS _row_id, b AS _batch_id, 'crm' AS _source_id, TIMESTAMP '2025-01-01' AS _extracted_at, k AS _dedup_key, id, name, email, age, region, city FROM u)"""
ORACLES["bronze_rows"] = f"WITH {_RAW} SELECT * FROM raw"

_CLEAN = "nullif(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '')"
_WHOLE = "coalesce(try_cast({0} AS BIGINT) IS NOT NULL AND regexp_full_match({0}, '[+-]?[0-9]+(\\.[0-9]*)?'), false)"


def _checked(source: str, keep: str = "") -> str:
    """Cleaned rows of a source with what is wrong with them."""
    cleaned = ", ".join(f"{_CLEAN.format(x)} AS {x}" for x in _CUST)
    bad = f"id IS NULL OR NOT {_WHOLE.format('id')} OR try_cast(id AS DOUBLE) < 1 OR NOT coalesce(email IS NULL OR regexp_full_match(lower(email), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}'), false) OR (age IS NOT NULL AND (NOT {_WHOLE.format('age')} OR NOT coalesce(try_cast(age AS DOUBLE) BETWEEN 0 AND 150, false)))"
    return f"c AS (SELECT {keep}{cleaned} FROM {source}), k AS (SELECT *, coalesce(id, name, email, age, region, city) IS NULL AS nothing, {bad} AS bad FROM c)"


ORACLES["silver_rows"] = (
    f"WITH {_RAW}, {_checked('raw', '_row_id, _batch_id, _source_id, _dedup_key, _extracted_at, ')} SELECT _row_id AS _bronze_row_id, _batch_id, _source_id, _dedup_key, _extracted_at, TIMESTAMP '2025-01-01' AS _cleaned_at, '1.0.0' AS _cleaning_version, CAST(try_cast(id AS DOUBLE) AS BIGINT) AS id, name, lower(email) AS email, CAST(try_cast(age AS DOUBLE) AS BIGINT) AS age, region, city, "
    "CAST(1.0 AS DOUBLE) AS _quality_score, CAST(1.0 AS DOUBLE) AS _completeness_score, CAST(1.0 AS DOUBLE) AS _validity_score, ['low'] AS _applied_rules, CAST([] AS VARCHAR[]) AS _warnings FROM k WHERE NOT nothing AND NOT bad"
)
ORACLES["stream_pipeline"] = f"WITH d AS (SELECT DISTINCT id, name, email, age, region, city FROM bronze_customers), {_checked('d')} SELECT layer, count(*) AS n FROM (SELECT 'bronze' AS layer FROM k UNION ALL SELECT CASE WHEN nothing OR bad THEN 'quarantine' ELSE 'silver' END FROM k) GROUP BY 1"

_LOOK = "CASE WHEN regexp_full_match(trim({0}), '[+-]?[0-9]+') THEN 'int' WHEN regexp_full_match(trim({0}), '[+-]?[0-9]*[.][0-9]+') THEN 'float' WHEN lower(trim({0})) IN ('true', 'false') THEN 'bool' WHEN {0} IS NOT NULL THEN 'text' END"
ORACLES["quality_batch_metrics"] = (
    f"WITH m AS (SELECT _source_id, _batch_id, count(*) AS row_count, CAST(1.0 AS DOUBLE) AS validity, ({' + '.join(f'count(*) FILTER (WHERE trim({c}) <> {chr(39) * 2})' for c in _CUST)}) / (6.0 * count(*)) AS completeness, ({' + '.join(f'CASE WHEN count(DISTINCT {_LOOK.format(c)}) <= 1 THEN 1 ELSE 0 END' for c in _CUST)}) / 6.0 AS consistency FROM bronze_customers GROUP BY 1, 2) "
    "SELECT *, least(1.0, greatest(0.0, (completeness + validity + consistency) / 3.0)) AS quality FROM m"
)
_WIDTH = "CASE WHEN max(try_cast(trim({0}) AS BIGINT)) < 256 THEN 'UInt8' WHEN max(try_cast(trim({0}) AS BIGINT)) < 65536 THEN 'UInt16' WHEN max(try_cast(trim({0}) AS BIGINT)) < 4294967296 THEN 'UInt32' ELSE 'UInt64' END"
_SHARE = "avg(CASE WHEN regexp_full_match(trim({0}), '-?[1-9][0-9]*|-?0') THEN 1.0 ELSE 0 END) FILTER (WHERE trim({0}) <> '')"
_FILLED = "count(*) FILTER (WHERE trim({0}) <> '') / count(*)"
ORACLES["infer_types"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CASE WHEN whole > 0.95 AND whole * filled >= 0.95 THEN width ELSE 'String' END AS type, CAST(CASE WHEN whole > 0.95 AND whole * filled >= 0.95 THEN whole * filled ELSE 1.0 END AS DOUBLE) AS confidence FROM (SELECT {_SHARE.format(c)} AS whole, {_FILLED.format(c)} AS filled, {_WIDTH.format(c)} AS width FROM bronze_customers)" for c in _CUST
)


@query(f"WITH {_RAW}, {_checked('raw', '_row_id, ')} SELECT _row_id, CASE WHEN nothing THEN 'empty_row' ELSE 'validation_failed' END AS reason FROM k WHERE nothing OR bad")
def quarantine_reasons(spark, d):
    """Rows put aside, with the reason and an original that can be read again."""
    from millrace.plans.reference import QUERIES as more

    q = more["quarantine_rows"](spark, d).where(F.try_parse_json("_original_row").isNotNull())
    return q.select("_row_id", F.col("_quarantine_reason").alias("reason"))


_NUMBERS = {"customer_id": "CAST(customer_id AS DOUBLE)", "age": "CAST(age AS DOUBLE)", "signup_date": "CAST(signup_date - DATE '1970-01-01' AS DOUBLE)", "total_sales": "total_sales", "_quality_score": "CAST(_quality_score AS DOUBLE)", "_completeness_score": "CAST(_completeness_score AS DOUBLE)", "_validity_score": "CAST(_validity_score AS DOUBLE)"}
_TEXTS = ("_cleaning_version", "email", "region", "city", "phone")
_ROWS = f"r AS (SELECT DISTINCT _row_id, _batch_id, regexp_extract(_batch_id, '^batch_(.*)_[^_]*_[^_]*$', 1) AS src, {', '.join([*_NUMBERS, *_TEXTS])} FROM silver_customers WHERE _batch_id IS NOT NULL)"
_PARTS = [f"SELECT src, _batch_id AS load, '{c}' AS col, count(*) AS n_rows, count(*) FILTER (WHERE v IS NULL OR NOT isfinite(v)) AS n_null, count(DISTINCT v) FILTER (WHERE isfinite(v)) AS n_distinct, min(v) FILTER (WHERE isfinite(v)) AS lo_num, max(v) FILTER (WHERE isfinite(v)) AS hi_num, quantile_disc(v, 0.5) FILTER (WHERE isfinite(v)) AS median FROM (SELECT src, _batch_id, {e} AS v FROM r) GROUP BY 1, 2" for c, e in _NUMBERS.items()]
_PARTS += [f"SELECT src, _batch_id, '{c}', count(*), count(*) FILTER (WHERE coalesce(trim({c}), '') = ''), count(DISTINCT {c}) FILTER (WHERE trim({c}) <> ''), NULL, NULL, NULL FROM r GROUP BY 1, 2" for c in _TEXTS]


@query(f"WITH {_ROWS} {' UNION ALL '.join(_PARTS)}")
def p7_basics(spark, d):
    """What of the profile plain SQL can say: rows, nulls, distinct values, range and median of every load and column."""
    from millrace.plans.problems import p7_profile

    p = p7_profile(spark, d).where("col not like '%#%'")
    return p.select("src", "load", "col", "n_rows", "n_null", "n_distinct", "lo_num", "hi_num", F.get("q", F.lit(2)).alias("median"))
