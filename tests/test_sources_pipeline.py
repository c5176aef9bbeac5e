import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import validators
from millrace.operators import contracts as C
from millrace.operators import dedup
from millrace.operators.exactly_once import QuotientStore
from millrace.operators.inference import loader_type
from millrace.operators.rules import load_rules
from millrace.plans import pipeline
from millrace.sources import catalog, messages, readers, writers
from millrace.streaming import jobs


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,name\n1,"a\nb"\n2,"say ""x"""\n3,\n', encoding="utf-8")
    df = readers.read_csv(spark, str(p), provenance=True)
    assert [(r["id"], r["name"]) for r in df.orderBy("id").collect()] == [("1", "a\nb"), ("2", 'say "x"'), ("3", None)]
    assert df.first()["_file_name"] == "a.csv" and df.first()["_file_size"] > 0
    rows, more = readers.page(df.select("id"), ["id"], 1, 1)
    assert [r["id"] for r in rows.collect()] == ["2"] and more
    assert [len(x.collect()) for x in readers.iterate_pages(df.select("id"), ["id"], 2)] == [2, 1]
    q = tmp_path / "b.csv"
    q.write_bytes("# note\nid;name\n1;é\n".encode("latin-1"))
    assert readers.detect_encoding(str(q)) == "latin-1" and readers.detect_encoding(str(p)) == "utf-8"
    assert readers.read_csv(spark, str(q), ";", encoding="latin-1", skip_rows=1).collect()[0].asDict() == {"id": "1", "name": "é"}
    for bad in ({"delimiter": ";;"}, {"encoding": "nope"}, {"skip_rows": -1}):
        with pytest.raises(readers.SourceError):
            readers.check_csv_options(**bad)


def test_files_and_uploads(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "x.parquet"))
    assert readers.read_file(spark, str(tmp_path / "x.parquet")).count() == 2
    for bad in ("a.exe", "../a.csv"):
        with pytest.raises(readers.SourceError):
            readers.check_upload(bad, 5)
    with pytest.raises(readers.SourceError):
        readers.check_upload("a.csv", 0)
    readers.check_upload("a.parquet", 10)


def test_database_sql():
    assert readers.scan_sql('s.t"x', "postgres", "a = 1", "id", 5) == 'SELECT * FROM "s"."t""x" WHERE (a = 1) AND "id" > 5'
    assert readers.scan_sql("t", "mysql", None, "k", "it's") == "SELECT * FROM `t` WHERE `k` > 'it''s'"
    for bad in ("a; drop table t", "a -- x", "a /* x */"):
        with pytest.raises(readers.SourceError):
            readers.safe_where(bad)
    assert readers.jdbc_url("mysql", "db.host", 3306, "d") == "jdbc:mysql://db.host:3306/d"
    for bad in (("oracle", "h", 1, "d"), ("mysql", "h/x", 1, "d"), ("mysql", "h", 0, "d"), ("mysql", "h", 1, "d?x")):
        with pytest.raises(readers.SourceError):
            readers.jdbc_url(*bad)
    assert "pg_index" in readers.key_query("postgres", "t") and "PRIMARY" in readers.key_query("mysql", "t")


def test_messages_required_and_marks(spark):
    m = spark.createDataFrame([(json.dumps({"source_id": "s", "rows": [{"a": "1"}, {"a": None}]}),), (json.dumps({"source_id": "t", "data": {"b": "2"}}),), ("no json",), (None,)], "value string")
    rows = readers.explode_messages(m).collect()
    assert sorted((r["source_id"], r["row_index"], str(r["data"])) for r in rows) == [("s", 0, "{'a': '1'}"), ("s", 1, "{'a': None}"), ("t", 0, "{'b': '2'}")]
    df = spark.createDataFrame([("x", float("nan")), (" ", 1.0)], "a string, n double")
    assert [r[0] for r in df.select(readers.required_errors(df, ["a", "n", "z"])).collect()] == [["n: empty", "z: missing"], ["a: empty", "z: missing"]]
    one = readers.advance(None, spark.createDataFrame([(9,), (10,)], "id bigint"), "t", "id")
    two = readers.advance(one, spark.createDataFrame([(7,)], "id bigint"), "t", "id")
    assert [tuple(r) for r in two.collect()] == [("t", "10")]
    assert readers.advance(two, spark.createDataFrame([], "id bigint"), "u", "id").count() == 1


def test_breaker_and_retry():
    now = [0.0]
    b = writers.CircuitBreaker(2, 30, lambda: now[0])
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            b.call(lambda: 1 / 0)
    with pytest.raises(writers.LoadError):
        b.call(lambda: 1)
    now[0] = 31
    assert b.call(lambda: 1) == 1
    waits, tries = [], iter([0, 0, 1])
    assert writers.with_retry(lambda: 1 / next(tries), 3, 1, 5, waits.append) == 1.0 and waits == [1, 2]


def test_staged_load_and_evolution(spark, tmp_path):
    p = str(tmp_path / "t")
    assert writers.staged_load(spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int"), p, ["k"], [F.col("v")]) == 2
    assert writers.staged_load(spark.createDataFrame([("a", 9, "x"), ("b", 4, "y"), (None, 5, "z")], "k string, v int, w string"), p, ["k"], [F.col("v")]) == 1
    assert sorted((str(r["k"]), r["v"], r["w"]) for r in writers.read_target(spark, p).collect()) == [("None", 3, None), ("a", 1, None), ("b", 4, "y")]
    assert writers.read_target(spark, str(tmp_path / "none")) is None
    writers.append_monthly(spark.createDataFrame([(dt.datetime(2024, 5, 1),)], "t timestamp"), str(tmp_path / "m"), "t")
    assert (tmp_path / "m" / "yyyymm=202405").exists()
    q = writers.quarantine_rows(spark.createDataFrame([("x", None)], "a string, b string"), F.lit("why"), F.array(F.lit("e")), F.lit("s"), F.lit("b"))
    assert json.loads(q.first()["_original_row"]) == {"a": "x", "b": None}
    done = writers.mark_reprocessed(q, q)
    assert done.first()["_reprocessed"] and writers.quarantine_page(q, reprocessed=True).count() == 0
    old = spark.createDataFrame([(dt.datetime(2020, 1, 1),), (None,), (dt.datetime(2024, 1, 9),)], "t timestamp")
    assert writers.purge(old, "t", 5, F.lit("2024-01-10").cast("timestamp")).count() == 2
    assert json.loads(writers.metadata_event(old.limit(1), "loading", rows=3).first()["details"]) == {"rows": 3}


USERS = C.Contract("u", "1.0.0", (C.Field("id", "integer", False), C.Field("name", "string"), C.Field("age", "integer", True, (C.Constraint("range", [0, 150]),))))


def test_transform_outcomes(spark):
    raw = pipeline.bronze(spark.createDataFrame([("1", "  Ann\n Lee ", "30"), ("x", "Bob", "5"), ("3", "Cy", "200"), (" ", None, ""), ("4.0", "Di", None)], "id string, name string, age string"), "s", 7)
    out = pipeline.transform(raw, USERS, load_rules("transformation_rules: [{rule_id: up, rule_type: CLEAN, priority: 1, condition: {type: always}, action: {type: uppercase_field, field_name: name}}]"))
    silver = {r["id"]: r for r in out.silver.collect()}
    assert set(silver) == {1, 4} and silver[1]["name"] == "ANN LEE" and silver[1]["age"] == 30 and silver[1]["_applied_rules"] == ["up"] and silver[1]["_quality_score"] == 1.0
    bad = {json.loads(r["_original_row"])["id"]: (r["_quarantine_reason"], r["_validation_errors"]) for r in out.quarantine.collect()}
    assert bad["x"] == ("validation_failed", ["id: not integer", "id: null"]) and bad["3"] == ("validation_failed", ["age: range"]) and bad[" "][0] == "empty_row"
    assert out.metrics.first()["row_count"] == 5
    ids = [r["_row_id"] for r in raw.collect()]
    assert len(set(ids)) == 5 and ids == [r["_row_id"] for r in pipeline.bronze(raw.select("id", "name", "age"), "s", 7).collect()]


def test_missing_contract_modes(spark):
    raw = pipeline.bronze(spark.createDataFrame([("1",)], "id string"), "s")
    assert pipeline.transform(raw, None, missing="warn").silver.count() == 1
    assert pipeline.transform(raw, None, missing="strict").quarantine.first()["_quarantine_reason"] == "missing_schema_contract"
    assert pipeline.transform(raw.limit(0), USERS).silver.count() == 0 and "_quality_score" in pipeline.silver_schema(USERS).fieldNames()
    with pytest.raises(ValueError):
        pipeline.transform(raw, None, missing="nope")


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id string, name string, age string"
    spark.createDataFrame([("1", "a", "5"), ("1", "a", "5"), ("x", "b", "6")], schema).coalesce(1).write.parquet(src)
    each = jobs.medallion(out, "s", USERS)
    jobs.run_available(jobs.file_stream(spark, src, schema), each, out + "-cp")
    spark.createDataFrame([("1", "a", "5"), ("2", "c", "7")], schema).coalesce(1).write.mode("append").parquet(src)
    jobs.run_available(jobs.file_stream(spark, src, schema), each, out + "-cp")
    assert [spark.read.parquet(f"{out}/{k}").count() for k in ("bronze", "silver", "quarantine")] == [3, 2, 1]
    each(spark.createDataFrame([("1", "a", "5"), ("2", "c", "7")], schema), 1)
    assert spark.read.parquet(f"{out}/silver").count() == 2, "a retried micro-batch replaces its own rows"


def test_once_only_stream(spark, tmp_path):
    store = QuotientStore(spark, str(tmp_path / "store"))
    each = jobs.once_only(store, str(tmp_path / "kept"))
    cols = "_dedup_key string, _batch_id string, _stage string, _processed_at timestamp, _row_id string"
    k1, k2 = "a" * 64, "b" * 64
    t = dt.datetime(2024, 1, 1)
    each(spark.createDataFrame([(k1, "b1", "load", t, "r1"), (k1.upper(), "b1", "load", t, "r0")], cols), 0)
    each(spark.createDataFrame([(k1, "b2", "load", t, "r2"), (k2, "b2", "load", t, "r3"), (k1, "b2", "extract", t, "r4")], cols), 1)
    each(spark.createDataFrame([(k1, "b2", "load", t, "r2"), (k2, "b2", "load", t, "r3"), (k1, "b2", "extract", t, "r4")], cols), 1)
    rows = spark.read.parquet(str(tmp_path / "kept")).collect()
    assert sorted((r["_dedup_key"][0], r["_stage"], r["_row_id"]) for r in rows) == [("a", "extract", "r4"), ("a", "load", "r0"), ("b", "load", "r3")]


def test_resumable(spark):
    c = spark.createDataFrame([("a", "ACTIVE", 5, dt.datetime(2024, 1, 1)), ("a", "COMPLETED", 9, dt.datetime(2024, 1, 2)), ("b", "failed", 3, dt.datetime(2024, 1, 1)), ("c", "ACTIVE", 0, dt.datetime(2024, 1, 1))], "extraction_id string, status string, last_offset bigint, updated_at timestamp")
    assert [r["extraction_id"] for r in jobs.resumable(c).collect()] == ["b"]


def test_message_checks(spark):
    rows = [
        ({"type": "file", "filename": "a.csv", "path": "/x", "size": 5}, []), ({"type": "file", "filename": "a" * 300, "path": "/x", "size": -1}, ["filename: too long", "size: too small"]), ({"type": "ftp"}, ["type: not one of file, database"]),
        ({"type": "database", "db_type": "mysql", "host": "h", "user": "u", "password": "p", "database": "d", "port": "1"}, ["port: not integer"]), ({}, ["type: missing"]), ({"type": None}, ["type: missing"]), ({"type": " "}, ["type: empty"]),
    ]
    df = spark.createDataFrame([(i, json.dumps(m)) for i, (m, _) in enumerate(rows)] + [(90, "no json"), (91, None), (92, "[1]")], "i int, value string")
    got = {r["i"]: r["p"] for r in df.select("i", messages.problems(F.col("value"), "connection_topic").alias("p")).collect()}
    assert [got[i] for i in range(len(rows))] == [w for _, w in rows] and got[90] == got[91] == got[92] == ["message: no JSON object"]
    good, bad = messages.split_messages(df, "connection_topic")
    assert [r["i"] for r in good.collect()] == [0] and bad.count() == 9
    row = spark.createDataFrame([(json.dumps({"source": "s", "source_id": "i", "schema_version": "1", "quality_score": 1.5}),)], "value string")
    assert messages.split_messages(row, "clean_rows_topic")[1].first()["_validation_errors"] == ["quality_score: too large", "data: neither data nor rows"]
    with pytest.raises(ValueError):
        messages.problems(F.col("value"), "nope")


def test_values_names_and_types():
    ok = {"host": "db.x.org", "port": 5432, "database": "d_1", "user": "me@x"}
    assert validators.problems(ok, validators.CONNECTION) == []
    assert validators.problems({"host": "a..b", "port": True, "database": "d;x"}, validators.CONNECTION) == ["host has a bad form", "port must be int", "database has a bad form", "user is required"]
    assert validators.Value("x").one_of(1, 2).problem(3) and validators.Value("x").length(2).problem("a") and not validators.Value("x").kind(str).problem(None)
    for bad in ("a b", "a;drop", "a.b.c", ""):
        with pytest.raises(ValueError):
            catalog.safe_name(bad)
    assert [loader_type("x", v) for v in (True, 1, 1.5, "a", "2024-01-01T10:00:00", dt.datetime(2024, 1, 1), dt.date(2024, 1, 1))] == ["boolean", "bigint", "double", "string", "timestamp", "timestamp", "date"] and loader_type("made_at", "x") == "timestamp"


def test_catalog_tables(spark):
    df = spark.createDataFrame([(1, "x")], "id int, name string")
    for t in ("mr_a", "mr_b", "mr_c"):
        catalog.drop(spark, t)
    catalog.create(spark, "mr_a", df.select("id").schema)
    assert catalog.add_columns(spark, "mr_a", df) == ["name"] and catalog.add_columns(spark, "mr_a", df) == []
    catalog.create_like(spark, "mr_b", "mr_a")
    catalog.rename(spark, "mr_b", "mr_c")
    df.write.insertInto("mr_c")
    assert catalog.exists(spark, "mr_c") and not catalog.exists(spark, "mr_b") and {"mr_a", "mr_c"} <= set(catalog.tables(spark)) and spark.table("mr_c").count() == 1
    for t in ("mr_a", "mr_c"):
        catalog.drop(spark, t)


def test_reprocess_and_rollback(spark):
    raw = pipeline.bronze(spark.createDataFrame([("1", "a", "200"), ("x", "b", "5")], "id string, name string, age string"), "s")
    q = pipeline.transform(raw, USERS).quarantine
    wider = C.Contract("u", "1.1.0", (C.Field("id", "integer", False), C.Field("name", "string"), C.Field("age", "integer", True, (C.Constraint("range", [0, 250]),))))
    out, done = pipeline.reprocess(q, wider)
    assert out.silver.count() == 1 and out.quarantine.count() == 1
    marked = writers.mark_reprocessed(q, done)
    assert marked.where("_reprocessed").count() == 1 and pipeline.reprocess(marked, wider)[0].silver.count() == 0
    log = spark.createDataFrame([("k", "r1"), ("k", "r2"), (None, "r3")], "k string, r string")
    assert sorted(r["r"] for r in dedup.rollback_claims(log, log.where("r <> 'r2'"), ["k"], "r").collect()) == ["r2"]
