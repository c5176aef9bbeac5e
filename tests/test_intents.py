"""Structured intents, the bronze write in one, appends undone, files under their own headers."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans import coverage, intents, pipeline, planner
from millrace.session import release, scratch_path
from millrace.sources import readers, writers

POP = planner.table_info("population", coverage._struct("region string, city string, total_population double, age double, employment_rate double, exam_score string"))
DRAFT = {"table": "etl.population", "metrics": [{"column": "age", "aggregation": "AVG"}], "dimensions": ["region"], "filters": [], "order_by": [], "limit": None}


def test_passes_repair_or_refuse():
    ask = lambda **k: intents.validate("average age per region above 18", DRAFT | k, [POP])
    sound = ask()
    assert sound.valid and not sound.repairs and sound.ir.metrics[0].column == "age" and sound.ir.dimensions == ("region",)
    assert ask(table="moon").problems == ["unknown table moon"] and not ask(metrics=[{"column": "zz"}]).valid
    assert ask(dimensions=["region", "planet"]).intent["dimensions"] == ["region"]
    assert ask(filters=[{"column": "age", "operator": ">", "value": "18"}]).ir.filters[0].value == 18
    assert not ask(filters=[{"column": "age", "operator": ">", "value": "above"}]).valid
    assert ask(filters=[{"column": "city", "operator": "=", "value": "atlantis"}]).intent["filters"] == []
    assert ask(order_by=[{"column": "avg_age", "direction": "DESC"}]).ir.limit == 1
    counted = ask(metrics=[{"column": "city", "aggregation": "SUM"}])
    assert counted.ir.metrics[0].aggregation == "COUNT" and DRAFT["metrics"][0]["aggregation"] == "AVG", "the draft stays as it was"
    cast = intents.validate("average exam score per region", DRAFT | {"metrics": [{"column": "exam_score", "aggregation": "AVG"}]}, [POP])
    assert cast.valid and cast.casts == {"exam_score": "double"}
    assert ask(metrics=[]).ir.metrics[0].column == "*" and not ask(limit=-1).valid
    assert intents.validate("", {}, []).problems == ["unknown table None"]


def test_phrases_and_resolution():
    assert intents.correct_phrases("employmnt rat by city", [POP])[0] == "employment_rate by city"
    assert intents.correct_phrases("", [POP]) == ("", []) and intents.correct_phrases("show the by per", [POP])[1] == []
    assert intents.resolve("regions", [POP]).column == "region" and intents.resolve("qqq", [POP]).outcome == "unmatched"
    assert intents.resolve("anything", []).outcome == "unmatched"


def test_bronze_write_and_undo(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", None), (" ", "x")], "id string, _name string").withColumnRenamed("_name", "name")
    path = str(tmp_path / "bronze")
    first = writers.write_bronze(rows, path, "crm", 0, ["id"], sleep=lambda s: None)
    assert first == {"read": 4, "refused": 1, "repeated": 1, "written": 2}
    assert writers.write_bronze(rows, path, "crm", 1, ["id"])["written"] == 0 and writers.write_bronze(rows.limit(0), path, "crm", 2)["written"] == 0
    more = spark.createDataFrame([("9", "z")], "id string, name string")
    fresh = pipeline.bronze_fresh(more, "crm", 3, None, spark.read.parquet(path))
    fresh.write.mode("append").parquet(path)
    assert writers.undo(spark, path, fresh, ["_dedup_key"]) >= 1 and spark.read.parquet(path).count() == 2
    message = pipeline.bronze_again(spark.read.parquet(path), "crm").first()
    assert set(json.loads(message["value"])["data"]) == {"id", "name"}


def test_load_that_fails(spark, tmp_path):
    tried = []
    with pytest.raises(Exception):
        writers.resilient_load(spark.createDataFrame([(1,)], "k int"), "nosuch://x/y", ["k"], str(tmp_path / "dead"), tries=3, sleep=tried.append)
    letter = spark.read.parquet(str(tmp_path / "dead")).first()
    assert letter["message"] == '{"k":1}' and letter["error"] and len(tried) == 2


def test_files_under_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# x\nid,name\n1,a\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("# y\nname,id,extra\nb,2,e\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("", encoding="utf-8")
    df = readers.read_csv(spark, str(tmp_path), skip_rows=1, provenance=True)
    got = {r["id"]: (r["name"], r["extra"], r["_file_name"]) for r in df.collect()}
    assert got == {"1": ("a", None, "a.csv"), "2": ("b", "e", "b.csv")}
    typed = readers.read_csv(spark, str(tmp_path), skip_rows=1, schema=T.StructType([T.StructField("id", T.IntegerType()), T.StructField("none", T.StringType())]))
    assert sorted(map(tuple, typed.collect())) == [(1, None), (2, None)]
    assert readers.estimate_rows(spark, str(tmp_path / "a.csv")) == 2 and readers.read_csv(spark, str(tmp_path / "c.csv"), skip_rows=1).count() == 0


def test_scratch_is_released(spark):
    release(spark)
    path = scratch_path(spark, "x")
    spark.range(1).write.parquet(path)
    assert release(spark, keep=1) == 0 and spark.read.parquet(path).count() == 1
    assert release(spark) == 1 and release(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(path).select(F.col("id")).count()
