import datetime as dt
import math
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.functions import ids, text, times
from millrace.operators import contracts as C
from millrace.operators import dedup, inference, quality

USER = C.Contract("user_schema", "1.0.0", (
    C.Field("id", "integer", False, (C.Constraint("min", 1),)),
    C.Field("username", "string", False, (C.Constraint("min", 3), C.Constraint("max", 20), C.Constraint("regex", "^[a-zA-Z0-9_]+$"))),
    C.Field("email", "string", True, (C.Constraint("format", "email"),)),
    C.Field("age", "integer", True, (C.Constraint("range", [0, 150]),)),
))


def test_contract_rows(spark):
    df = spark.createDataFrame([(1, "john_doe", "j@x.org", 30), (0, "jo", "bad", 200), (None, None, None, None)], "id bigint, username string, email string, age int")
    got = C.validate(df, USER).collect()
    assert [r["_validity"] for r in got] == [True, False, False]
    assert [round(r["_contract_score"], 2) for r in got] == [1.0, 0.0, 0.5]
    assert got[1]["_violations"] == ["id: min", "username: min", "email: format", "age: range"]
    assert got[2]["_violations"] == ["id: null", "username: null"]


def test_contract_absent_unknown_unique_and_types(spark):
    df = spark.createDataFrame([(1, "a", "2024-02-30", "2024-02-01T10:00:00Z"), (1, "b", "2024-02-29", "x")], "id bigint, extra string, day string, at string")
    k = C.Contract("c", "1.0.0", (C.Field("id", "integer", False, (C.Constraint("unique"),)), C.Field("gone", "string"), C.Field("day", "date"), C.Field("at", "timestamp")))
    got = sorted(C.validate(df, k).collect(), key=lambda r: r["extra"])
    assert got[0]["_violations"] == ["id: unique", "day: not date"] and got[1]["_violations"] == ["id: unique", "at: not timestamp"]
    assert got[0]["_validation_warnings"] == ["extra: unknown field"] and got[0]["_contract_score"] == pytest.approx(1.5 / 4)
    good, bad = C.split_valid(df, k)
    assert good.count() == 0 and bad.count() == 2
    assert C.batch_validation(df.limit(0), k).first().asDict() == {"n_rows": 0, "n_valid": 0, "n_invalid": 0, "mean_score": None}


def test_warning_severity_and_json():
    k = C.Contract("c", "2.0.0", (C.Field("a", "integer", True, (C.Constraint("min", 1, "warning"),), 5, "text"),))
    assert C.Contract.from_json(k.to_json()) == k
    assert k.struct()["a"].dataType.simpleString() == "bigint"


def test_evolution():
    one = C.Contract("s", "1.2.3", (C.Field("a", "integer"), C.Field("b", "string", True, (C.Constraint("max", 5),))))

    def to(*fields):
        return C.evolve(one, C.Contract("s", "x", fields))

    assert to(*one.fields).change_type == "NO_CHANGE"
    added = to(*one.fields, C.Field("c", "string"))
    assert (added.change_type, added.backward_compatible, added.next_version, added.severity) == ("ADDITION", True, "1.3.0", "INFO")
    assert to(*one.fields, C.Field("c", "string", False)).next_version == "2.0.0"
    gone = to(one.fields[0])
    assert (gone.change_type, gone.next_version, gone.severity) == ("DELETION", "2.0.0", "ERROR")
    wider = to(one.fields[0], C.Field("b", "string", True, (C.Constraint("max", 9),)))
    assert (wider.change_type, wider.backward_compatible, wider.next_version, wider.severity) == ("MODIFICATION", True, "1.2.4", "WARNING")
    assert not to(one.fields[0], C.Field("b", "string", True, (C.Constraint("max", 2),))).backward_compatible
    assert not to(C.Field("a", "float"), one.fields[1]).backward_compatible


def test_resolver_order(spark):
    k = C.Contract("s", "1", (C.Field("a", "string"),))
    r = C.ContractResolver((lambda s, v: k.to_json() if v == "9" else None,))
    r.register("src", k)
    assert r.resolve("src", "1") is k and r.resolve("other", "1", schema_id="s") is k and r.resolve("x", "9") == k and r.resolve("x", "8") is None
    assert r.resolve("x", "8", inline=k.to_json()) == k
    store = C.table_store(spark.createDataFrame([("s", "1", "old", dt.datetime(2024, 1, 1)), ("s", "1", "new", dt.datetime(2024, 1, 2))], "source_id string, schema_version string, contract_json string, updated_at timestamp"))
    assert store("s", "1") == "new" and store("s", "2") is None


def test_row_scores(spark):
    df = spark.createDataFrame([("x", None, " ", 2), ("x", "y", "z", 12)], "a string, b string, c string, n int")
    got = quality.score_rows(df, ["a", "b", "c"], F.col("n")).collect()
    assert got[0]["_completeness_score"] == pytest.approx(1 / 3) and got[0]["_validity_score"] == pytest.approx(0.8) and got[1]["_validity_score"] == 0.0
    assert got[0]["_quality_score"] == pytest.approx(0.4 / 3 + 0.48)
    assert quality.score_rows(df, [], F.lit(0)).first()["_quality_score"] == 1.0
    with pytest.raises(ValueError):
        quality.overall(F.lit(1), F.lit(1), 0.5, 0.6)


def test_batch_metrics(spark):
    df = spark.createDataFrame([("b", "1", "x"), ("b", "two", None)], "batch string, a string, c string")
    m = quality.batch_metrics(df, ["batch"], ["a", "c"], F.lit(0.5)).first()
    assert (m["completeness"], m["validity"], m["consistency"]) == (0.75, 0.5, 0.5) and m["quality"] == pytest.approx((0.75 + 0.5 + 0.5) / 3)


def test_deviation_modes(spark):
    df = spark.createDataFrame([("s", i, 10.0 + i % 2) for i in range(8)] + [("s", 8, 50.0)], "s string, t int, v double")
    last = quality.deviation(df, ["s"], ["t"], "v").where("t = 8").first()
    assert last["is_anomaly"] and last["n_seen"] == 8
    assert not quality.deviation(df, ["s"], ["t"], "v", include_current=True).where("t = 8").first()["is_anomaly"]
    assert not quality.deviation(df, ["s"], ["t"], "v").where("t = 3").first()["is_anomaly"]


def test_keys_and_ids(spark):
    df = spark.createDataFrame([("s", 100, "k", "é"), ("s", 200, "k", None)], "src string, off int, k string, v string")
    got = df.select(ids.uuid5(F.col("v")).alias("u"), ids.batch_id(F.col("src"), F.col("off")).alias("b"), ids.row_hash("k", "v").alias("h")).collect()
    assert got[0]["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "é")) and got[1]["u"] is None
    assert got[0]["b"].startswith("batch_s_100_") and len(got[0]["b"]) == len("batch_s_100_") + 8 and got[0]["h"] != got[1]["h"]
    assert df.select(ids.row_hash("v", "k").alias("h")).first()["h"] == got[0]["h"]


def test_dedup_ops(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), (None, 5, "n"), (None, 4, "m"), ("a", 1, "w")], "k string, t int, v string")
    first = {(r["k"], r["v"]) for r in dedup.first_wins(df, ["k"], [F.col("t"), F.col("v")]).collect()}
    assert first == {("a", "w"), (None, "m")}
    assert {(r["k"], r["v"]) for r in dedup.latest_per_key(df, ["k"], "t").collect()} == {("a", "y"), (None, "n")}
    target = spark.createDataFrame([("a",), (None,)], "k string")
    assert dedup.anti_load(df, target, ["k"]).count() == 0 and dedup.anti_load(df, target.where("k is null"), ["k"]).count() == 3
    w = {r["k"]: r["winner"] for r in dedup.claim_winners(df, ["k"], "v", "t").collect()}
    assert w == {"a": "w", None: "m"}
    assert dedup.won_rows(df.where("k is not null"), df, ["k"], "v", "t").collect()[0]["v"] == "w"
    assert dedup.reconcile(df, target).first().asDict() == {"n_left": 5, "n_right": 2, "difference": 3, "percent": 60.0}
    n = dedup.neighbours(spark.createDataFrame([("p",), ("c",), ("z",)], "id string"), spark.createDataFrame([("p", "c"), ("p", "c"), ("q", "r")], "parent string, child string")).collect()
    assert sorted(map(tuple, n)) == [("c", "parent", "p"), ("p", "child", "c")]


INFER = {
    "ints": (["1", "2", "3", "42", "100"], "Int8"), "user_id": (["1", "300"], "UInt16"), "neg": (["-5", "40000"], "Int32"), "bools": (["true", "no", "Y"], "Bool"), "floats": (["1.5", "2.25"], "Float64"),
    "days": (["2024-01-01", "2024-02-03"], "Date"), "stamps": (["2024-01-01T10:00:00", "2024-01-01 11:00:00"], "DateTime64(3)"), "lists": (["1,2,3", "4, 5"], "Array(Int64)"), "zips": (["00501", "01234"], "String"),
    "mixed": (["123", "abc", "456"], "String"), "empty": ([None, ""], "String"),
}


@pytest.mark.parametrize("name", list(INFER))
def test_infer(spark, name):
    values, want = INFER[name]
    got = inference.infer_types(spark.createDataFrame([(v,) for v in values], f"{name} string"))
    assert got[name][0] == want


def test_infer_strategies_and_typed(spark):
    df = spark.createDataFrame([(str(i),) for i in range(97)] + [(None,)] * 3, "a string")
    assert inference.infer_types(df, "conservative")["a"][0] == "Int8" and inference.infer_types(df, "strict")["a"][0] == "String"
    out = inference.typed(spark.createDataFrame([("1,2", "7")], "l string, n string"), {"l": ("Array(Int64)", 1.0), "n": ("Int8", 1.0)}).first()
    assert out["l"] == [1, 2] and out["n"] == 7
    c = inference.infer_contract(spark.createDataFrame([(1, "a", "2024-01-01"), (5, None, "2024-01-02")], "id int, g string, d string"), "s")
    f = {x.name: x for x in c.fields}
    assert not f["id"].nullable and f["g"].nullable and f["d"].type == "date" and C.Constraint("min", 1) in f["id"].constraints and C.Constraint("enum", ["a"]) in f["g"].constraints
    assert inference.confidence(1, 1, 1) == pytest.approx(1.0)


def test_text_and_times(spark):
    assert text.identifiers(["a b", "a-b", "1x", ""]) == ["a_b", "a_b_2", "c_1x", "_"]
    assert text.time_pattern("%d/%m/%Y %H:%M") == "dd/MM/yyyy HH:mm"
    df = spark.createDataFrame([("2024-05-05T10:20:30Z",), ("2024-05-05 10:20:30",), ("1714904430",), ("1714904430000",), ("05/05/2024",), ("x",), (None,)], "s string")
    got = [r[0] for r in df.select(times.parse_time(F.col("s"))).collect()]
    assert got[:4] == [dt.datetime(2024, 5, 5, 10, 20, 30)] * 4 and got[4] == dt.datetime(2024, 5, 5) and got[5] is None and got[6] is None
    d = spark.createDataFrame([(dt.datetime(2024, 5, 8, 13, 5),)], "t timestamp")
    b = d.select(*[times.bucket(F.col("t"), g).alias(g) for g in times.GRANULARITIES], times.bucket(F.col("t"), "week", "monday").alias("iso"), times.bucket(F.col("t"), "year", year_as_date=True).alias("yd")).first()
    assert b["hour"] == dt.datetime(2024, 5, 8, 13) and b["week"] == dt.date(2024, 5, 5) and b["iso"] == dt.date(2024, 5, 6) and b["month"] == dt.date(2024, 5, 1) and b["quarter"] == dt.date(2024, 4, 1) and b["year"] == 2024 and b["yd"] == dt.date(2024, 1, 1)
    f = spark.createDataFrame([(float("nan"),), (math.inf,), (1.5,)], "v double").select(text.finite(F.col("v"))).collect()
    assert [r[0] for r in f] == [0.0, 0.0, 1.5]
