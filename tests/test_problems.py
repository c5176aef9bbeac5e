"""The core data problems on small made-up tables: odd values, empty tables, repeated rows, clashing names, brute force."""

import datetime as dt
import hashlib
import json
import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import exactly_once, orphans, profile, row_parse, schema_drift, spikes

T0 = dt.datetime(2025, 3, 1)


# ---- messages delivered more than once -------------------------------------------------------------------


def test_permutation_is_invertible():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 2**63, (1000, 4), dtype=np.uint64)
    w[0] = 0
    w[1] = 2**64 - 1
    p = exactly_once.permute(w)
    assert (exactly_once.unpermute(p) == w).all() and len(np.unique(p[:, 0])) > 990


def test_shards_are_handed_on_one_stretch_at_a_time(monkeypatch):
    monkeypatch.setattr(exactly_once, "FLUSH_ENTRIES", 100)
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**63, (700, 4), dtype=np.uint64)
    words = np.concatenate([words, words[:300]])
    ids = exactly_once.permute(words)
    shard = (ids[:, 0] >> np.uint64(64 - exactly_once.SHARD_BITS)).astype(np.int32)
    order = np.argsort(shard, kind="stable")

    def batch(at):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(shard[at]), exactly_once._binary(ids[at]), pa.array(["s"] * len(at)), pa.array(np.ones(len(at), np.int64)), pa.array(np.arange(len(at))), pa.array([str(i) for i in at])], exactly_once._NAMES)

    out = list(exactly_once._insert(batch(at) for at in np.array_split(order, 40)))
    assert len(out) >= 5 and max(b.num_rows for b in out) < 200
    got = {bytes(i): n for b in out for i, n in zip(b["id"].to_pylist(), b["n"].to_pylist())}
    assert got == {w.astype(">u8").tobytes(): 1 + (k < 300) for k, w in enumerate(words[:700])}


def test_quotient_table_restores_and_never_mixes_up():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (3000, 4), dtype=np.uint64)
    base[1000:2000, 0] = base[:1000, 0]  # same quotient, other remainder
    base[2000:, 0] = 7  # one hot home slot
    pick = rng.integers(0, 3000, 20_000)
    table = exactly_once.QuotientTable(bits=4)
    seen: dict[bytes, int] = {}
    for part in np.array_split(pick, 7):
        table.insert(base[part], np.ones(len(part), np.int64), part.astype(np.int64), np.array([str(i) for i in part], object))
        for i in part:
            seen[base[i].tobytes()] = seen.get(base[i].tobytes(), 0) + 1
    slots = table.filled()
    assert {r.tobytes(): int(n) for r, n in zip(table.ids(slots), table.n[slots])} == seen


def _log(spark, rows):
    return spark.createDataFrame(rows, "_dedup_key string, _batch_id string, _stage string, _processed_at timestamp, _row_id string, id int, n int, ts string, shard int")


def test_messages_against_brute_force(spark):
    rng = random.Random(3)
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(40)]
    forms = [str, str.upper, lambda k: "sha256:" + k, lambda k: f"  SHA256:{k.upper()} ", lambda k: k + " "]
    rows = []
    for i in range(600):
        k = digests[0] if rng.random() < 0.3 else rng.choice(digests)
        t = None if rng.random() < 0.1 else T0 + dt.timedelta(seconds=rng.randint(0, 5))
        rows.append((rng.choice(forms)(k), "b", rng.choice(["load", "extract", None]), t, None if rng.random() < 0.05 else f"r{rng.randint(0, 20)}", 1, 2, "x", 3))
    rows += [(None, "b", "load", T0, "z", 1, 1, "", 1), ("", "b", "load", T0, "z", 1, 1, "", 1), ("  ", "b", "load", T0, "z", 1, 1, "", 1), ("abc", "b", "load", T0, "z", 1, 1, "", 1)]
    want: dict = {}
    for k, _, s, t, r, *_ in rows:
        k = re.sub(r"\s", "", (k or "").lower()).removeprefix("sha256:")
        if len(k) == 64:
            want.setdefault((k, s), []).append((t is None, t or T0, r is None, r or "", r))
    got = {(r["_dedup_key"], r["_stage"]): (r["n_deliveries"], r["_row_id"]) for r in exactly_once.messages(_log(spark, rows).repartition(5)).collect()}
    assert got == {k: (len(v), min(v, key=lambda x: x[:4])[4]) for k, v in want.items()}
    assert exactly_once.messages(_log(spark, rows).limit(0)).count() == 0
    assert exactly_once.repeated(_log(spark, rows)).count() == sum(len(v) > 1 for v in want.values())


def test_quotient_flush(spark, monkeypatch):
    monkeypatch.setattr(exactly_once, "FLUSH_ENTRIES", 5)
    rows = [(hashlib.sha256(str(i % 30).encode()).hexdigest(), "b", "load", T0, f"r{i}", 1, 1, "", 1) for i in range(120)]
    assert {r["n_deliveries"] for r in exactly_once.messages(_log(spark, rows)).collect()} == {4}


# ---- references to records that do not exist -----------------------------------------------------------------


def _blocked(spark, parents, refs, block=0):
    rows = [("f", block, k.to_bytes(8, "big"), k in parents, k in refs) for k in sorted(parents | refs)]
    return spark.createDataFrame(rows, "field string, block int, key binary, is_parent boolean, is_ref boolean")


def test_runs_of_parents(spark):
    keys = _blocked(spark, {1, 5, 9, 12, 40}, {0, 5, 7, 12, 50})
    got = sorted((r["run_start"], r["run_end"]) for r in orphans.run_table(keys).collect())
    assert got == [(2, 3), (5, 7)], "places 2 and 3 are keys 1 and 5, places 5 to 7 are 9, 12 and 40"
    assert orphans.run_table(keys.limit(0)).count() == 0


def test_runs_match_brute_force(spark):
    rng = random.Random(4)
    parents, refs = {rng.randrange(3000) for _ in range(900)}, {rng.randrange(3100) for _ in range(900)}
    both = _blocked(spark, parents, refs, 0).unionByName(_blocked(spark, refs, parents, 1))
    for r in orphans.runs(both).where("is_ref").collect():
        assert (r["run_end"] is not None and r["rank"] <= r["run_end"]) == r["is_parent"]
    n = orphans.run_table(both).groupBy("block").count().collect()
    assert all(r["count"] <= 1 + len((refs - parents) if r["block"] == 0 else (parents - refs)) for r in n), "only orphans part runs"


def test_reference_kinds(spark):
    u = [str(uuid.UUID(int=i + (7 << 64))) for i in range(6)]
    child = spark.createDataFrame(
        [("c0", u[0].upper(), T0, "b"), ("c1", "{" + u[1] + "}", T0, None), ("c2", u[2].replace("-", ""), T0, "gone"), ("c3", u[3], T0, "b"), ("c4", None, T0, "b"), ("c5", "junk", T0, "b"), ("c6", "", T0, "B"), ("c7", u[4], None, "b"), ("c3", u[3], T0, "b"), ("c8", "urn:uuid:" + u[0], T0, "b")],
        "key string, ref string, block timestamp, rank string",
    )
    parent = spark.createDataFrame([(u[0], T0), (u[1], T0 + dt.timedelta(1)), (u[1], T0 + dt.timedelta(2)), (u[4], T0 + dt.timedelta(9)), (None, T0)], "id string, at timestamp")
    batches = spark.createDataFrame([("b", T0), ("other", T0)], "id string, at timestamp")
    dead = spark.createDataFrame([(u[2].upper(),), (None,), ("gone",)], "target_key string")

    def kinds(child, parent, dead):
        refs = [orphans.Reference("ref", orphans.uuid_key, parent, "id", "at", dead), orphans.Reference("rank", orphans.text_key, batches, "id", "at", dead)]
        return sorted((r["key"], r["ref_field"], r["kind"]) for r in orphans.reference_problems(child, "key", "block", refs).collect())

    assert kinds(child, parent, dead) == [("c1", "ref", "late"), ("c2", "rank", "deleted"), ("c2", "ref", "deleted"), ("c3", "ref", "missing"), ("c5", "ref", "missing"), ("c6", "rank", "missing"), ("c6", "ref", "missing")]
    assert kinds(child.limit(0), parent, dead) == []
    assert sum(k[2] == "missing" and k[1] == "ref" for k in kinds(child, parent.limit(0), dead.limit(0))) == 8


# ---- rows that fail to parse ------------------------------------------------------------------------------------

FORMATS = [row_parse.RowFormat("c", ",", "id,username,email,age,signup_date,amount,active,note"), row_parse.RowFormat("p", "|", "id|username|email|age|signup_date|amount|active|note")]
GOOD = "5,ann_1,a@b.co,30,2024-02-29,-1.50,true,"
CASES = [
    (GOOD + "hello", None), (GOOD, None), (GOOD + '"a,b"', None), (GOOD + '"say ""x"", y"', None), (GOOD + '"two\nlines"', None), (GOOD + '""', None), (GOOD + '""""', None), ('"5","ann_1","a@b.co","30","2024-02-29","1","false",x', None), (GOOD.replace("30", ""), None),
    (GOOD + 'a"b', "broken_quoting"), (GOOD + '"open', "broken_quoting"), (GOOD + '"a" b', "broken_quoting"), ('"5,' + GOOD[2:], "broken_quoting"), ('x"y', "broken_quoting"),
    (GOOD + "a,b", "column_count"), ("5", "column_count"), ("", "column_count"), (None, "column_count"), (GOOD + '"a","b"', "column_count"),
    (GOOD.replace("5,", "0,", 1), "invalid_value"), (GOOD.replace("ann_1", "a"), "invalid_value"), (GOOD.replace("a@b.co", "a@b"), "invalid_value"), (GOOD.replace("30", "151"), "invalid_value"), (GOOD.replace("2024-02-29", "2023-02-29"), "invalid_value"), (GOOD.replace("2024-02-29", "1900-02-29"), "invalid_value"), (GOOD.replace("-1.50", "1e3"), "invalid_value"), (GOOD.replace("true", "TRUE"), "invalid_value"), (GOOD.replace("ann_1", '""'), "invalid_value"), (GOOD.replace("30", " 30"), "invalid_value"),
    (GOOD + '"' + '""' * 300_000 + '"', None), (GOOD + '"' + '""' * 300_000 + "x", "broken_quoting"), ("5," * 100_000, "column_count"),
    (GOOD + '"' + '""' * 5000 + '"', None), (GOOD + '"' + '""' * 5000, "broken_quoting"), (GOOD + '"' + '""' * 5000 + '",x', "column_count"), (GOOD.replace("30", "999") + '"' + '""' * 5000 + '"', "invalid_value"), (GOOD + "x" * 300_000, None), (GOOD + '"' + "y,\n" * 100_000 + '"', None),
]


def test_row_reasons(spark):
    rows = [(i, "c", r, "keep") for i, (r, _) in enumerate(CASES)] + [(1000 + i, "p", r.replace(",", "|") if r else r, "keep") for i, (r, _) in enumerate(CASES)] + [(-1, "q", "x", "k"), (-2, None, "x", "k")]
    df = spark.createDataFrame(rows, "line_id bigint, _source_id string, _original_row string, p string")
    out = row_parse.classify(df, FORMATS)
    got = {r["line_id"]: r for r in out.collect()}
    for i, (text, want) in enumerate(CASES):
        assert got[i]["_quarantine_reason"] == want, (text or "")[:80]
        assert got[1000 + i]["_quarantine_reason"] == want
        assert bool(got[i]["_validation_errors"]) == (want is not None)
    assert got[-1]["_quarantine_reason"] == got[-2]["_quarantine_reason"] == "unknown_source" and got[0]["p"] == "keep"
    valid = {r["line_id"]: r for r in row_parse.valid_rows(out, FORMATS, ["line_id"]).collect()}
    assert valid[2]["note"] == "a,b" and valid[3]["note"] == 'say "x", y' and valid[6]["note"] == '"' and valid[8]["age"] is None and valid[0]["signup_date"] == dt.date(2024, 2, 29) and valid[0]["amount"] == -1.5 and valid[7]["active"] is False
    bad = row_parse.quarantined(out, ["line_id"]).where("line_id = 22").first()
    assert bad["_validation_errors"] == ["age: invalid value"] and bad["_original_row"] == CASES[22][0]
    assert row_parse.classify(df.limit(0), FORMATS).count() == 0


# ---- implausible spikes ---------------------------------------------------------------------------------------------


def _wave(rng, n, level=0.6, noise=0.01):
    return level + 0.03 * np.sin(np.arange(n) * 2 * np.pi / 24) + rng.normal(0, noise, n)


def test_spikes_by_state():
    rng = np.random.default_rng(5)
    v = _wave(rng, 240)
    v[120:] += 0.15  # lasting change of level: normal
    v[50] += 0.2
    v[80:83] -= 0.25
    v[100] = 1.2
    v[150:162] = v[150]
    v[200] = np.nan
    state = spikes.judge([("validity", v)])[0][0]
    want = np.zeros(240, int)
    want[[50, 80, 81, 82]] = spikes.SPIKE
    want[150:162] = spikes.STUCK
    want[[100, 200]] = spikes.RANGE
    assert (state == want).all()


def test_coarse_series_is_not_stuck():
    rng = np.random.default_rng(6)
    v = 1000 + 50.0 * np.cumsum(np.where(rng.random(300) < 0.08, rng.choice([-1, 1], 300), 0))
    assert (spikes.judge([("row_count", v)])[0][0] == spikes.NORMAL).all()
    v[150] += 3000
    assert np.flatnonzero(spikes.judge([("row_count", v)])[0][0]).tolist() == [150]
    assert spikes.judge([("lag_seconds", np.array([-1.0]))])[0][0].tolist() == [spikes.RANGE]
    assert spikes.judge([("other", np.array([-1.0, np.inf]))])[0][0].tolist() == [spikes.NORMAL, spikes.RANGE]


def test_flags_of_a_table(spark, monkeypatch):
    rng = np.random.default_rng(7)
    v = _wave(rng, 300)
    v[[40, 250]] += 0.3
    rows = [(f"a{i}", "s", "validity", T0 + dt.timedelta(hours=i), float(x), 1, 2) for i, x in enumerate(v)]
    rows += [rows[40], ("n", "s", "validity", T0, None, 1, 2), ("m", None, None, None, 5.0, 1, 2), ("r", "t", " Quality ", T0, 1.5, 1, 2)]
    df = spark.createDataFrame(rows, "_anomaly_id string, _source_id string, _metric string, _detected_at timestamp, _value double, series int, at int")
    odd = lambda: {(r["_anomaly_id"], r["state"]) for r in spikes.flag_readings(df).where("state <> 'normal'").collect()}
    want = {("a40", "spike"), ("a250", "spike"), ("r", "out_of_range")}
    assert odd() == want and spikes.flag_readings(df).count() == 302
    monkeypatch.setattr(spikes, "BLOCK_READINGS", 80)
    monkeypatch.setattr(spikes, "MARGIN", 16)
    assert odd() == want and spikes.flag_readings(df).count() == 302
    assert spikes.flag_readings(df.limit(0)).count() == 0


def test_stuck_runs_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    lively, coarse = _wave(rng, 900), 0.5 + 0.1 * (np.arange(900) // 5 % 2)
    lively[300:600] = lively[300]
    lively[700:712] = lively[700]
    lively[[100, 101, 102, 103]] = np.nan
    coarse[400:500] = rng.normal(0.55, 0.02, 100)
    coarse[440:452] = coarse[440]
    rows = [(f"{k}{i}", k, "validity", T0 + dt.timedelta(hours=i), float(x)) for k, v in (("l", lively), ("c", coarse)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "_anomaly_id string, _source_id string, _metric string, _detected_at timestamp, _value double")
    monkeypatch.setattr(spikes, "BLOCK_READINGS", 80)
    monkeypatch.setattr(spikes, "MARGIN", 16)
    found = {r["_anomaly_id"] for r in spikes.flag_readings(df).where("state = 'stuck'").collect()}
    assert found == {f"l{i}" for i in [*range(300, 600), *range(700, 712)]}


def test_pieces_of_a_long_group(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(spikes, "PIECE_READINGS", 100)
    frame = pd.DataFrame({"group": "g", "margin": False, "k": range(1000)})
    seen = []
    for g, mask in spikes._pieces(frame.iloc[i : i + 37] for i in range(0, 1000, 37)):
        assert len(g) < 300
        seen += g.loc[mask, "k"].tolist()
    assert seen == list(range(1000))


# ---- schemas that drift ----------------------------------------------------------------------------------------------


def _contract(*fields):
    return json.dumps({"fields": [{"name": n, "type": t, "nullable": True, "description": d, "metadata": m or {}} for n, t, d, m in fields]})


def test_changes(spark):
    v = [
        ("s", "1.2.0", _contract(("a", "bigint", "A", None), ("b", "varchar(9)", "B", None), ("c", "text", "C", None), ("d", "date", None, None)), T0),
        ("s", "1.10.0", _contract(("a", "Int64", "A", None), ("bb", "String", "B", None), ("C", "String", "other", None), ("e", "Date", None, {"x": {"formerly": ["zz", "d"]}})), T0),
        ("s", "1.9.0", _contract(("a", "integer", "A", None), ("b", "text", "B", None), ("c", "varchar", "C", None), ("d", "date", None, None)), T0),
        ("s", "1.9.0", "broken", T0 - dt.timedelta(1)),
        ("s", "2.0.0", _contract(("a", "double", "A", None), ("bb", "text[]", "B", None), ("f", "Nullable(DateTime64(3))", "", None), ("e", "Date", None, None)), T0),
        ("t", "1", None, T0), (None, "1", "{}", T0), ("t", "2", _contract(("x", "jsonb", None, None)), None),
    ]
    df = spark.createDataFrame(v, "source_id string, schema_version string, contract_json string, updated_at timestamp").withColumn("pos", F.lit(1))
    fields = schema_drift.fields_of(df)
    lives = schema_drift.catalogue(fields)
    got = {tuple(r) for r in schema_drift.changes(lives).select("source_id", "schema_version", "field_name", "change_type").collect()}
    assert got == {("s", "1.10.0", "bb", "renamed"), ("s", "1.10.0", "C", "renamed"), ("s", "1.10.0", "e", "renamed"), ("s", "2.0.0", "a", "type_changed"), ("s", "2.0.0", "bb", "type_changed"), ("s", "2.0.0", "C", "removed"), ("s", "2.0.0", "f", "added"), ("t", "2", "x", "added")}
    assert schema_drift.changes(schema_drift.catalogue(schema_drift.fields_of(df.limit(0)))).count() == 0
    spans = {(r["name"], r["type"]): (r["first_pos"], r["last_pos"]) for r in lives.where("source_id = 's'").collect()}
    assert spans[("a", "integer")] == (1, 3) and spans[("a", "float")] == (4, 4) and spans[("b", "string")] == (1, 2) and spans[("bb", "array")] == (4, 4)
    names = {r["schema_version"]: r["names"] for r in schema_drift.field_names(fields, lives, schema_drift.changes(lives)).where("source_id = 's'").collect()}
    assert names["1.2.0"]["b"]["field"] == "bb" and names["1.2.0"]["b"]["type"] == "array" and names["1.2.0"]["d"]["field"] == "e" and names["1.9.0"]["c"]["field"] == "C"


def test_chain_of_renames_and_records(spark):
    v = [("s", f"1.{i}.0", _contract((n, t, "same", None)), T0) for i, (n, t) in enumerate([("a", "text"), ("b", "text"), ("c", "text"), ("d", "integer")])]
    fields = schema_drift.fields_of(spark.createDataFrame(v, "source_id string, schema_version string, contract_json string, updated_at timestamp"))
    lives = schema_drift.catalogue(fields)
    names = schema_drift.field_names(fields, lives, schema_drift.changes(lives))
    rec = spark.createDataFrame([(1, "x", "s", "f0", 1, T0, '{"a": "7.0", "zz": null}'), (2, "x", "s", "f0", 2, T0, '{"a": "no"}'), (2, "x", "s", "f0", 2, T0, '{"a": "no"}'), (3, "x", "s", "f3", 1, T0, '{"d": 5}'), (4, "x", "s", "gone", 1, T0, "not json"), (5, "x", "s", "f0", 1, T0, None)], "record_id bigint, extraction_id string, source_id string, _file_name string, _row_number bigint, _extracted_at timestamp, payload string")
    cp = spark.createDataFrame([("s", json.dumps({"file_name": "f0", "schema_version": "1.0.0"}), T0), ("s", json.dumps({"file_name": "f3", "schema_version": "1.3.0"}), T0), ("s", "{}", T0), ("s", None, T0)], "source_id string, metadata string, updated_at timestamp")
    got = {r["record_id"]: r for r in schema_drift.unify(rec, cp, names).collect()}
    assert len(got) == 5 and got[1]["data"] == {"d": "7", "zz": None} and got[2]["data"] == {"d": "no"} and got[2]["uncast"] == ["d"] and got[3]["data"] == {"d": "5"} and got[4]["data"] == {} and got[5]["data"] == {} and got[4]["schema_version"] is None
    table = schema_drift.typed(schema_drift.unify(rec, cp, names), names)
    assert table.schema["d"].dataType.typeName() == "long"
    got = {r["record_id"]: r for r in table.collect()}
    assert got[1]["d"] == 7 and got[1]["data"] == {"zz": None} and got[2]["d"] is None and got[2]["uncast"] == ["d"] and got[3]["d"] == 5 and got[5]["d"] is None


def test_two_fields_with_one_description():
    def side(*fields):
        return [{"name": n, "type": "string", "text": "Address", "metadata": m} for n, m in fields]

    starts, ends = side(("line_a", '{"was": "addr_1"}'), ("line_b", "{}")), side(("addr_1", None), ("addr_2", None))
    assert schema_drift.match_renames(starts, ends) == [(0, 0), (1, 1)]
    swapped = [starts[0] | {"metadata": '{"was": "addr_2"}'}, starts[1]]
    assert schema_drift.match_renames(swapped, ends) == [(0, 1), (1, 0)]
    partly = [starts[0] | {"metadata": None}, starts[1] | {"metadata": None, "name": "line_b"}]
    assert len(schema_drift.match_renames(partly, [ends[0], ends[1] | {"text": "Other"}])) == 1 and schema_drift.match_renames([], ends) == []


def test_names_of_typed_columns(spark):
    names = spark.createDataFrame([("s", "1", {"a": ("Data", "integer"), "b": ("source_id", "string")}), ("t", "1", {"a": ("Data", "date")})], "source_id string, schema_version string, names map<string,struct<field:string,type:string>>")
    rows = spark.createDataFrame([(1, "x", "s", "1", T0, {"Data": "5", "source_id": "q", "new": "n"}, [])], "record_id bigint, extraction_id string, source_id string, schema_version string, _extracted_at timestamp, data map<string,string>, uncast array<string>")
    got = schema_drift.typed(rows, names).first().asDict()
    assert got["Data_field"] == "5" and got["source_id_field"] == "q" and got["source_id"] == "s" and got["data"] == {"new": "n"}


def test_type_names(spark):
    cases = {"VARCHAR(64)": "string", "character varying": "string", "Int32": "integer", "bigint": "integer", "numeric(12,2)": "float", "double precision": "float", "Nullable(Float32)": "float", "timestamp without time zone": "timestamp", "DateTime64(3)": "timestamp", "text[]": "array", "Array(String)": "array", "list<string>": "array", "jsonb": "object", "bool": "boolean", "Date": "date", "strange": "strange"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", schema_drift.contract_type(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in got} == cases


# ---- profiles ----------------------------------------------------------------------------------------------------------

SPEC = profile.ProfileSpec(("load", "day"), ("id", "mail"), {"mail": r"^[^@]+@[^@]+$"})


def _loads(spark, shift=0.0):
    rng = random.Random(9)
    rows = []
    for b in range(8):
        for i in range(90):
            odd = b == 3
            rows.append((f"r{b}_{i}", f"batch_{'ab'[b % 2]}_{b}_x", rng.gauss(0, 1) + (3 * shift if odd else 0), dt.date(2024, 1, 1) + dt.timedelta(rng.randint(0, 300)), None if odd and i % 2 else rng.choice(['x', 'y', 'x', 'y', 'x', 'y', 'x', 'y', 'x', ' ']), f"u{i}@h" if not (b == 4 and i % 3 == 0) else "bad", "s"))
    rows += rows[:20]
    rows += [("n", None, 1.0, None, "x", "a@b", "s"), ("nan", "batch_a_0_x", float("nan"), None, None, None, "s")]
    return spark.createDataFrame(rows, "rid string, batch string, load double, day date, id string, mail string, src string"), rows


def source():
    return F.regexp_extract("batch", "^batch_(.*)_[^_]*_[^_]*$", 1)


@pytest.mark.parametrize("size,loads", [(10**9, 10**9), (150, 2)])
def test_profile_against_brute_force(spark, monkeypatch, size, loads):
    monkeypatch.setattr(profile, "PIECE_VALUES", size)
    monkeypatch.setattr(profile, "PIECE_LOADS", loads)
    monkeypatch.setattr(profile, "SALT_ROWS", 50 if size < 1000 else 10**9)
    df, rows = _loads(spark, 1.0)
    got = {(r["load"], r["col"]): r for r in profile.profile(df, "rid", "batch", source(), SPEC).collect()}
    once = [r for r in set(map(str, rows))]
    rows = [eval(r, {"datetime": dt, "nan": float("nan")}) for r in once]  # noqa: S307 - own literals
    for col, at in (("load", 2), ("day", 3)):
        for b in sorted({r[1] for r in rows if r[1]}):
            num = lambda x: x if col == "load" else (x - dt.date(1970, 1, 1)).days
            mine = sorted(num(r[at]) for r in rows if r[1] == b and r[at] is not None and r[at] == r[at])
            rest = sorted(num(r[at]) for r in rows if r[1] and r[1] != b and r[1][6] == b[6] and r[at] is not None and r[at] == r[at])
            both = np.array(mine + rest, float)
            ks = np.abs(np.searchsorted(mine, both, "right") / len(mine) - np.searchsorted(rest, both, "right") / len(rest)).max()
            r = got[b, col]
            assert r["ks"] == pytest.approx(ks) and r["n_distinct"] == len(set(mine)) and r["lo_num"] == mine[0] and r["hi_num"] == mine[-1]
            assert r["q"] == [mine[int(np.ceil(q * len(mine))) - 1] for q in profile.QUANTILES]
            assert r["n_null"] == sum(x[1] == b and (x[at] is None or x[at] != x[at]) for x in rows)
    assert got["batch_a_4_x", "mail"]["n_bad"] == 30 and got["batch_b_3_x", "id"]["n_null"] > 45 and got["batch_b_1_x", "id"]["lo"] == "x"


@pytest.mark.parametrize("size", [10**9, 150])
def test_range_and_fewer_distinct_values(spark, monkeypatch, size):
    monkeypatch.setattr(profile, "PIECE_VALUES", size)
    rng = random.Random(12)
    rows = []
    for b in range(9):
        for i in range(200):
            age = 999.0 if b == 3 and i % 8 == 0 else -5.0 if b == 6 and i % 8 == 0 else float(rng.randint(18, 90))
            day = rng.randint(0, 99) * 10 if b != 5 else rng.randint(0, 9) * 100 + 50
            rows.append((f"r{b}_{i}", f"batch_a_{b}_x", age, dt.date(2024, 1, 1) + dt.timedelta(day), "x", "u@h"))
    df = spark.createDataFrame(rows, "rid string, batch string, load double, day date, id string, mail string")
    found = {(r["load"], r["col"]): r["reasons"] for r in profile.departures(profile.profile(df, "rid", "batch", source(), SPEC)).collect()}
    assert found == {("batch_a_3_x", "load"): ["range"], ("batch_a_6_x", "load"): ["range"], ("batch_a_5_x", "day"): ["fewer"]}


def test_departures_and_odd_tables(spark):
    df, _ = _loads(spark, 1.0)
    found = {(r["load"], r["col"].split("#")[0]) for r in profile.departures(profile.profile(df, "rid", "batch", source(), SPEC)).collect()}
    assert found == {("batch_b_3_x", "load"), ("batch_b_3_x", "id"), ("batch_a_4_x", "mail")}
    assert profile.profile(df.limit(0), "rid", "batch", source(), SPEC).count() == 0
    one = df.where("batch = 'batch_a_0_x'")
    assert profile.departures(profile.profile(one, "rid", "batch", source(), SPEC)).count() == 0
