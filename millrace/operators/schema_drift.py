"""Schemas that drift: a catalogue of column lifespans, the changes they tell, and one consistent table.

The fields of every registered version are exploded into (producer, version, field, type). Gaps-and-islands over the
version order of a producer give the lifespan of each field with one type; the catalogue of lifespans is stored once and
everything else comes from it. A lifespan that starts or ends inside the producer's history is a change: of type where
another lifespan of the field adjoins, else a start or an ending. Starts and endings in the same version are matched to
renamed fields if the metadata of the new names the old, if both are the same words written differently, or if they share
their description; the strongest evidence first, and as many pairs as each kind of evidence allows. Renames form chains
whose last name is the field's name in the consistent table; the casts to its last type are generated from the alias
table of type names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialise

# Names of types in the dialects of the sources, by contract type.
TYPE_ALIASES = {
    "string": ("string", "str", "text", "varchar", "char", "character", "bpchar", "nvarchar", "uuid", "fixedstring", "character_varying", "lowcardinality", "enum8", "enum16"),
    "integer": ("integer", "int", "long", "bigint", "smallint", "tinyint", "mediumint", "short", "byte", "serial", "bigserial", "int2", "int4", "int8", "int16", "int32", "int64", "int128", "int256", "uint8", "uint16", "uint32", "uint64", "number_int"),
    "float": ("float", "double", "real", "numeric", "decimal", "number", "money", "float4", "float8", "float32", "float64", "double_precision", "decimal32", "decimal64", "decimal128"),
    "boolean": ("boolean", "bool", "bit"),
    "date": ("date", "date32"),
    "timestamp": ("timestamp", "datetime", "timestamptz", "datetime64", "datetime2", "timestamp_without_time_zone", "timestamp_with_time_zone", "timestamp_ntz", "timestamp_ltz"),
    "array": ("array", "list", "set", "repeated"),
    "object": ("object", "json", "jsonb", "struct", "map", "dict", "record", "variant", "tuple", "nested", "hstore"),
}
_CAST = {"integer": "bigint", "float": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamp"}
_FIELDS = "struct<fields:array<struct<name:string,type:string,nullable:string,description:string,metadata:string>>>"


def contract_type(t: Column) -> Column:
    """One of the eight contract types, whatever the dialect, width or nullability; null stays null, unknown names are kept."""
    low = F.lower(F.trim(t))
    low = F.regexp_replace(low, r"^(?:nullable|lowcardinality)\s*\(\s*(.*)\)$", "$1")
    low = F.regexp_replace(low, r"^(?:nullable|lowcardinality)\s*\(\s*(.*)\)$", "$1")
    is_list = low.rlike(r"\[\]\s*$|^(?:array|list)\s*[(<]")
    bare = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(low, r"\s*[(<].*[)>]", " "), r"\b(?:unsigned|signed|not null|null)\b", " ")), r"\s+", "_")
    aliases = F.create_map(*[F.lit(x) for kind, names in TYPE_ALIASES.items() for n in names for x in (n, kind)])
    return F.when(is_list, "array").otherwise(F.coalesce(F.get(F.array(aliases[bare]), F.lit(0)), bare))


def version_key(version: Column) -> Column:
    """Numeric order of dotted versions: an array of numbers without trailing zeros; other text sorts by its numbers."""
    parts = F.transform(F.regexp_extract_all(version, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("decimal(38,0)"))
    last = F.size(parts) - F.coalesce(F.array_position(F.transform(F.reverse(parts), lambda x: x != 0), True), F.lit(0)).cast("int") + 1
    return F.when(F.exists(parts, lambda x: x != 0), F.slice(parts, 1, F.greatest(last, F.lit(1)))).otherwise(F.slice(parts, 1, 1))


def versions(contracts: DataFrame) -> DataFrame:
    """Registered versions in order: ``source_id, schema_version, contract_json, pos, next_version`` (null for the last).

    A version registered more than once counts as its latest row. Only names of versions are sorted per source.
    """
    rows = contracts.where("source_id is not null and schema_version is not null").groupBy("source_id", "schema_version").agg(F.max_by("contract_json", F.struct("updated_at", "contract_json")).alias("contract_json"))
    order = Window.partitionBy("source_id").orderBy(version_key(F.col("schema_version")), "schema_version")
    named = rows.select("source_id", "schema_version", F.row_number().over(order).alias("pos"), F.lead("schema_version").over(order).alias("next_version"))
    return rows.join(named.hint("shuffle_hash"), ["source_id", "schema_version"])


def fields_of(contracts: DataFrame) -> DataFrame:
    """Fields of all versions with the lifespan they belong to: ``source_id, schema_version, pos, next_version, name, type, description, metadata, life``.

    Fields without a name and unreadable contracts give no fields, but an unreadable version still has its place in the
    order. ``life`` counts the lifespans of a name: it goes up where the field returns or has another type.
    """
    rows = versions(contracts)
    fields = rows.select("source_id", "schema_version", "pos", "next_version", F.explode(F.from_json("contract_json", _FIELDS)["fields"]).alias("f"))
    flat = fields.select("source_id", "schema_version", "pos", "next_version", F.col("f.name").alias("name"), contract_type(F.col("f.type")).alias("type"), F.nullif(F.trim("f.description"), F.lit("")).alias("description"), F.col("f.metadata").alias("metadata")).where("name is not null")
    w = Window.partitionBy("source_id", "name").orderBy("pos")
    before = F.lag("pos").over(w)
    flat = flat.withColumn("again", F.coalesce(before == F.col("pos"), F.lit(False))).withColumn("begins", F.coalesce((before < F.col("pos") - 1) | ~F.lag("type").over(w).eqNullSafe(F.col("type")), F.lit(True)))
    return flat.where("not again").withColumn("life", F.sum(F.col("begins").cast("int")).over(w)).drop("again", "begins")


def catalogue(fields: DataFrame) -> DataFrame:
    """One stored row per lifespan: ``source_id, name, life, type, first_pos, last_pos, first_version, next_version, first_text, last_text, metadata`` and its neighbours ``was_type, was_last, then_first``."""
    lives = fields.groupBy("source_id", "name", "life").agg(
        F.first("type").alias("type"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min_by("schema_version", "pos").alias("first_version"), F.max_by("next_version", "pos").alias("next_version"),
        F.min_by("description", "pos").alias("first_text"), F.max_by("description", "pos").alias("last_text"), F.min_by("metadata", "pos").alias("metadata"),
    )
    w = Window.partitionBy("source_id", "name").orderBy("life")
    return materialise(lives.select("*", F.lag("type").over(w).alias("was_type"), F.lag("last_pos").over(w).alias("was_last"), F.lead("first_pos").over(w).alias("then_first")), "lives")


def _spelling(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def match_renames(starts: list[dict], ends: list[dict]) -> list[tuple[int, int]]:
    """Pairs (start, ending) that are one field: for each strength of evidence, strongest first, as many pairs as possible.

    The metadata of the new field hold the old name as a text value (4), both names are the same words (2), both have the
    same description (1). Fields of one type go before others, then names in order.
    """
    score: dict[int, dict[int, int]] = {}
    for i, new in enumerate(starts):
        for j, old in enumerate(ends):
            hints = 4 * (json.dumps(old["name"], ensure_ascii=False) in (new["metadata"] or "")) + 2 * (_spelling(old["name"]) == _spelling(new["name"])) + (new["text"] is not None and new["text"] == old["text"])
            if hints:
                score.setdefault(hints, {}).setdefault(i, []).append(j)
    of_new: dict[int, int] = {}
    of_old: dict[int, int] = {}
    for hints in sorted(score, reverse=True):
        edges = {i: sorted((j for j in js if j not in of_old), key=lambda j, i=i: (starts[i]["type"] != ends[j]["type"], ends[j]["name"])) for i, js in score[hints].items() if i not in of_new}
        mine: dict[int, int] = {}

        def place(i: int, seen: set[int]) -> bool:
            for j in edges[i]:
                if j not in seen:
                    seen.add(j)
                    if j not in mine or place(mine[j], seen):
                        mine[j] = i
                        return True
            return False

        for i in sorted(edges, key=lambda i: starts[i]["name"]):
            place(i, set())
        for j, i in mine.items():
            of_new[i], of_old[j] = j, i
    return sorted(of_new.items())


_CHANGE = "source_id string, schema_version string, field_name string, change_type string, old_name string, old_type string, new_type string"


def _changes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split(" ")[0] for c in _CHANGE.split(", ")]
    for f in frames:
        out = []
        for source, version, events in zip(f["source_id"], f["schema_version"], f["events"]):
            starts, ends = ([e for e in events if e["kind"] == k] for k in ("start", "end"))
            pairs = match_renames(starts, ends)
            for i, j in pairs:
                new, old = starts[i], ends[j]
                out.append((source, version, new["name"], "renamed", old["name"], old["type"], new["type"]))
                if old["type"] != new["type"]:
                    out.append((source, version, new["name"], "type_changed", old["name"], old["type"], new["type"]))
            new, old = {i for i, _ in pairs}, {j for _, j in pairs}
            out += [(source, version, e["name"], "added", None, None, e["type"]) for i, e in enumerate(starts) if i not in new]
            out += [(source, version, e["name"], "removed", e["name"], e["type"], None) for j, e in enumerate(ends) if j not in old]
            out += [(source, version, e["name"], "type_changed", None, e["was"], e["type"]) for e in events if e["kind"] == "type"]
        yield pd.DataFrame(out, columns=columns).astype(object)


def changes(lives: DataFrame) -> DataFrame:
    """``source_id, schema_version, field_name, change_type, old_name, old_type, new_type`` of every change of a field.

    The changes of one version are matched in one row; it holds no more than the fields of two contracts.
    """
    adjoins = F.coalesce(F.col("was_last") == F.col("first_pos") - 1, F.lit(False))
    none = F.lit(None).cast("string")

    def event(kind: str, version: str, text: str, was=none):
        return F.struct(F.col(version).alias("schema_version"), F.struct(F.lit(kind).alias("kind"), F.col("name").alias("name"), F.col("type").alias("type"), F.col(text).alias("text"), F.col("metadata").alias("metadata"), was.alias("was")).alias("event"))

    retyped = F.when(adjoins & (F.col("was_type") != F.col("type")), event("type", "first_version", "first_text", F.col("was_type")))
    starts = F.when(~adjoins & (F.col("first_pos") > 1), event("start", "first_version", "first_text"))
    ends = F.when(F.col("next_version").isNotNull() & ~F.coalesce(F.col("then_first") == F.col("last_pos") + 1, F.lit(False)), event("end", "next_version", "last_text"))
    events = lives.select("source_id", F.inline(F.array_compact(F.array(retyped, starts, ends))))
    return events.groupBy("source_id", "schema_version").agg(F.collect_list("event").alias("events")).mapInPandas(_changes, _CHANGE)


def field_names(fields: DataFrame, lives: DataFrame, changed: DataFrame) -> DataFrame:
    """``source_id, schema_version, names map<name, struct<field, type>>``: each version's names in terms of the last name and type.

    Each lifespan points to the one that goes on with it, by a change of type or a rename; pointer jumping (as many joins
    as the logarithm of the most links of a source) leads every lifespan to its last one, so no source is folded in one task.
    """
    renames = changed.where("change_type = 'renamed'").select("source_id", F.col("schema_version").alias("next_version"), F.col("old_name").alias("name"), F.col("field_name").alias("to_name"))
    firsts = lives.select("source_id", F.col("name").alias("to_name"), F.col("first_version").alias("next_version"), F.col("life").alias("new_life"))
    links = renames.join(firsts, ["source_id", "to_name", "next_version"])
    on = F.coalesce(F.col("then_first") == F.col("last_pos") + 1, F.lit(False))
    goes = lives.join(links, ["source_id", "name", "next_version"], "left")
    goes = goes.select("source_id", "name", "life", "type", F.when(on, F.col("name")).otherwise(F.coalesce("to_name", "name")).alias("to_name"), F.when(on, F.col("life") + 1).otherwise(F.coalesce("new_life", "life")).alias("to_life"))
    goes = materialise(goes, "links")
    most = goes.where("to_name <> name or to_life <> life").groupBy("source_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(most).bit_length()):
        ahead = goes.select("source_id", F.col("name").alias("to_name"), F.col("life").alias("to_life"), F.col("to_name").alias("far_name"), F.col("to_life").alias("far_life"))
        goes = materialise(goes.join(ahead, ["source_id", "to_name", "to_life"]).select("source_id", "name", "life", "type", F.col("far_name").alias("to_name"), F.col("far_life").alias("to_life")), "links")
    last = goes.select("source_id", F.col("name").alias("to_name"), F.col("life").alias("to_life"), F.col("type").alias("final_type"))
    final = goes.join(last, ["source_id", "to_name", "to_life"]).select("source_id", "name", "life", F.col("to_name").alias("field"), "final_type")
    named = fields.select("source_id", "schema_version", "name", "life").join(final, ["source_id", "name", "life"])
    return named.groupBy("source_id", "schema_version").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("field", F.col("final_type").alias("type"))))).alias("names"))


def cast_text(value: Column, kind: Column) -> Column:
    """Text of ``value`` in the canonical spelling of a contract type; null where it cannot be read as one."""
    number = F.trim(value)
    whole = F.coalesce(number.try_cast("bigint"), F.when(number.try_cast("double") == F.floor(number.try_cast("double")), number.try_cast("double").try_cast("bigint")))
    word = F.lower(number)
    flag = F.when(word.isin("true", "t", "yes", "y", "1", "on"), "true").when(word.isin("false", "f", "no", "n", "0", "off"), "false")
    return (
        F.when(kind == "integer", whole.cast("string"))
        .when(kind == "float", number.try_cast("double").cast("string"))
        .when(kind == "boolean", flag)
        .when(kind == "date", number.try_cast("date").cast("string"))
        .when(kind == "timestamp", number.try_cast("timestamp").cast("string"))
        .otherwise(value)
    )


def unify(records: DataFrame, checkpoints: DataFrame, names: DataFrame) -> DataFrame:
    """All records in one table: ``record_id, extraction_id, source_id, schema_version, _extracted_at, data, uncast``.

    ``data`` maps each field's last name to its value in the spelling of its last type; a field that a record lacks
    has no key, one that is null has a null. ``uncast`` names the fields whose value does not fit that type (their
    text is kept in ``data``). The version is that of the record's file; identical records count once; a record
    whose payload is no object has empty ``data``; unknown files and fields keep their own names.
    """
    files = checkpoints.select("source_id", F.get_json_object("metadata", "$.file_name").alias("_file_name"), F.get_json_object("metadata", "$.schema_version").alias("schema_version"), "updated_at").where("_file_name is not null").groupBy("source_id", "_file_name").agg(F.max_by("schema_version", F.struct("updated_at", "schema_version")).alias("schema_version"))
    once = records.select("record_id", "extraction_id", "source_id", "_file_name", "_extracted_at", "payload").distinct()
    rows = once.join(files, ["source_id", "_file_name"], "left").join(names, ["source_id", "schema_version"], "left")
    raw = F.coalesce(F.map_entries(F.from_json("payload", "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>"))
    entries = F.transform(raw, lambda e: F.struct(F.coalesce(F.col("names")[e["key"]]["field"], e["key"]).alias("key"), e["value"].alias("text"), cast_text(e["value"], F.col("names")[e["key"]]["type"]).alias("value")))
    keys = F.transform(F.col("e"), lambda x: x["key"])
    rows = rows.withColumn("e", entries).withColumn("e", F.filter("e", lambda x, i: F.array_position(keys, x["key"]) == i + 1))
    data = F.map_from_entries(F.transform("e", lambda x: F.struct(x["key"], F.coalesce(x["value"], x["text"]).alias("value"))))
    uncast = F.array_sort(F.transform(F.filter("e", lambda x: x["value"].isNull() & x["text"].isNotNull()), lambda x: x["key"]))
    return rows.select("record_id", "extraction_id", "source_id", "schema_version", "_extracted_at", data.alias("data"), uncast.alias("uncast"))


#: Columns of the typed table at most, those of most versions first; further fields stay in ``data``.
MAX_COLUMNS = 256


def typed(unified: DataFrame, names: DataFrame) -> DataFrame:
    """The consistent table with a typed column per field: ``record_id, extraction_id, source_id, schema_version, _extracted_at``, the fields in order, ``uncast``.

    Fields of the same name in several sources share a column, of their common type or else text; lists and objects are
    text (JSON). A value that does not fit is null in its column and its field is named in ``uncast``. A field called like
    one of the fixed columns gets the suffix ``_field``. Fields that no contract names, and those beyond ``MAX_COLUMNS``,
    stay in the map ``data``.
    """
    kinds = names.select(F.explode(F.map_values("names")).alias("f")).groupBy("f.field").agg(F.when(F.count_distinct("f.type") == 1, F.first("f.type")).otherwise("string").alias("type"), F.count("*").alias("n"))
    fields = sorted((r[0], r[1]) for r in kinds.orderBy(F.desc("n"), "field").limit(MAX_COLUMNS).collect())
    fixed = ["record_id", "extraction_id", "source_id", "schema_version", "_extracted_at"]
    taken = {x.lower() for x in (*fixed, "uncast", "data")}
    columns = []
    for name, kind in fields:
        label = name
        while label.lower() in taken:
            label += "_field"
        taken.add(label.lower())
        value = F.get(F.array(F.col("data")[name]), F.lit(0))
        columns.append((value.try_cast(_CAST[kind]) if kind in _CAST else value).alias(label))
    known = F.array(*[F.lit(n) for n, _ in fields]).cast("array<string>")
    extra = F.map_filter("data", lambda k, v: ~F.array_contains(known, k)).alias("data")
    return unified.select(*fixed, *columns, extra, "uncast")
