"""Checks of JSON messages per topic, as columns over the parsed message."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    """A field of a message: its kind, whether it must be there (always, or when another field has a value), and bounds.

    ``not_empty`` holds for texts, lists and objects; ``longest`` for texts; ``least`` and ``most`` for numbers.
    """

    name: str
    kind: str = "string"
    required: bool = False
    when: tuple[str, str] | None = None
    choices: tuple[str, ...] = ()
    not_empty: bool = False
    least: float | None = None
    most: float | None = None
    longest: int | None = None


# The messages of each topic.
TOPICS = {
    "connection_topic": (
        Part("type", required=True, choices=("file", "database")),
        Part("filename", when=("type", "file"), not_empty=True, longest=255),
        Part("path", when=("type", "file"), not_empty=True),
        Part("size", "integer", when=("type", "file"), least=0),
        Part("db_type", when=("type", "database"), choices=("mysql", "postgres", "sqlite", "mssql", "oracle")),
        Part("host", when=("type", "database"), not_empty=True),
        Part("user", when=("type", "database"), not_empty=True),
        Part("password", when=("type", "database")),
        Part("database", when=("type", "database"), not_empty=True),
        Part("port", "integer", when=("type", "database"), least=1, most=65535),
    ),
    "schema_topic": (
        Part("source", required=True, not_empty=True),
        Part("type", required=True, choices=("file", "database")),
        Part("columns", "list", required=True, not_empty=True),
        Part("dtypes", "dict"),
        Part("row_count", "integer", least=0),
        Part("table"),
    ),
    "extracted_rows_topic": (
        Part("source", required=True, not_empty=True),
        Part("source_id", required=True, not_empty=True),
        Part("row_id", "integer", least=0),
        Part("table"),
        Part("data", "dict", not_empty=True),
        Part("rows", "list", not_empty=True),
        Part("batch_id"),
        Part("extracted_at"),
        Part("row_count", "integer", least=1),
        Part("schema_version", required=True, not_empty=True),
    ),
    "clean_rows_topic": (
        Part("source", required=True, not_empty=True),
        Part("source_id", required=True, not_empty=True),
        Part("row_id", "integer"),
        Part("table"),
        Part("data", "dict", not_empty=True),
        Part("rows", "list", not_empty=True),
        Part("batch_id"),
        Part("cleaned_at"),
        Part("row_count", "integer", least=1),
        Part("schema_version", required=True, not_empty=True),
        Part("quality_score", "float", least=0.0, most=1.0),
        Part("warnings", "list"),
    ),
    "load_rows_topic": (
        Part("source", required=True, not_empty=True),
        Part("table"),
        Part("status", required=True, choices=("success", "error")),
        Part("row_count", "integer", least=0),
        Part("error", when=("status", "error")),
        Part("batch_id"),
    ),
    "metadata_topic": (
        Part("event_type", not_empty=True),
        Part("metadata_type", not_empty=True),
        Part("timestamp", required=True, not_empty=True),
        Part("source"),
        Part("data", "dict"),
    ),
}

_KINDS = {"string": r"^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "float": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": r"^BOOLEAN$", "datetime": r"^(STRING|TIMESTAMP.*|DATE)$", "dict": r"^OBJECT", "list": r"^ARRAY", "any": r""}


def problems(value: Column, topic: str) -> Column:
    """Array of what is wrong with a JSON message of a topic; a message that is no JSON object has one problem."""
    if topic not in TOPICS:
        raise ValueError(f"unknown topic {topic!r}")
    v = F.try_parse_json(value)
    out = []
    for p in TOPICS[topic]:
        part = F.try_variant_get(v, f"$.{p.name}", "variant")
        text = F.try_variant_get(v, f"$.{p.name}", "string")
        kind = F.schema_of_variant(part)
        there = part.isNotNull() & (kind != "VOID")
        needed = F.lit(p.required)
        if p.when:
            needed = F.coalesce(F.try_variant_get(v, f"$.{p.when[0]}", "string") == p.when[1], F.lit(False))
        problem = F.when(needed & ~F.coalesce(there, F.lit(False)), f"{p.name}: missing").when(there & ~kind.rlike(_KINDS[p.kind]), f"{p.name}: not {p.kind}")
        if p.not_empty or (p.required and p.kind == "string"):
            blank = F.trim(text) == "" if p.kind == "string" else F.to_json(part).isin("[]", "{}")
            problem = problem.when(there & blank, f"{p.name}: empty")
        if p.choices:
            problem = problem.when(there & ~text.isin(list(p.choices)), f"{p.name}: not one of {', '.join(p.choices)}")
        if p.longest is not None:
            problem = problem.when(there & (F.length(text) > p.longest), f"{p.name}: too long")
        number = text.try_cast("double")
        if p.least is not None:
            problem = problem.when(there & (number < p.least), f"{p.name}: too small")
        if p.most is not None:
            problem = problem.when(there & (number > p.most), f"{p.name}: too large")
        out.append(problem)
    if topic in ("extracted_rows_topic", "clean_rows_topic"):
        out.append(F.when(F.try_variant_get(v, "$.data", "variant").isNull() & F.try_variant_get(v, "$.rows", "variant").isNull(), "data: neither data nor rows"))
    if topic == "metadata_topic":
        named = [F.coalesce(F.trim(F.try_variant_get(v, f"$.{n}", "string")) != "", F.lit(False)) for n in ("event_type", "metadata_type")]
        out.append(F.when(~named[0] & ~named[1], "event_type: neither event_type nor metadata_type"))
    whole = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.when(~whole, F.array(F.lit("message: no JSON object"))).otherwise(F.array_compact(F.array(*out)))


def split_messages(messages: DataFrame, topic: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(sound, faulty) messages; the faulty ones with ``_validation_errors`` for the dead-letter topic."""
    checked = messages.withColumn("_validation_errors", problems(F.col(value), topic))
    return checked.where(F.size("_validation_errors") == 0).drop("_validation_errors"), checked.where(F.size("_validation_errors") > 0)


def write_topic(df: DataFrame, servers: str, topic: str, checkpoint: str | None = None):
    """Rows as JSON messages to a Kafka topic, batch or stream; needs the connector on the class path."""
    body = df.select(F.to_json(F.struct("*")).alias("value"))
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.compression.type": "gzip"}
    if df.isStreaming:
        return body.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).start()
    return body.write.format("kafka").options(**options).save()
