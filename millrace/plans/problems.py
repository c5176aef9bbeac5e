"""Queries over the pipeline tables for the core data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import exactly_once, orphans, profile, row_parse, schema_drift, spikes
from millrace.session import materialise, table


def _dead(spark: SparkSession, d: str, target: str) -> DataFrame:
    return table(spark, d, "row_tombstones").where(F.lower(F.trim("target_table")) == target)


def _silver_references(spark: SparkSession, d: str) -> list[orphans.Reference]:
    return [
        orphans.Reference("_bronze_row_id", orphans.uuid_key, table(spark, d, "bronze_customers"), "_row_id", "_extracted_at", _dead(spark, d, "bronze_customers")),
        orphans.Reference("_batch_id", orphans.text_key, table(spark, d, "extraction_checkpoints"), "last_batch_id", "updated_at", _dead(spark, d, "extraction_checkpoints")),
    ]


def p3_rows(spark: SparkSession, d: str) -> DataFrame:
    return orphans.reference_problems(table(spark, d, "silver_customers"), "_row_id", "_cleaned_at", _silver_references(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_rows(spark, d).select("_row_id", "ref_field", "kind").distinct()


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, reference, kind and month of the referring row."""
    return p3_rows(spark, d).groupBy(F.lit("silver_customers").alias("table_name"), "ref_field", "kind", F.date_format("_cleaned_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return exactly_once.repeated(table(spark, d, "deduplication_log"))


def p5_messages(spark: SparkSession, d: str) -> DataFrame:
    """Every message once, with the row that is kept."""
    return exactly_once.messages(table(spark, d, "deduplication_log")).select("_dedup_key", "_stage", "_row_id", "n_deliveries")


def _p6(spark: SparkSession, d: str, *keep: str):
    formats = row_parse.formats_of(table(spark, d, "raw_formats"))
    rows = table(spark, d, "raw_rows").select("line_id", "_source_id", "_original_row", *keep).distinct()
    return row_parse.classify(rows, formats), formats


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d)[0].where("_quarantine_reason is not null").select("line_id", "_quarantine_reason").distinct()


def p6_valid(spark: SparkSession, d: str) -> DataFrame:
    rows, formats = _p6(spark, d, "_batch_id")
    return row_parse.valid_rows(rows, formats, ["line_id", "_batch_id", "_source_id"])


def p6_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return row_parse.quarantined(_p6(spark, d, "_batch_id")[0], ["line_id", "_batch_id", "_source_id"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flag_readings(table(spark, d, "quality_anomalies")).where("state <> 'normal'").select("_anomaly_id").distinct()


def p1_flags(spark: SparkSession, d: str) -> DataFrame:
    """Every reading with the baseline, spread and state that its own series gives."""
    return spikes.flag_readings(table(spark, d, "quality_anomalies"))


SILVER = profile.ProfileSpec(
    numeric=("customer_id", "age", "signup_date", "total_sales", "_quality_score", "_completeness_score", "_validity_score"),
    text=("_cleaning_version", "email", "region", "city", "phone"),
    patterns={"email": f"^{row_parse.EMAIL}$", "phone": r"^\+?[0-9][0-9 -]*$", "_cleaning_version": r"^[0-9]+(?:\.[0-9]+)*$"},
)


def p7_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile of every load and column of the silver table."""
    source = F.regexp_extract("_batch_id", r"^batch_(.*)_[^_]*_[^_]*$", 1)
    return profile.profile(table(spark, d, "silver_customers"), "_row_id", "_batch_id", source, SILVER)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    changed = profile.departures(p7_profile(spark, d))
    return changed.select(F.col("load").alias("_batch_id"), F.split_part("col", F.lit("#"), F.lit(1)).alias("column_name")).distinct()


def _p4(spark: SparkSession, d: str):
    fields = schema_drift.fields_of(table(spark, d, "schema_contract"))
    return fields, schema_drift.catalogue(fields)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(_p4(spark, d)[1]).select("source_id", "schema_version", "field_name", "change_type").distinct()


def p4_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every change with old name and both types."""
    return schema_drift.changes(_p4(spark, d)[1])


def p4_lifespans(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue: in which versions each field had which type."""
    return _p4(spark, d)[1].select("source_id", "name", "type", "first_version", "first_pos", "last_pos")


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """All source records in one typed table."""
    fields, lives = _p4(spark, d)
    names = materialise(schema_drift.field_names(fields, lives, schema_drift.changes(lives)), "names")
    return schema_drift.typed(schema_drift.unify(table(spark, d, "source_records"), table(spark, d, "extraction_checkpoints"), names), names)


_UUID = "regexp_replace(lower(trim({})), '^urn:uuid:|[{{}}()\\s-]', '', 'g')"

P3_CTE = f"""
WITH s AS (SELECT DISTINCT _row_id, _cleaned_at, {_UUID.format('_bronze_row_id')} AS b, _bronze_row_id AS braw, _batch_id FROM silver_customers),
p AS (SELECT {_UUID.format('_row_id')} AS k, min(_extracted_at) AS at FROM bronze_customers GROUP BY 1),
c AS (SELECT last_batch_id AS k, min(updated_at) AS at FROM extraction_checkpoints WHERE last_batch_id IS NOT NULL GROUP BY 1),
tb AS (SELECT DISTINCT {_UUID.format('target_key')} AS k FROM row_tombstones WHERE lower(trim(target_table)) = 'bronze_customers'),
tc AS (SELECT DISTINCT target_key AS k FROM row_tombstones WHERE lower(trim(target_table)) = 'extraction_checkpoints'),
r AS (SELECT DISTINCT s._row_id, s._cleaned_at, '_bronze_row_id' AS ref_field, CASE WHEN p.k IS NULL THEN CASE WHEN tb.k IS NOT NULL THEN 'deleted' ELSE 'missing' END WHEN p.at > s._cleaned_at THEN 'late' END AS kind
 FROM s LEFT JOIN p ON p.k = s.b LEFT JOIN tb ON tb.k = s.b WHERE s.braw IS NOT NULL
 UNION SELECT DISTINCT s._row_id, s._cleaned_at, '_batch_id', CASE WHEN c.k IS NULL THEN CASE WHEN tc.k IS NOT NULL THEN 'deleted' ELSE 'missing' END WHEN c.at > s._cleaned_at THEN 'late' END
 FROM s LEFT JOIN c ON c.k = s._batch_id LEFT JOIN tc ON tc.k = s._batch_id WHERE s._batch_id IS NOT NULL)
"""
_P5 = "WITH m AS (SELECT regexp_replace(lower(_dedup_key), '^\\s*(sha256:)?|\\s+', '', 'g') AS k, _stage, _processed_at, _row_id FROM deduplication_log), g AS (SELECT k AS _dedup_key, _stage, first(_row_id ORDER BY _processed_at NULLS LAST, _row_id NULLS LAST) AS _row_id, count(*) AS n_deliveries FROM m WHERE regexp_full_match(k, '[0-9a-f]{64}') GROUP BY 1, 2) "

_FIELD = """("([^"]|"")*"|[^"' || d || ']*)"""
_P6 = f"""
WITH r AS (SELECT DISTINCT line_id, _batch_id, _source_id, _original_row AS o, delimiter AS d, n_columns AS n, string_split(header_line, delimiter) AS h FROM raw_rows JOIN raw_formats USING (_source_id)),
q AS (SELECT *, regexp_full_match(o, '{_FIELD}([' || d || ']{_FIELD})*') AS sound FROM r),
l AS (SELECT *, CASE WHEN sound THEN list_transform(regexp_extract_all(d || o, '[' || d || ']{_FIELD}'), lambda x: CASE WHEN x[2] = '"' THEN replace(x[3:-2], '""', '"') ELSE x[2:] END) END AS f FROM q),
v AS (SELECT *, f[list_position(h, 'id')] AS id, f[list_position(h, 'username')] AS username, f[list_position(h, 'email')] AS email, f[list_position(h, 'age')] AS age, f[list_position(h, 'signup_date')] AS signup_date, f[list_position(h, 'amount')] AS amount, f[list_position(h, 'active')] AS active, f[list_position(h, 'note')] AS note FROM l),
k AS (SELECT *, CASE WHEN o IS NULL THEN 'column_count' WHEN NOT sound THEN 'broken_quoting' WHEN len(f) <> n THEN 'column_count'
 WHEN regexp_full_match(id, '[0-9]+') AND ltrim(id, '0') <> '' AND length(username) BETWEEN 3 AND 20 AND NOT regexp_matches(username, '[^A-Za-z0-9_]') AND regexp_full_match(email, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}')
 AND (age = '' OR (regexp_full_match(age, '[0-9]+') AND try_cast(age AS HUGEINT) BETWEEN 0 AND 150)) AND regexp_full_match(signup_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(signup_date AS DATE) IS NOT NULL
 AND regexp_full_match(amount, '-?[0-9]+([.][0-9]+)?') AND active IN ('true', 'false') THEN NULL ELSE 'invalid_value' END AS _quarantine_reason FROM v)
"""

_P4 = r"""
WITH c AS (SELECT source_id, schema_version, arg_max(contract_json, updated_at) AS j FROM schema_contract WHERE source_id IS NOT NULL AND schema_version IS NOT NULL GROUP BY 1, 2),
v AS (SELECT *, row_number() OVER w AS pos, lead(schema_version) OVER w AS nextv FROM c WINDOW w AS (PARTITION BY source_id ORDER BY list_transform(string_split(schema_version, '.'), lambda x: CAST(x AS INTEGER)))),
e AS (SELECT source_id, schema_version, pos, nextv, unnest(json_extract(j, '$.fields[*]')) AS f FROM v),
t AS (SELECT source_id, schema_version, pos, nextv, f->>'$.name' AS name, lower(trim(f->>'$.type')) AS raw, nullif(trim(f->>'$.description'), '') AS text, coalesce(CAST(f->'$.metadata' AS VARCHAR), '') AS meta FROM e),
k AS (SELECT *, CASE WHEN raw LIKE '%[]' OR regexp_matches(raw, '^(array|list)') THEN 'array' WHEN regexp_matches(raw, '^(json|dict|object)') THEN 'object' WHEN regexp_matches(raw, '^(datetime|timestamp)') THEN 'timestamp' WHEN regexp_matches(raw, '^date') THEN 'date' WHEN raw LIKE 'bool%' THEN 'boolean'
 WHEN regexp_matches(raw, '^(float|double|numeric|real|decimal)') THEN 'float' WHEN regexp_matches(raw, '^(u?int|smallint|bigint|long)') THEN 'integer' ELSE 'string' END AS kind FROM t WHERE name IS NOT NULL),
l AS (SELECT *, lag(pos) OVER w AS before, lead(pos) OVER w AS after, lag(kind) OVER w AS was FROM k WINDOW w AS (PARTITION BY source_id, name ORDER BY pos)),
s AS (SELECT source_id, schema_version AS ver, name, kind, text, meta FROM l WHERE pos > 1 AND (before IS NULL OR before < pos - 1)),
x AS (SELECT source_id, nextv AS ver, name, kind, text FROM l WHERE nextv IS NOT NULL AND (after IS NULL OR after > pos + 1)),
p AS (SELECT s.source_id, s.ver, s.name AS new, x.name AS old, s.kind AS new_kind, x.kind AS old_kind, CASE WHEN contains(s.meta, '"' || x.name || '"') THEN 4 ELSE 0 END + CASE WHEN regexp_replace(lower(s.name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(x.name), '[^a-z0-9]', '', 'g') THEN 2 ELSE 0 END + CASE WHEN s.text = x.text THEN 1 ELSE 0 END AS score
 FROM s JOIN x ON x.source_id = s.source_id AND x.ver = s.ver),
q AS (SELECT *, row_number() OVER (PARTITION BY source_id, ver, new ORDER BY score DESC, old_kind = new_kind DESC, old) AS a, row_number() OVER (PARTITION BY source_id, ver, old ORDER BY score DESC, old_kind = new_kind DESC, new) AS b FROM p WHERE score > 0),
r AS (SELECT * FROM q WHERE a = 1 AND b = 1),
ch AS (SELECT source_id, ver AS schema_version, new AS field_name, 'renamed' AS change_type, old AS old_name, old_kind AS old_type, new_kind AS new_type FROM r
 UNION ALL SELECT source_id, ver, new, 'type_changed', old, old_kind, new_kind FROM r WHERE old_kind <> new_kind
 UNION ALL SELECT source_id, ver, name, 'added', NULL, NULL, kind FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.source_id = s.source_id AND r.ver = s.ver AND r.new = s.name)
 UNION ALL SELECT source_id, ver, name, 'removed', name, kind, NULL FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.source_id = x.source_id AND r.ver = x.ver AND r.old = x.name)
 UNION ALL SELECT source_id, schema_version, name, 'type_changed', NULL, was, kind FROM l WHERE before = pos - 1 AND was <> kind)
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_flags, p3_found, p3_counts, p4_found, p4_changes, p4_lifespans, p4_records, p5_found, p5_messages, p6_found, p6_valid, p6_quarantine, p7_found, p7_profile)}
ORACLES = {
    "p4_found": _P4 + "SELECT DISTINCT source_id, schema_version, field_name, change_type FROM ch",
    "p4_changes": _P4 + "SELECT * FROM ch",
    "p4_lifespans": _P4 + ", g AS (SELECT *, sum(CASE WHEN before = pos - 1 AND was = kind THEN 0 ELSE 1 END) OVER (PARTITION BY source_id, name ORDER BY pos) AS life FROM l) SELECT source_id, name, any_value(kind) AS type, arg_min(schema_version, pos) AS first_version, min(pos) AS first_pos, max(pos) AS last_pos FROM g GROUP BY source_id, name, life",
    "p6_found": _P6 + "SELECT DISTINCT line_id, _quarantine_reason FROM k WHERE _quarantine_reason IS NOT NULL",
    "p6_valid": _P6 + "SELECT line_id, _batch_id, _source_id, CAST(id AS DECIMAL(38,0)) AS id, username, email, try_cast(age AS INTEGER) AS age, CAST(signup_date AS DATE) AS signup_date, CAST(amount AS DECIMAL(38,10)) AS amount, active = 'true' AS active, note FROM k WHERE _quarantine_reason IS NULL",
    "p3_found": P3_CTE + "SELECT DISTINCT _row_id, ref_field, kind FROM r WHERE kind IS NOT NULL",
    "p3_counts": P3_CTE + "SELECT 'silver_customers' AS table_name, ref_field, kind, strftime(_cleaned_at, '%Y-%m') AS month, count(*) AS n FROM r WHERE kind IS NOT NULL GROUP BY ALL",
    "p5_found": _P5 + "SELECT _dedup_key, _stage, _row_id FROM g WHERE n_deliveries > 1",
    "p5_messages": _P5 + "SELECT _dedup_key, _stage, _row_id, n_deliveries FROM g",
}
