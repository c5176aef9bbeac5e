"""Readers: delimited files, parquet, JSON, spreadsheets, databases and message topics, with paging and guards."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from itertools import chain, islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Encodings that are tried in order.
ENCODINGS = ("utf-8", "latin-1", "iso-8859-1", "cp1252", "utf-16")
FILE_KINDS = (".csv", ".xls", ".xlsx", ".parquet", ".json")


class SourceError(ValueError):
    """A source that cannot be read as asked."""


def detect_encoding(path: str, size: int = 1024) -> str:
    """The first encoding that decodes the head of a local file; a byte order mark wins."""
    with open(path, "rb") as f:
        head = f.read(size)
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    for e in ENCODINGS:
        for cut in range(4 if len(head) == size else 1):  # a character may be cut at the end of the head
            try:
                head[: len(head) - cut].decode(e)
                return e
            except UnicodeError:
                continue
    return "latin-1"


def check_csv_options(delimiter: str = ",", encoding: str | None = None, skip_rows: int = 0) -> None:
    if len(delimiter) != 1:
        raise SourceError("the delimiter must be one character")
    if skip_rows < 0 or not isinstance(skip_rows, int):
        raise SourceError("skip_rows must be a whole number, 0 at least")
    if encoding is not None:
        try:
            "".encode(encoding)
        except LookupError:
            raise SourceError(f"unknown encoding {encoding!r}") from None


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, encoding: str | None = None, skip_rows: int = 0, schema: T.StructType | None = None, provenance: bool = False, multi_line: bool = True) -> DataFrame:
    """Text columns of delimited files; quoted fields may span lines. Splits of the files are the chunks.

    ``multi_line=False`` says that no field holds a line break, which lets one file be read in many splits.
    ``skip_rows`` lines before the header are left out (of each file, by line number of the file); columns are then those
    of all headers together, each file's values under its own header. ``provenance`` adds ``_file_name`` and
    ``_file_size``.
    """
    check_csv_options(delimiter, encoding, skip_rows)
    options = {"sep": delimiter, "header": str(header and not skip_rows).lower(), "encoding": encoding or "utf-8", "multiLine": str(multi_line).lower(), "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    if not skip_rows:
        reader = spark.read.options(**options)
        df = (reader.schema(schema) if schema else reader).csv(path)
    else:
        return _read_skipping(spark, path, delimiter, header, encoding or "utf-8", skip_rows, schema, provenance)
    if provenance:
        df = df.withColumns({"_file_name": F.col("_metadata.file_name"), "_file_size": F.col("_metadata.file_size").cast("decimal(20,0)")})
    return df


#: Columns of all headers together, at most.
MAX_COLUMNS = 10_000


def _read_skipping(spark: SparkSession, path: str, delimiter: str, header: bool, encoding: str, skip_rows: int, schema: T.StructType | None, provenance: bool) -> DataFrame:
    """Files with lines before the header: a file is decoded and split in one task, files in parallel.

    Names of the columns are gathered from the header of every file in a first pass over their heads.
    """
    from millrace.session import ship

    ship(spark)

    def records(content: bytes) -> Iterator[list[str]]:
        lines = io.StringIO(content.decode(encoding), newline="")
        for _ in range(skip_rows):
            lines.readline()
        return csv.reader(lines, delimiter=delimiter)

    def named(data: Iterator[list[str]]) -> tuple[list[str], Iterator[list[str]]]:
        first = next(data, [])
        if header:
            return [n.strip() or f"column_{i}" for i, n in enumerate(first)], data
        return [f"_c{i}" for i in range(len(first))], chain([first], data)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                names = named(records(content))[0]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(names), pa.string()), pa.array(range(len(names)), pa.int32()), pa.array(names, pa.string())], ["path", "pos", "name"])

    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    if schema:
        columns = [f.name for f in schema.fields]
    else:
        seen = files.mapInArrow(heads, "path string, pos int, name string").groupBy("name").agg(F.min(F.struct("path", "pos")).alias("at"))
        columns = [r[0] for r in seen.orderBy("at").limit(MAX_COLUMNS + 1).collect()]
        if len(columns) > MAX_COLUMNS:
            raise SourceError(f"the headers name over {MAX_COLUMNS} columns")
    if not columns:
        return spark.createDataFrame([], schema or T.StructType([]))
    extra = ["_file_name", "_file_size"] if provenance else []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, content in zip(*(b[c].to_pylist() for c in ("path", "length", "content"))):
                names, data = named(records(content))
                at = [names.index(c) if c in names else None for c in columns]
                while part := list(islice(data, 10_000)):
                    full = [r for r in part if r]
                    cols = [pa.array([(r[i] or None) if i is not None and i < len(r) else None for r in full], pa.string()) for i in at]
                    if provenance:
                        cols += [pa.array([path.rsplit("/", 1)[-1]] * len(full), pa.string()), pa.array([str(size)] * len(full), pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, columns + extra)

    text = files.mapInArrow(rows, T.StructType([T.StructField(n, T.StringType()) for n in columns + extra]))
    kinds = {f.name: f.dataType for f in schema.fields} if schema else {}
    if provenance:
        kinds["_file_size"] = T.DecimalType(20, 0)
    return text.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in columns + extra])


def estimate_rows(spark: SparkSession, path: str, sample_bytes: int = 1 << 20) -> int:
    """Number of records of delimited files, estimated from their size and the length of the lines in the head of the first file.

    Small sets are counted. The header is no record; the figure is for progress reports only.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).select("path", "length")
    total, first = files.agg(F.sum("length"), F.min("path")).first()
    if not total:
        return 0
    lines = spark.read.text(path)
    if total <= sample_bytes:
        return max(0, lines.count() - files.count())
    head = spark.read.text(first).limit(1000)
    mean = head.agg(F.avg(F.octet_length("value") + 1)).first()[0]
    return max(0, round(total / mean) - files.count())


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> tuple[DataFrame, bool]:
    """Rows ``offset`` to ``offset + limit`` in a stable order, and whether there are more."""
    if limit < 1 or offset < 0:
        raise SourceError("offset and limit must not be negative, limit at least 1")
    ordered = df.orderBy(*order)
    more = len(ordered.offset(offset + limit).limit(1).take(1)) > 0
    return ordered.offset(offset).limit(limit), more


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """Active sheet of a workbook, first row as header (blank names become ``column_i``); needs openpyxl."""
    try:
        import openpyxl
    except ImportError:
        raise SourceError("reading workbooks needs the optional package openpyxl") from None
    sheet = openpyxl.load_workbook(path, read_only=True, data_only=True).active
    rows = sheet.iter_rows(values_only=True)
    head = next(rows, ())
    names = [str(h).strip() if h not in (None, "") else f"column_{i}" for i, h in enumerate(head)]
    fields = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame(([None if v is None else str(v) for v in r] for r in rows), fields)


def read_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """Any supported file by its suffix."""
    kind = Path(path).suffix.lower()
    if kind == ".csv":
        return read_csv(spark, path, **options)
    if kind == ".parquet":
        return read_parquet(spark, path)
    if kind == ".json":
        return read_json(spark, path)
    if kind in (".xls", ".xlsx"):
        return read_excel(spark, path)
    raise SourceError(f"files of kind {kind!r} are not supported")


def check_upload(name: str, size: int, most: int = 100 * 1024 * 1024) -> None:
    """Suffix, name and size of an uploaded file."""
    if Path(name).suffix.lower() not in FILE_KINDS:
        raise SourceError(f"files of kind {Path(name).suffix!r} are not supported")
    if "/" in name or "\\" in name or ".." in name or "\0" in name:
        raise SourceError("bad file name")
    if not 0 < size <= most:
        raise SourceError(f"size must be from 1 to {most} bytes")


# ---- databases ---------------------------------------------------------------------------------------------

_DRIVERS = {"postgres": ("postgresql", "org.postgresql.Driver", '"'), "postgresql": ("postgresql", "org.postgresql.Driver", '"'), "mysql": ("mysql", "com.mysql.cj.jdbc.Driver", "`")}


def jdbc_url(kind: str, host: str, port: int, database: str) -> str:
    if kind not in _DRIVERS:
        raise SourceError(f"databases of kind {kind!r} are not supported")
    if not re.fullmatch(r"[A-Za-z0-9._-]+", host) or not 0 < int(port) < 65536 or not re.fullmatch(r"[A-Za-z0-9_$-]+", database):
        raise SourceError("bad host, port or database name")
    return f"jdbc:{_DRIVERS[kind][0]}://{host}:{port}/{database}"


def quote_name(name: str, kind: str) -> str:
    """A dotted identifier in the quotes of the dialect."""
    q = _DRIVERS[kind][2]
    return ".".join(q + part.replace(q, q + q) + q for part in name.split("."))


def safe_where(clause: str) -> str:
    """A condition to push down; several statements and comments are refused."""
    if any(x in clause for x in (";", "--", "/*", "*/", "\0")):
        raise SourceError("the condition must not hold statements or comments")
    return clause


def scan_sql(table: str, kind: str, where: str | None = None, key: str | None = None, after=None) -> str:
    """The query of a full or an incremental scan (keys beyond the last one read)."""
    parts = []
    if where:
        parts.append(f"({safe_where(where)})")
    if key is not None and after is not None:
        literal = str(after) if isinstance(after, (int, float)) and not isinstance(after, bool) else "'" + str(after).replace("'", "''") + "'"
        parts.append(f"{quote_name(key, kind)} > {literal}")
    return f"SELECT * FROM {quote_name(table, kind)}" + (f" WHERE {' AND '.join(parts)}" if parts else "")


def page_sql(table: str, kind: str, limit: int, where: str | None = None, key: str | None = None, after=None, offset: int = 0) -> str:
    """The query of one page: beyond the last key where there is one, else by offset in a stable order.

    Without a key postgres pages by the physical place of rows (``ctid``); other databases page by offset alone, which
    is stable only while the table is not written.
    """
    if limit < 1 or offset < 0:
        raise SourceError("limit must be 1 at least, offset not negative")
    if key is not None:
        return f"{scan_sql(table, kind, where, key, after)} ORDER BY {quote_name(key, kind)} LIMIT {limit}" + (f" OFFSET {offset}" if offset else "")
    order = " ORDER BY ctid" if kind.startswith("postgres") else ""
    return f"{scan_sql(table, kind, where)}{order} LIMIT {limit} OFFSET {offset}"


def read_jdbc(spark: SparkSession, kind: str, url: str, table: str, user: str, password: str, where: str | None = None, key: str | None = None, after=None, bounds: tuple[int, int] | None = None, partitions: int = 1, no_key: str = "warn") -> DataFrame:
    """A table by JDBC, incremental beyond ``after``, in parallel over a numeric ``key`` where ``bounds`` are known.

    Without a key the scan runs in one partition: ``no_key`` says whether that fails, warns or is taken.
    """
    if key is None and no_key == "fail":
        raise SourceError(f"{table} has no key")
    if key is None and no_key == "warn":
        import warnings

        warnings.warn(f"{table} has no key and is read in one partition", stacklevel=2)
    reader = spark.read.format("jdbc").options(url=url, driver=_DRIVERS[kind][1], user=user, password=password, fetchsize="10000")
    if key is not None and bounds is not None and partitions > 1:
        return reader.options(dbtable=f"({scan_sql(table, kind, where, key, after)}) s", partitionColumn=quote_name(key, kind), lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions)).load()
    return reader.option("query", scan_sql(table, kind, where, key, after)).load()


def key_query(kind: str, table: str) -> str:
    """Query for the primary key columns of a table."""
    name = table.replace("'", "''")
    if kind.startswith("postgres"):
        return f"SELECT a.attname AS name FROM pg_index i JOIN pg_attribute a ON a.attrelid = i.indrelid AND a.attnum = ANY(i.indkey) WHERE i.indrelid = '{name}'::regclass AND i.indisprimary"
    return f"SELECT column_name AS name FROM information_schema.key_column_usage WHERE constraint_name = 'PRIMARY' AND table_schema = database() AND table_name = '{name}' ORDER BY ordinal_position"


def advance(state: DataFrame | None, batch: DataFrame, table: str, key: str) -> DataFrame:
    """High-water marks ``table_name, last_key`` after a batch: the largest key of each table."""
    new = batch.agg(F.lit(table).alias("table_name"), F.max(key).cast("string").alias("last_key"), F.max(key).cast("decimal(38,0)").alias("n")).where("last_key is not null")
    if state is None:
        return new.select("table_name", "last_key")
    old = state.select("table_name", "last_key", F.col("last_key").try_cast("decimal(38,0)").alias("n"))
    return old.unionByName(new).groupBy("table_name").agg(F.max_by("last_key", "n").alias("last_key"))


# ---- rows and messages ----------------------------------------------------------------------------------------


def required_errors(df: DataFrame, required: list[str]) -> Column:
    """Texts for required fields that are absent, null, blank or not a number."""
    out = []
    for n in required:
        if n not in df.columns:
            out.append(F.lit(f"{n}: missing"))
            continue
        c = F.col(f"`{n}`")
        empty = c.isNull()
        if isinstance(df.schema[n].dataType, T.StringType):
            empty = empty | (F.trim(c) == "")
        if isinstance(df.schema[n].dataType, (T.DoubleType, T.FloatType)):
            empty = empty | F.isnan(c)
        out.append(F.when(empty, f"{n}: empty"))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def read_topic(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", most: int | None = None, lossy: bool = False) -> DataFrame:
    """A Kafka topic as stream of ``key, value`` text; needs the connector on the class path.

    Offsets that the topic no longer holds stop the query; ``lossy`` goes on without them.
    """
    reader = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": str(not lossy).lower()})
    if most:
        reader = reader.option("maxOffsetsPerTrigger", most)
    return reader.load().selectExpr("cast(key as string) key", "cast(value as string) value", "timestamp")


def explode_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """One row per data row of JSON messages: single ``data`` objects and ``rows`` arrays alike.

    Columns ``source_id, batch_id, dedup_key, row_index, data map<string,string>``; rows of an array take the keys of
    their message. Messages that are no JSON object, or hold no data, give no row.
    """
    shape = "struct<source_id:string,batch_id:string,_dedup_key:string,data:map<string,string>,rows:array<map<string,string>>>"
    m = messages.select(F.from_json(value, shape).alias("m")).where("m is not null")
    rows = F.when(F.col("m.rows").isNotNull(), F.col("m.rows")).when(F.col("m.data").isNotNull(), F.array("m.data"))
    return m.select(F.col("m.source_id"), F.col("m.batch_id"), F.col("m._dedup_key").alias("dedup_key"), F.posexplode(rows).alias("row_index", "data"))


def iterate_pages(df: DataFrame, order: list[str], size: int) -> Iterator[DataFrame]:
    """Successive pages; for parity with paged readers, a plain scan is the way to read all."""
    at = 0
    while True:
        rows, more = page(df, order, at, size)
        yield rows
        if not more:
            return
        at += size
