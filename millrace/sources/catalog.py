"""Tables of the catalog: statements to create, copy the shape of, rename, extend and drop them; listing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)?")


def safe_name(name: str) -> str:
    """A plain table or column name in quotes; anything else is refused."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"bad name {name!r}")
    return ".".join(f"`{p}`" for p in name.split("."))


def create_sql(name: str, schema: T.StructType, partition: str | None = None) -> str:
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return f"CREATE TABLE IF NOT EXISTS {safe_name(name)} ({cols}) USING parquet" + (f" PARTITIONED BY ({safe_name(partition)})" if partition else "")


def create(spark: SparkSession, name: str, schema: T.StructType, partition: str | None = None) -> None:
    spark.sql(create_sql(name, schema, partition))


def create_like(spark: SparkSession, name: str, model: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {safe_name(name)} LIKE {safe_name(model)}")


def rename(spark: SparkSession, old: str, new: str) -> None:
    spark.sql(f"ALTER TABLE {safe_name(old)} RENAME TO {safe_name(new)}")


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {safe_name(name)}")


def add_columns(spark: SparkSession, name: str, df: DataFrame) -> list[str]:
    """Add the columns of ``df`` that the table lacks; returns their names."""
    have = {c.lower() for c in spark.table(name).columns}
    new = [f for f in df.schema.fields if f.name.lower() not in have]
    if new:
        spark.sql(f"ALTER TABLE {safe_name(name)} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
    return [f.name for f in new]


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def columns(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """``table_name, column_name, type, nullable`` of the tables of the catalog; metadata only, one row a column."""
    rows = [(n, f.name, f.dataType.simpleString(), f.nullable) for n in (names or tables(spark)) for f in spark.table(n).schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string, nullable boolean")


def columns_sql(kind: str) -> str:
    """Query for tables and columns of a database, for a read over JDBC."""
    scope = "table_schema = database()" if kind == "mysql" else "table_schema NOT IN ('pg_catalog', 'information_schema')"
    return f"SELECT table_name, column_name, data_type, is_nullable FROM information_schema.columns WHERE {scope} ORDER BY table_name, ordinal_position"
