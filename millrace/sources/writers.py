"""Writers: partitioned appends, staged loads, quarantine, evolution of tables, retries with a breaker."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.dedup import anti_load
from millrace.session import delete_path, scratch_path


class LoadError(RuntimeError):
    """A load that did not come out as it should."""


class CircuitBreaker:
    """Refuses calls for ``reset`` seconds after ``most`` failures in a row; then one trial."""

    def __init__(self, most: int = 5, reset: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.reset, self.clock = most, reset, clock
        self.failures, self.opened = 0, None

    def call(self, f: Callable[[], Any]) -> Any:
        if self.opened is not None and self.clock() - self.opened < self.reset:
            raise LoadError("the breaker is open")
        try:
            out = f()
        except Exception:
            self.failures += 1
            if self.failures >= self.most:
                self.opened = self.clock()
            raise
        self.failures, self.opened = 0, None
        return out


def with_retry(f: Callable[[], Any], tries: int = 3, base: float = 1.0, most: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Call with waits of ``base * 2 ** n`` seconds, at most ``most``, between tries."""
    for n in range(tries):
        try:
            return f()
        except Exception:
            if n == tries - 1:
                raise
            sleep(min(most, base * 2**n))
    raise LoadError("no tries")


def with_month(df: DataFrame, time_col: str) -> DataFrame:
    """Adds ``yyyymm``, the partition of a time."""
    return df.withColumn("yyyymm", F.date_format(time_col, "yyyyMM"))


def append_monthly(df: DataFrame, path: str, time_col: str) -> None:
    """Append to parquet partitioned by month; rows of a month are spread, not gathered in one task."""
    with_month(df, time_col).write.mode("append").partitionBy("yyyymm").parquet(path)


def read_target(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where nothing was written."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except Exception as e:  # noqa: BLE001 - only absence is no error
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def align(df: DataFrame, target: DataFrame) -> DataFrame:
    """Columns of both: new ones are added, absent ones are null, those of the target keep its type."""
    kinds = {f.name: f.dataType for f in target.schema.fields}
    mine = df.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns])
    return target.limit(0).unionByName(mine, allowMissingColumns=True)


def staged_load(df: DataFrame, path: str, keys: list[str], order: list | None = None) -> int:
    """Append the rows whose key the target lacks, through a staging table that is counted; returns how many.

    First writer wins in the batch and against the target. The batch is written to staging once, so the rows that are
    counted are the rows that are appended.
    """
    from millrace.operators.dedup import first_wins

    spark = df.sparkSession
    staging = scratch_path(spark, "staging")
    target = read_target(spark, path)
    once = first_wins(df, keys, order or [F.col(k) for k in keys])
    fresh = anti_load(align(once, target), target, keys) if target is not None else once
    fresh.write.mode("overwrite").parquet(staging)
    staged = spark.read.schema(fresh.schema).parquet(staging)
    n = staged.count()
    if n:
        before = target.count() if target is not None else 0
        staged.write.mode("append").parquet(path)
        after = spark.read.parquet(path).count()
        if after - before != n:
            undo(spark, path, staged, keys)
            raise LoadError(f"staged {n} rows, target grew by {after - before}; the append was undone")
    delete_path(spark, staging)
    return n


def undo(spark: SparkSession, path: str, appended: DataFrame, keys: list[str]) -> int:
    """Delete the files of the table that hold rows of ``appended``, whose keys no earlier row had; returns how many."""
    target = spark.read.parquet(path).select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.col("_metadata.file_path").alias("__file"))
    mine = appended.select(*[F.col(f"`{k}`").alias(f"__m{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i in range(len(keys)):
        same = same & F.col(f"__k{i}").eqNullSafe(F.col(f"__m{i}"))
    files = [r[0] for r in target.join(mine, same, "left_semi").select("__file").distinct().collect()]  # files of one append
    for f in files:
        delete_path(spark, f)
    return len(files)


def resilient_load(df: DataFrame, path: str, keys: list[str], dead: str, breaker: CircuitBreaker | None = None, tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> int:
    """A staged load with retries behind a breaker; a batch that cannot be loaded goes to the dead-letter folder with the error, and the error is raised."""
    call = (breaker or CircuitBreaker()).call
    try:
        return with_retry(lambda: call(lambda: staged_load(df, path, keys)), tries, sleep=sleep)
    except Exception as e:
        letter = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("message"), F.lit(f"{type(e).__name__}: {str(e)[:500]}").alias("error"), F.current_timestamp().alias("failed_at"))
        letter.write.mode("append").parquet(dead)
        raise


def direct_write(df: DataFrame, path: str, required: list[str] = ()) -> tuple[int, int]:
    """Append rows as they are, without staging, after a check of required fields; returns (written, refused)."""
    from millrace.sources.readers import required_errors

    checked = df.withColumn("__errors", required_errors(df, list(required)))
    good = checked.where(F.size("__errors") == 0).drop("__errors")
    n, every = good.count(), df.count()
    if n:
        good.write.mode("append").parquet(path)
    return n, every - n


def write_bronze(df: DataFrame, path: str, source: str, offset: int = 0, required: list[str] = (), tries: int = 3, at=None, sleep: Callable[[float], None] = time.sleep) -> dict[str, int]:
    """The whole bronze write: check required fields, add lineage, leave out rows the table has, write with retries, verify the count.

    Returns ``read, refused, repeated, written``. A write whose count is wrong is undone and raised.
    """
    from millrace.plans.pipeline import bronze_fresh
    from millrace.sources.readers import required_errors

    spark = df.sparkSession
    checked = df.withColumn("__errors", required_errors(df, list(required)))
    good = checked.where(F.size("__errors") == 0).drop("__errors")
    read, sound = df.count(), good.count()
    target = read_target(spark, path)
    fresh = bronze_fresh(good, source, offset, at, target)
    n = with_retry(lambda: staged_load(fresh, path, ["_dedup_key"]), tries, sleep=sleep)
    return {"read": read, "refused": read - sound, "repeated": sound - n, "written": n}


def table_engine(columns: list[str], dedup: str = "_dedup_key", version: str = "_cleaned_at") -> dict[str, object]:
    """How a table keeps its rows: replaced by key where it has the dedup column (latest ``version`` wins), else appended; its sort order and monthly partition."""
    has = set(columns)
    times = [c for c in ("_extracted_at", "_cleaned_at", "_quarantined_at") if c in has]
    if dedup in has:
        return {"mode": "replace", "keys": [dedup], "version": version if version in has else (times or [None])[0], "partition": times[0] if times else None}
    return {"mode": "append", "keys": [], "version": None, "partition": times[0] if times else None}


def quarantine_rows(df: DataFrame, reason, errors, source, batch, at=None) -> DataFrame:
    """Rows put aside: ids, reason, errors and the original as JSON, nulls included."""
    original = F.to_json(F.struct(*[c for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select(F.sha2(F.concat_ws("\u0001", batch, original), 256).alias("_quarantine_id"), batch.alias("_batch_id"), source.alias("_source_id"), (at if at is not None else F.current_timestamp()).alias("_quarantined_at"), reason.alias("_quarantine_reason"), errors.alias("_validation_errors"), original.alias("_original_row"), F.lit(False).alias("_reprocessed"))


def quarantine_page(table: DataFrame, source: str | None = None, reason: str | None = None, reprocessed: bool | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of quarantined rows, latest first."""
    out = table
    for name, v in (("_source_id", source), ("_quarantine_reason", reason), ("_reprocessed", reprocessed)):
        if v is not None:
            out = out.where(F.col(name) == v)
    return out.orderBy(F.desc_nulls_last("_quarantined_at"), F.asc_nulls_last("_quarantine_id")).offset(offset).limit(limit)


def mark_reprocessed(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The table with the rows of ``ids(_quarantine_id)`` marked."""
    hit = ids.select("_quarantine_id").distinct().withColumn("__hit", F.lit(True))
    return table.join(hit, "_quarantine_id", "left").withColumn("_reprocessed", F.coalesce("__hit", F.col("_reprocessed"))).drop("__hit")


def purge(table: DataFrame, time_col: str, days: int, now=None) -> DataFrame:
    """Rows not older than ``days``; null times stay."""
    limit = (now if now is not None else F.current_timestamp()) - F.make_dt_interval(F.lit(days))
    return table.where(F.col(time_col).isNull() | (F.col(time_col) >= limit))


def copy_table(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def metadata_event(df: DataFrame, kind: str, **fields) -> DataFrame:
    """One event per row: ``kind, at, details`` (JSON of the given columns and values)."""
    if kind not in ("connection", "schema", "extraction", "cleaning", "loading"):
        raise ValueError(f"unknown event {kind!r}")
    return df.select(F.lit(kind).alias("kind"), F.current_timestamp().alias("at"), F.to_json(F.struct(*[(v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in fields.items()])).alias("details"))
