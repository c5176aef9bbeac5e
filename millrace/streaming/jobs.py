"""The pipeline as stream: messages in, silver and quarantine out, each micro-batch written so that a retry replaces it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.contracts import Contract
from millrace.operators.exactly_once import QuotientStore
from millrace.operators.rules import Rule
from millrace.plans.pipeline import bronze, transform


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder as stream, a bounded number per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process all that is there in micro-batches, then stop."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def medallion(out: str, source: str, contract: Contract | None, rules: list[Rule] = (), missing: str = "warn") -> Callable[[DataFrame, int], None]:
    """A micro-batch function: bronze, silver and quarantine under ``out``, each in a folder of the micro-batch.

    First writer wins over all micro-batches by content key, known from a store of identifiers, so earlier rows are not
    read again; folders of the same micro-batch are replaced on a retry.
    """

    def each(batch: DataFrame, batch_no: int) -> None:
        spark = batch.sparkSession
        raw = bronze(batch, source, batch_no)
        store = QuotientStore(spark, f"{out}/keys")
        new = store.insert(raw.select("_dedup_key", F.lit("bronze").alias("_stage"), F.col("_extracted_at").alias("_processed_at"), "_row_id"), batch_no)
        fresh = raw.dropDuplicates(["_dedup_key"]).join(new.select("_dedup_key"), "_dedup_key", "left_semi").select(*raw.columns)
        fresh.write.mode("overwrite").parquet(f"{out}/bronze/micro_batch={batch_no}")
        written = spark.read.schema(raw.schema).parquet(f"{out}/bronze/micro_batch={batch_no}")
        result = transform(written, contract, rules, missing)
        result.silver.write.mode("overwrite").parquet(f"{out}/silver/micro_batch={batch_no}")
        result.quarantine.write.mode("overwrite").parquet(f"{out}/quarantine/micro_batch={batch_no}")
        if result.metrics is not None:
            result.metrics.write.mode("overwrite").parquet(f"{out}/metrics/micro_batch={batch_no}")

    return each


def once_only(store: QuotientStore, out: str) -> Callable[[DataFrame, int], None]:
    """A micro-batch function that keeps each message once, by exact quotient tables, across all micro-batches."""

    def each(batch: DataFrame, batch_no: int) -> None:
        store.insert(batch, batch_no).write.mode("overwrite").parquet(f"{out}/micro_batch={batch_no}")

    return each


def dedup_stream(stream: DataFrame, keys: list[str], time: str | None = None, late: str | None = None) -> DataFrame:
    """A stream without repeated keys: for ever, or within the lateness of a watermark where one is given."""
    if time and late:
        return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def progress(query: StreamingQuery) -> dict:
    """Rows, rows a second and the last micro-batch of a query."""
    last = query.lastProgress
    return {"batch": last["batchId"], "rows": last["numInputRows"], "rows_per_second": last["processedRowsPerSecond"]} if last else {"batch": None, "rows": 0, "rows_per_second": 0.0}


def progress_figures(done: int, total: int | None, seconds: float) -> dict:
    """Share done (percent, null where the total is not known), rows a second, and seconds left at that rate."""
    rate = done / seconds if seconds > 0 else 0.0
    share = None if not total else min(100.0, 100.0 * done / total)
    left = None if not total or not rate else max(0.0, (total - done) / rate)
    return {"rows": done, "percent": share, "rows_per_second": rate, "seconds_left": left}


def resumable(checkpoints: DataFrame) -> DataFrame:
    """Extractions to go on with: latest row per extraction, active or failed, with an offset beyond 0."""
    from millrace.operators.dedup import latest_per_key

    last = latest_per_key(checkpoints, ["extraction_id"], "updated_at")
    return last.where(F.upper(F.trim("status")).isin("ACTIVE", "FAILED") & (F.col("last_offset") > 0))
