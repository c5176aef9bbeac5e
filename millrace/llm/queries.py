"""Queries over texts."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, neardup, packing, spam
from millrace.session import delete_path, scratch_path, shared_dir, spread, table

CAPACITY = 2048


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """All batches as the first run of an index."""
    docs = spread(table(spark, d, "documents").select("doc_id", "batch_no", "_row_id", "text"))
    return neardup.HistoryIndex(spark, scratch_path(spark, "history")).load(docs, table(spark, d, "deduplication_log"), 0)


#: Indexes of this process by application and folder, of all batches but the last.
_KEPT: dict[tuple[str, str], tuple[neardup.HistoryIndex, int]] = {}


def p2_last_batch(spark: SparkSession, d: str) -> DataFrame:
    """The last batch against the index of everything before it, which is made once and kept for later calls."""
    docs, log = table(spark, d, "documents").select("doc_id", "batch_no", "_row_id", "text"), table(spark, d, "deduplication_log")
    at = (spark.sparkContext.applicationId, d)
    if at not in _KEPT:
        last = docs.agg(F.max("batch_no")).first()[0] or 0
        path = f"{shared_dir(spark)}/millrace/kept-{uuid.uuid4().hex}"
        atexit.register(delete_path, spark, path)
        index = neardup.HistoryIndex(spark, path)
        index.load(spread(docs.where(F.col("batch_no") < last)), log, 0)
        _KEPT[at] = index, last
    index, last = _KEPT[at]
    return index.load(docs.where(F.col("batch_no") == last), log, 1, docs)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(spread(table(spark, d, "documents").select("doc_id", "text")))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(spread(table(spark, d, "documents").select("doc_id", "text")), CAPACITY)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.find_spam(spread(table(spark, d, "documents").select("doc_id", "text"))).distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_last_batch, p8_ids, p9_containers, p10_found)}
ORACLES: dict[str, str] = {}
