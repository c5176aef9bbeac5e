"""Exactly-once delivery by exact quotient hash tables.

A fixed-width identifier (256 bits) is permuted by an invertible mixing of its words. The top bits of the
permuted identifier (the quotient) name the shard and the home slot, all other bits (the remainder) are stored
in full, so a look-up can never return a false match, and the identifier can be restored from its place.

Each map task first fills its own table (a map-side combine: a digest that holds a third of all rows leaves a
task as one row per flush), then rows are shuffled and sorted by shard, and each shard inserts every identifier once. A
table is handed on at the end of the shard in which it reached ``FLUSH_ENTRIES``, so a task holds about as many entries
however many its partition has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import materialise

#: log2 of the number of shards an identifier space is cut into; shuffle partitions hold whole shards.
SHARD_BITS = 20
#: Entries after which a task hands its table on and begins a new one (on the reduce side at the end of a shard).
FLUSH_ENTRIES = 250_000
_LAST = np.iinfo(np.int64).max
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def permute(words: np.ndarray) -> np.ndarray:
    """Invertible mixing of n identifiers of four 64-bit words: each step xors a word with a hash of others."""
    out = words.copy()
    out[:, 0] ^= _mix(out[:, 1] ^ _mix(out[:, 2] ^ _mix(out[:, 3])))
    out[:, 3] ^= _mix(out[:, 0])
    return out


def unpermute(words: np.ndarray) -> np.ndarray:
    """The inverse of :func:`permute`."""
    out = words.copy()
    out[:, 3] ^= _mix(out[:, 0])
    out[:, 0] ^= _mix(out[:, 1] ^ _mix(out[:, 2] ^ _mix(out[:, 3])))
    return out


class QuotientTable:
    """Open-addressed table: slot = quotient + displacement, content = complete remainder.

    ``skip_bits`` top bits of word 0 are the shard and equal for all entries of a shard's table (0 where the
    table holds all shards).
    """

    def __init__(self, bits: int = 12, skip_bits: int = 0):
        self.skip, self.used = np.uint64(skip_bits), 0
        self._alloc(bits)

    def _alloc(self, bits: int) -> None:
        size = 1 << bits
        self.bits, self.mask = bits, np.int64(size - 1)
        self.rem = np.zeros((size, 4), np.uint64)
        self.disp = np.full(size, -1, np.int32)
        self.n = np.zeros(size, np.int64)
        self.ts = np.full(size, _LAST, np.int64)
        self.row = np.full(size, None, object)

    def _split(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shifted = ids[:, 0] << self.skip
        quotient = (shifted >> np.uint64(64 - self.bits)).astype(np.int64)
        remainder = ids.copy()
        remainder[:, 0] = shifted << np.uint64(self.bits)
        return quotient, remainder

    def ids(self, slots: np.ndarray, shard: np.ndarray | int = 0) -> np.ndarray:
        """Restore the permuted identifiers from place, displacement and remainder."""
        out = self.rem[slots].copy()
        quotient = ((slots - self.disp[slots]) & self.mask).astype(np.uint64)
        word = (out[:, 0] >> np.uint64(self.bits)) | (quotient << np.uint64(64 - self.bits))
        top = np.uint64(0) if not self.skip else np.uint64(shard) << (np.uint64(64) - self.skip)
        out[:, 0] = (word >> self.skip) | top
        return out

    def filled(self) -> np.ndarray:
        return np.flatnonzero(self.disp >= 0)

    def _grow(self, extra: int) -> None:
        bits = self.bits
        while self.used + extra > 0.6 * (1 << bits):
            bits += 1
        if bits == self.bits:
            return
        slots = self.filled()
        ids, n, ts, row = self.ids(slots), self.n[slots], self.ts[slots], self.row[slots]
        self.used = 0
        self._alloc(bits)
        at = self._place(ids)
        self.n[at], self.ts[at], self.row[at] = n, ts, row

    def _place(self, ids: np.ndarray) -> np.ndarray:
        quotient, remainder = self._split(ids)
        out = np.empty(len(ids), np.int64)
        claim = np.empty(1 << self.bits, np.int64) if len(ids) else None
        pending, k = np.arange(len(ids)), 0
        while len(pending):
            slot = (quotient[pending] + k) & self.mask
            free = np.flatnonzero(self.disp[slot] < 0)
            if len(free):
                claim[slot[free]] = free
                won = free[claim[slot[free]] == free]
                self.rem[slot[won]] = remainder[pending[won]]
                self.disp[slot[won]] = k
                self.used += len(won)
            same = (self.disp[slot] == k) & (self.rem[slot] == remainder[pending]).all(axis=1)
            out[pending[same]] = slot[same]
            pending, k = pending[~same], k + 1
        return out

    def insert(self, ids: np.ndarray, n: np.ndarray, ts: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Insert deliveries: add up ``n`` and keep the row of the smallest (ts, row); nulls last."""
        self._grow(len(ids))
        slot = self._place(ids)
        np.add.at(self.n, slot, n)
        order = np.lexsort((ts, slot))
        s, t = slot[order], ts[order]
        head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
        best_row = row[order[head]]
        length = np.diff(np.r_[head, len(s)])
        tied = (length > 1) & (t[np.minimum(head + 1, len(s) - 1)] == t[head]) if len(s) else head
        for g in np.flatnonzero(tied):
            for j in range(head[g] + 1, head[g] + length[g]):
                if t[j] != t[head[g]]:
                    break
                if _before(row[order[j]], best_row[g]):
                    best_row[g] = row[order[j]]
        at, best_ts = s[head], t[head]
        fresh = (self.n[at] == np.add.reduceat(n[order], head)) if len(head) else np.empty(0, bool)
        better = fresh | (best_ts < self.ts[at])
        for g in np.flatnonzero(~better & (best_ts == self.ts[at])):
            better[g] = _before(best_row[g], self.row[at[g]])
        self.ts[at[better]], self.row[at[better]] = best_ts[better], best_row[better]
        return slot


def _before(a: str | None, b: str | None) -> bool:
    return a is not None and (b is None or a < b)


def _words(keys: pa.Array) -> np.ndarray:
    """The four words of each 32-byte identifier, straight from the buffers."""
    offsets = np.frombuffer(keys.buffers()[1], np.int32, len(keys) + 1, keys.offset * 4) if len(keys) else np.zeros(1, np.int32)
    raw = keys.buffers()[2]
    return np.frombuffer(raw, ">u8", len(keys) * 4, int(offsets[0])).astype(np.uint64).reshape(-1, 4) if len(keys) else np.empty((0, 4), np.uint64)


def _binary(words: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(words.astype(">u8"))
    offsets = np.arange(0, 32 * len(words) + 1, 32, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


_STATE = "shard int, id binary, stage string, n bigint, ts bigint, row_id string"
_NAMES = ["shard", "id", "stage", "n", "ts", "row_id"]


def _flush(tables: dict, restore: bool) -> Iterator[pa.RecordBatch]:
    for (shard, stage), t in tables.items():
        slots = t.filled()
        for lo in range(0, len(slots), 50_000):
            part = slots[lo : lo + 50_000]
            ids = t.ids(part, shard or 0)
            ids = ids[:, ::-1] if restore else ids
            shards = (ids[:, 0] >> np.uint64(64 - SHARD_BITS)).astype(np.int32)
            ts = pa.array(t.ts[part], pa.int64(), mask=t.ts[part] == _LAST)
            yield pa.RecordBatch.from_arrays([pa.array(shards), _binary(unpermute(ids) if restore else ids), pa.array([stage] * len(part), pa.string()), pa.array(t.n[part]), ts, pa.array(t.row[part], pa.string())], _NAMES)


def _columns(batch: pa.RecordBatch):
    ts = batch["ts"].cast(pa.int64())
    ts = ts.fill_null(_LAST).to_numpy(zero_copy_only=False)
    stage = batch["stage"].dictionary_encode()
    codes = stage.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    names = {-1: None} | dict(enumerate(stage.dictionary.to_pylist()))
    row = np.array(batch["row_id"].to_pylist(), dtype=object)
    return _words(batch["id"]), batch["n"].to_numpy(), ts, row, codes, names


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: permute, fill one table per stage, hand on when it is large."""
    tables: dict = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        words, n, ts, row, codes, names = _columns(batch)
        ids = permute(words)
        for c in np.unique(codes):
            at = codes == c
            tables.setdefault((None, names[c]), QuotientTable()).insert(ids[at], n[at], ts[at], row[at])
        if sum(t.used for t in tables.values()) > FLUSH_ENTRIES:
            yield from _flush(tables, False)
            tables = {}
    yield from _flush(tables, False)


def _insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: rows come sorted by shard; one table per stage covers the shards of a stretch.

    Its home slots come from the last word: the first one names the shard, so in their order it would fill one end.
    """
    tables: dict = {}
    last = -1
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, n, ts, row, codes, names = _columns(batch)
        shard = batch["shard"].to_numpy()
        change = np.flatnonzero(shard != shard[0])  # a batch is small: its first change of shard is near enough
        cuts = [0, *change[:1].tolist(), len(shard)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if shard[lo] != last and sum(t.used for t in tables.values()) >= FLUSH_ENTRIES:
                yield from _flush(tables, True)
                tables = {}
            part = slice(lo, hi)
            for c in np.unique(codes[part]):
                at = np.flatnonzero(codes[part] == c) + lo
                tables.setdefault((None, names[c]), QuotientTable()).insert(ids[at, ::-1], n[at], ts[at], row[at])
            last = shard[hi - 1]
    yield from _flush(tables, True)


def digest(key: Column) -> Column:
    """A SHA-256 digest as 64 lower-case hex digits however it is written; null for null, blank and other values."""
    bare = F.regexp_replace(F.lower(key), r"^\s*(?:sha-?256\s*[:=]\s*|0x)?|[\s-]+", "")
    return F.when(bare.rlike(r"\A[0-9a-f]{64}\z"), bare)


def messages(log: DataFrame, key: str = "_dedup_key", stage: str = "_stage", time: str = "_processed_at", row: str = "_row_id") -> DataFrame:
    """One row per message (digest, stage): ``_dedup_key, _stage, n_deliveries, _processed_at, _row_id``.

    ``n_deliveries`` counts all rows of the log, identical ones too. ``_row_id`` is that of the earliest time
    (null last), then the smallest. Null, blank and malformed keys are no messages; a null stage is a stage of
    its own; extra columns are not read; an empty log gives no rows.
    """
    rows = log.select(
        F.unhex(digest(F.col(key))).alias("id"), F.col(stage).cast("string").alias("stage"), F.lit(1).cast("bigint").alias("n"), F.unix_micros(F.col(time).cast("timestamp")).alias("ts"), F.col(row).cast("string").alias("row_id")
    ).where("id is not null")
    combined = rows.mapInArrow(_combine, _STATE)
    return combined.repartition("shard").sortWithinPartitions("shard").mapInArrow(_insert, _STATE).select(
        F.lower(F.hex("id")).alias("_dedup_key"), F.col("stage").alias("_stage"), F.col("n").alias("n_deliveries"), F.timestamp_micros("ts").alias("_processed_at"), F.col("row_id").alias("_row_id")
    )


def repeated(log: DataFrame, **names: str) -> DataFrame:
    """Messages with more than one row in the log: ``_dedup_key, _stage, _row_id`` (the row that is kept)."""
    return messages(log, **names).where("n_deliveries > 1").select("_dedup_key", "_stage", "_row_id")


#: Quotient and remainder of stored identifiers: the quotient's top bits name the folder.
_STORED = "part int, quotient bigint, remainder binary, _dedup_key string, _stage string, _processed_at timestamp, _row_id string"
PART_BITS = 8


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotient (64 permuted bits) and remainder (the other 192) of each message's identifier."""
    for b in batches:
        ids = permute(_words(b["id"]))
        rest = np.ascontiguousarray(ids[:, 1:].astype(">u8"))
        offsets = np.arange(0, 24 * len(ids) + 1, 24, dtype=np.int32)
        remainder = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(rest)])
        part = pa.array((ids[:, 0] >> np.uint64(64 - PART_BITS)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([part, pa.array(ids[:, 0].copy().view(np.int64)), remainder, *(b[c] for c in ("_dedup_key", "_stage", "_processed_at", "_row_id"))], ["part", "quotient", "remainder", "_dedup_key", "_stage", "_processed_at", "_row_id"])


class QuotientStore:
    """Persisted identifiers, parquet by the top bits of the quotient, for batches that arrive over time.

    ``insert`` returns the rows of a batch that are new (one per message) and appends quotient and complete remainder of
    their identifiers, sorted by quotient. It reads only the parts that the batch touches, and of these only identifiers:
    exact, no false match. A batch that is written again after a failure finds its own folder and replaces it, so a retry
    is not taken for a repetition. The rows to keep lie beside the identifiers, so a reader of history opens no text.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _history(self, batch_id: int) -> DataFrame | None:
        try:
            seen = self.spark.read.option("basePath", f"{self.path}/ids").parquet(f"{self.path}/ids")
        except Exception as e:  # noqa: BLE001 - an empty store has no schema
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        return seen.where(F.col("batch") != batch_id)

    def insert(self, batch: DataFrame, batch_id: int, key: str = "_dedup_key", stage: str = "_stage", time: str = "_processed_at", row: str = "_row_id") -> DataFrame:
        own = messages(batch, key, stage, time, row).select(F.unhex("_dedup_key").alias("id"), "_dedup_key", "_stage", "_processed_at", "_row_id").mapInArrow(_stored, _STORED)
        seen = self._history(batch_id)
        if seen is not None:
            own = materialise(own, "delivered")
            touched = [r[0] for r in own.select("part").distinct().collect()]  # at most 2 ** PART_BITS numbers
            old = seen.where(F.col("part").isin(touched)).select(F.col("part").alias("p"), F.col("quotient").alias("q"), F.col("remainder").alias("r"), F.col("_stage").alias("s"))
            own = own.join(old, (F.col("part") == F.col("p")) & (F.col("quotient") == F.col("q")) & (F.col("remainder") == F.col("r")) & F.col("_stage").eqNullSafe(F.col("s")), "left_anti")
        target = f"{self.path}/rows/batch={batch_id}"
        own.write.mode("overwrite").parquet(target)
        kept = self.spark.read.schema(_STORED).parquet(target)
        kept.select("part", "quotient", "remainder", "_stage").repartition("part").sortWithinPartitions("part", "quotient").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/ids/batch={batch_id}")
        return kept.select("_dedup_key", "_stage", "_processed_at", "_row_id")
