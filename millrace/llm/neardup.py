"""New batches against all accepted history: minwise band keys with signatures, bucket probes, verification.

Words (letter case, spacing and punctuation aside) give a class per distinct text. Band keys are minwise keys of the bag
of words (a word's second occurrence is another element); each key row carries a signature of the text's three-word
shingles. :class:`HistoryIndex` keeps the rows in files bucketed by the hash of the key and sorted by key. A load writes
the new batches' keys as a run of its own, then merges the buckets: a record meets only accepted records of earlier
batches that hold the same key, and the pair goes on if its signatures agree enough. Pairs are then verified on the words: the
longest common subsequence must cover at least ``MIN_SHARED`` of the longer text. Copies are expanded from classes only at the end.

Why bags of words and a subsequence instead of five-word shingles and 0.8: here texts count as nearly the same with up
to an eighth of their words changed, which scattered changes turn into a five-word similarity far below 0.8, while the
bags still agree in 0.74 to 0.8 and those of other texts hardly in over 0.35. 32 bands of 8 rows meet with probability
0.95 to 0.997 there. The similarity of three-word shingles is 0.42 at least then (24 words, every eighth changed; 0.5
where changes fall at random), and the cut on the signatures lies three and a half standard deviations below the least.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import delete_path, materialise

ROWS, BANDS, SHINGLE = 8, 32, 3
MIN_WORDS, MIN_SHARED = 20, 0.8
#: Least similarity of the three-word shingles of two texts with an eighth of their words changed, and how many
#: standard deviations below it the cut lies.
LEAST, MARGIN = 0.42, 3.5
#: Two-bit minwise values that travel with every key, 32 to a number.
SKETCH = 192
#: Rows of a bucket, about; rows of one key beyond which its group is split; keys and ids named in a filter at most.
BUCKET_KEYS, HOT_KEY, NAMED = 100_000, 20_000, 10_000
_SIGNS = tuple(f"s{k}" for k in range(SKETCH // 32))
_AGREE = LEAST + (1 - LEAST) / 4
_NEED = int(SKETCH * (_AGREE - MARGIN * (_AGREE * (1 - _AGREE) / SKETCH) ** 0.5))

_WORD = re.compile(r"\w+")
#: Characters that are not shown: zero-width ones, the soft hyphen, direction marks.
_HIDDEN = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_RNG = np.random.default_rng(20250301)
_A = (_RNG.integers(0, 2**32, ROWS * BANDS + SKETCH, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 2**32, ROWS * BANDS + SKETCH, dtype=np.uint64).astype(np.uint32)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words(text: str | None) -> list[str]:
    """Words of a text without letter case, spacing, punctuation and hidden characters."""
    if not text:
        return []
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _K2
    return x ^ (x >> np.uint64(32))


class _WordHash(dict):
    def __missing__(self, w: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_HASHES = _WordHash()


def _least(x: np.ndarray, at: slice) -> np.ndarray:
    """Smallest value of each of the permutations ``at`` over the elements, in pieces that stay in the cache."""
    a, b = _A[at], _B[at]
    low = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    if len(x) < 512:
        v = np.empty((128, len(a)), np.uint32)
        for lo in range(0, len(x), 128):
            part = x[lo : lo + 128]
            w = v[: len(part)]
            np.multiply(part[:, None], a, out=w)
            np.add(w, b, out=w)
            np.minimum(low, w.min(axis=0), out=low)
        return low
    v = np.empty((16, min(len(x), 8192)), np.uint32)
    for lo in range(0, len(x), 8192):
        part = x[lo : lo + 8192]
        for k in range(0, len(a), 16):
            w = v[: len(a[k : k + 16]), : len(part)]
            np.multiply(part, a[k : k + 16, None], out=w)
            np.add(w, b[k : k + 16, None], out=w)
            np.minimum(low[k : k + 16], w.min(axis=1), out=low[k : k + 16])
    return low


def minima(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Minwise values of the bag of words and of the three-word shingles."""
    h = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))
    bag = np.sort(h)
    first = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]])
    nth = np.arange(len(bag)) - np.repeat(first, np.diff(np.r_[first, len(bag)]))
    elements = (_mix(bag * _K1 + nth.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    s = h[: len(h) - SHINGLE + 1]
    for k in range(1, SHINGLE):
        s = _mix(s * _K1 + h[k : len(h) - SHINGLE + 1 + k])
    return _least(elements, slice(0, ROWS * BANDS)), _least((s >> np.uint64(32)).astype(np.uint32), slice(ROWS * BANDS, None))


def signatures(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts, bands) and the signatures that travel with them (texts, numbers), both int64."""
    both = [minima(t) for t in texts]
    rows = np.array([m[0] for m in both], np.uint64).reshape(len(texts), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * _K1 + np.zeros((len(texts), 1), np.uint64)
    for r in range(ROWS):
        key = _mix(key * _K1 + rows[:, :, r])
    two = (np.array([m[1] for m in both], np.uint64) & np.uint64(3)).reshape(len(texts), -1, 32)
    sign = np.bitwise_or.reduce(two << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=2)
    return key.view(np.int64), sign.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, batch_no, row_id`` -> adds ``cls_a, cls_b`` (128 bits of the words), ``n_words, bands`` and the signature ``s0`` to ``s5``.

    Texts of fewer than ``MIN_WORDS`` words, null and empty ones are not compared and have no row.
    """
    names = ["doc_id", "batch_no", "row_id", "cls_a", "cls_b", "n_words", "bands", *_SIGNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keep, cls, sizes, kept_words = [], [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                w = words(text)
                if len(w) >= MIN_WORDS:
                    keep.append(i)
                    cls.append(xxhash.xxh3_128_digest(" ".join(w)))
                    sizes.append(len(w))
                    kept_words.append(w)
            if not keep:
                continue
            kept = batch.take(pa.array(keep))
            c = np.frombuffer(b"".join(cls), np.int64).reshape(-1, 2)
            keys, signs = signatures(kept_words)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(keep) + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
            arrays = [kept.column(0), kept.column(1), kept.column(2), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy()), pa.array(sizes, pa.int32()), lists, *[pa.array(signs[:, k].copy()) for k in range(len(_SIGNS))]]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("batch_no").cast("bigint"), F.lower(F.trim("_row_id")).alias("row_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, batch_no bigint, row_id string, cls_a bigint, cls_b bigint, n_words int, bands array<bigint>, " + ", ".join(f"{x} bigint" for x in _SIGNS))


def shared_words(a: list[str], b: list[str]) -> float:
    """Longest common subsequence over the longer length, by bit-parallel rows after common ends are cut."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if (lo + hi + min(len(x), len(y))) < MIN_SHARED * longer:
        return (lo + hi + min(len(x), len(y))) / longer
    at: dict[str, int] = {}
    for i, w in enumerate(x):
        at[w] = at.get(w, 0) | 1 << i
    full = v = (1 << len(x)) - 1
    for w in y:
        m = v & at.get(w, 0)
        if m:
            v = ((v + m) | (v - m)) & full
    return (lo + hi + len(x) - v.bit_count()) / longer


def verify(pairs: DataFrame) -> DataFrame:
    """Keep the pairs ``a, b, text_a, text_b`` whose texts share enough words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [shared_words(words(x), words(y)) >= MIN_SHARED for x, y in zip(batch["text_a"].to_pylist(), batch["text_b"].to_pylist())]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], ["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _plausible() -> Column:
    """Lengths allow enough common words, and the two-bit signatures agree in as many places as similar texts do."""
    n, m = F.col("o.n_words"), F.col("n.n_words")

    def differ(x: str) -> Column:
        d = F.col(f"o.{x}").bitwiseXOR(F.col(f"n.{x}"))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    return (F.least(n, m) >= MIN_SHARED * F.greatest(n, m) - 1e-6) & (SKETCH - sum(map(differ, _SIGNS[1:]), differ(_SIGNS[0])) >= _NEED)


def loaded_rows(log: DataFrame) -> DataFrame:
    """``row_id`` of the records that the log shows as loaded."""
    return log.where(F.lower(F.trim("_stage")) == "load").select(F.lower(F.trim("_row_id")).alias("row_id")).where("row_id is not null").distinct()


class HistoryIndex:
    """Persisted band keys with signatures in buckets of the key's hash, and the classes and members of each run.

    ``load`` takes one or many new batches at once. Their keys are written as a run, bucketed and sorted like the runs
    before, so the buckets of both merge without a shuffle. A run of few keys names them in the scan, which then opens
    only the buckets that hold one; work per batch is bounded by its keys times the size of a bucket. A run that is
    loaded again after a failure replaces its own files. Texts are not copied: those of the candidates alone are read
    from the documents. The index lives under ``path``; another session opens it with the same path.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_keys: int = BUCKET_KEYS):
        self.spark, self.path, self.bucket_keys = spark, path.rstrip("/"), bucket_keys
        self.name = f"millrace_keys_{uuid.uuid4().hex}"

    def _stored(self, part: str) -> DataFrame | None:
        try:
            return self.spark.read.option("basePath", f"{self.path}/{part}").parquet(f"{self.path}/{part}")
        except Exception as e:  # noqa: BLE001 - an empty index has no files
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def _buckets(self, n_keys: int) -> int:
        """Number of buckets, fixed by the first run."""
        known = self._stored("layout")
        if known is not None:
            return known.first()[0]
        n = min(100_000, max(1, -(-n_keys // self.bucket_keys)))
        self.spark.createDataFrame([(n,)], "buckets int").coalesce(1).write.parquet(f"{self.path}/layout")
        return n

    def _keys(self, buckets: int) -> None:
        if not self.spark.catalog.tableExists(self.name):
            columns = "key bigint, rep bigint, first_in bigint, last_in bigint, n_words int, " + ", ".join(f"{x} bigint" for x in _SIGNS) + ", run bigint"
            self.spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet PARTITIONED BY (run) CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{self.path}/keys'")
        if self._stored("keys") is not None:
            self.spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def load(self, docs: DataFrame, log: DataFrame, run: int, texts: DataFrame | None = None) -> DataFrame:
        """``doc_id_a, doc_id_b``: near-duplicates among ``docs`` (batches newer than those of all runs before) and between them and accepted records of earlier batches; then the index holds ``docs`` too.

        ``texts`` are the documents of all runs (``docs`` where it is the first).
        """
        sketched = materialise(sketches(docs), "sketches")
        narrow = sketched.select("doc_id", "batch_no", "row_id", "cls_a", "cls_b", "n_words")
        of = narrow.join(loaded_rows(log).withColumn("accepted", F.lit(True)), "row_id", "left").select("doc_id", "batch_no", "cls_a", "cls_b", F.coalesce("accepted", F.lit(False)).alias("accepted"))
        classes = of.groupBy("cls_a", "cls_b").agg(F.min("doc_id").alias("rep"), F.min(F.when(F.col("accepted"), F.col("batch_no"))).alias("first_in"), F.max("batch_no").alias("last_in"), F.count("*").alias("n"))
        for part in ("keys", "classes", "members"):
            delete_path(self.spark, f"{self.path}/{part}/run={run}")
        classes.write.parquet(f"{self.path}/classes/run={run}")
        mine = self.spark.read.schema(classes.schema).parquet(f"{self.path}/classes/run={run}")
        of.join(mine.select("cls_a", "cls_b", "rep"), ["cls_a", "cls_b"]).select("doc_id", "batch_no", "accepted", "rep").write.parquet(f"{self.path}/members/run={run}")
        buckets = self._buckets(mine.count() * BANDS)
        keys = sketched.join(mine, ["cls_a", "cls_b"]).where("doc_id = rep").select(F.explode("bands").alias("key"), "rep", "first_in", "last_in", "n_words", *_SIGNS)
        self._keys(buckets)
        keys.repartition(buckets, "key").withColumn("run", F.lit(run).cast("bigint")).write.mode("append").partitionBy("run").bucketBy(buckets, "key").sortBy("key").format("parquet").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)
        pairs = materialise(self._candidates(run), "pairs")
        return self._expand(self._verified(pairs, docs if texts is None else texts), run)

    def _candidates(self, run: int) -> DataFrame:
        """Pairs of classes ``a, b`` (representatives) that share a key and agree in the signatures that travel with it."""
        table = self.spark.table(self.name)
        new = table.where(F.col("run") == run)
        older = F.coalesce(F.col("o.first_in") < F.col("n.last_in"), F.lit(False))
        within = (F.col("o.rep") < F.col("n.rep")) & (older | F.coalesce(F.col("n.first_in") < F.col("o.last_in"), F.lit(False)))
        out = self._meet(new, new, within)
        old = table.where(F.col("run") != run)
        if not old.isEmpty():
            named = [r[0] for r in new.select("key").distinct().limit(NAMED + 1).collect()]
            if len(named) <= NAMED:  # the scan then opens only the buckets of these keys; more keys lie in all buckets
                old = old.where(F.col("key").isin(named))
            out = out.unionByName(self._meet(old, new, older))
        return out.distinct()

    def _meet(self, old: DataFrame, new: DataFrame, wanted: Column) -> DataFrame:
        """Merge of both sides' buckets. Keys that very many classes hold are split: one side in salts, the other to each."""
        hot = new.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_KEY).select("key", F.ceil(F.col("n") / HOT_KEY).cast("int").alias("salts"))
        pick = F.col("o.rep").alias("a"), F.col("n.rep").alias("b")
        same = F.col("o.key") == F.col("n.key")
        if hot.isEmpty():
            return old.alias("o").join(new.alias("n"), same & wanted & _plausible()).select(*pick)
        hot = materialise(hot, "hot")
        rest = old.join(hot, "key", "left_anti").alias("o").join(new.join(hot, "key", "left_anti").alias("n"), same & wanted & _plausible()).select(*pick)
        salted = new.join(hot, "key").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")))
        each = old.join(hot, "key").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts").cast("bigint") - 1)))
        return rest.unionByName(each.alias("o").join(salted.alias("n"), same & (F.col("o.salt") == F.col("n.salt")) & wanted & _plausible()).select(*pick))

    def _verified(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        named = [r[0] for r in wanted.limit(NAMED + 1).collect()]
        texts = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        texts = texts.where(F.col("doc_id").isin(named)) if len(named) <= NAMED else texts.join(wanted, "doc_id", "left_semi")
        texts = materialise(texts, "texts")
        return materialise(verify(pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")), "linked")

    def _expand(self, linked: DataFrame, run: int) -> DataFrame:
        """Pairs of documents from linked classes and from classes of several copies."""
        same = self._stored("classes").where((F.col("run") == run) & (F.col("n") > 1)).select(F.col("rep").alias("a"), F.col("rep").alias("b"))
        both = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(same)
        members = self._stored("members")
        old = members.where("accepted").select(F.col("doc_id").alias("old"), F.col("batch_no").alias("old_batch"), F.col("rep").alias("a"))
        new = members.where(F.col("run") == run).select(F.col("doc_id").alias("new"), F.col("batch_no").alias("new_batch"), F.col("rep").alias("b"))
        found = both.join(old, "a").join(new, "b").where("old_batch < new_batch and old <> new")
        return found.select(F.least("old", "new").alias("doc_id_a"), F.greatest("old", "new").alias("doc_id_b")).distinct()
